"""Results of text recognition: parsing and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv_words(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Words of recogniser output in tab-separated rows of twelve columns: keys, ``block, line, word_no, text, confidence, bbox``.

    Rows that are not words (confidence below 0, blank text, the head) are left out.
    """
    rows = pages.select(*keys, F.explode(F.split("tsv", r"\r?\n")).alias("row")).select(*keys, F.split("row", "\t").alias("c"))
    number = lambda i: F.get("c", F.lit(i)).try_cast("double")
    words = rows.where((F.size("c") == 12) & (number(10) >= 0) & (F.trim(F.get("c", F.lit(11))) != ""))
    box = F.array(number(6), number(7), number(6) + number(8), number(7) + number(9))
    return words.select(
        *keys, number(2).cast("int").alias("block"), number(4).cast("int").alias("line"), number(5).cast("int").alias("word_no"),
        F.get("c", F.lit(11)).alias("text"), (number(10) / 100).alias("confidence"), box.alias("bbox"),
    )


def greedy_decode(steps: Column, alphabet: list[str], blank: int = 0) -> Column:
    """Text of the best class of each step: repeats once, blanks dropped."""
    pairs = F.arrays_zip(steps.alias("now"), F.concat(F.array(F.lit(-1)), F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))).alias("before"))
    kept = F.filter(pairs, lambda p: (p["now"] != p["before"]) & (p["now"] != blank))
    letters = F.array(*map(F.lit, alphabet))
    return F.array_join(F.transform(kept, lambda p: F.element_at(letters, p["now"].cast("int") + 1)), "")


def needs_ocr(text: Column, image_share: Column, largest_share: Column, text_overlap: Column) -> Column:
    """'full', 'partial' or 'none' by the amount of text and the area of images of a page."""
    few = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 40
    return F.when(few & (image_share >= 0.5), "full").when((largest_share >= 0.15) & (text_overlap < 0.05), "partial").otherwise("none")
