"""Layout of pages from the boxes of their lines: sizes, heading and list levels, paragraphs, overlaps, words, tables over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

PAGE = ("entry_id", "page")
ORDER = ("line_no", "line_id")
#: Height of the bands in which lines are looked for that overlap.
BAND = 16.0
#: Signs below which a page is read by recognition.
FEW_SIGNS = 10


def sized(rows: DataFrame) -> DataFrame:
    """Lines with a box as ``x0, y0, x1, y1`` and their ``size``, its height; lines without a whole box are left out."""
    b = F.col("bbox")
    boxes = rows.where(b.isNotNull() & (F.size(b) == 4)).select("*", *[b[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return boxes.withColumn("size", F.round(F.col("y1") - F.col("y0"), 1))


def body_sizes(lines: DataFrame) -> DataFrame:
    """``entry_id, size``: the size in which most signs of a document are set, the smaller one of equals."""
    signs = lines.groupBy("entry_id", "size").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("signs"))
    return signs.groupBy("entry_id").agg(F.max(F.struct("signs", (-F.col("size")).alias("neg")))["neg"].alias("neg")).select("entry_id", (-F.col("neg")).alias("size"))


def heading_levels(lines: DataFrame, levels: int = 3) -> DataFrame:
    """``line_id, level``: lines larger than the body, the largest size of a document level 1, ``levels`` at most."""
    body = body_sizes(lines).withColumnRenamed("size", "body")
    larger = lines.join(body, "entry_id").where(F.col("size") > F.col("body"))
    # Few sizes a document: they are ranked, not the lines.
    ranks = larger.select("entry_id", "size").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("entry_id").orderBy(F.desc("size"))))
    return larger.join(ranks, ["entry_id", "size"]).select("line_id", F.least(F.col("rank"), F.lit(levels)).alias("level"))


def paragraph_numbers(lines: DataFrame, gap: float = 0.6) -> DataFrame:
    """``line_id, paragraph``: lines of a page counted into paragraphs.

    A new one begins after white space of more than ``gap`` line heights, where the size
    changes by more than a tenth, where the kind changes, and at each list item.
    """
    on_page = Window.partitionBy(*PAGE).orderBy(*ORDER)
    before = lambda c: F.lag(c).over(on_page)
    same_size = F.abs(F.col("size") - before("size")) <= 0.1 * before("size")
    goes_on = (before("y0") - F.col("y1") <= gap * F.col("size")) & same_size & (F.col("kind") == before("kind")) & (F.col("kind") != "listItem")
    starts = (~F.coalesce(goes_on, F.lit(False))).cast("int")
    marked = lines.select(*PAGE, *ORDER, starts.alias("_start"))
    return marked.select("line_id", F.sum("_start").over(on_page.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("paragraph"))


def list_levels(lines: DataFrame, step: float = 4.0) -> DataFrame:
    """``line_id, level``: list items by how far they are set in on their page, from 1."""
    by_inset = Window.partitionBy(*PAGE).orderBy(F.floor(F.col("x0") / step))
    return lines.where("kind = 'listItem'").select("line_id", F.dense_rank().over(by_inset).alias("level"))


def head_frequency(lines: DataFrame) -> DataFrame:
    """``line_id, times``: how often a line of the page begins with the same word at the same inset."""
    head = lines.where(F.trim("text") != "").select("line_id", *PAGE, F.split(F.trim("text"), r"\s+")[0].alias("head"), F.round("x0").alias("inset"))
    counted = head.groupBy(*PAGE, "head", "inset").agg(F.count(F.lit(1)).alias("times"))
    return head.join(counted, [*PAGE, "head", "inset"]).select("line_id", "times")


def page_number_lines(lines: DataFrame) -> DataFrame:
    """``line_id`` of the foot lines whose key holds a number and that do not begin at the left edge of the body."""
    body = lines.where(~F.col("kind").isin("header", "footer")).groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("low"))
    key = T.furniture_key(F.col("text"))
    foot = lines.where(key.contains("#")).join(body, list(PAGE)).where(F.col("y1") <= F.col("low"))
    return foot.where(F.abs(F.col("x0") - F.col("left")) > 0.01 * (F.col("right") - F.col("left"))).select("line_id")


def subtitles(lines: DataFrame, em: float = 0.25) -> DataFrame:
    """``line_id, heading_id``: lines that follow a heading of their page at no more than ``em`` of its size."""
    on_page = Window.partitionBy(*PAGE).orderBy(*ORDER)
    before = F.lag(F.struct("line_id", "kind", "y0", "size")).over(on_page)
    near = (before["kind"] == "heading") & (before["y0"] - F.col("y1") <= em * before["size"])
    return lines.select("line_id", before["line_id"].alias("heading_id"), F.coalesce(near, F.lit(False)).alias("near")).where("near").drop("near")


def overlapping_lines(lines: DataFrame) -> DataFrame:
    """``line_a, line_b``: lines of a page that overlap in height by more than half of the lower one.

    Only lines with a band of the page in common are compared.
    """
    band = lambda c: F.floor(F.col(c) / BAND)
    in_bands = lines.select("line_id", *PAGE, "y0", "y1", F.explode(F.sequence(band("y0"), band("y1"))).alias("band"))
    a = in_bands.select(*PAGE, "band", F.col("line_id").alias("line_a"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    b = in_bands.select(*PAGE, "band", F.col("line_id").alias("line_b"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    lower = F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))
    first_band = F.col("band") == F.floor(F.greatest("a0", "b0") / BAND)
    return a.join(b, [*PAGE, "band"]).where((F.col("line_a") < F.col("line_b")) & first_band & (shared > lower / 2)).select("line_a", "line_b")


def word_boxes(lines: DataFrame) -> DataFrame:
    """``line_id, word_no, word, x0, x1, y0, y1``: the words of lines, each with its share of the line's box."""
    text = F.col("text")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # The offset of a word is what comes before it, looked for from the end of the word before.
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,from:int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        at = F.call_function("locate", w, text, s["at"])
        return F.struct((at + F.length(w)).alias("at"), F.array_append(s["out"], F.struct(w.alias("word"), (at - 1).alias("from"))).alias("out"))

    placed = lines.where(F.trim(text) != "").select("line_id", "x0", "x1", "y0", "y1", F.length(text).alias("n"), F.posexplode(F.aggregate(words, start, step)["out"]).alias("word_no", "w"))
    unit = (F.col("x1") - F.col("x0")) / F.col("n")
    left = F.col("x0") + unit * F.col("w.from")
    return placed.select("line_id", "word_no", F.col("w.word").alias("word"), F.round(left, 3).alias("x0"), F.round(left + unit * F.length("w.word"), 3).alias("x1"), "y0", "y1")


def lines_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line, text``: words with boxes gathered to lines from the top of a page.

    A word belongs to the line above it if it overlaps the height the line has reached by
    more than half of the lower of both; the line's height grows with its words.  A page
    holds a bounded number of words.
    """
    item = F.struct((-F.col("y1")).alias("top"), "x0", F.col("y0").alias("low"), F.col("y1").alias("high"), "word")
    ordered = F.array_sort(F.collect_list(item))
    kind = "array<struct<no:int,x0:double,word:string>>"
    start = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.array().cast(kind).alias("out"))

    def step(s: Column, w: Column) -> Column:
        shared = F.least(s["high"], w["high"]) - F.greatest(s["low"], w["low"])
        joins = (s["no"] >= 0) & (shared > F.least(s["high"] - s["low"], w["high"] - w["low"]) / 2)
        no = F.when(joins, s["no"]).otherwise(s["no"] + 1)
        return F.struct(
            no.alias("no"),
            F.when(joins, F.least(s["low"], w["low"])).otherwise(w["low"]).alias("low"),
            F.when(joins, F.greatest(s["high"], w["high"])).otherwise(w["high"]).alias("high"),
            F.array_append(s["out"], F.struct(no.alias("no"), w["x0"].alias("x0"), w["word"].alias("word"))).alias("out"),
        )

    placed = words.groupBy(*keys).agg(F.aggregate(ordered, start, step)["out"].alias("out")).select(*keys, F.explode("out").alias("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w.x0", "w.word"))), lambda x: x["word"]), " ")
    return placed.groupBy(*keys, F.col("w.no").alias("line")).agg(text.alias("text"))


def tables_over_pages(lines: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``entry_id, page, table_id, next_table_id``: a table that ends a page's body and goes on at the top of the next one at the same edges."""
    body = lines.where(~F.col("kind").isin("header", "footer"))
    at = F.struct(*ORDER, "table_id")
    ends = body.groupBy(*PAGE).agg(F.min(at)["table_id"].alias("first"), F.max(at)["table_id"].alias("last"))
    hulls = lines.where("table_id is not null").groupBy(*PAGE, "table_id").agg(F.min("x0").alias("x0"))
    tail = ends.where("last is not null").select(*PAGE, F.col("last").alias("table_id")).join(hulls, [*PAGE, "table_id"])
    head = ends.where("first is not null").select(*PAGE, F.col("first").alias("table_id")).join(hulls, [*PAGE, "table_id"])
    head = head.select("entry_id", (F.col("page") - 1).alias("page"), F.col("table_id").alias("next_table_id"), F.col("x0").alias("next_x0"))
    return tail.join(head, list(PAGE)).where(F.abs(F.col("x0") - F.col("next_x0")) <= tolerance).select(*PAGE, "table_id", "next_table_id")


def kept_columns(cells: DataFrame, keys: list[str], col: str = "col", text: str = "text") -> DataFrame:
    """Cells without the columns that are empty in all rows of their table, the others numbered anew from 0."""
    kept = cells.groupBy(*keys, col).agg(F.count_if(F.trim(text) != "").alias("_n")).where("_n > 0")
    numbered = kept.select(*keys, col, (F.row_number().over(Window.partitionBy(*keys).orderBy(col)) - 1).alias("new_col"))
    return cells.join(numbered, [*keys, col]).drop(col).withColumnRenamed("new_col", col)


def figure_names(hulls: DataFrame) -> DataFrame:
    """Hulls with a ``name`` by page and number, both from 1."""
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "x0"))
    return hulls.withColumn("name", F.concat_ws("-", F.lit("figure"), (F.col("page") + 1).cast("string"), n.cast("string")))


def style_features(lines: DataFrame) -> DataFrame:
    """``line_id, size_ratio, upper, digits, words, colon``: how a line is set against the body of its document."""
    body = body_sizes(lines).withColumnRenamed("size", "body")
    share = lambda c: F.round(F.regexp_count("text", F.lit(c)) / F.greatest(F.length("text"), F.lit(1)), 6)
    rows = lines.where(F.trim("text") != "").join(body, "entry_id")
    return rows.select(
        "line_id", F.round(F.col("size") / F.col("body"), 6).alias("size_ratio"), share(r"\p{Lu}").alias("upper"), share("[0-9]").alias("digits"),
        F.size(F.split(F.trim("text"), r"\s+")).alias("words"), F.rtrim("text").endswith(":").alias("colon"),
    )


def table_distance(lines: DataFrame) -> DataFrame:
    """``line_id, distance``: white space between a line outside tables and the nearest table of its page; a page has few tables."""
    hulls = lines.where("table_id is not null").groupBy(*PAGE, "table_id").agg(F.min("y0").alias("t0"), F.max("y1").alias("t1"))
    away = F.greatest(F.lit(0.0), F.col("t0") - F.col("y1"), F.col("y0") - F.col("t1"))
    return lines.where("table_id is null").join(hulls, list(PAGE)).groupBy("line_id").agg(F.round(F.min(away), 3).alias("distance"))


def outside(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose box lies in none of the ``boxes`` (``b0..b3``) of their page."""
    inside = (F.col("x0") >= F.col("b0")) & (F.col("x1") <= F.col("b2")) & (F.col("y0") >= F.col("b1")) & (F.col("y1") <= F.col("b3"))
    hit = lines.select("line_id", *PAGE, "x0", "y0", "x1", "y1").join(boxes.select(*PAGE, "b0", "b1", "b2", "b3"), list(PAGE)).where(inside)
    return lines.join(hit.select("line_id").distinct(), "line_id", "left_anti")


def recognition_need(rows: DataFrame, few: int = FEW_SIGNS) -> DataFrame:
    """``entry_id, page, signs, need``: pages whose text has fewer than ``few`` signs need recognition."""
    counted = rows.groupBy(*PAGE).agg(F.sum(F.coalesce(F.length(F.trim("text")), F.lit(0))).alias("signs"))
    return counted.withColumn("need", F.when(F.col("signs") < few, "full").otherwise("none"))


def page_words_json(words: DataFrame) -> DataFrame:
    """``line_id, json``: one JSON line a word, with its box."""
    one = F.to_json(F.struct("word_no", "word", F.array("x0", "y0", "x1", "y1").alias("bbox")))
    return words.select("line_id", "word_no", one.alias("json"))
