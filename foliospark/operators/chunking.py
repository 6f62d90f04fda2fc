"""Retrieval chunks from blocks, and the metadata that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hierarchy import hierarchy
from .structure import FURNITURE, ORDER


def sections(rows: DataFrame) -> DataFrame:
    """``line_id, section``: the last heading before each line of a document, over pages.

    Headings are carried from page to page over one row per page first, so a long
    document is not sorted line by line in one task.
    """
    heading = F.when((F.col("kind") == "heading") & (F.trim("text") != ""), F.trim("text"))
    last = F.max(F.when(heading.isNotNull(), F.struct(*ORDER[1:], heading.alias("text"))))
    pages = rows.groupBy("entry_id", "page").agg(last["text"].alias("_last"))
    before = Window.partitionBy("entry_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select("entry_id", "page", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("entry_id", "page", "line_id", F.last(heading, ignorenulls=True).over(inside).alias("_own"))
    return own.join(carried, ["entry_id", "page"]).select("line_id", F.coalesce("_own", "_carried").alias("section"))


def block_chunks(rows: DataFrame, furniture: bool = False) -> DataFrame:
    """One chunk per paragraph, heading or list item line, and one per table: ``entry_id, page, chunk_no, kind, text, section, n_lines``.

    ``chunk_no`` counts in reading order within the page; blank lines and, unless
    wanted, running heads give no chunk.  A heading's own text is not its section.
    """
    kept = rows if furniture else rows.where(~F.col("kind").isin(*FURNITURE))
    kept = kept.where(F.trim("text") != "").join(sections(rows), "line_id")
    table = F.col("table_id").isNotNull() & (F.col("kind") == "tableCell")
    key = F.when(table, F.concat(F.lit("t"), F.col("table_id").cast("string"))).otherwise(F.concat(F.lit("l"), F.col("line_id").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER[1:], F.trim("text").alias("text"), "section", "kind")))
    grouped = kept.withColumn("_key", key).groupBy("entry_id", "page", "_key").agg(ordered.alias("l"), F.max(table).alias("table"))
    first = F.col("l")[0]
    at = F.row_number().over(Window.partitionBy("entry_id", "page").orderBy(first["line_no"], first["line_id"])) - 1
    return grouped.select(
        "entry_id", "page", at.alias("chunk_no"), F.when(F.col("table"), "table").otherwise(first["kind"]).alias("kind"),
        F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), F.when(first["kind"] != "heading", first["section"]).alias("section"), F.size("l").alias("n_lines"),
    )


def budget(tokens: int) -> int:
    """Signs that a budget of tokens stands for."""
    if tokens < 1:
        raise ValueError("tokens must be at least 1")
    return 4 * tokens


def flat_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """The fields of a struct as columns of plain values; nested ones as JSON, for stores that take nothing else."""
    inner = df.schema[column].dataType
    plain = [
        (F.col(f"{column}.{f.name}") if f.dataType.simpleString().split("(")[0] in _PLAIN else F.to_json(F.col(f"{column}.{f.name}"))).alias(f"{column}_{f.name}") for f in inner
    ]
    return df.select(*[c for c in df.columns if c != column], *plain)


_PLAIN = frozenset(["string", "int", "bigint", "double", "float", "boolean", "smallint", "tinyint", "date", "timestamp", "decimal"])


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """``doc_id, level, title, page``: outline entries with a page, levels by depth in the tree; entries without page keep their children.

    ``nodes`` has ``doc_id, id, parent_id, title, page``; trees may have any depth, entries
    in a ring are left out.
    """
    rows = nodes.select(
        F.col("doc_id").alias("entry_id"), F.col("id").cast("string").alias("style_id"), F.lit(None).cast("string").alias("name"),
        F.col("parent_id").cast("string").alias("based_on"), F.lit(0).alias("loaded_at"),
    )
    depths = hierarchy(rows).where("depth >= 0").select(F.col("entry_id").alias("doc_id"), F.col("style_id").alias("_id"), (F.col("depth") + 1).alias("level"))
    found = nodes.withColumn("_id", F.col("id").cast("string")).join(depths, ["doc_id", "_id"])
    return found.where("page is not null").select("doc_id", "level", "title", "page")


def split_box(box: Column, text: Column) -> Column:
    """Words of a span with their share of its box, by length: array of ``struct<word, x0, x1>``."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    width = (box[2] - box[0]) / F.greatest(F.length(text), F.lit(1))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,x0:double,x1:double>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        at = F.position(w, text, s["at"])
        x0 = box[0] + (at - 1) * width
        return F.struct((at + F.length(w)).alias("at"), F.array_append(s["out"], F.struct(w.alias("word"), x0.alias("x0"), (x0 + F.length(w) * width).alias("x1"))).alias("out"))

    return F.aggregate(words, start, step, lambda s: s["out"])


def joins_word(gap: Column, drift: Column, size: Column) -> Column:
    """Whether two spans make one word: a gap under 0.15 and a drift under 0.3 of the type size."""
    return (gap < 0.15 * size) & (F.abs(drift) < 0.3 * size)
