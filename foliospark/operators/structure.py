"""Structure of documents: lines, paragraphs, sections, tables, running heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .hierarchy import latest

ORDER = ("page", "line_no", "line_id")
FURNITURE = ("header", "footer")


def lines(page_lines: DataFrame, *columns: str) -> DataFrame:
    """Lines in their latest state with the wanted ``columns`` (all if none is named); rows without id are left out."""
    return latest(page_lines.where("line_id is not null"), ["line_id"], "read_at", list(columns) or None)


def text_blocks(documents: DataFrame) -> DataFrame:
    """Plain text as blocks: list items, and paragraphs of the lines between blank lines.

    ``doc_id, index, kind, text``; null and blank texts give no block.
    """
    rows = documents.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    item = (T.item_marker(F.col("line")) != "") & (F.col("line") != "")
    by_doc = Window.partitionBy("doc_id").orderBy("line_no")
    previous_blank = F.coalesce(F.lag("line").over(by_doc), F.lit("")) == ""
    previous_item = F.coalesce(F.lag(item).over(by_doc), F.lit(False))
    starts = item | previous_blank | previous_item
    marked = rows.withColumn("item", item).withColumn("starts", starts).where("line <> ''")
    island = F.sum(F.col("starts").cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    grouped = marked.withColumn("block", island).groupBy("doc_id", "block").agg(
        F.max("item").alias("item"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line")
    )
    return grouped.select(
        "doc_id",
        (F.col("block") - 1).cast("int").alias("index"),
        F.when(F.col("item"), "listItem").otherwise("paragraph").alias("kind"),
        F.when(F.col("item"), T.item_text(F.col("line"))).otherwise(F.col("line")).alias("text"),
    )


def words(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per word: keys, ``word_no`` from 0, ``word``."""
    split = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return rows.select(*keys, F.posexplode(split).alias("word_no", "word"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """Lines of a block joined: ``entry_id, page, block, kind, text, n_lines``.

    A hyphen at a line end before a lower-case letter joins the word.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    joined = F.regexp_replace(F.array_join(ordered, "\n"), r"(\p{L})-\n(\p{Ll})", "$1$2")
    return rows.where("block is not null").groupBy("entry_id", "page", "block").agg(
        F.min("kind").alias("kind"), T.squeeze(F.replace(joined, F.lit("\n"), F.lit(" "))).alias("text"), F.count(F.lit(1)).alias("n_lines")
    )


def furniture(rows: DataFrame, pages: int = 3, length: int = 160) -> DataFrame:
    """Text keys that repeat on at least ``pages`` pages of a document: ``entry_id, key, pages, lines``."""
    key = T.furniture_key(F.col("text"))
    candidates = rows.where((F.length("text") <= length) & (F.trim("text") != "")).select("entry_id", "page", key.alias("key"))
    return candidates.groupBy("entry_id", "key").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("lines")).where(F.col("pages") >= pages)


def reading_order(rows: DataFrame) -> DataFrame:
    """Reading order of a page: body first, furniture after it; ``line_id, index``."""
    by_page = Window.partitionBy("entry_id", "page").orderBy(F.col("kind").isin(*FURNITURE), *ORDER[1:])
    return rows.select("line_id", "entry_id", "page", (F.row_number().over(by_page) - 1).alias("index"))


def continuations(rows: DataFrame) -> DataFrame:
    """Paragraphs that go on from the page before: the last body line there is open, the first here is lower case.

    ``entry_id, page``.
    """
    body = rows.where(~F.col("kind").isin(*FURNITURE) & F.col("text").isNotNull())
    at = F.struct(*[F.col(c) for c in ORDER[1:]], "kind", "text")
    ends = body.groupBy("entry_id", "page").agg(F.min(at).alias("head"), F.max(at).alias("tail"))
    before = ends.select("entry_id", (F.col("page") + 1).alias("page"), F.col("tail").alias("before"))
    goes_on = (
        (F.col("before.kind") == "paragraph")
        & (F.col("head.kind") == "paragraph")
        & ~F.rtrim("before.text").rlike(r"[.!?:;]$")
        & F.ltrim("head.text").rlike(r"^\p{Ll}")
    )
    return ends.join(before, ["entry_id", "page"]).where(goes_on).select("entry_id", "page")


def enter_heading(path: Column, level: Column, text: Column) -> Column:
    """The section stack below a heading: cut to the levels above it, then pushed; no level is level 1."""
    depth = F.greatest(F.coalesce(level, F.lit(1)), F.lit(1))
    return F.concat(F.slice(path, F.lit(1), depth - 1), F.array(text))


def section_paths(headings: DataFrame, doc: str, order: str) -> DataFrame:
    """``doc, order, path``: the headings around each heading, itself excluded.

    A fold over the headings of a document in order, as a window cannot cut a stack.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "level", "text")))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(f"array<struct<at:bigint,path:array<string>>>").alias("out"))
    step = lambda s, h: F.struct(
        enter_heading(s["stack"], h["level"], h["text"]).alias("stack"),
        F.array_append(
            s["out"],
            F.struct(h[order].cast("bigint").alias("at"), F.slice(s["stack"], F.lit(1), F.greatest(F.coalesce(h["level"], F.lit(1)), F.lit(1)) - 1).alias("path")),
        ).alias("out"),
    )
    folded = headings.groupBy(doc).agg(F.aggregate(rows, start, step)["out"].alias("out"))
    return folded.select(doc, F.explode("out").alias("o")).select(doc, F.col("o.at").alias(order), F.col("o.path").alias("path"))


def nearest_heading(rows: DataFrame) -> DataFrame:
    """``line_id, section``: the last heading before each line, within its page."""
    before = Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("line_id", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before).alias("section"))


def table_runs(cells: DataFrame, doc: list[str], order: str) -> DataFrame:
    """Cells with a ``run``: a new table starts where (row, col) does not climb."""
    by_page = Window.partitionBy(*doc).orderBy(order)
    climbs = F.struct("row", "col") > F.lag(F.struct("row", "col")).over(by_page)
    starts = cells.withColumn("_start", (~F.coalesce(climbs, F.lit(False))).cast("int"))
    return starts.withColumn("run", F.sum("_start").over(by_page.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def context(rows: DataFrame, columns: list[str], reach: int = 2) -> DataFrame:
    """Values of the lines up to ``reach`` before and after each line of a page."""
    by_page = Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:])
    out = [F.lag(c, k).over(by_page).alias(f"{c}_before_{k}") for c in columns for k in range(1, reach + 1)]
    out += [F.lead(c, k).over(by_page).alias(f"{c}_after_{k}") for c in columns for k in range(1, reach + 1)]
    return rows.select("line_id", *out)


def list_ordinals(rows: DataFrame) -> DataFrame:
    """``line_id, ordinal``: list items counted within their run on a page."""
    by_page = Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:])
    item = (F.col("kind") == "listItem").cast("int")
    runs = rows.withColumn("_item", item).withColumn("_run", F.sum(1 - F.col("_item")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("entry_id", "page", "_run").orderBy(*ORDER[1:])
    return runs.where("_item = 1").select("line_id", F.row_number().over(inner).alias("ordinal"))


def extents(rows: DataFrame, keys: list[str], bbox: str = "bbox") -> DataFrame:
    """Smallest box around the boxes of each key; rows without box are left out."""
    b = F.col(bbox)
    return rows.where(b.isNotNull() & (F.size(b) == 4)).groupBy(*keys).agg(
        F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[2]).alias("x1"), F.max(b[3]).alias("y1"), F.count(F.lit(1)).alias("boxes")
    )


def clip(rows: DataFrame, margins: DataFrame, share: float) -> DataFrame:
    """Lines whose centre lies within the page extent less ``share`` of its size at every side."""
    joined = rows.join(margins, ["entry_id", "page"])
    cx, cy = (F.col("bbox")[0] + F.col("bbox")[2]) / 2, (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    dx, dy = (F.col("x1") - F.col("x0")) * share, (F.col("y1") - F.col("y0")) * share
    inside = cx.between(F.col("x0") + dx, F.col("x1") - dx) & cy.between(F.col("y0") + dy, F.col("y1") - dy)
    return joined.where(inside).select("line_id")


def heading_gaps(rows: DataFrame, keys: list[str], order: list[str], level: str = "level") -> DataFrame:
    """Headings that skip a level: ``previous`` is more than one above."""
    previous = F.lag(level).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("previous", previous).where(F.col(level) > F.coalesce("previous", F.lit(0)) + 1)
