"""Pages: windows, lists, ranges, and the re-ordering of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window(blocks: DataFrame, first: int, count: int, doc: str = "entry_id", order: tuple[str, ...] = ("page", "line_no")) -> DataFrame:
    """Blocks of ``count`` pages from page ``first`` (0-based); a window past the end is empty.

    The window is applied to finished blocks.  A continuation flag that would point
    before the window is cleared.
    """
    inside = blocks.where((F.col("page") >= first) & (F.col("page") < first + count))
    if "continues_previous" not in blocks.columns:
        return inside
    at = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return inside.withColumn("continues_previous", F.when(at == 1, F.lit(False)).otherwise(F.col("continues_previous")))


def parse_spec(spec: Column) -> Column:
    """``1-3,5`` as a sorted array of distinct page numbers; a reversed or malformed part is an error."""
    def part(p: Column) -> Column:
        ends = F.split(F.trim(p), r"\s*-\s*")
        a, b = ends[0].try_cast("int"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).try_cast("int")
        return F.when((a >= 1) & (b >= a), F.sequence(a, b)).otherwise(F.raise_error(F.concat(F.lit("bad page range: "), p)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part))))


def batches(pages: Column, every: int) -> Column:
    """First and last page (1-based) of each batch of ``every`` pages."""
    starts = F.when(pages >= 1, F.sequence(F.lit(1), pages, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + every - 1, pages).alias("last")))


def ranges(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Runs of consecutive pages: ``doc, first, last``."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page))
    rows = pages.select(doc, page).distinct().withColumn("_island", island)
    return rows.groupBy(doc, "_island").agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_island")


def delete(pages: DataFrame, gone: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages without those listed, numbered anew from 0."""
    kept = pages.join(gone.select(doc, page).distinct(), [doc, page], "left_anti")
    return kept.withColumn("new_page", F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1)


def extract(pages: DataFrame, wanted: DataFrame, doc: str, page: str, position: str) -> DataFrame:
    """Pages in the order listed; a page may be listed repeatedly."""
    return pages.join(wanted, [doc, page]).withColumn("new_page", F.row_number().over(Window.partitionBy(doc).orderBy(position)) - 1)


def merge(pages: DataFrame, into: Column, order: list[str]) -> DataFrame:
    """Documents joined end to end: ``merged_id, new_page`` over ``order``."""
    keyed = pages.withColumn("merged_id", into)
    return keyed.withColumn("new_page", F.row_number().over(Window.partitionBy("merged_id").orderBy(*order)) - 1)


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pages of two states: 'common', 'added' or 'removed', and whether the value changed."""
    left, right = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("common")
    return left.join(right, keys, "full_outer").select(*keys, status.alias("status"), "before", "after")


def insert(pages: DataFrame, more: DataFrame, doc: str, page: str, position: int) -> DataFrame:
    """``doc, page, inserted, new_page``: the pages of ``more`` put into each document before its page ``position`` (from 1).

    A position past the end puts them behind; documents without pages are made of the new ones.
    """
    if position < 1:
        raise ValueError("position must be at least 1")
    at = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    own = pages.select(doc, page, F.when(at < position, 0).otherwise(2).alias("_part"))
    both = own.unionByName(more.select(doc, page, F.lit(1).alias("_part")))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("_part", page)) - 1
    return both.select(doc, page, (F.col("_part") == 1).alias("inserted"), place.alias("new_page"))


def rearrange(pages: DataFrame, doc: str, page: str, *order: Column) -> DataFrame:
    """Pages of each document numbered anew in ``order``; none is lost or repeated."""
    return pages.withColumn("new_page", F.row_number().over(Window.partitionBy(doc).orderBy(*order, page)) - 1)


def split_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """``doc, page, part``: each page as a document of its own, named by document and page from 1."""
    return pages.select(doc, page, F.concat_ws("-", F.col(doc).cast("string"), (F.col(page) + 1).cast("string")).alias("part"))


def split_ranges(pages: DataFrame, spans: DataFrame, doc: str, page: str) -> DataFrame:
    """``doc, part, page, new_page``: pages by the ranges ``part, first, last`` (from 0, both included) they lie in.

    The ranges are few and the same for all documents; a page may lie in several.
    """
    joined = pages.join(F.broadcast(spans), (F.col(page) >= F.col("first")) & (F.col(page) <= F.col("last")))
    return joined.select(doc, "part", page, (F.row_number().over(Window.partitionBy(doc, "part").orderBy(page)) - 1).alias("new_page"))


def written_ranges(spec: Column, pages: Column) -> Column:
    """Ranges of a page specification as they are written; page 0, reversed ranges and pages past the end are errors."""
    def part(p: Column) -> Column:
        ends = F.split(F.trim(p), r"\s*-\s*")
        first = ends[0].try_cast("int")
        last = F.coalesce(F.get(ends, F.lit(1)), ends[0]).try_cast("int")
        bad = F.raise_error(F.concat(F.lit("bad page range: "), p)).cast("struct<first:int,last:int>")
        return F.when((first >= 1) & (last >= first) & (last <= pages), F.struct(first.alias("first"), last.alias("last"))).otherwise(bad)

    return F.transform(F.split(spec, ","), part)


def turned(rotation: Column, degrees: int) -> Column:
    """A page's rotation after turning it by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("pages turn by multiples of 90 degrees")
    return F.pmod(rotation + F.lit(degrees), F.lit(360))


def cropped(box: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """A box less the margins; null where nothing is left."""
    inner = F.array(box[0] + left, box[1] + bottom, box[2] - right, box[3] - top)
    return F.when((inner[0] < inner[2]) & (inner[1] < inner[3]), inner)


def merged_bookmarks(bookmarks: DataFrame, page_counts: DataFrame, doc: str, into: str) -> DataFrame:
    """``into, doc, title, page``: bookmarks of joined documents, their pages shifted by the pages of the documents before."""
    before = F.sum("pages").over(Window.partitionBy(into).orderBy(doc).rowsBetween(Window.unboundedPreceding, -1))
    shifts = page_counts.select(into, doc, F.coalesce(before, F.lit(0)).alias("_shift"))
    return bookmarks.join(shifts, doc).select(into, doc, "title", (F.col("page") + F.col("_shift")).alias("page"))


def first_copies(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """``key, first``: for each row the smallest key of the rows with the same content; references go there when copies are dropped.

    Only keys and digests are shuffled, and the copies of one content are pre-aggregated.
    """
    keyed = rows.select(key, digest.alias("_d")).where("_d is not null")
    return keyed.join(keyed.groupBy("_d").agg(F.min(key).alias("first")), "_d").select(key, "first")
