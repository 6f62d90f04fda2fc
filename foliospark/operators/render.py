"""Serialisers: tables, chunks, Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def row_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells as rows of ``a | b | c``: keys, ``row``, ``line``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("text")))), lambda c: c["text"])
    return cells.groupBy(*keys, "row").agg(F.array_join(ordered, " | ").alias("line"))


def table_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each table as lines of ``a | b | c``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"])
    return row_texts(cells, keys).groupBy(*keys).agg(F.array_join(ordered, "\n").alias("text"))


def _budget(lines: Column, most: int) -> Column:
    """Greedy groups of the data rows of a table, the header counted into each."""
    header = F.length(lines[0])
    start = F.struct(
        F.array().cast("array<string>").alias("now"), header.cast("int").alias("size"), F.array().cast("array<array<string>>").alias("done")
    )
    step = lambda s, l: F.when(
        (F.size(s["now"]) > 0) & (s["size"] + 1 + F.length(l) > most),
        F.struct(F.array(l).alias("now"), (header + 1 + F.length(l)).cast("int").alias("size"), F.array_append(s["done"], s["now"]).alias("done")),
    ).otherwise(F.struct(F.array_append(s["now"], l).alias("now"), (s["size"] + 1 + F.length(l)).cast("int").alias("size"), s["done"].alias("done")))
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def table_chunks(cells: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Tables as chunks of at most ``most`` signs: header repeated, rows never broken; ``part``, ``parts``, ``text``.

    A table that fits, or has a single data row, stays whole (``parts`` 1).
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"])
    tables = row_texts(cells, keys).groupBy(*keys).agg(ordered.alias("lines")).withColumn("whole", F.array_join("lines", "\n"))
    groups = tables.withColumn("groups", F.when(F.length("whole") > most, _budget(F.col("lines"), most)))
    split = groups.withColumn("groups", F.when(F.size("groups") >= 2, F.col("groups")).otherwise(F.array(F.slice("lines", 2, F.size("lines")))))
    return split.select(*keys, F.size("groups").alias("parts"), F.col("lines")[0].alias("header"), F.posexplode("groups").alias("part", "rows")).select(
        *keys, (F.col("part") + 1).alias("part"), "parts", F.array_join(F.concat(F.array("header"), "rows"), "\n").alias("text")
    )


def table_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each table as a pipe table, its first row as the head."""
    escaped = F.replace(F.trim("text"), F.lit("|"), F.lit("\\|"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", escaped.alias("text")))), lambda c: c["text"])
    rows = cells.groupBy(*keys, "row").agg(ordered.alias("texts"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("row", "texts"))), lambda r: r["texts"])
    tables = rows.groupBy(*keys).agg(body.alias("rows"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.col("rows")[0], lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    rest = F.transform(F.slice("rows", 2, F.size("rows")), line)
    return tables.select(*keys, F.array_join(F.concat(F.array(line(F.col("rows")[0]), rule), rest), "\n").alias("markdown"))


def block_markdown(kind: Column, text: Column, level: Column) -> Column:
    """One block as Markdown."""
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(level, F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), text)
    return F.when(kind == "heading", heading).when(kind == "listItem", F.concat(F.lit("- "), T.item_text(text))).otherwise(T.escape_markdown(text))


def document_markdown(blocks: DataFrame, keys: list[str], order: list[str], furniture: bool = False) -> DataFrame:
    """Blocks of each key joined by blank lines; running heads are left out unless wanted."""
    rows = blocks if furniture else blocks.where(~F.col("kind").isin("header", "footer"))
    rows = rows.where(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, block_markdown(F.col("kind"), F.col("text"), F.col("level")).alias("_md")))), lambda b: b["_md"])
    return rows.groupBy(*keys).agg(F.array_join(ordered, "\n\n").alias("markdown"))


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every place of every table, cells spread over their spans; the later cell wins a place, empty places are ''."""
    spans = cells.select(
        *keys, "text", "order", F.explode(F.sequence("row", F.col("row") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1)).alias("row"), "col", "col_span"
    ).select(*keys, "text", "order", "row", F.explode(F.sequence("col", F.col("col") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)) - 1)).alias("col"))
    placed = spans.groupBy(*keys, "row", "col").agg(F.max_by("text", "order").alias("text"))
    sizes = placed.groupBy(*keys).agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    places = sizes.select(*keys, F.explode(F.sequence(F.lit(0), "_r")).alias("row"), "_c").select(*keys, "row", F.explode(F.sequence(F.lit(0), "_c")).alias("col"))
    return places.join(placed, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("text", F.lit("")).alias("text"))
