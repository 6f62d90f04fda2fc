"""Positions on pages: nearest and containing boxes, areas, tables by alignment, choices without overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tolerances, in points, within which lines and columns of a table agree.
Y_TOLERANCE, X_TOLERANCE = 2.0, 5.0


def centre(box: Column) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def contained(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an ``inner`` row whose centre lies in the ``box`` of an ``outer`` row with the same keys.

    ``inner`` has ``id, bbox``, ``outer`` has ``box_id, box``; the join is an equi-join
    on the keys (a page), whose boxes are few.
    """
    x, y = centre(F.col("bbox"))
    inside = x.between(F.col("box")[0], F.col("box")[2]) & y.between(F.col("box")[1], F.col("box")[3])
    return inner.join(outer, keys).where(inside).select(*keys, "id", "box_id")


def nearest_above(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``id, above``: the line with the nearest bottom edge over the top of each line, of those that share part of its width.

    Boxes are ``x0, y0, x1, y1`` with y upwards; ties are decided by id.  Lines are put
    into bands of a page and first compared with their own band and the next; those with
    nothing above there are compared with their whole page.
    """
    band = 100.0
    b = F.col("bbox")
    sized = rows.where(b.isNotNull() & (F.size(b) == 4)).select(*keys, "id", *[b[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    own = sized.withColumn("band", F.floor(F.col("y1") / band))
    others = sized.select(*keys, *[F.col(c).alias("o_" + c) for c in ("id", "x0", "y0", "x1")])
    at = F.floor(F.col("o_y0") / band)
    other = others.withColumn("band", F.explode(F.array_distinct(F.array(at, at - 1, F.floor((F.col("o_y0") + 0.01) / band)))))
    over = "o_id <> id and o_y0 >= y1 - 0.01 and o_x0 < x1 and o_x1 > x0"
    near = own.join(other, [*keys, "band"]).where(over).select("id", "y1", "o_id", "o_y0")
    far = own.join(near.select("id"), "id", "left_anti").join(others, keys).where(over).select("id", "y1", "o_id", "o_y0")
    first = near.unionByName(far).groupBy("id").agg(F.min(F.struct(F.round(F.col("o_y0") - F.col("y1"), 6).alias("gap"), F.col("o_id").alias("above"))).alias("n"))
    return first.select("id", F.col("n.above").alias("above"))


def _area(boxes: np.ndarray) -> float:
    """Area covered by boxes, overlaps once, by a sweep over their left and right edges."""
    total = 0.0
    edges = np.unique(boxes[:, [0, 2]])
    for a, b in zip(edges[:-1], edges[1:]):
        spans = boxes[(boxes[:, 0] <= a) & (boxes[:, 2] >= b)][:, [1, 3]]
        end = -np.inf
        for low, high in spans[np.argsort(spans[:, 0])]:
            total += max(0.0, high - max(low, end)) * (b - a)
            end = max(end, high)
    return total


def union_area(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``area``: the area that the boxes of a page cover together; a page holds a bounded number of boxes."""
    b = F.col("bbox")
    some = rows.where(b.isNotNull() & (F.size(b) == 4)).groupBy(*keys).agg(F.collect_list("bbox").alias("boxes"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["area"] = [_area(np.array([list(x) for x in boxes], dtype=float)) for boxes in batch["boxes"]]
            yield batch.drop(columns="boxes")

    schema = ", ".join(f"{n} {t}" for n, t in some.drop("boxes").dtypes) + ", area double"
    return some.mapInPandas(measure, schema)


def _columns(xs: list[float]) -> list[float]:
    """First-seen positions, each standing for those within the tolerance."""
    out: list[float] = []
    for x in xs:
        if not any(abs(x - c) <= X_TOLERANCE for c in out):
            out.append(x)
    return out


def detect(spans: list[tuple[float, float, str]]) -> list[list[list[str]]]:
    """Tables in positioned texts ``x, y, text``: rows of cells.

    Texts within the y tolerance make a line, from the top; a run of at least two lines
    that each hit two columns or more is a table.
    """
    lines: list[tuple[float, list[tuple[float, str]]]] = []
    for x, y, text in sorted(spans, key=lambda s: (-s[1], s[0])):
        home = next((line for line in lines if abs(line[0] - y) <= Y_TOLERANCE), None)
        if home is None:
            lines.append((y, [(x, text)]))
        else:
            home[1].append((x, text))
    columns = _columns([x for _, line in lines for x, _ in line])

    def place(x: float) -> int:
        return next(i for i, c in enumerate(columns) if abs(x - c) <= X_TOLERANCE)

    tables: list[list[list[str]]] = []
    run: list[list[tuple[float, str]]] = []
    for _, line in [*lines, (0.0, [])]:
        if len({place(x) for x, _ in line}) >= 2:
            run.append(line)
            continue
        if len(run) >= 2:
            used = sorted({place(x) for r in run for x, _ in r}, key=lambda i: columns[i])
            tables.append([[" ".join(t for x, t in r if place(x) == i) for i in used] for r in run])
        run = []
    return tables


def detect_tables(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, ``table_no, row, col, text`` of the tables found on each page of positioned texts ``x, y, text``."""
    some = spans.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "text")).alias("spans"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                for n, table in enumerate(detect([(s["x"], s["y"], s["text"]) for s in record.spans])):
                    rows += [(*[getattr(record, k) for k in keys], n, r, c, t) for r, cells in enumerate(table) for c, t in enumerate(cells)]
            yield pd.DataFrame(rows, columns=[*keys, "table_no", "row", "col", "text"])

    schema = ", ".join(f"{n} {t}" for n, t in some.drop("spans").dtypes) + ", table_no int, row int, col int, text string"
    return some.mapInPandas(find, schema)


def choose(candidates: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """Candidates chosen greedily by score: none shares a line with one chosen before; ``id``.

    Of each page the ``most`` best candidates are looked at; ties are decided by id.
    """
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("_r") <= most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "lines")))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, c: F.when(F.arrays_overlap(a["used"], c["lines"]), a).otherwise(
        F.struct(F.concat(a["used"], c["lines"]).alias("used"), F.array_append(a["ids"], c["id"]).alias("ids"))
    )
    return best.groupBy(*keys).agg(F.aggregate(ordered, start, step)["ids"].alias("ids")).select(*keys, F.explode("ids").alias("id"))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of two sets of ids, 0 for empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
