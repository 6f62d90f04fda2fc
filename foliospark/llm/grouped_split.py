"""Splits that keep related records together, by grouped iterative stratification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .names import author_key, document_key

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Units that are placed one by one: components above 1/UNITS of the rows, and bundles of the rest.
UNITS = 4_000
#: Labels that are balanced by name; rarer ones share the label 'other'.
LABELS = 1_000


def links(manifest: DataFrame) -> DataFrame:
    """``u, v``: each entry and the smallest entry that shares a document, author, source or entity."""
    shared = F.array(
        F.struct(F.lit("d").alias("kind"), document_key(F.col("document")).alias("key")),
        F.struct(F.lit("a").alias("kind"), F.col("author_key").alias("key")),
        F.struct(F.lit("s").alias("kind"), F.when(F.trim("source") != "", F.col("source")).alias("key")),
        F.struct(F.lit("e").alias("kind"), F.when(F.col("entity_id") != 0, F.col("entity_id").cast("string")).alias("key")),
    )
    keyed = (
        manifest.select("entry_id", "document", "author", "source", "entity_id")
        .where("entry_id is not null")
        .withColumn("author_key", author_key("author"))
        .select("entry_id", F.explode(shared).alias("k"))
        .select("entry_id", "k.kind", "k.key")
        .where("key is not null")
        .distinct()
    )
    least = keyed.groupBy("kind", "key").agg(F.min("entry_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(least, ["kind", "key"]).where("entry_id > v").select(F.col("entry_id").alias("u"), "v").distinct()


def groups(manifest: DataFrame) -> DataFrame:
    """``entry_id, group_id``: every entry linked to another, with the smallest entry of its group.

    Null, blank and 'not known' values link nothing; entries without id are left out;
    repeated rows count once; an empty table gives an empty result.
    """
    found = components(links(manifest))
    return found.select(F.col("node").alias("entry_id"), F.col("group").alias("group_id"))


def place(sizes: np.ndarray, labels: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Iterative stratification of units.

    ``labels[i, j]`` counts the rows of unit ``i`` with label ``j``.  The label with the
    fewest rows outstanding goes first, its largest unit first, into the split that
    needs most of that label, then most rows.
    """
    want_label = np.outer(shares, labels.sum(axis=0)).astype(float)
    want_rows = np.array(shares, dtype=float) * sizes.sum()
    out = np.full(len(sizes), -1)
    left = labels.sum(axis=0).astype(float)
    order = np.argsort(-sizes, kind="stable")
    has = [[i for i in order if labels[i, j] > 0] for j in range(labels.shape[1])]
    waiting = [j for j in range(labels.shape[1]) if left[j] > 0]
    while waiting:
        j = min(waiting, key=lambda x: (left[x], x))
        waiting.remove(j)
        for i in has[j]:
            if out[i] >= 0:
                continue
            s = max(range(len(shares)), key=lambda x: (want_label[x, j], want_rows[x], -x))
            if want_rows[s] < sizes[i] / 2:  # the rows of that split are used up: the emptiest takes the unit
                s = int(np.argmax(want_rows))
            out[i] = s
            want_label[s] -= labels[i]
            want_rows[s] -= sizes[i]
            left -= labels[i]
    return out


def assign(manifest: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS, label: str = "lang", units: int = UNITS) -> DataFrame:
    """``entry_id, group_id, split``: every entry once, related entries in the same split.

    Components with more than ``1/units`` of the rows are placed one by one.  The rest is
    bundled by rarest label and hash into at most ``2 * units`` bundles, so what the
    driver sees has a fixed size whatever the number of components.  Null labels count as
    a label of their own.
    """
    entries = manifest.where("entry_id is not null").select("entry_id", F.coalesce(label, F.lit("?")).alias("label")).dropDuplicates(["entry_id"])
    grouped = entries.join(groups(manifest), "entry_id", "left").withColumn("group_id", F.coalesce("group_id", "entry_id"))
    total = entries.count()
    if not total:
        return grouped.select("entry_id", "group_id", F.lit(None).cast("string").alias("split"))
    names = [r[0] for r in entries.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS).collect()]
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("label")), F.lit(len(names) + 1)).cast("int")
    per_label = grouped.withColumn("rank", rank).groupBy("group_id", "rank").agg(F.count(F.lit(1)).alias("n"))
    vectors = per_label.groupBy("group_id").agg(
        F.sum("n").alias("size"), F.max("rank").alias("rarest"), F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("vector")
    )  # at most LABELS + 1 values are collected for a group
    alone = F.col("size") > F.lit(total / units)
    per_rank = max(1, units // (len(names) + 1))
    bundle = F.concat_ws("-", F.lit("b"), "rarest", F.pmod(F.xxhash64("group_id"), F.lit(per_rank)))
    unit_of = vectors.withColumn("unit", F.when(alone, F.concat(F.lit("g"), F.col("group_id").cast("string"))).otherwise(bundle))
    table = (
        unit_of.select("unit", F.explode("vector").alias("rank", "n")).groupBy("unit", "rank").agg(F.sum("n").alias("n")).orderBy("unit", "rank").collect()
    )  # bounded: 2 * units units with LABELS + 1 values each
    ids = sorted({r["unit"] for r in table})
    at = {u: i for i, u in enumerate(ids)}
    labels = np.zeros((len(ids), len(names) + 1), dtype=np.int64)
    for r in table:
        labels[at[r["unit"]], r["rank"] - 1] = r["n"]
    chosen = place(labels.sum(axis=1), labels, [s for _, s in splits])
    spark = manifest.sparkSession
    placed = spark.createDataFrame([(u, splits[chosen[i]][0]) for u, i in at.items()], "unit string, split string")
    where = unit_of.select("group_id", "unit").join(F.broadcast(placed), "unit").select("group_id", "split")
    return grouped.join(where, "group_id").select("entry_id", "group_id", "split")
