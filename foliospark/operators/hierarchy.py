"""Parent-child links to full hierarchies.

Links are resolved by one join, then folded in two stages.  Each block of nodes runs a
weighted disjoint-set forest of its own: every node learns the last ancestor known in
its block and the offset to it.  Sheets of one block are finished by that.  The rest
merges round by round: a node whose chain leaves its block takes over root, offset and
path of the node it points at, which doubles the known distance each time.  What is
still open when the distance exceeds the number of nodes hangs on a ring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import blank_trim, broadcast_if_small, cut

CYCLE = "(cycle)"
#: Nodes of one sheet that one block holds at most (on average, as blocks are drawn by hash).
BLOCK_NODES = 50_000


class WeightedForest:
    """Disjoint sets over ``0..n-1`` whose members know the distance to their root."""

    def __init__(self, parent: np.ndarray):
        """``parent[i]`` is the parent of ``i``, or -1 where the chain ends."""
        n = len(parent)
        own = np.arange(n)
        self.root = np.where(parent < 0, own, parent)
        self.offset = (parent >= 0).astype(np.int64)
        self.cyclic = np.zeros(n, dtype=bool)
        for _ in range(max(1, n.bit_length() + 1)):
            step = self.root[self.root]
            if np.array_equal(step, self.root):
                break
            self.offset = self.offset + self.offset[self.root]
            self.root = step
        self.cyclic = parent[self.root] >= 0


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str] | None = None) -> DataFrame:
    """The row with the largest ``order`` of each key; equal times are decided by a hash of the columns.

    Only the keys, ``order`` and the wanted ``columns`` (all if None) are read and shuffled.
    """
    rest = [c for c in (df.columns if columns is None else columns) if c not in (*keys, order)]
    row = F.struct(*rest) if rest else F.lit(True)
    newest = F.max_by(F.struct(order, *rest), F.struct(order, F.xxhash64(row))).alias("_top")
    return df.select(*keys, order, *rest).groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (order, *rest)])


def latest_wide(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """:func:`latest` for wide rows of which few are sent again: only those are shuffled."""
    several = broadcast_if_small(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    again = latest(df.join(several, keys, "left_semi"), keys, order)
    return df.join(several, keys, "left_anti").unionByName(again)


def resolve_links(styles: DataFrame) -> DataFrame:
    """``entry_id, style_id, name, parent``: the parent's ``style_id``, null for a root.

    ``based_on`` is compared with ``style_id`` first and with ``name`` second, letter
    case and edge blanks ignored; of several candidates the smallest id is taken.
    """
    norm = lambda c: F.lower(blank_trim(F.col(c)))
    nodes = latest(
        styles.select("entry_id", "style_id", "name", "based_on", "loaded_at").where(
            "entry_id is not null and style_id is not null"
        ),
        ["entry_id", "style_id"],
        "loaded_at",
    )
    keys = nodes.select(
        "entry_id",
        "style_id",
        F.explode(
            F.array(
                F.struct(norm("style_id").alias("key"), F.lit(0).alias("prio")),
                F.struct(norm("name").alias("key"), F.lit(1).alias("prio")),
            )
        ).alias("k"),
    ).select("entry_id", F.col("k.key").alias("key"), F.struct("k.prio", "style_id").alias("hit"))
    keys = keys.where("key <> ''").groupBy("entry_id", "key").agg(F.min("hit").alias("hit"))
    return (
        nodes.withColumn("key", norm("based_on"))
        .join(keys, ["entry_id", "key"], "left")
        .select("entry_id", "style_id", "name", F.col("hit.style_id").alias("parent"))
    )


def _fold_block(block: pd.DataFrame, with_path: bool) -> pd.DataFrame:
    """Root, offset, open end and path of each node of some whole blocks."""
    keys = list(zip(block["entry_id"], block["block"], block["style_id"]))
    at = {k: i for i, k in enumerate(keys)}
    wanted = list(zip(block["entry_id"], block["block"], block["parent"]))
    parent = np.fromiter((at.get(k, -1) if k[2] is not None else -1 for k in wanted), dtype=np.int64, count=len(keys))
    forest = WeightedForest(parent)
    ids = block["style_id"].to_numpy(dtype=object)
    up = block["parent"].to_numpy(dtype=object)[forest.root]
    leaves = np.fromiter((u is not None for u in up), dtype=bool, count=len(up)) & ~forest.cyclic
    out = pd.DataFrame(
        {
            "entry_id": block["entry_id"].to_numpy(),
            "style_id": ids,
            "root_id": np.where(forest.cyclic, CYCLE, ids[forest.root]),
            "depth": np.where(forest.cyclic, -1, forest.offset).astype(np.int32),
            "target": np.where(leaves, up, None),
        }
    )
    if with_path:
        known: dict[int, list[str]] = {}
        for i in np.argsort(forest.offset, kind="stable"):
            if not forest.cyclic[i]:
                known[i] = [*known[parent[i]], ids[i]] if parent[i] >= 0 else [ids[i]]
        out["path"] = [known.get(i) for i in range(len(ids))]
    return out


def _fold(batches: Iterator[pd.DataFrame], with_path: bool, rows: int) -> Iterator[pd.DataFrame]:
    """Fold sorted batches; blocks that end in a batch are worked on together."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) < rows:
            continue
        last = (held["entry_id"] == held["entry_id"].iloc[-1]) & (held["block"] == held["block"].iloc[-1])
        if not last.all():
            yield _fold_block(held[~last].reset_index(drop=True), with_path)
            held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield _fold_block(held, with_path)


def hierarchy(styles: DataFrame, with_path: bool = False, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """One row per style: ``entry_id, style_id, root_id, depth`` and, if wanted, ``path``.

    A style without a parent in its sheet is a root of depth 0.  A style on a ring, or
    whose chain runs into one, has ``root_id`` '(cycle)', ``depth`` -1 and a null path.
    Rows without ``entry_id`` or ``style_id`` name no style and are left out; repeated
    rows count once, of several states the latest ``loaded_at`` holds (null is oldest).
    An empty table gives an empty result; further columns are ignored.
    """
    links = resolve_links(styles)
    big = (
        links.groupBy("entry_id")
        .count()
        .where(F.col("count") > block_nodes)
        .select("entry_id", F.ceil(F.col("count") / block_nodes).cast("int").alias("blocks"))
    )
    blocks = links.join(big, "entry_id", "left").withColumn(
        "block", F.pmod(F.xxhash64("style_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    )
    schema = "entry_id bigint, style_id string, root_id string, depth int, target string" + ", path array<string>" * with_path
    state = cut(
        blocks.select("entry_id", "block", "style_id", "parent")
        .repartition("entry_id", "block")
        .sortWithinPartitions("entry_id", "block")
        .mapInPandas(lambda it: _fold(it, with_path, 20_000), schema)
    )
    columns = ["entry_id", "style_id", "root_id", "depth"] + ["path"] * with_path
    open_rows = state.where("target is not null")
    if open_rows.isEmpty():
        return state.select(*columns)
    return _merge(state, big, with_path).select(*columns)


def _merge(state: DataFrame, big: DataFrame, with_path: bool) -> DataFrame:
    """Resolve chains that cross blocks by pointer doubling within the divided sheets."""
    done = state.join(big.select("entry_id"), "entry_id", "left_anti")
    live = state.join(big.select("entry_id"), "entry_id", "left_semi")
    largest = live.groupBy("entry_id").count().agg(F.max("count")).first()[0]
    for _ in range(math.ceil(math.log2(largest + 1)) + 1):
        ahead = live.select(
            "entry_id",
            F.col("style_id").alias("target"),
            F.col("root_id").alias("r"),
            F.col("depth").alias("d"),
            F.col("target").alias("t"),
            *[F.col("path").alias("p")] * with_path,
        )
        ring = F.col("r") == CYCLE
        moved = F.col("r").isNotNull()
        step = live.join(ahead, ["entry_id", "target"], "left").select(
            "entry_id",
            "style_id",
            F.coalesce("r", "root_id").alias("root_id"),
            F.when(ring, F.lit(-1)).when(moved, F.col("depth") + 1 + F.col("d")).otherwise(F.col("depth")).alias("depth"),
            F.when(moved, F.col("t")).otherwise(F.col("target")).alias("target"),
            *[F.when(ring, None).when(moved, F.concat("p", "path")).otherwise(F.col("path")).alias("path")] * with_path,
        )
        live = cut(step)
        if live.where("target is not null").isEmpty():
            break
    ring = F.col("target").isNotNull()
    live = live.select(
        "entry_id",
        "style_id",
        F.when(ring, F.lit(CYCLE)).otherwise(F.col("root_id")).alias("root_id"),
        F.when(ring, F.lit(-1)).otherwise(F.col("depth")).alias("depth"),
        F.lit(None).cast("string").alias("target"),
        *[F.when(ring, None).otherwise(F.col("path")).alias("path")] * with_path,
    )
    return done.unionByName(live)


def descendants(styles: DataFrame) -> DataFrame:
    """``entry_id, ancestor_id, style_id, distance``: every style below every style.

    Styles on a ring have neither ancestors nor descendants here.
    """
    tree = hierarchy(styles, with_path=True).where("path is not null and depth > 0")
    pairs = tree.select("entry_id", "style_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return pairs.where("pos < depth").select("entry_id", "ancestor_id", "style_id", (F.col("depth") - F.col("pos")).alias("distance"))
