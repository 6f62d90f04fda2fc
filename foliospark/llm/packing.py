"""Filling fixed-capacity containers with items.

Sizes are counted in tokens.  Dynamic programming over the histogram of all sizes chooses
the bucket boundaries with the least padding.  Token-budget batches form inside each
bucket, from the longest bucket down; the room a batch leaves is topped up with the
longest items of the shorter buckets that fit.  Planning needs the histogram only, whose
size is bounded by the capacity; items take their places by rank.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import broadcast_if_small, cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUCKETS = 32
#: Parts into which the items of one size are ranked side by side.
SALTS = 64
#: Largest capacity; the histogram and the plan on the driver have at most so many sizes.
LARGEST = 1_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer whose ranks are stored at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    shipped = SparkFiles.get(os.path.basename(path))
    encode = tokenizer(shipped if os.path.exists(shipped) else path).encode_ordinary
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encode(t)) for t in batch["text"]]})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every document with text; the vocabulary file goes to the executors with the job."""
    documents.sparkSession.sparkContext.addFile(path)
    texts = spread(documents.select("doc_id", "text").where("doc_id is not null and text <> ''"))
    return texts.mapInPandas(lambda it: _count(it, path), "doc_id bigint, tokens bigint")


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending sizes that pad the items least."""
    m = len(sizes)
    n = np.concatenate(([0], np.cumsum(counts))).astype(float)
    total = np.concatenate(([0], np.cumsum(counts * sizes))).astype(float)
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    picks = []
    for _ in range(min(buckets, m)):
        new, pick = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, m, 0, m - 1)]
        while todo:  # the best last boundary moves up with the size: halve the range each time
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            value = cost[i] + sizes[j - 1] * (n[j] - n[i]) - (total[j] - total[i])
            k = int(np.argmin(value))
            new[j], pick[j] = value[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        picks.append(pick)
        cost = new
    bounds, j = [], m
    for pick in reversed(picks):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(pick[j])
    return bounds[::-1]


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> list[tuple[int, dict[int, int]]]:
    """Fillings ``(how many containers, {size: items})`` that use up the histogram.

    Every step empties at least one size, so there are no more fillings than sizes.
    """
    left = {int(s): int(c) for s, c in zip(sizes, counts)}
    order = sorted(left)
    floors = [0, *bucket_bounds(np.asarray(sizes), np.asarray(counts), buckets)]
    out = []
    while order:
        floor = floors[bisect_right(floors, order[-1] - 1) - 1]
        filling: dict[int, int] = {}
        room = capacity
        # The batch takes items of its own bucket first, then the longest of the shorter ones that fit.
        for least in (floor, 0):
            k = bisect_right(order, room)
            while k and order[k - 1] > least:
                size = order[k - 1]
                fit = min(room // size, left[size] - filling.get(size, 0))
                if fit:
                    filling[size] = filling.get(size, 0) + fit
                    room -= fit * size
                k = bisect_right(order, min(room, size - 1))
        times = min(left[s] // n for s, n in filling.items())
        out.append((times, filling))
        for s, n in filling.items():
            left[s] -= times * n
            if not left[s]:
                del order[bisect_left(order, s)]
    return out


def _place(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    table = shared.value
    for batch in batches:
        out = np.zeros(len(batch), dtype=np.int64)
        size, rank = batch["tokens"].to_numpy(), batch["rank"].to_numpy()
        for s in np.unique(size):
            here = size == s
            first, container, each = table[int(s)]
            i = np.searchsorted(first, rank[here], "right") - 1
            out[here] = container[i] + (rank[here] - first[i]) // each[i]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "piece_no": batch["piece_no"], "first_token": batch["first_token"], "tokens": size, "container_id": out})


def pack(sized: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """``container_id, doc_id, piece_no, first_token, tokens``: every item in a container of ``capacity`` tokens.

    Only an item above the capacity is split, into full containers and a rest.  Items of
    equal size are told apart by id, so the result does not depend on partitions.
    """
    if not 0 < capacity <= LARGEST:
        raise ValueError(f"capacity must be between 1 and {LARGEST}")
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))
    items = (
        sized.where("tokens > 0")
        .select("doc_id", F.col("tokens").alias("all"), pieces.alias("piece_no"))
        .select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("all") - F.col("piece_no") * capacity).cast("bigint").alias("tokens"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int"))
    )
    parts = items.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = sorted((int(r[0]), int(r[1])) for r in parts.groupBy("tokens").agg(F.sum("n")).collect())  # at most `capacity` rows
    sizes, counts = np.array([h[0] for h in histogram], dtype=np.int64), np.array([h[1] for h in histogram], dtype=np.int64)
    table: dict[int, tuple[list, list, list]] = {int(s): ([], [], []) for s in sizes}
    used, container = dict.fromkeys(table, 0), 0
    for times, filling in plan(sizes, counts, capacity, buckets) if len(sizes) else []:
        for s, n in filling.items():
            for column, value in zip(table[s], (used[s], container, n)):
                column.append(value)
            used[s] += times * n
        container += times
    shared = sized.sparkSession.sparkContext.broadcast({s: tuple(np.array(c, dtype=np.int64) for c in columns) for s, columns in table.items()})
    before = F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("tokens", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("rank", rank.cast("bigint")).join(offsets, ["tokens", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    return ranked.select("doc_id", "piece_no", "first_token", "tokens", "rank").mapInPandas(
        lambda it: _place(it, shared), "doc_id bigint, piece_no int, first_token bigint, tokens bigint, container_id bigint"
    )


def pack_all(documents: DataFrame, budgets: DataFrame, path: str = TOKENIZER, buckets: int = BUCKETS, most: int = 100) -> DataFrame:
    """:func:`pack` for each row of ``budgets`` (at most ``most``), with its ``budget_id`` in front.

    Null and empty texts fill nothing; of repeated ids each row is an item; budgets
    without a capacity are left out; empty tables give an empty result.
    """
    rows = budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} budgets")
    sized = cut(token_counts(documents, path))
    found = None
    for budget_id, capacity in sorted((r[0], r[1]) for r in rows):
        part = pack(sized, capacity, buckets).select(F.lit(budget_id).alias("budget_id"), "container_id", "doc_id", "piece_no", "first_token", "tokens")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = pack(sized.limit(0), 1).select(F.lit(None).cast("int").alias("budget_id"), "container_id", "doc_id", "piece_no", "first_token", "tokens")
    return found


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget_id, containers, tokens, filled``: how full the containers are."""
    used = packed.groupBy("budget_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(broadcast_if_small(budgets.select("budget_id", "capacity_tokens").distinct()), "budget_id").select(
        "budget_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled")
    )
