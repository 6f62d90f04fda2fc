"""Same or near-same records across splits.

Near-same opening texts are found by content-defined chunks: a rolling hash over the
normalised words cuts each text, the chunk digests are joined across splits, and the
lengths of shared chunks add up to overlap fractions, of pairs and of records.  A pair
that shares at least ``CHUNK_SHARE`` of the longer text in whole chunks is verified word
by word.

Only the rarest chunks of a text enter the join of pairs: those left out add up to less
than ``CHUNK_SHARE`` of it, so a pair sharing that much shares a chunk that did enter, as
all texts rank their chunks in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import both_sides, broadcast_if_small, cut, salted_pairs, spread
from .filters import filter_of
from .names import digest_key, document_key
from .words import Hashes, lcs_length, mix, word_hashes, words

HELD_OUT = ("validation", "test")
#: A text is cut where the hash of two neighbouring words is divisible by this: three words a chunk on average.
CUT_EVERY = 3
#: Longest chunk in words; fits the low bits of a digest.
CHUNK_WORDS = 16
#: Share of the longer text that must lie in shared chunks before two texts are compared; 0 compares all pairs with a chunk in common.
CHUNK_SHARE = 0.15
#: Chunks in more than one of so many texts are ranked by how common they are; a text of ``c`` chunks bounds them by ``c * COMMON_TEXTS``.
COMMON_TEXTS = 2_000
#: Share of the longer text's words that must stand in the other in the same order.
SAME_SHARE = 0.8

_PLACE = mix(np.arange(1, CHUNK_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LENGTH = np.uint64(31)


def chunk_words(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the content-defined chunks of some texts and the number of the text of each.

    ``h`` holds the word hashes of the texts one after the other, ``sizes`` how many words
    each has, at least one.  The five lowest bits of a digest are the number of its words.
    A chunk that a text repeats has a digest of its own each time, so shared digests count
    as often as both texts hold them.
    """
    n = len(h)
    if not n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    before = np.where(first, np.uint64(0), np.concatenate(([np.uint64(0)], h[:-1])))
    with np.errstate(over="ignore"):
        hit = mix(h + before * np.uint64(3)) % np.uint64(CUT_EVERY) == 0
        opens = first | np.concatenate(([True], hit[:-1]))
        place = np.arange(n)
        depth = (place - np.maximum.accumulate(np.where(opens, place, 0))) % CHUNK_WORDS
        starts = np.flatnonzero(depth == 0)
        digest = mix(np.add.reduceat(mix(h * _PLACE[depth]), starts))
        size = np.diff(np.concatenate((starts, [n]))).astype(np.uint64)
        owner = owner[starts]
        digest = digest & ~_LENGTH | size
        order = np.lexsort((digest, owner))
        again = np.concatenate(([False], (owner[order][1:] == owner[order][:-1]) & (digest[order][1:] == digest[order][:-1])))
        if again.any():
            turn = np.arange(len(order))
            times = np.empty(len(order), dtype=np.uint64)
            times[order] = turn - np.maximum.accumulate(np.where(again, 0, turn))
            digest = np.where(times > 0, mix(digest + times * np.uint64(0xD1B54A32D192ED03)) & ~_LENGTH | size, digest)
    return digest, owner


def word_bits(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of each text as a set of 256 bits, four numbers a text."""
    bits = np.zeros((len(sizes), 4), dtype=np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), (h >> np.uint64(62)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
    return bits.view(np.int64)


_BITS = [f"bits_{i}" for i in range(4)]


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Hashes()
    for batch in batches:
        tokens = [words(text) for text in batch["lead_text"]]
        some = np.array([bool(t) for t in tokens], dtype=bool)
        tokens = [t for t in tokens if t]
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        h = word_hashes(list(chain.from_iterable(tokens)), known)
        digests, owner = chunk_words(h, sizes)
        out = batch.loc[some, ["entry_id", "is_left"]].rename(columns={"entry_id": "id"})
        out["text_key"] = [xxhash.xxh3_128_digest("\x00".join(t)) for t in tokens]
        out["n_words"] = sizes.astype(np.int32)
        for name, column in zip(_BITS, word_bits(h, sizes).T):
            out[name] = column
        each = np.split(digests.view(np.int64), np.searchsorted(owner, np.arange(1, len(tokens)))) if tokens else []
        out["digests"] = pd.Series(each, index=out.index, dtype=object)
        yield out


def chunked_texts(entries: DataFrame) -> DataFrame:
    """Entries with the key of their normalised text and its chunks; entries without words are left out."""
    texts = spread(entries.where("lead_text is not null").select("entry_id", "is_left", "lead_text"))
    bits = ", ".join(f"{b} bigint" for b in _BITS)
    return texts.mapInPandas(_chunked, f"id bigint, is_left boolean, text_key binary, n_words int, {bits}, digests array<bigint>")


def _verify(batches: Iterator[pd.DataFrame], same: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["text_a"], batch["text_b"]):
            wa, wb = words(a), words(b)
            keep.append(lcs_length(wa, wb) >= same * max(len(wa), len(wb)))
        yield batch[["a", "b", "chunk_share"]][np.array(keep, dtype=bool)]


def _rarest(batches: Iterator[pd.DataFrame], common, both, share: float) -> Iterator[pd.DataFrame]:
    """The rarest chunks of each text; those left out add up to less than ``share`` of its words.

    Of those, only what may stand on the other side as well comes out.
    """
    often, times = common.value
    there = both.value
    for batch in batches:
        sizes = batch["digests"].map(len).to_numpy()
        digest = np.concatenate([np.empty(0, dtype=np.int64), *batch["digests"]])
        owner = np.repeat(np.arange(len(batch)), sizes)
        at = np.minimum(np.searchsorted(often, digest), max(0, len(often) - 1))
        count = np.where(often[at] == digest, times[at], 0) if len(often) else np.zeros(len(digest), dtype=np.int64)
        order = np.lexsort((digest, -count, owner))
        digest, owner = digest[order], owner[order]
        so_far = np.cumsum(digest & 31)
        base = np.concatenate(([0], so_far))[np.searchsorted(owner, owner)]
        kept = so_far - base >= share * batch["n_words"].to_numpy()[owner]
        kept &= there.has(mix(digest.view(np.uint64)))
        rows = batch[["id", "train", "held"]].iloc[owner[kept]].assign(digest=digest[kept])
        sides = [rows[rows[there]].drop(columns=["train", "held"]).assign(is_left=side) for side, there in ((True, "train"), (False, "held"))]
        yield pd.concat(sides)[["digest", "id", "is_left"]]


def _mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"h": mix(np.unique(np.concatenate([np.empty(0, dtype=np.int64), *batch["digests"]])).view(np.uint64)).view(np.int64)})


def different_texts(chunked: DataFrame) -> DataFrame:
    """One row for each different text, by its smallest entry, with the sides ``train`` and ``held`` that have it.

    Only texts of several entries are shuffled.
    """
    several = broadcast_if_small(chunked.groupBy("text_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    facts = ["id", "n_words", *_BITS, "digests"]
    train, held = F.col("is_left").alias("train"), (~F.col("is_left")).alias("held")
    alone = chunked.join(several, "text_key", "left_anti").select(*facts, train, held)
    shared = chunked.join(several, "text_key", "left_semi").groupBy("text_key").agg(F.min(F.struct(*facts)).alias("t"), F.max("is_left").alias("train"), F.max(~F.col("is_left")).alias("held"))
    return alone.unionByName(shared.select("t.*", "train", "held"))


def near_same_texts(chunked: DataFrame, texts: DataFrame, same: float = SAME_SHARE, share: float = CHUNK_SHARE) -> DataFrame:
    """``a, b, chunk_share``: different texts, by their smallest entries, ``a`` in train and ``b`` held out.

    ``texts`` has the ``id`` and ``text`` of every entry.  Before two texts are compared,
    their words as bit sets must not differ in more places than the words that may differ,
    and their shared chunks must add up to ``share`` of the longer one.
    """
    distinct = different_texts(chunked)
    often = distinct.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    least = max(2, distinct.count() // COMMON_TEXTS)
    common = sorted((r[0], r[1]) for r in often.where(F.col("texts") > least).collect())
    arrays = tuple(np.array([c[i] for c in common], dtype=np.int64) for i in range(2))
    context = chunked.sparkSession.sparkContext
    # The held-out side is the smaller one; its filter keeps most chunks of train out of the join.
    held = distinct.where("held").select("digests").mapInPandas(_mixed, "h bigint")
    shared, both = context.broadcast(arrays), context.broadcast(filter_of(held, "h"))
    rare = distinct.select("id", "train", "held", "n_words", "digests").mapInPandas(lambda it: _rarest(it, shared, both, share), "digest bigint, id bigint, is_left boolean")
    kept = both_sides(rare, "digest").join(distinct.select("id", "n_words", *_BITS), "id")
    longer = F.greatest("left_n_words", "right_n_words")
    missing = lambda a, b: sum((F.bit_count(F.col(f"{a}_{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{c}")))) for c in _BITS), F.lit(0))
    may = (1 - same) * longer + 1e-9
    alike = (F.least("left_n_words", "right_n_words") >= same * longer) & (missing("left", "right") <= may) & (missing("right", "left") <= may)
    found = salted_pairs(kept, "digest", alike & (F.col("left_id") != F.col("right_id")), ("n_words", *_BITS))
    pairs = cut(found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).distinct())
    wanted = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = distinct.join(wanted, "id", "left_semi")
    side = lambda s: some.select(F.col("id").alias(s), F.col("n_words").alias(f"n_{s}"), F.col("digests").alias(f"d_{s}"))
    lengths = F.aggregate(F.array_intersect("d_a", "d_b"), F.lit(0).cast("bigint"), lambda total, d: total + d.bitwiseAND(F.lit(31).cast("bigint")))
    summed = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (lengths / F.greatest("n_a", "n_b")).alias("chunk_share"))
    summed = summed.where(F.col("chunk_share") >= share)
    whole = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    side = lambda s: whole.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    return summed.join(side("a"), "a").join(side("b"), "b").mapInPandas(lambda it: _verify(it, same), "a bigint, b bigint, chunk_share double")


def splits(manifest: DataFrame) -> DataFrame:
    """The entries of train and of the held-out splits; those without split or id are left out."""
    return manifest.where("entry_id is not null").where(F.col("split").isin("train", *HELD_OUT)).select(
        "entry_id", (F.col("split") == "train").alias("is_left"), "document", "lead_text"
    )


def relations(manifest: DataFrame, results: DataFrame, same: float = SAME_SHARE, share: float = CHUNK_SHARE) -> DataFrame:
    """``key, id, is_left, relation``: entries with the classes they belong to, in which every train entry overlaps every held-out one.

    A class of 'document' names one document, one of 'hash' has results with one digest, one
    of 'text' has a held-out text and all train texts near-same to it.  Repeated entries repeat their rows.
    """
    entries = splits(manifest)
    sides = entries.select(F.col("entry_id").alias("id"), "is_left")
    digests = results.select(F.col("entry_id").alias("id"), digest_key(F.col("pdf_hash")).alias("key")).where("key is not null").distinct()
    chunked = cut(chunked_texts(entries))
    texts = entries.select(F.col("entry_id").alias("id"), F.col("lead_text").alias("text"))
    near = cut(near_same_texts(chunked, texts, same, share).select("a", "b"))
    # Entries of equal texts share the smallest of them, which is how the near pairs name a text.
    members = chunked.select("id", "is_left", "text_key").join(chunked.groupBy("text_key").agg(F.min("id").alias("text")), "text_key").select("id", "is_left", "text")
    trained = near.join(members.where("is_left").select(F.col("text").alias("a"), "id"), "a").select(F.col("b").alias("key"), "id", F.lit(True).alias("is_left"))
    found = {
        "document": entries.select(document_key(F.col("document")).alias("key"), F.col("entry_id").alias("id"), "is_left"),
        "hash": sides.join(digests, "id").select("key", "id", "is_left"),
        "text": trained.unionByName(members.select(F.col("text").alias("key"), "id", "is_left")),
    }
    out = None
    for relation, rows in found.items():
        # Two hashes stand for the key: 128 bits.
        key = F.struct(F.xxhash64("key", F.lit(relation)), F.xxhash64(F.lit(relation), "key"))
        rows = rows.where("key is not null").select(key.alias("key"), "id", "is_left", F.lit(relation).alias("relation"))
        out = rows if out is None else out.unionByName(rows)
    return out


def cross_split_pairs(manifest: DataFrame, results: DataFrame, same: float = SAME_SHARE, share: float = CHUNK_SHARE) -> DataFrame:
    """``train_id, held_id, relation``: every overlap between train and a held-out split.

    ``relation`` is 'document' (same document named), 'hash' (results with the same
    file digest) or 'text' (near-same ``lead_text``); a pair may come out under several.
    Entries without split, null and empty names, hashes and texts overlap with nothing;
    repeated rows count once; empty tables give an empty result; further columns are ignored.
    """
    return related_pairs(relations(manifest, results, same, share)).distinct()


def related_pairs(rows: DataFrame) -> DataFrame:
    """``train_id, held_id, relation`` of the classes of :func:`relations`; a pair comes out for each class that holds it."""
    pairs = salted_pairs(both_sides(rows, "key").withColumn("id", F.struct("id", "relation")), "key")
    return pairs.select(F.col("left_id.id").alias("train_id"), F.col("right_id.id").alias("held_id"), F.col("left_id.relation").alias("relation"))


def overlap_classes(rows: DataFrame) -> DataFrame:
    """``relation, class_id, train_entries, held_entries, first_train, first_held``: the overlaps of :func:`relations` without their pairs.

    A class stands for all pairs of a train and a held-out member; one without both is left out.
    """
    train, held = F.col("is_left"), ~F.col("is_left")
    return rows.distinct().groupBy("relation", "key").agg(
        F.count_if(train).alias("train_entries"), F.count_if(held).alias("held_entries"),
        F.min(F.when(train, F.col("id"))).alias("first_train"), F.min(F.when(held, F.col("id"))).alias("first_held"),
    ).where("train_entries > 0 and held_entries > 0").withColumn("class_id", F.xxhash64("key")).drop("key")


def overlap_fractions(manifest: DataFrame) -> DataFrame:
    """``entry_id, split, source, n_words, shared_words, fraction``: how much of each held-out ``lead_text`` lies in chunks that train texts hold.

    Chunk digests are joined across splits and the lengths of the shared ones summed per
    record.  A chunk that a text repeats is shared as often as some train text holds it.
    Entries without words have no row; repeated rows count once.
    """
    chunked = cut(chunked_texts(splits(manifest)))
    train = chunked.where("is_left").select(F.explode("digests").alias("digest")).distinct()
    held = chunked.where(~F.col("is_left")).select("id", "n_words", F.explode("digests").alias("digest")).distinct()
    words_of = F.col("digest").bitwiseAND(F.lit(31).cast("bigint"))
    there = held.join(train.withColumn("there", F.lit(True)), "digest", "left")
    summed = there.groupBy("id", "n_words").agg(F.coalesce(F.sum(F.when(F.col("there"), words_of)), F.lit(0)).alias("shared_words"))
    facts = manifest.select(F.col("entry_id").alias("id"), "split", "source").distinct()
    return summed.join(facts, "id").select(F.col("id").alias("entry_id"), "split", "source", "n_words", "shared_words", (F.col("shared_words") / F.col("n_words")).alias("fraction"))


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("entry_a"), F.greatest(a, b).alias("entry_b")]


def overlap_report(rows: DataFrame, fractions: DataFrame, manifest: DataFrame) -> DataFrame:
    """``split, source, relation, pairs, entries, mean_fraction``: overlaps of the held-out entries by split and source.

    ``rows`` are those of :func:`relations`.  Pairs are counted by class, train entries
    times held-out ones; only entries with several classes of a relation are paired, to
    take off the pairs that several classes hold.  ``mean_fraction`` is the mean share of
    words in shared chunks over the reported entries that have a text.
    """
    kept = both_sides(rows.distinct(), "key").select("key", "id", "is_left", "relation", "_nl", "_nr")
    train = kept.where("is_left").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = kept.where(~F.col("is_left")).join(train, "key").groupBy("id", "relation").agg(F.sum("n").alias("n"))
    several = kept.groupBy("relation", "id").agg(F.count(F.lit(1)).alias("_keys")).where("_keys > 1").drop("_keys")
    twice = salted_pairs(kept.join(several, ["relation", "id"], "left_semi").withColumn("id", F.struct("id", "relation")), "key")
    over = twice.groupBy("left_id", "right_id").agg((F.count(F.lit(1)) - 1).alias("over")).groupBy(F.col("right_id.id").alias("id"), F.col("right_id.relation").alias("relation")).agg(F.sum("over").alias("over"))
    exact = counted.join(over, ["id", "relation"], "left").select("id", "relation", (F.col("n") - F.coalesce("over", F.lit(0))).alias("n"))
    facts = manifest.select(F.col("entry_id").alias("id"), "split", "source").distinct()
    shares = fractions.select(F.col("entry_id").alias("id"), "fraction").dropDuplicates(["id"])
    return exact.join(facts, "id").join(shares, "id", "left").groupBy("split", "source", "relation").agg(
        F.sum("n").alias("pairs"), F.countDistinct("id").alias("entries"), F.round(F.avg("fraction"), 6).alias("mean_fraction")
    )
