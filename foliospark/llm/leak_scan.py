"""Evaluation texts leaking into training text.

The word n-grams of the evaluation items form a hash set that every executor holds.
Each document is read once: its word windows are looked up in the set, hits that line
up along an item are verified word by word, and verified spans can be removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread
from .words import Hashes, shingle_hashes, word_hashes, words

#: Words of a seed.  Of 24 words with 2 changed, 14 lie in unchanged runs of 5 or more.
SEED_WORDS = 5
MIN_WORDS = 24
#: One word in so many may be changed, missing or added.
EDIT_EVERY = 10
#: Words of all items that one broadcast index may hold; more are scanned for in several blocks.
INDEX_WORDS = 5_000_000
#: Words around the seeds that are aligned as well.
MARGIN = 15
#: Words by which two neighbouring seeds of one passage may be shifted or apart.
SHIFT, APART = 12, 16


class ItemIndex:
    """The seeds of some items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        known = Hashes()
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.items = [word_hashes(words(t), known) for _, t in items]
        seeds = [shingle_hashes(h, SEED_WORDS) for h in self.items]
        flat = np.concatenate([np.empty(0, dtype=np.uint64), *seeds])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.concatenate([np.empty(0, dtype=np.int32), *[np.full(len(s), i, dtype=np.int32) for i, s in enumerate(seeds)]])[order]
        self.at = np.concatenate([np.empty(0, dtype=np.int32), *[np.arange(len(s), dtype=np.int32) for s in seeds]])[order]

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item number, place in the item and place in the document of every seed found."""
        grams = shingle_hashes(doc, SEED_WORDS)
        lo = np.searchsorted(self.seeds, grams, "left")
        n = np.searchsorted(self.seeds, grams, "right") - lo
        where = np.repeat(np.arange(len(grams)), n)
        pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.owner[pick], self.at[pick], where


def _runs(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Maximal runs of equal words ``(item start, doc start, length)`` on the diagonals ``low..high``."""
    out = []
    for diagonal in range(low, high + 1):
        i0 = max(0, -diagonal)
        n = min(len(item) - i0, len(doc) - i0 - diagonal)
        if n <= 0:
            continue
        same = np.concatenate(([False], item[i0 : i0 + n] == doc[i0 + diagonal : i0 + diagonal + n], [False])).astype(np.int8)
        turns = np.flatnonzero(np.diff(same))
        out += [(i0 + a, i0 + a + diagonal, b - a) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]
    return sorted(out)


def passage(item: np.ndarray, doc: np.ndarray, low: int, high: int, least: int = MIN_WORDS) -> tuple[int, int, int, int] | None:
    """The longest passage of the item in the document: item span and doc span, or None.

    Runs are chained; words between two chained runs count as changed, missing or added.
    A passage may begin and end with changed words as far as the allowance goes.
    """
    runs = _runs(item, doc, low, high)
    best: tuple[int, tuple[int, int, int, int]] | None = None
    for s, (i_start, d_start, length) in enumerate(runs):
        ends: dict[int, tuple[int, int, int]] = {s: (0, i_start + length, d_start + length)}
        reach = i_start + length + SHIFT
        for t in range(s + 1, len(runs)):
            ti, td, tl = runs[t]
            if ti > reach:  # the runs are in order, so no later one is near enough either
                break
            least_edits = None
            for edits, i_end, d_end in ends.values():
                over = max(0, i_end - ti, d_end - td)
                if over >= tl or ti + over - i_end > SHIFT or td + over - d_end > SHIFT:
                    continue
                total = edits + max(ti + over - i_end, td + over - d_end)
                if total * EDIT_EVERY <= ti + tl - i_start + EDIT_EVERY and (least_edits is None or total < least_edits):
                    least_edits = total
            if least_edits is not None:
                ends[t] = (least_edits, ti + tl, td + tl)
                reach = max(reach, ti + tl + SHIFT)
        for edits, i_end, d_end in ends.values():
            span = i_end - i_start
            more = max(0, least - span)
            room = min(len(item) - span, len(doc) - (d_end - d_start))
            if more <= room and (edits + more) * EDIT_EVERY <= span + more and (best is None or span > best[0]):
                best = (span, (i_start, i_end, d_start, d_end))
    return best[1] if best else None


def _clusters(at: np.ndarray, where: np.ndarray) -> Iterator[np.ndarray]:
    """Seeds of one item, split where neighbours in the document do not line up."""
    order = np.argsort(where, kind="stable")
    left = order.tolist()
    while left:
        chain, rest = [left[0]], []
        for k in left[1:]:
            prev = chain[-1]
            near = where[k] - where[prev] <= APART + SEED_WORDS and abs((where[k] - at[k]) - (where[prev] - at[prev])) <= SHIFT
            (chain if near else rest).append(k)
        yield np.array(chain)
        left = rest


def passages(index: ItemIndex, doc: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """``item id, item start, item end, doc start, doc end`` (in words) of every leaked passage."""
    owner, at, where = index.hits(doc)
    need = least - least // EDIT_EVERY - (SEED_WORDS - 1) * (least // EDIT_EVERY)
    found = []
    if len(owner) == 0:
        return found
    order = np.argsort(owner, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        if len(np.unique(at[group])) + SEED_WORDS - 1 < need:
            continue
        item = index.items[owner[group[0]]]
        for chain in _clusters(at[group], where[group]):
            a, w = at[group][chain], where[group][chain]
            if len(np.unique((a[:, None] + np.arange(SEED_WORDS)).ravel())) < need:
                continue
            i0, i1 = max(0, int(a.min()) - MARGIN), min(len(item), int(a.max()) + SEED_WORDS + MARGIN)
            d0, d1 = max(0, int(w.min()) - MARGIN), min(len(doc), int(w.max()) + SEED_WORDS + MARGIN)
            shift = (w - a) - (d0 - i0)
            hit = passage(item[i0:i1], doc[d0:d1], int(shift.min()) - 4, int(shift.max()) + 4, least)
            if hit:
                found.append((int(index.ids[owner[group[0]]]), hit[0] + i0, hit[1] + i0, hit[2] + d0, hit[3] + d0))
    return found


def _scan(batches: Iterator[pd.DataFrame], index, least: int) -> Iterator[pd.DataFrame]:
    known = Hashes()
    for batch in batches:
        rows = [
            (doc_id, key, *hit)
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"])
            for hit in passages(index.value, word_hashes(words(text), known), least)
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "item_from", "item_to", "doc_from", "doc_to"])


def item_blocks(spark: SparkSession, items: DataFrame, index_words: int = INDEX_WORDS) -> Iterator:
    """Broadcast indexes over blocks of the items, each of a checked size."""
    texts = items.select("item_id", "text").where("item_id is not null and text is not null")
    total = texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // index_words))
    for b in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect() if blocks > 1 else texts.collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in rows]))


def leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, index_words: int = INDEX_WORDS, keyed: bool = False) -> DataFrame:
    """``doc_id, item_id`` and the word spans of every leaked passage.

    A passage is ``least`` or more consecutive words of the item of which at most one in
    ten is changed, missing or added; case, spacing and punctuation do not count.  Null
    and empty texts leak nothing, repeated rows give repeated passages, empty tables an
    empty result; whole texts are read, whatever their length.  Items above
    ``index_words`` words are scanned for in several blocks.  ``keyed`` adds the digest of
    the text as ``text_key``.
    """
    schema = "doc_id bigint, text_key string, item_id bigint, item_from int, item_to int, doc_from int, doc_to int"
    key = F.md5("text") if keyed else F.lit("")
    docs = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).withColumn("text_key", key)
    found = None
    for index in item_blocks(documents.sparkSession, items, index_words):
        part = docs.mapInPandas(lambda it, index=index: _scan(it, index, least), schema)
        found = part if found is None else found.unionByName(part)
    return found if keyed else found.drop("text_key")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given spans of words; what no blank separates goes together."""
    gone = {k for a, b in spans for k in range(a, b)}
    out, at = [], 0
    for piece in re.split(r"(\s+)", text):
        n = len(words(piece))
        if not any(k in gone for k in range(at, at + n)):
            out.append(piece)
        at += n
    return re.sub(r"[^\S\n]{2,}", " ", "".join(out))


def _scrub(batches: Iterator[pd.DataFrame], drop_share: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, hits in zip(batch["doc_id"], batch["text"], batch["hits"]):
            spans = [(h["doc_from"], h["doc_to"]) for h in hits]
            gone = {k for a, b in spans for k in range(a, b)}
            whole = len(gone) > drop_share * len(words(text))
            rows.append((doc_id, "drop" if whole else "cut", len({h["item_id"] for h in hits}), None if whole else _without(text, spans)))
        yield pd.DataFrame(rows, columns=["doc_id", "action", "n_items", "clean_text"])


def cleaned(documents: DataFrame, items: DataFrame, drop_share: float = 0.5, index_words: int = INDEX_WORDS) -> DataFrame:
    """``doc_id, action, n_items, clean_text``: documents with leaks, cut or dropped.

    Leaked spans are removed; a document of which more than ``drop_share`` of the words
    leaked is dropped as a whole (``clean_text`` null).  The spans of all blocks of items
    are put together first, so the number of blocks does not change the result.  Texts are
    told apart by id and text; repeated rows come out repeatedly.
    """
    found = leaks(documents, items, index_words=index_words, keyed=True)
    # A document has as many passages at most as its words and the items allow; the words of one text.
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("item_id", "doc_from", "doc_to")).alias("hits"))
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("text_key", F.md5("text"))
    return texts.join(spans, ["doc_id", "text_key"]).select("doc_id", "text", "hits").mapInPandas(
        lambda it: _scrub(it, drop_share), "doc_id bigint, action string, n_items int, clean_text string"
    )
