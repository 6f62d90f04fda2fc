"""Splitting oversized items at natural boundaries.

Between the sentences of a text the lexical cohesion is measured: the cosine of the
words in the blocks before and after each gap.  Valleys of that curve mark topic
boundaries.  Each piece ends at the deepest valley its size window holds; where a window
holds no sentence end, lines, words and at last signs are cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..operators.hierarchy import latest_wide
from ..runtime import blank_trim, broadcast_if_small

#: Words of the blocks that are compared before and after a gap.
BLOCK_WORDS = 40
#: Share of the window that a piece fills at least, if a boundary allows it.
LEAST_FILLED = 0.4
#: How much deeper than any valley a paragraph end counts.
PARAGRAPH_BONUS = 0.25

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|\n\s*")
_LINE = re.compile(r"\n+")
_SPACE = re.compile(r"\s+")


def gaps(text: str) -> list[int]:
    """Offsets at which a sentence or line begins, except the first."""
    return [m.end() for m in _SENTENCE.finditer(text) if m.end() < len(text)]


def valleys(text: str, at: list[int]) -> np.ndarray:
    """Depth of the cohesion valley at each gap: how far similarity rises on both sides."""
    places = [m.start() for m in _WORD.finditer(text)]
    tokens = [w.lower() for w in _WORD.findall(text)]
    cosine = np.ones(len(at))
    for i, g in enumerate(np.searchsorted(places, at)):
        a, b = Counter(tokens[max(0, g - BLOCK_WORDS) : g]), Counter(tokens[g : g + BLOCK_WORDS])
        norm = np.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        cosine[i] = sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0

    def rise(values: np.ndarray) -> np.ndarray:
        """How far the curve fell on its way to each value from the nearest peak before."""
        out, peak = np.zeros(len(values)), 0.0
        for i, v in enumerate(values):
            if i == 0 or v >= values[i - 1]:
                peak = v
            out[i] = peak - v
        return out

    depth = rise(cosine) + rise(cosine[::-1])[::-1]
    paragraph = np.fromiter(("\n\n" in text[max(0, g - 4) : g] for g in at), dtype=bool, count=len(at))
    return depth + PARAGRAPH_BONUS * paragraph


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int | None:
    ends = [m.end() for m in pattern.finditer(text, low, high)]
    return ends[-1] if ends else None


def cut_points(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``: each within ``most`` signs, each beginning ``overlap`` before the last one's end."""
    if len(text) <= most:
        return [(0, len(text))]
    overlap = min(max(overlap, 0), most - 1)
    at = gaps(text)
    depth = valleys(text, at)
    places = np.array(at, dtype=np.int64)
    spans, start, end = [], 0, 0
    while len(text) - start > most:
        high = start + most
        low = end + max(1, int(LEAST_FILLED * (high - end)))
        first, last = np.searchsorted(places, low, "left"), np.searchsorted(places, high, "right")
        if first < last:
            end = int(places[last - 1 - int(np.argmax(depth[first:last][::-1]))])  # the last of equally deep ones
        else:
            end = _last(_LINE, text, low, high) or _last(_SPACE, text, low, high) or high
            while end > low and end < len(text) and unicodedata.combining(text[end]):
                end -= 1
        spans.append((start, end))
        start = end - overlap
    return [*spans, (start, len(text))]


@F.pandas_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def _spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, most, overlap in batches:
        yield pd.Series(
            [None if t is None else [{"start": a, "end": b} for a, b in cut_points(t, int(m), int(o))] for t, m, o in zip(texts, most, overlap)], dtype=object
        )


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks with the ``max_chars`` and ``overlap_chars`` of their kind, null where none holds."""
    kind = F.lower(blank_trim(F.col("kind")))
    known = limits.where("kind is not null and max_chars is not null and max_chars > 0").groupBy(kind.alias("_kind")).agg(
        F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars")
    )
    return chunks.withColumn("_kind", F.lower(blank_trim(F.col("metadata.kind")))).join(broadcast_if_small(known), "_kind", "left").drop("_kind")


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id, piece_no, n_pieces, start, end, text, metadata``: all chunks, oversized ones in pieces.

    A chunk with more signs (code points) than the limit of its kind is cut into pieces
    within the limit; each piece but the first begins ``overlap_chars`` before the end of
    the one before, as specified even inside a word (an overlap that leaves no room is
    taken as one sign less than the limit).  Other chunks come out as one piece.  Of resent
    chunks the latest ``made_at`` counts; chunks without id or text are left out; kinds
    that are null, unknown or without limit are not cut; an empty text is one empty piece;
    an empty table gives an empty result.
    """
    rows = chunks.select("chunk_id", "text", "metadata", "made_at").where("chunk_id is not null and text is not null")
    sized = with_limits(latest_wide(rows, ["chunk_id"], "made_at"), limits)
    over = F.coalesce(F.length("text") > F.col("max_chars"), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    # Texts within their limit do not leave the JVM; the others are cut once, wherever the result is used.
    cut_up = sized.withColumn("spans", _spans.asNondeterministic()(F.when(over, F.col("text")), F.coalesce("max_chars", F.lit(0)), F.coalesce("overlap_chars", F.lit(0))))
    spans = cut_up.withColumn("spans", F.coalesce("spans", whole))
    pieces = spans.select("chunk_id", F.size("spans").alias("n_pieces"), F.posexplode("spans").alias("piece_no", "s"), "text", "metadata")
    start, end = F.col("s.start"), F.col("s.end")
    return pieces.select("chunk_id", "piece_no", "n_pieces", start.alias("start"), end.alias("end"), F.substring("text", start + 1, end - start).alias("text"), "metadata")


def oversized_ids(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id`` of the chunks that :func:`split_oversized` cuts."""
    return split_oversized(chunks, limits).where("n_pieces > 1").select("chunk_id").distinct()
