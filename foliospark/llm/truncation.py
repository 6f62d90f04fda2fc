"""Text cut off by field limits.

Near-copies are found by min-hash banding over five-word shingles, of the whole texts and
of their beginnings in growing lengths, as a cut copy is like the beginning of the other.
Pairs are verified by the share of the shorter text's shingles that the other holds, and
aligned; the copy whose alignment ends early, inside a word or line of the other, is
flagged.  All other texts are scored by the terminality of their closing words: how
often, over the whole corpus, the same last words end a line rather than go on.  Marks of
omission, broken units and words known nowhere else never end a text, so their
terminality is nil.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import both_sides, broadcast_if_small, cut, salted_pairs, spread
from .filters import filter_of
from .words import Hashes, mix, shingle_hashes, word_hashes, words

BANDS, BAND_ROWS = 8, 3
SHINGLE = 5
#: Share of the shorter text's shingles that a near-copy holds.
SIMILARITY = 0.8
#: Words of the shortest beginning that is compared, and how much longer each next one is.
FIRST_RUNG, RUNG_GROWTH = 8, 1.5
#: Words whose min-hashes are worked out together.
SKETCHED_WORDS = 16_384
#: Words that a near-copy which goes on may have less, through words missing inside.
SLACK = 2
#: Words at the end that tell apart texts of one band.
CLASS_WORDS = 8
#: A word counts as known to the contexts if it stands in this share of the texts, outside their last word, and as a word at
#: all if it stands in LEAST_TEXTS of them.
KNOWN_SHARE, LEAST_TEXTS = 0.0005, 3
#: A word whose capitals stand inside sentences in at least this share of the texts with capitals is a name or noun;
#: names and nouns are told apart by their case only.
NAME_SHARE = 0.2
#: Tokens of the longest closing context.
LEVELS = 6
#: Weight, in occurrences, of the next shorter context, and the share of line ends assumed before any is seen.
PRIOR_WEIGHT, PRIOR = 4.0, 0.05
#: Below this share of line ends a closing context is open.
OPEN_BELOW = 0.1
#: Words at the end of a text that are aligned with its near-copy.
TAIL_WORDS = 16
#: Signs at the end that decide whether it is broken, and hold the closing context if they hold enough tokens.
TAIL_SIGNS = 400
_OMITTED = re.compile(r"\s*(\[\s*(\.{2,}|…)\s*\]|\(\s*(\.{2,}|…)\s*\)|\.{2,}|…)\s*$")
_BROKEN = re.compile(r"(<[A-Za-z/!][^<>\n]{0,200}|\\u[0-9a-fA-F]{0,3}|�)$")
_ENTITY = re.compile(r"(.?)&(#[0-9]{0,6}|#[xX][0-9a-fA-F]{0,5}|[A-Za-z0-9]{0,12})$", re.S)
_CLOSED = re.compile(r"[.!?。？！][\"'”’»«)\]]*$")
_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
_NUMBER = re.compile(r"[\d.,]+")
_PIECE = re.compile(r"\n|[^\s]+")
_LINES = re.compile(r"\s*\n\s*")

_SEED = np.random.default_rng(20240607)
_MULT = _SEED.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _SEED.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4096)
def _parts(n_words: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Where the shingles that each longer beginning adds start, and for each row of bands the last such part and its number.

    The rows are the beginnings of FIRST_RUNG words and so on, number 0 is the whole text.
    """
    n, ends, at = n_words - SHINGLE + 1, [], float(FIRST_RUNG)
    while at <= n_words:
        ends.append(int(at) - SHINGLE + 1)
        at *= RUNG_GROWTH
    starts = [0, *(e for e in ends if e < n)]
    return tuple(starts), (*range(len(ends)), len(starts) - 1), (*range(1, len(ends) + 1), 0)


def bands(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Band digests of some texts, whose word hashes ``h`` holds one after the other: BANDS for each beginning, then BANDS for the whole.

    The last beginning comes next to last.  Texts shorter than a shingle have none.
    """
    out = [np.empty(0, dtype=np.uint64)] * len(sizes)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    group: list[int] = []
    for i in range(len(sizes) + 1):
        if group and (i == len(sizes) or offset[i] - offset[group[0]] > SKETCHED_WORDS):
            for k, found in zip(group, _bands(h[offset[group[0]] : offset[group[-1] + 1]], sizes[group[0] : group[-1] + 1])):
                out[k] = found
            group = []
        if i < len(sizes):
            group.append(i)
    return out


def _bands(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    shingles = shingle_hashes(h, SHINGLE)
    at = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    shingles = shingles[(at < np.repeat(counts, sizes))[: len(shingles)]]
    if len(shingles) == 0:
        return [np.empty(0, dtype=np.uint64)] * len(sizes)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    starts, deep, rows, numbers, lengths, base = [], [], [], [], [], 0
    for n, f in zip(sizes.tolist(), first.tolist()):
        if n < SHINGLE:
            lengths.append(0)
            continue
        here, last, number = _parts(n)
        starts += [f + x for x in here]
        deep += range(len(here))
        rows += [base + x for x in last]
        numbers += number
        lengths.append(len(last))
        base += len(here)
    with np.errstate(over="ignore"):
        mixed = shingles[:, None] * _MULT + _PLUS
        least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), np.array(starts), axis=0)
        depth = np.array(deep)
        for d in range(1, int(depth.max()) + 1):
            here = np.flatnonzero(depth == d)
            least[here] = np.minimum(least[here], least[here - 1])
        key = _BAND + np.array(numbers, dtype=np.uint64)[:, None]
        least = least[np.array(rows)]
        for row in range(BAND_ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, row::BAND_ROWS])
    return [part.ravel() for part in np.split(key, np.cumsum(lengths)[:-1])]


def split_token(token: str) -> tuple[str, str]:
    """A token's core in lower case and the signs after it."""
    _, core, tail = _EDGES.match(token).groups()
    return (core.lower(), tail) if core else (token, "")


_ENTITY_PARTS = frozenset(name[:n] for name in html5 for n in range(len(name)))


def broken(body: str) -> bool:
    """Whether a text ends inside an entity, a tag, an escape or a character.

    An ampersand within a word, as in initials, is no entity unless two letters of one follow.
    """
    if _BROKEN.search(body):
        return True
    m = _ENTITY.search(body)
    if not m:
        return False
    before, name = m.groups()
    return name.startswith("#") or name in _ENTITY_PARTS and (len(name) >= 2 or not before.isalnum())


class Tokens:
    """Token codes, in which words that the corpus hardly knows are only told apart by their case."""

    NEWLINE = np.uint64(1)

    def __init__(self, known: dict[str, bool]):
        """``known`` says of each known word whether its capitals only mark the start of a sentence."""
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.index, self.codes, self.shapes = _Index(self), [1], [1]
        self.index["\n"] = 0

    def form(self, token: str) -> str:
        core, tail = split_token(token)
        if any(c.isdigit() for c in core):
            return ("9" if _NUMBER.fullmatch(core) else "C") + tail
        first = next((c for c in token if c.isalpha()), "")
        if not first or self.known.get(core, False) or (core in self.known and not first.isupper()):
            return core + "\x00" + tail
        return ("A" if first.isupper() else "a") + tail

    def unknown(self, token: str) -> bool:
        """Whether a lower-case word stands nowhere else."""
        core, _ = split_token(token)
        first = next((c for c in token if c.isalpha()), "")
        return first.islower() and core not in self.known and not any(c.isdigit() for c in core)

    def shape(self, token: str) -> str:
        core, tail = split_token(token)
        if any(c.isdigit() for c in core):
            return ("9" if _NUMBER.fullmatch(core) else "C") + tail
        first = next((c for c in token if c.isalpha()), "")
        return ("A" if first.isupper() else "a") + tail if first else token

    def arrays(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the tokens and of their shapes."""
        if len(self.codes) > 400_000:
            self.clear()
        at = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        some, place = np.unique(at, return_inverse=True)
        return tuple(np.array([values[i] for i in some.tolist()], dtype=np.uint64)[place] for values in (self.codes, self.shapes))


class _Index(dict):
    """The place of each token among the codes."""

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, token: str) -> int:
        own = self.tokens
        own.codes.append(xxhash.xxh3_64_intdigest(own.form(token)) | 2)
        own.shapes.append(xxhash.xxh3_64_intdigest(own.shape(token)) | 2)
        at = self[token] = len(own.codes) - 1
        return at


def pieces(text: str) -> list[str]:
    """Tokens and line ends, the first line led by a line end; blank lines count once."""
    return ["\n", *_PIECE.findall(_LINES.sub("\n", text.strip()))]


def contexts(codes: np.ndarray, shapes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of one to LEVELS tokens that end at each token, then of the short line so far.

    The last one is a token with the shapes of all tokens before it in its line; it is 0
    where these are more than LEVELS.
    """
    n = len(codes)

    def earlier(values: np.ndarray, back: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.uint64)
        out[back:] = values[: max(0, n - back)]
        return out

    with np.errstate(over="ignore"):
        out = [mix(codes + np.uint64(0x51ED270B))]
        for back in range(1, LEVELS):
            out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + earlier(codes, back) + np.uint64(back)))
        place = np.arange(n)
        depth = place - np.maximum.accumulate(np.where(codes == Tokens.NEWLINE, place, 0))
        line = mix(codes + np.uint64(0x2545F491))
        for back in range(1, LEVELS + 1):
            line = np.where(back <= depth, mix(line * np.uint64(0x9E3779B97F4A7C15) + earlier(shapes, back) + np.uint64(back)), line)
    return [*out, np.where((depth > 0) & (depth <= LEVELS), line, np.uint64(0))]


class _Facts(dict):
    """Of each token: its core, whether it has letters, whether it begins with a capital, and whether a sentence begins after it (None: as before)."""

    def __missing__(self, token: str) -> tuple[str, bool, bool, bool | None]:
        if len(self) > 400_000:
            self.clear()
        head = next((c for c in token if c.isalpha()), "")
        stop = token[-1] in ".!?:"
        after = stop if head else (stop and len(token) > 3 if any(c.isdigit() for c in token) else None)
        found = self[token] = (split_token(token)[0], bool(head), head.isupper(), after)
        return found


def _known_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    facts = _Facts()
    counts: dict[str, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(w, *n) for w, n in counts.items()], columns=["word", "texts", "first", "inner"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            start, seen = True, set()
            for t in pieces(text)[:-1]:
                if t == "\n":
                    start = True
                    continue
                core, word, capital, after = facts[t]
                if word:
                    seen.add((core, (1 if start else 2) if capital else 0))
                if after is not None:
                    start = after
            for word in {w for w, _ in seen}:
                counts.setdefault(word, [0, 0, 0])[0] += 1
            for word, kind in seen:
                if kind:
                    counts[word][kind] += 1
        if len(counts) > 200_000:
            yield flush()
    yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, texts, first, inner``: in how many texts each word stands outside the last place, with a capital at a sentence start, and inside."""
    return (
        texts.select("text")
        .mapInPandas(_known_words, "word string, texts bigint, first bigint, inner bigint")
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in ("texts", "first", "inner")])
        .where(F.col("texts") >= LEAST_TEXTS)
    )


def known_words(counts: DataFrame, n_texts: int) -> dict[str, bool]:
    """Words in at least KNOWN_SHARE of the texts, and whether their capitals only mark the start of a sentence.

    A text has so many different words at most as it has tokens, so texts of ``w`` tokens
    on average know ``w / KNOWN_SHARE`` words at most, whatever their number.
    """
    often = counts.where(F.col("texts") >= max(LEAST_TEXTS, int(KNOWN_SHARE * n_texts)))
    return {r[0]: r[1] for r in often.select("word", F.col("inner") < NAME_SHARE * (F.col("first") + F.col("inner"))).collect()}


def _ending(batches: Iterator[pd.DataFrame], known) -> Iterator[pd.DataFrame]:
    tokens, seen = Tokens(known.value), Hashes()
    place = np.arange(1, CLASS_WORDS + 1, dtype=np.uint64)
    for batch in batches:
        plain = [words(text) for text in batch["text"]]
        sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        hashes = word_hashes(list(chain.from_iterable(plain)), seen)
        ends = np.cumsum(sizes)
        rows = []
        for doc_id, key, text, own, n, end, digests in zip(batch["doc_id"], batch["text_key"], batch["text"], plain, sizes.tolist(), ends.tolist(), bands(hashes, sizes)):
            body = text.rstrip()
            state, levels, rare = "closed", [], None
            close = body[-TAIL_SIGNS:]  # no pattern of an end is longer
            if _OMITTED.search(close):
                state = "omitted"
            elif broken(close):
                state = "broken"
            elif not _CLOSED.search(close):
                tail = pieces(close if len(close) < len(body) and len(close.split()) > LEVELS + 1 else body)[-LEVELS - 1 :]
                state = "open"
                rare = split_token(tail[-1])[0] if tokens.unknown(tail[-1]) else None
                at = contexts(*tokens.arrays(tail))
                levels = [int(c[-1].view(np.int64)) for c in [*at[: min(len(tail), 3)], at[-1], *at[3 : min(len(tail), LEVELS)]] if c[-1]]
            last = hashes[max(end - n, end - CLASS_WORDS) : end]
            with np.errstate(over="ignore"):
                end_key = int((last * place[: len(last)]).sum(dtype=np.uint64).view(np.int64)) if n else 0
            digests = digests.view(np.int64)
            # The bands under which a text looks for others: those of its longest beginning and of the whole.
            rows.append((doc_id, key, n, own[-1][:64] if own else "", end_key, digests, digests[-2 * BANDS :] if state != "closed" else digests[:0], state, rare, levels))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_words", "last_word", "end_key", "bands", "own", "state", "rare", "levels"])


def endings(texts: DataFrame, known: dict[str, bool]) -> DataFrame:
    """How each text ends, its min-hash bands and the hashes of its closing contexts."""
    shared = texts.sparkSession.sparkContext.broadcast(known)
    return texts.mapInPandas(
        lambda it: _ending(it, shared),
        "doc_id bigint, text_key string, n_words int, last_word string, end_key bigint, bands array<bigint>, own array<bigint>, state string, rare string, levels array<bigint>",
    )


def _count(batches: Iterator[pd.DataFrame], known, wanted) -> Iterator[pd.DataFrame]:
    tokens, some = Tokens(known.value), wanted.value
    for batch in batches:
        tokens_here: list[str] = []
        for text in batch["text"]:
            tokens_here += pieces(text)
        code, shape = tokens.arrays([*tokens_here, "\n"])
        ends = np.concatenate((code[1:] == Tokens.NEWLINE, [True]))
        found, use = [], np.arange(len(code))
        *nested, line = contexts(code, shape)
        for level in nested:
            # A text that closes with a context also closes with each shorter one.
            use = use[some.has(level[use])]
            found.append((level[use], ends[use]))
        use = np.flatnonzero(some.has(line) & (line != 0))
        found.append((line[use], ends[use]))
        h, e = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        keys, place = np.unique(h, return_inverse=True)
        yield pd.DataFrame({"h": keys.view(np.int64), "seen": np.bincount(place, minlength=len(keys)), "ended": np.bincount(place, weights=e, minlength=len(keys)).astype(np.int64)})


def context_counts(texts: DataFrame, ends: DataFrame, known: dict[str, bool]) -> DataFrame:
    """``h, seen, ended``: occurrences, and those at a line end, of all contexts some text closes with.

    A filter keeps most other contexts out of the shuffle; the counts do not depend on it.
    """
    context = texts.sparkSession.sparkContext
    levels = ends.where("state = 'open'").select(F.explode("levels").alias("h")).distinct()
    shared, wanted = context.broadcast(known), context.broadcast(filter_of(levels, "h"))
    return (
        texts.select("text")
        .mapInPandas(lambda it: _count(it, shared, wanted), "h bigint, seen bigint, ended bigint")
        .groupBy("h")
        .agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    )


def open_endings(ends: DataFrame, counts: DataFrame) -> DataFrame:
    """``text_key, terminality``: how often the closing words of an open text end a line.

    Shares of line ends are taken over from the shorter context to the longer one, each
    weighing more the more often it was seen.  The text itself and its copies do not count.
    """
    copies = ends.where("state = 'open'").groupBy("text_key").agg(F.first("levels").alias("levels"), F.count(F.lit(1)).alias("copies"))
    wanted = copies.select("text_key", "copies", F.posexplode("levels").alias("level", "h"))
    seen = wanted.join(counts, "h").groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("level", (F.col("seen") - F.col("copies")).alias("seen"), (F.col("ended") - F.col("copies")).alias("ended")))).alias("steps")
    )  # LEVELS values for a text
    share = F.aggregate("steps", F.lit(PRIOR), lambda p, s: (s["ended"] + F.lit(PRIOR_WEIGHT) * p) / (s["seen"] + F.lit(PRIOR_WEIGHT)))
    return seen.select("text_key", share.alias("terminality"))


def _placed(text: str) -> list[tuple[str, int, int]]:
    """The words of a text in lower case without signs around them, and where they start and end."""
    return [(core.lower(), m.start(), m.end()) for m in re.finditer(r"\S+", text) if (core := _EDGES.match(m.group()).group(2))]


def aligned_end(tail: list[str], whole: list[str]) -> int | None:
    """The place in ``whole`` of the last word of ``tail``, aligned at the least edits; the last one if there are several.

    The last word must be there or be the start of the word there; of the others a quarter may be edited.
    """
    ends = np.array([w.startswith(tail[-1]) for w in whole], dtype=bool)
    if not ends.any():
        return None
    place = np.arange(len(whole) + 1)
    cost = np.zeros(len(whole) + 1, dtype=np.int64)
    other = np.array(whole, dtype=object)
    for word in tail[:-1]:
        step = cost + 1
        step[1:] = np.minimum(step[1:], cost[:-1] + (other != word))
        cost = place + np.minimum.accumulate(step - place)
    at = np.where(ends, cost[:-1], len(tail))
    best = int(at.min())
    return None if 4 * best > len(tail) else int(np.flatnonzero(at == best)[-1])


def ends_early(short: str, long: str) -> bool:
    """Whether the other text goes on, inside a word or line, where ``short`` ends.

    The last signs are looked for as they are; if they are not there, the last words are aligned.
    """
    body = _OMITTED.sub("", short.rstrip())
    if _CLOSED.search(body) or not body:
        return False
    for back in (60, 30):
        tail = body[-back:]
        at = long.rfind(tail)
        if at >= 0:
            rest = long[at + len(tail) :]
            return bool(rest) and not rest.startswith("\n") and bool(rest.strip())
    return _aligned_early(body, long)


def _aligned_early(body: str, long: str) -> bool:
    ours, theirs = _placed(body)[-TAIL_WORDS:], _placed(long)
    end = aligned_end([w for w, _, _ in ours], [w for w, _, _ in theirs]) if ours and theirs else None
    if end is None:
        return False
    last, (word, start, stop) = ours[-1][0], theirs[end]
    if word != last:
        return True
    rest = long[stop:]
    if not rest.strip():
        return False
    # Where the same words end a line in one text only, lines are wrapped otherwise, and only a blank line ends one.
    lines = lambda text, at: {a[0]: "\n" in text[a[2] : b[1]] for a, b in zip(at, at[1:])}
    a, b = lines(body, ours), lines(long, theirs[max(0, end + 1 - TAIL_WORDS) : end + 1])
    wrapped = any(a[w] != b[w] for w in a.keys() & b.keys())
    return not re.match(r"[^\S\n]*\n[^\S\n]*\n" if wrapped else r"[^\S\n]*\n", rest)


def _align(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    seen = Hashes()
    for batch in batches:
        out = []
        for a, b in zip(batch["text_a"], batch["text_b"]):
            sa, sb = (np.unique(shingle_hashes(word_hashes(words(t), seen), SHINGLE)) for t in (a, b))
            near = len(np.intersect1d(sa, sb, assume_unique=True)) >= similarity * min(len(sa), len(sb))
            out.append((near, near and ends_early(a, b)))
        yield batch[["key_a", "key_b"]].assign(near=[x[0] for x in out], early=[x[1] for x in out])


def _in_bands(batches: Iterator[pd.DataFrame], wanted) -> Iterator[pd.DataFrame]:
    some = wanted.value
    for batch in batches:
        sizes = batch["bands"].map(len).to_numpy()
        digest = np.concatenate([np.empty(0, dtype=np.int64), *batch["bands"]])
        owner = np.repeat(np.arange(len(batch)), sizes)
        kept = some.has(digest.view(np.uint64))
        yield batch.drop(columns="bands").iloc[owner[kept]].assign(band=digest[kept])


def _band_counts(batches: Iterator[pd.DataFrame], wanted) -> Iterator[pd.DataFrame]:
    some = wanted.value
    for batch in batches:
        digest = np.concatenate([np.empty(0, dtype=np.int64), *batch["bands"]])
        band, n = np.unique(digest[some.has(digest.view(np.uint64))], return_counts=True)
        yield pd.DataFrame({"band": band, "n": n})


def near_copies(texts: DataFrame, ends: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``key_a, key_b, near, early``: texts that are not closed, with a text of their bands that may go on where they end.

    Equal texts are one text here.  The other text must be longer, or end in a longer form
    of the same last word.  Within a band texts with the same last words are one class, and
    a text is compared with the first of the largest class first.  Only texts that do not
    prove cut by that are compared with all other texts of their bands, so a large family
    of near-copies costs one comparison for each that was cut, and no link is lost.
    """
    facts = ["text_key", "n_words", "last_word", "end_key"]
    context = texts.sparkSession.sparkContext
    wanted = context.broadcast(filter_of(ends.select(F.explode("own").alias("band")).distinct(), "band"))
    counts = ends.select("bands").mapInPandas(lambda it: _band_counts(it, wanted), "band bigint, n bigint").groupBy("band").agg(F.sum("n").alias("n"))
    # A text is in its own bands; only those that hold another row as well are looked into.
    shared = context.broadcast(filter_of(cut(counts.where("n > 1").select("band")), "band"))
    rows = "text_key string, n_words int, last_word string, end_key bigint, band bigint"
    asked, there = (cut(ends.where(F.size(c) > 0).select(*facts, F.col(c).alias("bands")).mapInPandas(lambda it: _in_bands(it, shared), rows).distinct()) for c in ("own", "bands"))
    goes_on = (F.col("left_end_key") != F.col("right_end_key")) & (
        (F.col("right_n_words") > F.col("left_n_words"))
        | (F.col("right_n_words") >= F.col("left_n_words") - SLACK)
        & F.startswith("right_last_word", "left_last_word")
        & (F.col("right_last_word") != F.col("left_last_word"))
    )
    columns = ("n_words", "last_word", "end_key")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = left.select("band", F.struct(F.lit(0).cast("bigint").alias("size"), "n_words", "text_key").alias("id"), *columns, F.lit(True).alias("is_left"))
        sides = sides.unionByName(right.select("band", F.struct("size", "n_words", "text_key").alias("id"), *columns, F.lit(False).alias("is_left")))
        found = salted_pairs(both_sides(sides, "band"), "band", goes_on, columns)
        return found.select(F.col("left_id.text_key").alias("key_a"), F.col("right_id").alias("b"))

    def compared(found: DataFrame) -> DataFrame:
        met = cut(found)
        wanted = broadcast_if_small(met.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct())
        # Only the texts that are compared are shuffled.
        whole = texts.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
        side = lambda s: whole.select(F.col("text_key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}"))
        return cut(met.join(side("a"), "key_a").join(side("b"), "key_b").mapInPandas(lambda it: _align(it, similarity), "key_a string, key_b string, near boolean, early boolean"))

    classes = there.groupBy("band", "end_key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n_words", "text_key", "last_word")).alias("t")).select("band", "end_key", "size", "t.*")
    first = compared(pairs(asked, classes).groupBy("key_a").agg(F.max("b").alias("b")).select("key_a", F.col("b.text_key").alias("key_b")))
    open_yet = first.where("not early").select(F.col("key_a").alias("text_key"))
    if open_yet.isEmpty():
        return first
    rest = pairs(asked.join(open_yet, "text_key", "left_semi"), there.withColumn("size", F.lit(0).cast("bigint"))).select("key_a", F.col("b.text_key").alias("key_b")).distinct()
    return first.unionByName(compared(rest.join(first, ["key_a", "key_b"], "left_anti")))


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id, source, reason``: every document whose text was cut, copies included.

    ``reason`` is 'copy' (a near-copy goes on), 'omitted' (a mark of omission ends it),
    'broken' (it ends inside an entity, a tag or a character), 'fragment' (the last word
    is known nowhere else) or 'open' (the closing words hardly ever end a line).
    Null and blank texts are not cut; of repeated ids each text counts; an empty table
    gives an empty result; whole texts are read.
    """
    texts = spread(documents.select("doc_id", "source", "text").where("doc_id is not null and trim(text) <> ''")).withColumn("text_key", F.md5("text"))
    counts = cut(word_counts(texts))
    known = known_words(counts, texts.count())
    ends = cut(endings(texts.select("doc_id", "text_key", "text"), known))
    scored = open_endings(ends, context_counts(texts, ends, known))
    early = near_copies(texts.select("text_key", "text"), ends).where("early").select(F.col("key_a").alias("text_key")).distinct().withColumn("copy", F.lit(True))
    words_there = counts.select(F.col("word").alias("rare"), F.lit(True).alias("word_there"))
    reason = (
        F.when(F.col("copy"), "copy")
        .when(F.col("state").isin("omitted", "broken"), F.col("state"))
        .when(F.col("rare").isNotNull() & F.col("word_there").isNull(), "fragment")
        .when((F.col("state") == "open") & (F.coalesce("terminality", F.lit(0.0)) < OPEN_BELOW), "open")
    )
    judged = ends.select("text_key", "state", "rare").join(early, "text_key", "left").join(scored, "text_key", "left").join(words_there, "rare", "left")
    # Copies of a cut text are cut as well, whatever the id.
    cut_texts = judged.withColumn("reason", reason).where("reason is not null").groupBy("text_key").agg(F.min("reason").alias("reason"))
    sources = texts.select("doc_id", "text_key", "source").distinct()
    return sources.join(cut_texts, "text_key").groupBy("doc_id", "source").agg(F.min("reason").alias("reason"))


def by_source(documents: DataFrame) -> DataFrame:
    """``source, texts, cut, share``: how often each source cuts its texts."""
    texts = documents.where("doc_id is not null and trim(text) <> ''").groupBy("source").agg(F.countDistinct("doc_id").alias("texts"))
    counts = truncated(documents).groupBy("source").agg(F.countDistinct("doc_id").alias("n"))
    return texts.join(counts, texts["source"].eqNullSafe(counts["source"]), "left").select(
        texts["source"], "texts", F.coalesce("n", F.lit(0)).alias("cut"), (F.coalesce("n", F.lit(0)) / F.col("texts")).alias("share")
    )
