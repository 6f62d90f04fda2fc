"""Garbled text from wrong character encoding.

Words with signs beyond ASCII are classified one by one: a multinomial classifier over
hashed byte bigrams, trained on synthetically garbled words of the corpus itself,
predicts the chain of encodings a word went through.  The chain is inverted, the result
must decode strictly and must look more like the corpus than the garbled word does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut, spread

#: Words to which the classifier is fitted: the most frequent ones beyond ASCII.  Which words are known is looked up among all.
TRAINING_WORDS = 8_000
BUCKETS = 1 << 14
#: Weight of an unseen bigram.
SMOOTHING = 0.02
#: Log odds over clean text from which a chain is believed: if the result is a known word or strict UTF-8, and if it is neither.
ODDS, ODDS_ALONE = -8.0, 8.0
#: The same for a known word if the garbled one mixes alphabets in a way that looks like no ordinary word.
ODDS_MIXED = -30.0
#: Share of all occurrences of words beyond ASCII, and least number, from which a sign, or a word that is not restorable
#: to a more frequent one, is taken for granted.
GRANTED_SHARE, GRANTED = 1e-5, 3
#: Training passes; each drops from the clean words what the one before calls garbled.
PASSES = 3

# Single-byte encodings, by their names in Python.
_BYTES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253")

# Chains of (written in, read as) that garble text in practice.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", seen),) for seen in _BYTES),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "mac_roman"), ("utf-8", "mac_roman")),
    (("cp1252", "mac_roman"),),
    (("cp1252", "latin-1"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1252", "cp1250"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "cp1253"),),
    (("cp1251", "cp1252"),),
    (("cp1253", "cp1252"),),
    (("koi8-r", "cp1251"),),
)

# Letters of other alphabets that look like the Latin ones below them.
_LATIN = "aceopxyiskBEKMHPCTX" + "oiuvAEZHIKMNOPTYX"
_ALIKE = "асеорхуіѕкВЕКМНРСТХ" + "οιυνΑΕΖΗΙΚΜΝΟΡΤΥΧ"
_TO_ALIKE = {}
for _l, _a in zip(_LATIN, _ALIKE):
    _TO_ALIKE.setdefault(_l, []).append(_a)
    _TO_ALIKE.setdefault(_a, []).append(_l)

_TOKEN = re.compile(r"[^ \t\r\n]+")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_IGNORED = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_BLANKS = re.compile("([\u00a0\u2000-\u200a\u202f\u3000]+)")
_CORE = re.compile(r"^[!-/:-@\[-`{-~]*(.*?)[!-/:-@\[-`{-~]*$", re.S)


def _tables() -> dict[str, tuple[list[str], dict[str, int]]]:
    out = {}
    for name in {e for chain in CHAINS for step in chain for e in step if e != "utf-8"}:
        signs = []
        for b in range(256):
            try:
                signs.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                signs.append(chr(b))  # undefined bytes pass as control signs
        out[name] = (signs, {s: b for b, s in reversed(list(enumerate(signs)))})
    return out


_TABLES = _tables()
#: Signs of Western text, which UTF-8 may restore even if the corpus shows them nowhere else.
_WESTERN = frozenset(s for s in _TABLES["cp1252"][0] if s >= "\xa0")


def _encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    table = _TABLES[name][1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    signs = _TABLES[name][0]
    return "".join([signs[b] for b in raw])


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after it was written and read by each step of the chain, or None."""
    for written, read in chain:
        raw = _encode(text, written)
        text = None if raw is None else _decode(raw, read)
        if text is None:
            return None
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text that the chain garbled into ``text``, or None if no text was."""
    for written, read in reversed(chain):
        raw = _encode(text, read)
        text = None if raw is None else _decode(raw, written)
        if text is None:
            return None
    return text


_SEEDED = np.array([xxhash.xxh3_64_intdigest(bytes([a, b])) % BUCKETS for a in range(256) for b in range(256)], dtype=np.int32)


def bigrams(text: str) -> np.ndarray:
    """Buckets of the byte bigrams of a word, its edges included."""
    raw = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", dtype=np.uint8).astype(np.int32)
    return _SEEDED[raw[:-1] * 256 + raw[1:]]


@dataclass
class Verdict:
    """What became of a word: the number of its chain, -1 if beyond repair; the restored word."""

    chain: int
    restored: str | None

    @property
    def strict(self) -> bool:
        return bool(self.restored) and CHAINS[self.chain][0][0] == "utf-8"


def core(word: str) -> str:
    """The word in lower case without ASCII punctuation around it."""
    return _CORE.match(word).group(1).lower()


def granted(total: int) -> float:
    """Occurrences that are taken for granted among ``total`` ones."""
    return max(GRANTED, GRANTED_SHARE * total)


def sign_counts(words: dict[str, int]) -> dict[str, int]:
    """Occurrences of the signs of words."""
    out: dict[str, int] = {}
    for word, n in words.items():
        for sign in set(word):
            out[sign] = out.get(sign, 0) + n
    return out


class Classifier:
    """Multinomial model over chains; the last two classes are clean words and look-alikes.

    ``words`` are all words; :func:`judged` fits it to some of them and looks up the others.
    """

    def __init__(self, words: dict[str, int]):
        self.logs = np.zeros((len(CHAINS) + 2, BUCKETS), dtype=np.float32)
        self.memo: dict[str, Verdict | None] = {}
        self.seen: dict[str, int] = {}
        self.granted = granted(sum(words.values()))
        for word, n in words.items():
            self.seen[core(word)] = self.seen.get(core(word), 0) + n
        counts, plain = dict(words), dict(self.seen)
        forms = {word: self.forms(word) for word in words}
        for _ in range(PASSES):
            self.fit(counts, forms, sign_counts(counts))
            counts, known = {}, dict(plain)
            for word, n in words.items():
                found = self.verdict(word)
                if found is None:
                    counts[word] = n
                elif found.strict:  # strictly restored words are known from then on
                    known[core(found.restored)] = known.get(core(found.restored), 0) + n
            self.seen, self.memo = known, {}

    @staticmethod
    def forms(word: str) -> list[tuple[int, np.ndarray]]:
        """The classes a word has an example for, and the bigrams of the example."""
        out = [(-2, bigrams(word))]
        for c, chain in enumerate(CHAINS):
            bad = garble(word, chain)
            if bad is not None and bad != word and restore(bad, chain) == word:
                out.append((c, bigrams(bad)))
        draw = np.random.default_rng(xxhash.xxh3_64_intdigest(word))
        swap = draw.random(len(word)) < 0.4
        alike = "".join(_TO_ALIKE[s][int(draw.integers(len(_TO_ALIKE[s])))] if w and s in _TO_ALIKE else s for s, w in zip(word, swap))
        return out if alike == word else [*out, (-1, bigrams(alike))]

    def fit(self, counts: dict[str, int], forms: dict[str, list[tuple[int, np.ndarray]]], signs: dict[str, int]) -> None:
        """Take the clean words in ``counts`` and the occurrences of signs in clean words."""
        self.signs = {sign for sign, n in signs.items() if n >= self.granted}
        seen = np.full((len(CHAINS) + 2, BUCKETS), SMOOTHING)
        for word, n in counts.items():
            for c, places in forms[word]:
                np.add.at(seen[c], places, n)
        self.logs = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
        self.memo = {}

    def verdict(self, word: str) -> Verdict | None:
        """None for a word that was not garbled."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 200_000:
            self.memo = {}
        found = self._judge(word)
        if found is None and _IGNORED.search(word):
            found = self._judge(_IGNORED.sub("", word))
        if found is None and _BLANKS.search(word):
            parts = _BLANKS.split(word)
            each = [self._judge(p) for p in parts]
            if hit := next((v for v in each if v), None):
                found = Verdict(hit.chain, "".join(v.restored if v and v.restored else p for v, p in zip(each, parts)))
        self.memo[word] = found
        return found

    def asked(self, word: str) -> set[str]:
        """The cores whose counts the verdict on the word may depend on."""
        out = set()
        for part in {word, _IGNORED.sub("", word), *_BLANKS.split(word)}:
            if part.isascii() or "\ufffd" in part:
                continue
            scores = self.logs[:, bigrams(part)].sum(axis=1)
            near = np.flatnonzero(scores[:-2] - max(scores[-1], scores[-2]) > min(ODDS, ODDS_MIXED))
            texts = (restore(part, CHAINS[c]) for c in near)
            out |= {core(part), *(core(t) for t in texts if t is not None and t != part)}
        return out

    def _judge(self, word: str) -> Verdict | None:
        if "\ufffd" in word:
            return Verdict(-1, None)
        if word.isascii():
            return None
        here = bigrams(word)
        scores = self.logs[:, here].sum(axis=1)
        clean, often = max(scores[-1], scores[-2]), self.seen.get(core(word), 0)
        plain = not _IGNORED.search(word) and not _BLANKS.search(word)
        foreign = [s for s in word if "\u0370" <= s <= "\u052f"]
        latin = any(s.isascii() and s.isalpha() for s in word)
        odd = latin and any(s not in _TO_ALIKE for s in foreign)
        alike = latin and bool(foreign) and not odd
        least = ODDS_MIXED if odd else ODDS
        best: tuple[float, int, str] | None = None
        for c, chain in enumerate(CHAINS):
            if scores[c] - clean <= least:
                continue
            text = restore(word, chain)
            if text is None or text == word:
                continue
            known = self.seen.get(core(text), 0)
            if chain[0][0] == "utf-8":
                believed = known > often or all(s.isascii() or s in self.signs or s in _WESTERN for s in text)
            elif plain:
                odds = scores[c] - clean
                believed = (known > often and odds > (0 if len(word) == 1 else least)) or (not alike and odds > ODDS_ALONE and often < self.granted and self._better(text, here))
            else:
                believed = False
            if believed:
                value = float(scores[c]) + np.log1p(known)
                if best is None or value > best[0]:
                    best = (value, c, text)
        return None if best is None else Verdict(best[1], best[2])

    def _better(self, text: str, here: np.ndarray) -> bool:
        """Whether the restored word looks more like clean text; per bigram, as it has fewer bytes."""
        return self.logs[-2, bigrams(text)].mean() > self.logs[-2, here].mean() + 1.0


_BEYOND_ASCII = r"[^\x00-\x7F]"
_JUDGED = "word string, n bigint, trained boolean, chain int, restored string, known string"


def _tokens(text: str) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w.rlike(_BEYOND_ASCII))


def word_counts(texts: DataFrame, words: int = TRAINING_WORDS) -> DataFrame:
    """``word, n, trained``: all words beyond ASCII, how often all rows hold them, and whether the classifier is fitted to them."""
    counts = cut(texts.where(F.col("text").rlike(_BEYOND_ASCII)).select(F.explode(_tokens("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    plain = counts.where(~F.contains("word", F.lit("\ufffd")) & (F.length("word") <= 64))
    trained = plain.orderBy(F.desc("n"), "word").limit(words).select("word", F.lit(True).alias("trained"))
    return cut(counts.join(F.broadcast(trained), "word", "left").withColumn("trained", F.coalesce("trained", F.lit(False))))


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"known": [core(w) for w in batch["word"]], "seen": batch["n"]})


def _signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(sign_counts(dict(zip(batch["word"], batch["n"]))).items(), columns=["sign", "seen"])


def _asked(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    model = shared.value
    for batch in batches:
        rows = [(w, n, t, k) for w, n, t in zip(batch["word"], batch["n"], batch["trained"]) for k in (model.asked(w) or {""})]
        yield pd.DataFrame(rows, columns=["word", "n", "trained", "known"])


def _judged(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    model = shared.value
    for batch in batches:
        rows = []
        for word, n, trained, looked in zip(batch["word"], batch["n"], batch["trained"], batch["looked"]):
            model.seen, model.memo = {x["known"]: x["seen"] for x in looked}, {}
            if found := model.verdict(word):
                rows.append((word, n, trained, found.chain, found.restored, core(found.restored) if found.strict else None))
        yield pd.DataFrame(rows, columns=["word", "n", "trained", "chain", "restored", "known"])


def judged(words: DataFrame) -> DataFrame:
    """``word, n, trained, chain, restored, known``: the garbled ones among :func:`word_counts`.

    The classifier is fitted on the driver to the trained words; what it looks up is joined
    from the counts of all words, so a rare word is known like any other.
    """
    context = words.sparkSession.sparkContext
    sound = words.where(~F.contains("word", F.lit("\ufffd")))
    plain = cut(sound.mapInPandas(_cores, "known string, seen bigint").groupBy("known").agg(F.sum("seen").alias("seen")))
    counts = {r[0]: r[1] for r in words.where("trained").select("word", "n").collect()}  # at most TRAINING_WORDS
    model, forms = Classifier({}), {w: Classifier.forms(w) for w in counts}
    model.granted = granted(plain.agg(F.sum("seen")).first()[0] or 0)
    seen, clean = plain, sound

    def verdicts() -> DataFrame:
        shared = context.broadcast(model)
        asked = spread(words).mapInPandas(lambda it: _asked(it, shared), "word string, n bigint, trained boolean, known string")
        looked = asked.join(seen, "known", "left").groupBy("word", "n", "trained")
        # The cores one word asks for are at most its parts times the chains.
        return cut(looked.agg(F.collect_list(F.struct("known", F.coalesce("seen", F.lit(0)).alias("seen"))).alias("looked")).mapInPandas(lambda it: _judged(it, shared), _JUDGED))

    for _ in range(PASSES):
        signs = clean.mapInPandas(_signs, "sign string, seen bigint").groupBy("sign").agg(F.sum("seen")).collect()  # at most the signs of Unicode
        model.fit(counts, forms, {r[0]: r[1] for r in signs})
        found = verdicts()
        wrong = {r[0] for r in found.where("trained").select("word").collect()}
        counts = {r[0]: r[1] for r in words.where("trained").select("word", "n").collect() if r[0] not in wrong}
        clean = sound.join(found.select("word"), "word", "left_anti")
        seen = plain.unionByName(found.where("known is not null").select("known", F.col("n").alias("seen"))).groupBy("known").agg(F.sum("seen").alias("seen"))
    return verdicts()


def repair(text: str, verdicts: dict[str, Verdict]) -> tuple[str, list[int]]:
    """The text with every word restored that can be, and the chains met (-1: beyond repair)."""
    out, chains, at = [], [], 0
    for m in _TOKEN.finditer(text):
        if m.group().isascii():
            continue
        found = verdicts.get(m.group())
        if found:
            chains.append(found.chain)
            out += [text[at : m.start()], m.group() if found.restored is None else found.restored]
            at = m.end()
    return "".join([*out, text[at:]]), chains


def chain_name(c: int) -> str:
    return "lost" if c < 0 else ", ".join(f"{w} as {r}" for w, r in CHAINS[c])


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, row_id, text, words in zip(batch["item_kind"], batch["row_id"], batch["text"], batch["words"]):
            fixed, chains = repair(text, {w["word"]: Verdict(w["chain"], w["restored"]) for w in words})
            if chains:
                whole = -1 not in chains
                rows.append((kind, row_id, fixed if whole or fixed != text else None, whole, sorted({chain_name(c) for c in chains})))
        yield pd.DataFrame(rows, columns=["item_kind", "row_id", "restored", "whole", "chains"])


def garbled(texts: DataFrame, rows: DataFrame | None = None, words: int = TRAINING_WORDS) -> DataFrame:
    """``item_kind, row_id, restored, whole, chains``: every garbled row once for each of its texts.

    ``texts`` has ``item_kind``, ``row_id`` and ``text``.  ``restored`` is null where
    nothing could be restored, ``whole`` tells whether everything could.  Null, empty and
    plain ASCII texts are not garbled; whole texts are read; repeated rows come out
    repeatedly; an empty table gives an empty result; further columns are ignored.  The
    classifier is fitted to ``words`` words; every word is judged by the counts of all.
    ``rows`` may name those of the texts that are asked for; the words of all count nevertheless.
    """
    texts = texts.select("item_kind", "row_id", "text")
    verdicts = broadcast_if_small(judged(word_counts(texts, words)).select("word", "chain", "restored"))
    odd = (texts if rows is None else rows).where(F.col("text").rlike(_BEYOND_ASCII)).withColumn("key", F.sha2("text", 256))
    met = odd.select("key", F.explode(F.array_distinct(_tokens("text"))).alias("word")).join(verdicts, "word").dropDuplicates(["key", "word"])
    found = met.groupBy("key").agg(F.collect_list(F.struct("word", "chain", "restored")).alias("words"))  # the words of one text
    return odd.join(found, "key").select("item_kind", "row_id", "text", "words").mapInPandas(
        _mend, "item_kind string, row_id bigint, restored string, whole boolean, chains array<string>"
    )


def page_texts(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_kind, row_id, text`` of lines and chunks, rows without id or text left out."""
    a = lines.select(F.lit("line").alias("item_kind"), F.col("line_id").alias("row_id"), "text")
    b = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("row_id"), "text")
    return a.unionByName(b).where("row_id is not null and text is not null")
