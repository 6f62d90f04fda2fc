"""Visually identical text with different characters, brought to one form.

Words that hold wide forms, separate accents, signs of no width or letters of another
alphabet are looked up in tries over the corpus vocabulary by a weighted edit automaton:
look-alikes, width, composition and ignorable signs cost nothing, letters that are merely
similar cost ``NEAR`` each, any other difference is visible and not allowed.  The cheapest
match, among equals the most frequent one, is the canonical spelling; words without a
match are normalised by table.  A row is a case if the path of one of its words, or the
table, had to change anything.

Every edge keeps the skeleton of a word, its letters by classes of similar ones, so words
and vocabulary are split by skeleton and each part has a trie of its own: the vocabulary
has no bound and is never broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut, spread

#: Cost of a letter that is similar only, and the most a match may cost.
NEAR, MOST = 0.25, 1.0
#: Vocabulary words of one trie, on average.
TRIE_WORDS = 20_000

# Groups of letters of the Latin, Greek and Cyrillic alphabets that look alike.
ALIKE = (
    "aа", "cϲс", "eе", "iі", "jϳј", "oοо", "pρр", "sѕ", "vν", "xχх", "yу", "hһ", "dԁ", "lӏ", "qԛ", "wԝ", "kкκ",
    "AΑА", "BΒВ", "CϹС", "EΕЕ", "FϜ", "HΗН", "IΙІ", "JͿЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥУ", "ZΖ", "ГΓ", "ПΠ", "ФΦ", "ЛΛ",
    "óό", "íί", "ëё", "ïїϊ", "ÏЇΪ", "ÁΆ", "ÓΌ", "ÍΊ", "ÉΈ",
)

# Groups of letters that are similar.
SIMILAR = ("aα", "áά", "iι", "uυ", "vѵ", "νѵ", "wω", "tτт", "mм", "bьв", "gց", "уγ")

_JOINERS = "\u200c\u200d\ufe00-\ufe0f"
_IGNORABLE = "\u00ad\u034f\u061c\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufeff"
_BLANK = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = "\uff01-\uff5e\uffe0-\uffe6"
_MARK = "\u0300-\u036f"
_SCRIPTS = ("Latin", "Greek", "Cyrillic")
#: Signs beside which joiners and variation selectors are seen: letters that join, and pictures.
_JOINED = "\u0600-\u077f\u0900-\u0dff\u0f00-\u0fff\u1000-\u109f\u1780-\u18af\ufe0f\u20e3\u2190-\u21ff\u2300-\u23ff\u25a0-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"

#: Rows with one of these need a closer look.
SUSPECT = "[" + _IGNORABLE + _JOINERS + _BLANK + _WIDE + _MARK + "]"
MIXED = "|".join(rf"\p{{Is{a}}}[\p{{M}}\p{{Cf}}]*\p{{Is{b}}}" for a in _SCRIPTS for b in _SCRIPTS if a != b)

#: Letters of the alphabets beside the Latin one; without them nothing is mixed.
OTHER_ALPHABETS = "[\\u0370-\\u03ff\\u1f00-\\u1fff\\u0400-\\u052f\\u1c80-\\u1c8f\\u2de0-\\u2dff\\ua640-\\ua69f]"

_IGNORED = re.compile(f"[{_IGNORABLE}]|(?<![{_JOINED}])[{_JOINERS}](?![{_JOINED}])")
_BLANKS = re.compile(f"[{_BLANK}]")
_WIDES = re.compile(f"[{_WIDE}]")
_MARKS = re.compile(f"[{_MARK}]")
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARK}{_IGNORABLE}{_JOINERS}])*")

#: What a letter may stand for, and at which cost.
_OTHERS: dict[str, dict[str, float]] = {}
for _groups, _cost in ((SIMILAR, NEAR), (ALIKE, 0.0)):
    for _group in _groups:
        for _sign in _group:
            _OTHERS.setdefault(_sign, {}).update({o: _cost for o in _group if o != _sign})


def _classes() -> dict[str, str]:
    """The first letter of the class of each letter, in lower case; classes join what any group holds."""
    home: dict[str, str] = {}
    for group in (*ALIKE, *SIMILAR):
        signs = {s.lower() for s in group if len(s.lower()) == 1}
        least = min({home.get(s, s) for s in signs})
        for old in {home.get(s, s) for s in signs}:
            home |= {s: least for s, h in home.items() if h == old}
        home |= dict.fromkeys(signs, least)
    return {s: h for s, h in home.items() if s != h}


_CLASS = _classes()
_CLASS_TABLE = str.maketrans(_CLASS)


def script(sign: str) -> str | None:
    """The alphabet of a letter, None for letters that belong to several or to none of the three."""
    if sign.isascii():
        return "Latin" if sign.isalpha() else None
    o = ord(sign)
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "Greek" if sign.isalpha() else None
    if 0x400 <= o <= 0x52F or 0x1C80 <= o <= 0x1C8F:
        return "Cyrillic"
    if 0xC0 <= o <= 0x24F and sign.isalpha() or 0x1E00 <= o <= 0x1EFF or sign in "ªº":
        return "Latin"
    return None


def alphabets(word: str) -> set[str]:
    return {s for s in map(script, word) if s}


@dataclass
class Unit:
    """A letter as it is written, what was done to see it as one sign, and the words' letters it may stand for."""

    sign: str
    edges: frozenset[str]
    options: dict[str, float]


def units(word: str) -> list[Unit]:
    """The letters of a word: width undone, accents put on, ignorable signs passed over.

    Letters of other alphabets are options only where the word mixes alphabets.  A sign
    whose accent has no composed form has no option.
    """
    out: list[Unit] = []
    edges: set[str] = set()
    for c in word:
        if _IGNORED.fullmatch(c):
            edges.add("ignorable")
            continue
        if _MARKS.match(c) and out:
            last = out[-1]
            sign = unicodedata.normalize("NFC", last.sign + c)
            out[-1] = Unit(sign, last.edges | {"accent"} | edges, {})
        elif _WIDES.match(c):
            out.append(Unit(unicodedata.normalize("NFKC", c), frozenset({"wide", *edges}), {}))
        else:
            out.append(Unit(c, frozenset(edges), {}))
        edges = set()
    if out and edges:
        out[-1] = Unit(out[-1].sign, out[-1].edges | edges, {})
    mixes = len(alphabets("".join(u.sign for u in out))) > 1
    for u in out:
        if len(u.sign) == 1:
            # Capitals are matched as capitals, as other letters look alike among them; vocabularies are in lower case.
            found = {u.sign.lower(): 0.0}
            for o, cost in _OTHERS.get(u.sign, {}).items() if mixes else ():
                found[o.lower()] = min(cost, found.get(o.lower(), cost))
            u.options = {o: cost for o, cost in found.items() if len(o) == 1}
    return out


def skeleton(word: str) -> str:
    """The letters of a word by classes of similar ones."""
    return "".join(u.sign for u in units(word)).lower().translate(_CLASS_TABLE)


class Trie:
    """A trie over sorted words; a node is the range of words with its prefix."""

    def __init__(self, counts: dict[str, int]):
        self.words = sorted(counts)
        self.counts = [counts[w] for w in self.words]

    def step(self, low: int, high: int, depth: int, sign: str) -> tuple[int, int]:
        """The node below ``low..high`` that is reached by ``sign``."""
        prefix = self.words[low][:depth] + sign if low < high else ""
        a = bisect_left(self.words, prefix, low, high)
        b = bisect_left(self.words, prefix + chr(0x10FFFF), a, high)
        return a, b

    def match(self, letters: list[Unit], most: float = MOST) -> tuple[str, float] | None:
        """The word that the letters look like at the least cost, of several the most frequent, ties by spelling; and its cost."""
        best: tuple[float, int, str] | None = None
        nodes = [(0, len(self.words), 0, 0.0)]
        while nodes:
            low, high, depth, cost = nodes.pop()
            if low >= high or cost > most or (best and cost > best[0]):
                continue
            if depth == len(letters):
                if len(self.words[low]) == depth:
                    found = (cost, -self.counts[low], self.words[low])
                    best = found if best is None else min(best, found)
                continue
            for sign, paid in letters[depth].options.items():
                nodes.append((*self.step(low, high, depth, sign), depth + 1, cost + paid))
        return (best[2], best[0]) if best else None


def by_table(word: str) -> str:
    """A word in the alphabet of most of its unmistakable letters, or of most of its letters."""
    found = [s for s in map(script, word) if s]
    if len(set(found)) < 2:
        return word
    sure = [script(c) for c in word if script(c) and not any(script(o) != script(c) for o in _OTHERS.get(c, ()))]
    votes = sure or found
    home = max(_SCRIPTS, key=lambda s: (votes.count(s), found.count(s), -_SCRIPTS.index(s)))
    return "".join(
        c
        if script(c) in (home, None)
        else next((o for o, _ in sorted(_OTHERS.get(c, {}).items(), key=lambda x: (x[1], not x[0].isascii(), x[0])) if script(o) == home), c)
        for c in word
    )


def _recase(plain: str, like: str) -> str:
    """``plain`` with the capitals of ``like``, which has as many letters."""
    return "".join(p.upper() if s.isupper() else p for p, s in zip(plain, like)) if len(plain) == len(like) else plain


def canonical(word: str, trie: Trie) -> tuple[str, list[str], float | None]:
    """The canonical spelling of a word, what had to be changed, and the cost of the match, None if the table was used."""
    letters = units(word)
    edges = set().union(*(u.edges for u in letters))
    plain = "".join(u.sign for u in letters)
    hit = trie.match(letters)
    if len(alphabets(plain)) > 1:
        edges.add("alphabet")
    found = _recase(hit[0], plain) if hit else by_table(plain)
    return unicodedata.normalize("NFC", found), sorted(edges), hit[1] if hit else None


def unify(text: str, words: dict[str, tuple[str, list[str]]]) -> tuple[str, list[str]]:
    """The text in canonical form and what was found in it; ``words`` are the canonical spellings of its suspect words."""
    out, kinds, at = [], set(), 0

    def between(part: str) -> str:
        for kind, pattern in (("wide", _WIDES), ("accent", _MARKS), ("ignorable", _IGNORED), ("blank", _BLANKS)):
            if pattern.search(part):
                kinds.add(kind)
        return _BLANKS.sub(" ", _IGNORED.sub("", _WIDES.sub(lambda m: unicodedata.normalize("NFKC", m.group()), part)))

    for m in _WORD.finditer(text):
        hit = words.get(m.group())
        if hit:
            kinds.update(hit[1])
            out += [between(text[at : m.start()]), hit[0]]
            at = m.end()
    out.append(between(text[at:]))
    return unicodedata.normalize("NFC", "".join(out)), sorted(kinds)


def suspects(text: str) -> set[str]:
    """Words of a text that do not consist of plain letters of one alphabet."""
    odd = re.compile(f"{_IGNORED.pattern}|[{_WIDE}{_MARK}]")
    return {w for w in set(_WORD.findall(text)) if not w.isascii() and (odd.search(w) or len(alphabets(w)) > 1)}


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, w, skeleton(w)) for key, text in zip(batch["key"], batch["text"]) for w in suspects(text)]
        yield pd.DataFrame(rows, columns=["key", "word", "skeleton"])


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word, n, skeleton``: all words of one alphabet and how often all rows hold them."""
    tokens = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    one = F.col("word").rlike(r"^(\p{IsLatin}{2,}|\p{IsGreek}{2,}|\p{IsCyrillic}{2,})$")
    counts = tokens.where(one).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("skeleton", F.translate("word", "".join(_CLASS), "".join(_CLASS.values())))


def _spell(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    trie = Trie(dict(zip(known["word"], known["n"])))
    rows = [(w, *canonical(w, trie)) for w in asked["word"]]
    return pd.DataFrame(rows, columns=["word", "spelling", "changed", "cost"])


def spellings(words: DataFrame, texts: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """``word, spelling, changed, cost``: canonical spellings of ``word, skeleton`` by the vocabulary of the texts."""
    asked = cut(words.select("word", "skeleton").distinct())
    shapes = broadcast_if_small(asked.select("skeleton").distinct())
    known = cut(vocabulary(texts).join(shapes, "skeleton", "left_semi"))
    parts = max(1, -(-max(known.count(), asked.count()) // trie_words))
    part = F.pmod(F.xxhash64("skeleton"), F.lit(parts)).alias("part")
    a, b = asked.select("word", part).groupBy("part"), known.select("word", "n", part).groupBy("part")
    return a.cogroup(b).applyInPandas(_spell, "word string, spelling string, changed array<string>, cost double")


def _unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, row_id, text, words in zip(batch["item_kind"], batch["row_id"], batch["text"], batch["words"]):
            found = {w["word"]: (w["spelling"], list(w["changed"])) for w in words} if words is not None else {}
            done, kinds = unify(text, found)
            if kinds:
                rows.append((kind, row_id, done, kinds))
        yield pd.DataFrame(rows, columns=["item_kind", "row_id", "canonical", "found"])


def suspicious(texts: DataFrame) -> DataFrame:
    """Rows that may hold other characters than it looks; the cheap tests come first."""
    text = F.col("text")
    mixed = text.rlike(OTHER_ALPHABETS) & text.rlike(MIXED)
    return texts.where((F.octet_length(text) > F.length(text)) & (text.rlike(SUSPECT) | mixed))


def unified(texts: DataFrame, trie_words: int = TRIE_WORDS, odd: DataFrame | None = None) -> DataFrame:
    """``item_kind, row_id, canonical, found``: rows whose text is made of other characters than it looks.

    ``texts`` has ``item_kind``, ``row_id`` and ``text``.  ``found`` names what the paths of
    its words and the table between them changed: 'wide', 'accent', 'ignorable', 'blank' or
    'alphabet'.  Rows in one consistent form, null and empty texts are left out; joiners of
    joining scripts and pictures, line ends and tabs stay; repeated rows come out
    repeatedly; an empty table gives an empty result; further columns are ignored.  ``odd``
    are the :func:`suspicious` rows, if they are at hand.
    """
    texts = texts.select("item_kind", "row_id", "text").where("text is not null")
    odd = (cut(spread(suspicious(texts))) if odd is None else odd).withColumn("key", F.md5("text"))
    met = cut(odd.select("key", "text").mapInPandas(_suspects, "key string, word string, skeleton string").distinct())
    spelled = broadcast_if_small(cut(spellings(met, texts, trie_words)).select("word", "spelling", "changed"))
    # The suspect words of one text.
    words = met.join(spelled, "word").groupBy("key").agg(F.collect_list(F.struct("word", "spelling", "changed")).alias("words"))
    return odd.join(words, "key", "left").select("item_kind", "row_id", "text", "words").mapInPandas(
        _unify, "item_kind string, row_id bigint, canonical string, found array<string>"
    )
