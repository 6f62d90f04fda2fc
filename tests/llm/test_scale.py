"""Results that must not depend on bounds, blocks or hot groups; planted cut copies; recall of the chunk step."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark.llm import filters, leak_scan, lookalikes, segment, split_overlap, truncation
from foliospark.llm.words import Hashes, lcs_length, word_hashes, words

DOCUMENT = "doc_id bigint, text string, source string"
RESULTS = "entry_id bigint, pdf_hash string"
MANIFEST = "entry_id bigint, document string, source string, split string, lead_text string"


def prose(draw: random.Random, n: int) -> str:
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "ra", "sto", "lit")]
    out = []
    while len(out) < n:
        sentence = [draw.choice(vocabulary) for _ in range(draw.randint(6, 14))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out)


def near(spark, rows):
    texts = spark.createDataFrame(rows, DOCUMENT).withColumn("text_key", F.md5("text"))
    ends = truncation.endings(texts.select("doc_id", "text_key", "text"), {}).cache()
    ids = {r.text_key: r.doc_id for r in texts.select("doc_id", "text_key").collect()}
    return [(ids[r.key_a], ids[r.key_b], r.early) for r in truncation.near_copies(texts.select("text_key", "text"), ends).collect()]


def contained(a: str, b: str) -> float:
    """Share of the five-word shingles of ``a`` that ``b`` holds."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a), words(b)))
    return len(x & y) / max(1, min(len(x), len(y)))


@pytest.mark.parametrize("edits", [0.0, 0.03])
def test_cut_copies_are_aligned(spark, edits):
    draw = random.Random(4)
    rows, cut = [], set()
    for i in range(100):
        full = prose(draw, draw.randint(60, 300))
        rows.append((i, full, "s"))
        tokens = full.split()[: int(len(full.split()) * draw.uniform(0.2, 0.8))]
        tokens = [draw.choice(["other", w + "x", w]) if draw.random() < edits else w for w in tokens]
        while tokens and tokens[-1].endswith("."):
            tokens.pop()
        body = " ".join(tokens)
        body = body[: len(body) - draw.randint(0, 2)]
        rows.append((1000 + i, body, "s"))
        if contained(body, full) >= truncation.SIMILARITY:
            cut.add(1000 + i)
    found = {a for a, _, early in near(spark, rows) if early}
    assert found <= cut and len(found) >= 0.9 * len(cut) and len(cut) > 60


def test_hot_family_of_near_copies(spark):
    draw = random.Random(9)
    body = prose(draw, 120)
    make = lambda i: re.sub(r"^\w+", f"Notice {i}", body) + f" signed at office {i % 7}"
    rows = [(i, make(i), "s") for i in range(300)]
    rows += [(1000 + i, re.match(rf"(\S+\s+){{{60 + i}}}\S\S", make(5000 + i)).group(), "s") for i in range(20)]
    met = near(spark, rows)
    assert {a for a, _, early in met if early} == {1000 + i for i in range(20)}
    assert len(met) < 3 * len(rows)  # not the pairs of the family


def test_closing_words_do_not_depend_on_filters(spark, monkeypatch):
    rows = spark.createDataFrame([(i, prose(random.Random(i), 40)[:-9 if i % 5 == 0 else None], f"s{i % 3}") for i in range(200)], DOCUMENT)
    want = {tuple(r) for r in truncation.truncated(rows).collect()}
    monkeypatch.setattr(filters, "FILTER_MOST", 1 << 10)
    assert {tuple(r) for r in truncation.truncated(rows).collect()} == want and want


def test_repeated_ids_keep_their_own_texts(spark):
    full = prose(random.Random(1), 80)
    rows = spark.createDataFrame([(1, full, "s"), (2, full[:-30], "s"), (1, "Something else [...]", "s")], DOCUMENT)
    assert {r.doc_id for r in truncation.truncated(rows).collect()} == {1, 2}


def test_clean_over_blocks_is_clean_over_one(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(6)], "item_id bigint, text string")
    rows = [(i, "keep this " + " ".join(f"i{j}w{k}" for j in (i, (i + 1) % 6) for k in range(5, 35)) + " and that " * 20, "s") for i in range(6)]
    docs = spark.createDataFrame([*rows, (7, None, "s"), (0, "another text", "s")], DOCUMENT)
    one, many = (sorted(map(tuple, leak_scan.cleaned(docs, items, index_words=n).collect())) for n in (10_000, 50))
    assert one == many and len(one) == 6 and all(r[2] == 2 for r in one)


def test_tries_of_any_size_give_the_same(spark):
    rows = [("line", i, t, "x") for i, t in enumerate(["page counter", "страница печать", "καλημέρα σελίδα"] * 9)]
    rows += [("line", 100, "pаgе", "x"), ("line", 101, "cтpaница", "x"), ("line", 102, "ｐａｇｅ соunter", "x"), ("line", 103, "kαλημέρα", "x"), ("line", 104, "q́x", "x")]
    texts = spark.createDataFrame(rows, "item_kind string, row_id bigint, text string, word string")
    few, many = ({r.row_id: (r.canonical, tuple(r.found)) for r in lookalikes.unified(texts, n).collect()} for n in (1, 100_000))
    assert few == many
    assert {k: v[0] for k, v in few.items()} == {100: "page", 101: "страница", 102: "page counter", 103: "καλημέρα", 104: "q́x"}


def test_similar_letters_cost(spark):
    trie = lookalikes.Trie({"counter": 5, "summit": 2})
    assert lookalikes.canonical("соunter", trie) == ("counter", ["alphabet"], 0.0)
    assert lookalikes.canonical("Couпter", trie)[2] is None  # another letter is visible
    assert lookalikes.canonical("counтer", trie) == ("counter", ["alphabet"], lookalikes.NEAR)
    assert lookalikes.canonical("suммiт", trie) == ("summit", ["alphabet"], 3 * lookalikes.NEAR)
    assert lookalikes.Trie({"mmmmm": 1}).match(lookalikes.units("mммммa"[:5] + "ммм")) is None


def test_joiners_that_are_seen_stay(spark):
    texts = ["می‌خواهم", "क्‍ष", "❤️‍\U0001f525", "pa‍ge"]
    frame = spark.createDataFrame([("line", i, t) for i, t in enumerate(texts)], "item_kind string, row_id bigint, text string")
    assert {r.row_id: r.canonical for r in lookalikes.unified(frame).collect()} == {3: "page"}


def test_overlap_above_half_the_limit():
    text = " ".join(f"word{i}" for i in range(60))
    spans = segment.cut_points(text, 50, 40)
    assert all(b - a <= 50 for a, b in spans) and spans[-1][1] == len(text)
    assert all(a[1] - b[0] == 40 for a, b in zip(spans, spans[1:]))
    assert [b - a for a, b in segment.cut_points("x" * 9, 3, 99)][0] == 3


def test_report_counts_match_pairs(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcdefghij") + str(draw.randint(0, 30)) for _ in range(50)) for _ in range(8)]
    splits = ["train", "validation", "test", None]
    rows = [(i, f"d{draw.randint(0, 15)}", f"s{i % 3}", splits[draw.randint(0, 3)], draw.choice([None, "", *texts])) for i in range(120)]
    files = [(draw.randint(0, 119), f"{draw.randint(0, 20):064x}") for _ in range(200)]
    manifest, results = spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, RESULTS)
    pairs = split_overlap.cross_split_pairs(manifest, results).toPandas()
    kinds = split_overlap.relations(manifest, results)
    report = split_overlap.overlap_report(kinds, split_overlap.overlap_fractions(manifest), manifest).toPandas()
    facts = {r[0]: (r[3], r[2]) for r in rows}
    want = {}
    for train, held, relation in pairs.itertuples(index=False):
        seen = want.setdefault((*facts[held], relation), [0, set()])
        seen[0] += 1
        seen[1].add(held)
    got = {(r.split, r.source, r.relation): (r.pairs, r.entries) for r in report.itertuples()}
    assert got == {k: (n, len(e)) for k, (n, e) in want.items()}
    classes = split_overlap.overlap_classes(kinds).toPandas()
    assert (classes.train_entries > 0).all() and (classes.held_entries > 0).all() and set(classes.relation) == set(pairs.relation)


def test_fractions_match_brute_force(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcde") for _ in range(draw.randint(1, 60))) for _ in range(40)]
    rows = [(i, None, "s", ["train", "test"][i % 2], t) for i, t in enumerate(texts)] + [(90, None, "s", "test", " . "), (91, None, "s", "test", None)]
    known = Hashes()
    chunks = [set(split_overlap.chunk_words(word_hashes(words(t), known), np.array([len(words(t))]))[0].tolist()) for t in texts]
    train = set().union(*chunks[::2])
    got = {r.entry_id: (r.shared_words, r.n_words) for r in split_overlap.overlap_fractions(spark.createDataFrame(rows, MANIFEST)).collect()}
    assert got == {i: (sum(d & 31 for d in chunks[i] & train), len(words(texts[i]))) for i in range(1, 40, 2)}


def test_chunks_do_not_depend_on_their_neighbours():
    texts = [f"w{i} " * (i % 40 + 1) for i in range(50)] + [" ".join(f"a{k}" for k in range(100))]
    known = Hashes()
    sizes = np.array([len(words(t)) for t in texts])
    digests, owner = split_overlap.chunk_words(word_hashes([w for t in texts for w in words(t)], known), sizes)
    for i, t in enumerate(texts):
        alone, _ = split_overlap.chunk_words(word_hashes(words(t), known), sizes[i : i + 1])
        assert alone.tolist() == digests[owner == i].tolist() and sum(d & 31 for d in alone.tolist()) == sizes[i] and len(set(alone.tolist())) == len(alone)


def edited(draw: random.Random, text: list[str], most: float) -> list[str]:
    out = list(text)
    for i in draw.sample(range(len(out)), int(len(out) * draw.uniform(0, most))):
        out[i] = draw.choice(["", "other" + str(draw.randint(0, 99)), out[i] + " more" + str(draw.randint(0, 99))])
    return words(" ".join(out))


def test_recall_of_the_chunk_step():
    """Share of near-same texts whose shared chunks reach CHUNK_SHARE, where edits are spread evenly: see README."""
    draw, known, met = random.Random(8), Hashes(), {}
    for _ in range(3000):
        a = words(prose(draw, draw.randint(50, 130)))
        b = edited(draw, a, 0.2)
        left = lcs_length(a, b) / max(len(a), len(b))
        if left < 0.8:
            continue
        x, y = (set(split_overlap.chunk_words(word_hashes(t, known), np.array([len(t)]))[0].tolist()) for t in (a, b))
        shared = sum(d & 31 for d in x & y) / max(len(a), len(b))
        met.setdefault("80-85" if left < 0.85 else "above", []).append(shared >= split_overlap.CHUNK_SHARE)
    assert np.mean(met["80-85"]) >= 0.95 and np.mean(met["above"]) >= 0.99


def test_all_pairs_with_a_chunk_in_common(spark):
    draw = random.Random(2)
    base = [words(prose(draw, 60)) for _ in range(12)]
    rows = [(i, None, "s", draw.choice(["train", "test"]), " ".join(edited(draw, draw.choice(base), 0.22))) for i in range(150)]
    want = {
        (a[0], b[0]) for a in rows if a[3] == "train" for b in rows if b[3] == "test"
        if lcs_length(words(a[4]), words(b[4])) >= 0.8 * max(len(words(a[4])), len(words(b[4])))
    }
    got = {(r.train_id, r.held_id) for r in split_overlap.cross_split_pairs(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame([], RESULTS), share=0.0).collect()}
    assert got == want


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"p[1-9]_", n) and not n.startswith("p4")])
def test_same_as_sql(spark, name):
    import compare

    got = compare.canon(entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas())
    want = compare.canon(compare.views("/root/testdata/sf0.001").execute(entry.oracle_sql()[name]).df())
    assert [str(r) for r in got] == [str(r) for r in want]


@pytest.mark.parametrize("written", ["{}", "{}\n", " {}", "SHA256:{}", "0x{}"])
def test_digests_however_written(spark, written):
    from foliospark.llm.names import digest_key

    digest = "0" + "a1b2" * 15 + "fed"
    rows = spark.createDataFrame([(written.format(digest),), (written.format(digest.upper()),)], "d string")
    assert {r[0] for r in rows.select(digest_key(F.col("d"))).collect()} == {digest}
