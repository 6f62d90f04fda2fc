"""Nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliospark.llm import grouped_split, leak_scan, lookalikes, mojibake, packing, segment, split_overlap, truncation

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
MANIFEST = "entry_id bigint, document string, source string, author string, entity_id bigint, split string, lang string, lead_text string, key string"
RESULTS = "entry_id bigint, pdf_hash string, id string"
LEAD = " ".join(f"word{i}" for i in range(40))
HASH = "ab" * 32


def manifest(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], MANIFEST)


ENTRIES = [
    (1, "batch1/ABC00000001.PDF", "s1", "Ann Bee", 7, "train", "en", LEAD),
    (2, "ＡＢＣ00000001-p0003.pdf", "s2", "BEE,  ann", 0, "test", "en", None),
    (2, "ＡＢＣ00000001-p0003.pdf", "s2", "BEE,  ann", 0, "test", "en", None),  # repeated
    (3, "x3", "s3", "n/a", None, "validation", None, LEAD.upper().replace("WORD7 ", "other ") + "!"),
    (4, "x4", "s4", None, 7, "test", "de", ""),
    (5, None, None, " ", 0, None, "de", LEAD),
    (6, "x6", "s6", "-", None, "train", "de", "short"),
    (7, "x7", "s7", "Unknown", None, "test", "de", " Short. "),
    (8, "x8", "s8", None, None, "train", "en", " ".join(f"far{i}" for i in range(40))),
]
FILES = [(6, HASH, "r"), (4, " SHA256:" + HASH.upper(), "r"), (8, "0" * 64, "r"), (7, "0" * 64, "r"), (8, None, "r"), (None, HASH, "r")]


def test_overlaps(spark):
    got = {tuple(r) for r in split_overlap.cross_split_pairs(manifest(spark, ENTRIES), spark.createDataFrame(FILES, RESULTS)).collect()}
    assert got == {(1, 2, "document"), (6, 4, "hash"), (1, 3, "text"), (6, 7, "text")}


def test_overlaps_of_nothing(spark):
    assert split_overlap.cross_split_pairs(manifest(spark, []), spark.createDataFrame([], RESULTS)).count() == 0


def test_near_texts_match_brute_force(spark):
    from foliospark.llm.words import lcs_length

    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[random.choice(vocabulary) for _ in range(random.randint(30, 90))] for _ in range(60)]
    for _ in range(120):
        copy = list(random.choice(texts[:60]))
        for _ in range(random.randint(0, len(copy) // 5)):
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
        texts.append(copy)
    rows = [(i, None, None, None, None, random.choice(["train", "test"]), None, " ".join(t)) for i, t in enumerate(texts)]
    want = {
        (a[0], b[0])
        for a in rows
        if a[5] == "train"
        for b in rows
        if b[5] == "test"
        if lcs_length(texts[a[0]], texts[b[0]]) >= 0.8 * max(len(texts[a[0]]), len(texts[b[0]]))
    }
    got = {(r.train_id, r.held_id) for r in split_overlap.cross_split_pairs(manifest(spark, rows), spark.createDataFrame([], RESULTS)).collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want)


def test_groups(spark):
    got = {r.entry_id: r.group_id for r in grouped_split.groups(manifest(spark, ENTRIES)).collect()}
    assert got == {1: 1, 2: 1, 4: 1}
    assert grouped_split.groups(manifest(spark, [])).count() == 0


def test_long_chains_settle(spark):
    rows = [(i, f"d{i // 2}", f"s{(i + 1) // 2}", None, None, None, None, None) for i in range(400)]
    assert {r.group_id for r in grouped_split.groups(manifest(spark, rows)).collect()} == {0}


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(i, None, f"s{i // (1 + i % 4)}", None, None, None, ["en", "de", None][i % 3], None) for i in range(900)]
    got = grouped_split.assign(manifest(spark, rows), units=100).toPandas()
    assert len(got) == 900 and (got.groupby("group_id").split.nunique() == 1).all()
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.04
    assert grouped_split.assign(manifest(spark, [])).count() == 0


ITEM = " ".join(f"Item{i}" for i in range(40))


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, key string")


def test_leaks(spark):
    changed = ITEM.split()
    changed[5], changed[20] = "x", "y"
    rows = [
        (1, "before " + ITEM.lower().replace(" ", ",  ") + " after", "s"),
        (2, " ".join(changed[:30]), "s"),
        (3, " ".join(ITEM.split()[:15]) + " other words", "s"),
        (4, None, "s"),
        (5, "", "s"),
        (6, " ".join(f"pad{i}" for i in range(20_000)) + " " + ITEM, "s"),
        (7, " ".join(w if i % 4 else "gap" for i, w in enumerate(ITEM.split())), "s"),
    ]
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leak_scan.leaks(documents(spark, rows), items).collect()}
    assert got == {(1, 9), (2, 9), (6, 9)}
    clean = {r.doc_id: (r.action, r.clean_text) for r in leak_scan.cleaned(documents(spark, rows), items).collect()}
    assert clean[1] == ("drop", None) and clean[6][0] == "cut" and "Item" not in clean[6][1] and "pad19999" in clean[6][1]
    assert leak_scan.leaks(documents(spark, []), items).count() == 0
    assert leak_scan.leaks(documents(spark, rows), items.limit(0)).count() == 0


def test_leak_that_starts_with_one_equal_word(spark):
    words = [f"item{k}" for k in range(24)]
    changed = [w if k not in (1, 12) else f"other{k}" for k, w in enumerate(words)]
    items = spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    docs = documents(spark, [(1, " ".join(["pad"] * 9 + changed + ["end"] * 9), "s")])
    assert [(r.doc_id, r.item_id) for r in leak_scan.leaks(docs, items).collect()] == [(1, 9)]


def test_leaks_in_blocks_of_items(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(6)], "item_id bigint, text string")
    docs = documents(spark, [(i, " ".join(f"i{i}w{k}" for k in range(30)), "s") for i in range(6)])
    blocks = list(leak_scan.item_blocks(spark, items, index_words=40))
    assert len(blocks) > 1 and sum(len(b.value.ids) for b in blocks) == 6
    assert leak_scan.leaks(docs, items).count() == 6


def _sentence(r):
    return f"The {r.choice(['red', 'blue', 'green'])} {r.choice(['box', 'lid', 'cup'])} holds {r.randint(1, 999)} {r.choice(['pins', 'keys', 'caps'])} near the {r.choice(['door', 'wall', 'desk'])}."


def test_truncation(spark):
    r = random.Random(1)
    whole = [(i, " ".join(_sentence(r) for _ in range(4)) + r.choice(["", f"\nSigned, {r.choice(['Ann', 'Bob', 'Eve'])}", "\n- red box\n- blue lid"]), "s") for i in range(300)]
    cut = [
        (1000, whole[0][1][:60] + " The gre", "s"),
        (1001, "The red box holds 5 pins near the", "s"),
        (1002, "The red box holds 5 pins...", "s"),
        (1003, "The red box holds 5 pins &nb", "s"),
        (1004, "The red box holds 5 pins near the", "t"),  # a copy under another id
        (1005, None, "s"),
        (1006, "  ", "s"),
    ]
    got = {x.doc_id for x in truncation.truncated(documents(spark, whole + cut)).collect()}
    assert {1000, 1001, 1002, 1003, 1004} <= got and not {1005, 1006} & got
    assert len(got - {1000, 1001, 1002, 1003, 1004}) <= 6
    assert truncation.truncated(documents(spark, [])).count() == 0
    shares = {x.source: (x.texts, x.cut) for x in truncation.by_source(documents(spark, cut)).collect()}
    assert shares["t"][0] == 1


def test_near_copy_that_ends_early(spark):
    long = " ".join(f"word{i}" for i in range(200)) + "."
    texts = documents(spark, [(1, long, "s"), (2, long[:1430], "s"), (3, "something else entirely that is whole.", "s")]).withColumn("text_key", F.md5("text"))
    ends = truncation.endings(texts.select("doc_id", "text_key", "text"), {})
    got = [(r.early) for r in truncation.near_copies(texts, ends).collect()]
    assert got == [True]


def test_near_copy_beside_a_longer_text(spark):
    a, b, c = (" ".join(f"{letter}{i}" for i in range(90)) for letter in "abc")
    texts = documents(spark, [(1, f"{b} {a[:320]}", "s"), (2, f"{b} {a}.", "s"), (3, f"{c} {c.upper()} {c[::-1]} {b[::-1]}.", "s")]).withColumn("text_key", F.md5("text"))
    band = F.array(F.lit(1).cast("bigint"))
    ends = truncation.endings(texts.select("doc_id", "text_key", "text"), {}).withColumn("bands", band).withColumn("own", F.when(F.size("own") > 0, band))
    key = {r.doc_id: r.text_key for r in ends.collect()}
    got = {(r.key_a, r.key_b, r.early) for r in truncation.near_copies(texts, ends).where("near").collect()}
    assert got == {(key[1], key[2], True)}


LETTER = "The committee met on the second day of the month and agreed to send the draft to all members before the summer break"


@pytest.mark.parametrize("text,early", [
    (LETTER[:90].replace("send the", "send\nthe"), True), (LETTER[:90].replace("to send", "to  send"), True), (LETTER[:90].upper(), True),
    (LETTER[:90].replace("send", "mail"), True), (LETTER[:-8].replace("all", "the"), True), (LETTER.replace("all", "our"), False),
    (LETTER[:90].replace("draft", "plan").replace("send", "mail")[:-3] + "an office", False), ("of other things entirely the", False),
])
def test_end_of_an_edited_copy(text, early):
    assert truncation.ends_early(text, LETTER) == early


def test_end_at_a_line_of_the_copy():
    assert not truncation.ends_early("Signed on the third of MAY, Ann", "Signed on the third of May,  Ann\nfor the board")
    assert truncation.ends_early("one two three four five six seven", "one two three\nfour five  six seven\neight nine")


@pytest.mark.parametrize("text", ["holds &nb", "holds &", "caf&eac", "holds &#82", "see <a hre", "caf�", "\\u00e"])
def test_broken_ends(text):
    assert truncation.broken(text)


@pytest.mark.parametrize("text", ["AT&T", "R&D", "grew by 20%", "a < b", "plain", "Smith &Company"])
def test_whole_ends(text):
    assert not truncation.broken(text)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_kind string, row_id bigint, text string, key string")


CLEAN = ["Größe prüfen", "Überlauf während", "café résumé", "señal según línea", "não está à mão", "l’étape d’entrée", "ночной отчёт закрыт", "σελίδα κάτω από", "naïve façade — “x”", "für Blätter €"]


def test_encoding_chains_round_trip():
    for text in CLEAN:
        for chain in mojibake.CHAINS:
            bad = mojibake.garble(text, chain)
            if bad is not None and bad != text and mojibake.restore(bad, chain) is not None and chain[0][0] == "utf-8":
                assert mojibake.restore(bad, chain) == text


def test_garbled(spark):
    rows = [("line", i, CLEAN[i % len(CLEAN)]) for i in range(400)]
    bad = [
        ("line", 1000, "GrÃ¶ÃŸe prüfen"), ("line", 1001, "â€œxâ€\x9d"), ("chunk", 1002, "caf�"), ("chunk", 1003, "пїЅ"[:0] + "Ð½Ð¾Ñ‡Ð½Ð¾Ð¹"),
        ("line", 1004, None), ("line", 1005, ""), ("line", 1006, "plain"), ("chunk", 1007, "x " * 50_000 + "sÃ©ance"), ("line", 1008, "ÅÄÖ ± ½ Ã"),
    ]
    found = {r.row_id: r for r in mojibake.garbled(pages(spark, rows + bad)).collect()}
    assert set(found) == {1000, 1001, 1002, 1003, 1007}
    assert found[1000].restored == "Größe prüfen" and found[1000].whole
    assert found[1001].restored == "“x”" and not found[1002].whole and found[1003].restored == "ночной"
    assert mojibake.garbled(pages(spark, [])).count() == 0


def test_rare_words_are_known_beyond_the_training_words(spark):
    letters = "abcdefghijklmnopqrst"
    fill = [f"{a}{b}{c}{sign}{d}" for a in letters for b in letters for c in letters[:12] for sign, d in (("ñ", "a"), ("ń", "a"))]
    rows = [("line", i, w) for i, w in enumerate(3 * fill)]
    rows += [("line", 100_000, "montaña"), ("line", 100_001, "montaña"), ("line", 100_002, "montańa"), ("line", 100_003, "pańa")]
    assert len(set(fill)) > mojibake.TRAINING_WORDS
    found = {r.row_id: r.restored for r in mojibake.garbled(pages(spark, rows)).collect()}
    assert found == {100_002: "montaña"}


def test_classifier_on_held_out_words():
    words = {w for t in CLEAN for w in t.split() if not w.isascii()}
    model = mojibake.Classifier(dict.fromkeys(words, 20))
    utf8 = [(w, c) for w in words for c in mojibake.CHAINS if c[0][0] == "utf-8" and (b := mojibake.garble(w, c)) and b != w]
    hit = sum(v is not None and v.restored == w for w, c in utf8 if (v := model.verdict(mojibake.garble(w, c))) or True)
    assert hit >= 0.9 * len(utf8)
    assert all(model.verdict(w) is None for w in words)


def test_lookalikes(spark):
    rows = [("line", i, "the page counter holds für Größe résumé печать страница") for i in range(20)]
    odd = [
        ("line", 100, "ｔｈｅ page"), ("line", 101, "résumé"), ("line", 102, "pa­ge"), ("line", 103, "the page"), ("line", 104, "pаgе соuntеr"),
        ("line", 105, "m² 5 Ω № 4 µ печать"), ("line", 106, None), ("line", 107, ""), ("chunk", 108, "x " * 60_000 + "pаge"), ("line", 109, "cтpaница"),
        ("line", 110, "tab\tand\nline"),
    ]
    found = {r.row_id: (r.canonical, set(r.found)) for r in lookalikes.unified(pages(spark, rows + odd)).collect()}
    assert set(found) == {100, 101, 102, 103, 104, 108, 109}
    assert found[100] == ("the page", {"wide"}) and found[101] == ("résumé", {"accent"}) and found[102] == ("page", {"ignorable"})
    assert found[103] == ("the page", {"blank"}) and found[104] == ("page counter", {"alphabet"}) and found[109][0] == "страница"
    assert lookalikes.unified(pages(spark, [])).count() == 0


CHUNK = "chunk_id bigint, text string, metadata struct<source:string,kind:string>, made_at timestamp, piece_no string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, t, (None, k), at, "clash") for i, t, k, at in rows], CHUNK)


def test_pieces(spark):
    limits = spark.createDataFrame([("Page", 100, 10), ("note", None, 5), ("tiny", 3, 50)], "kind string, max_chars int, overlap_chars int")
    text = ("One sentence here. " * 6 + "\n\n" + "Another topic starts now. " * 6).strip()
    rows = [
        (1, text, " PAGE ", T0), (1, "old", "page", None), (1, text, "page", T0), (2, "x" * 250, "page", T0), (3, "short", "page", T0), (4, None, "page", T0),
        (5, "", "page", T0), (6, "y" * 999, "note", T0), (7, "z" * 999, None, T0), (8, "abcdefgh", "tiny", T0), (9, "é" * 80, "page", T0), (None, "x" * 500, "page", T0),
    ]
    got = {}
    for r in segment.split_oversized(chunks(spark, rows), limits).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert {k for k, v in got.items() if len(v) > 1} == {1, 2, 8, 9}
    assert {r.chunk_id for r in segment.oversized_ids(chunks(spark, rows), limits).collect()} == {1, 2, 8, 9}
    assert 4 not in got and [r.text for r in got[5]] == [""] and len(got[6]) == len(got[7]) == 1
    for key, full in ((1, text), (2, "x" * 250), (9, "é" * 80)):
        pieces = got[key]
        assert all(len(p.text) <= 100 and full[p.start : p.end] == p.text for p in pieces) and pieces[-1].end == len(full)
        assert all(a.end - b.start == 10 for a, b in zip(pieces, pieces[1:]))
    assert all(p.text.endswith((" ", "\n", ".")) for p in got[1])
    assert "".join(p.text[-1:] if i else p.text for i, p in enumerate(got[8]))
    assert segment.split_oversized(chunks(spark, []), limits).count() == 0


def test_packing(spark):
    random.seed(2)
    rows = [(i, random.choice([5, 5, 17, random.randint(1, 130)])) for i in range(3000)] + [(9000, 333), (9001, 100), (9002, 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    got = packing.pack(sized, 100).toPandas()
    assert got.groupby("container_id").tokens.sum().max() <= 100
    assert got.tokens.sum() == sum(t for _, t in rows)
    assert got[got.doc_id == 9000].sort_values("piece_no")[["first_token", "tokens"]].values.tolist() == [[0, 100], [100, 100], [200, 100], [300, 33]]
    assert (got.groupby("doc_id").size()[[d for d, t in rows if 0 < t <= 100]] == 1).all()
    assert got.tokens.sum() / (got.container_id.nunique() * 100) > 0.99
    other = packing.pack(sized.repartition(7), 100).toPandas()
    assert other.sort_values(["doc_id", "piece_no"]).container_id.tolist() == got.sort_values(["doc_id", "piece_no"]).container_id.tolist()
    assert packing.pack(sized.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sized, 0)


def test_bucket_bounds_are_optimal():
    import itertools

    import numpy as np

    sizes, counts = np.array([1, 3, 4, 9, 10, 30]), np.array([5, 1, 7, 2, 2, 1])

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in zip(sizes, counts))

    best = min(padding((*c, 30)) for c in itertools.combinations(sizes[:-1].tolist(), 2))
    assert padding(packing.bucket_bounds(sizes, counts, 3)) == best


def test_token_counts(spark):
    docs = documents(spark, [(1, "Hello world", "s"), (2, None, "s"), (3, "", "s"), (3, "again", "s")])
    budgets = spark.createDataFrame([(1, "a", 4), (2, "b", None)], "budget_id int, label string, capacity_tokens int")
    got = packing.pack_all(docs, budgets)
    assert {r.doc_id for r in got.collect()} == {1, 3} and got.select(F.sum("tokens")).first()[0] == 3
    assert packing.pack_all(docs, budgets.limit(0)).count() == 0
