import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import images as I
from foliospark.operators import layout as Y
from foliospark.operators import records as R
from foliospark.operators import tables as G


def rows(columns, n, top=700.0, pitch=14.0, width=30.0):
    return np.array([[x, top - i * pitch - 9, x + width, top - i * pitch] for i in range(n) for x in columns])


def test_rows_that_stand_below_each_other_are_a_table():
    assert [[len(r) for r in t] for t in G.aligned(rows((72, 200, 330), 4))] == [[3, 3, 3, 3]]
    assert G.aligned(rows((72,), 9, width=400.0)) == []
    assert G.aligned(rows((72, 300), 2)) == [] and len(G.aligned(rows((72, 300), 3))) == 1 and len(G.aligned(rows((72, 200, 330), 2))) == 1


def test_what_crosses_the_gap_or_is_far_ends_a_table():
    crossing = np.vstack([rows((72, 200), 3), [[72, 640, 260, 649]], rows((72, 200), 3, top=630.0)])
    assert [len(t) for t in G.aligned(crossing)] == [3, 3]
    assert [len(t) for t in G.aligned(np.vstack([rows((72, 200), 3), rows((72, 200), 4, top=600.0)]))] == [3, 4]


def test_proposals_split_at_white():
    assert G.split_at_white(np.vstack([rows((72, 74), 3), rows((200,), 3)])) == [[0, 1, 2, 3, 4, 5], [6, 7, 8]]
    assert [len(p) for p in G.split_at_white(np.vstack([rows((72,), 3, pitch=12.0), rows((72,), 2, top=600.0, pitch=12.0)]))] == [3, 2]
    assert G.split_at_white(rows((72,), 3)) == [[0, 1, 2]]


def test_lattice_joins_fields_without_a_rule_between():
    level = [[0, y, 90, y] for y in (0, 20, 40)]
    upright = [[0, 0, 0, 40], [90, 0, 90, 40], [30, 0, 30, 20], [60, 0, 60, 40]]
    cells = [c[:4] for c in G.lattice(np.array(level + upright, dtype=float))]
    assert cells == [(0, 0, 0, 1), (0, 0, 2, 2), (1, 1, 0, 0), (1, 1, 1, 1), (1, 1, 2, 2)]
    assert G.lattice(np.array([[0, 0, 9, 0]], dtype=float)) == []


def test_grid_from_pairs():
    boxes = np.array([[0, 20, 10, 29], [12, 20, 20, 29], [50, 20, 60, 29], [0, 0, 10, 9], [50, 0, 60, 9]], dtype=float)
    got = G.grid_from_pairs(boxes, [(0, 1)], [(1, 2), (3, 4)], [(0, 3), (2, 4)])
    assert got == [(0, 0, 0), (0, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)]


def test_spans_and_clusters():
    assert G.widened([["a", "", "", "b"], ["", "c", "", ""]], lambda r, c: c + 1) == [(0, 0, 2, "a"), (0, 3, 1, "b"), (1, 1, 2, "c")]
    assert G.largest_cluster(np.array([0.1, 0.9, 0.11, 0.5, 0.12]), 0.06).tolist() == [0, 2, 4]
    assert len(G.largest_cluster(np.array([]), 0.1)) == 0


def test_tables_of_pages(spark):
    data = [(p, int(i), *map(float, b)) for p in (1, 2) for i, b in enumerate(rows((72, 200), 3 if p == 1 else 1))] + [(3, 1, None, 0.0, 1.0, 1.0)]
    got = G.aligned_tables(spark.createDataFrame(data, "page int, id int, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert len(got) == 6 and {(r.page, r.table) for r in got} == {(1, 0)} and {(r.row, r.col) for r in got} == {(r, c) for r in range(3) for c in range(2)}
    frame = [(1, 0.0, y, 90.0, y) for y in (0.0, 20.0)] + [(1, x, 0.0, x, 20.0) for x in (0.0, 45.0, 90.0)]
    assert G.ruled_tables(spark.createDataFrame(frame, "page int, x0 double, y0 double, x1 double, y1 double"), ["page"]).count() == 2


def test_structural_similarity():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 255, (64, 96)).astype(float)
    b = a.copy()
    b[:32, :32] = 255 - b[:32, :32]
    assert I.ssim(a, a) == 1.0 and I.ssim(a[:4], a[:4]) == 1.0
    assert I.tile_ssim(a, b) < I.ssim(a, b) < 1.0
    assert I.difference(a, b)[1] > 0 and I.difference(a, a)[1] == 0.0 and I.picture_hash(a) == I.picture_hash(a)


def test_pictures_compared(spark):
    def picture(v, w=16, h=16):
        return bytearray(np.full((h, w, 4), v, dtype=np.uint8).tobytes())

    data = [(1, 16, 16, picture(9), 16, 16, picture(9)), (2, 16, 16, picture(9), 16, 8, picture(9, h=8)), (3, 16, 16, None, 16, 16, picture(1)), (4, 16, 16, picture(0), 16, 16, picture(255))]
    pairs = spark.createDataFrame(data, "id bigint, width_a int, height_a int, a binary, width_b int, height_b int, b binary")
    assert {r.id: r.verdict for r in I.compare_pictures(pairs).collect()} == {1: "Pass", 2: "Fail", 3: "Fail", 4: "Fail"}


def lines(spark, data):
    schema = "line_id bigint, entry_id bigint, page int, line_no int, kind string, text string, table_id int, bbox array<double>"
    return Y.sized(spark.createDataFrame(data, schema))


def test_overlaps_words_and_lines(spark):
    data = [
        (1, 1, 0, 1, "paragraph", "alpha beta", None, [0.0, 90.0, 100.0, 100.0]), (2, 1, 0, 2, "paragraph", "gamma", None, [110.0, 92.0, 160.0, 102.0]),
        (3, 1, 0, 3, "paragraph", "below", None, [0.0, 70.0, 50.0, 80.0]), (4, 1, 1, 1, "paragraph", "other page", None, [0.0, 90.0, 100.0, 100.0]), (5, 1, 0, 4, "paragraph", None, None, None),
    ]
    rows_ = lines(spark, data)
    assert [tuple(r) for r in Y.overlapping_lines(rows_).collect()] == [(1, 2)]
    words = Y.word_boxes(rows_)
    assert {(r.word, r.x0, r.x1) for r in words.where("line_id = 1").collect()} == {("alpha", 0.0, 50.0), ("beta", 60.0, 100.0)}
    placed = words.join(rows_.select("line_id", "entry_id", "page"), "line_id")
    assert {(r.page, r.line, r.text) for r in Y.lines_of_words(placed, ["entry_id", "page"]).collect()} == {(0, 0, "alpha beta gamma"), (0, 1, "below"), (1, 0, "other page")}


def test_filters(spark):
    data = [(1, 0.5, "7", True, ("x", 2)), (2, None, None, None, None), (3, 2.0, "b", False, ("y", 9))]
    df = spark.createDataFrame(data, "id int, score double, name string, ok boolean, at struct<k:string,n:int>")
    ids = lambda *f: {r.id for r in R.query(df, f).collect()}
    assert ids("score<1") == {1} and ids("at.n>=2", "at.k!=y") == {1} and ids("ok=1") == {1} and ids("score!=0.5") == {3}
    assert ids("name=7") == set() and ids("name!=7") == {1, 3} and ids("name<7") == {1} and ids("score>b") == set()
    assert [r.id for r in R.query(df, [], "score", True, 2).collect()] == [3, 1]


def test_codes_and_statuses(spark):
    row = spark.range(1).select(
        R.composite_status(F.lit(0), F.lit("partial"), F.lit("pass"), F.lit("pass"), F.lit("pass"), F.lit(False)).alias("a"),
        R.composite_status(F.lit(3), F.lit("fail"), F.lit("fail"), F.lit("fail"), F.lit("fail"), F.lit(True)).alias("b"),
        R.primary_code(F.array(F.lit("BIND-003"), F.lit("FLAT-001"))).alias("c"), R.primary_code(F.array().cast("array<string>")).alias("d"),
        R.tier(F.lit("X"), F.lit(30), F.lit(3)).alias("e"), R.agreement(F.lit(1), F.lit(0)).alias("f"), R.bar(F.lit(0.26), 4).alias("g"), R.name_prefix(F.lit("a-b__c")).alias("h"),
        R.gate_band(F.lit(0.95)).alias("i"), R.excluded_because("all", *[F.lit(None)] * 6).alias("j"),
    ).first()
    assert tuple(row) == ("minor_deviation", "degenerate", "FLAT-001", None, "should_fix", None, "#...", "a-b", None, None)
