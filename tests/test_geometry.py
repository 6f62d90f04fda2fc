from pyspark.sql import functions as F

from foliospark.operators import geometry as G
from foliospark.operators import ocr


def test_union_area_counts_overlaps_once(spark):
    rows = [(1, [0.0, 0.0, 2.0, 2.0]), (1, [1.0, 1.0, 3.0, 3.0]), (1, [0.0, 0.0, 2.0, 2.0]), (2, None), (3, [0.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "page int, bbox array<double>")
    assert {r.page: r.area for r in G.union_area(df, ["page"]).collect()} == {1: 7.0, 3: 1.0}


def test_nearest_above_at_any_distance(spark):
    boxes = [(1, 1, [0.0, 40.0, 50.0, 50.0]), (1, 2, [0.0, 600.0, 50.0, 610.0]), (1, 3, [10.0, 500.0, 40.0, 510.0]), (1, 4, [200.0, 100.0, 250.0, 110.0]), (2, 5, [0.0, 700.0, 50.0, 710.0]), (1, 6, [10.0, 299.995, 40.0, 300.0]), (1, 7, [10.0, 290.0, 40.0, 300.0]), (3, 8, None)]
    df = spark.createDataFrame(boxes, "page int, id bigint, bbox array<double>")
    assert {r.id: r.above for r in G.nearest_above(df, ["page"]).collect()} == {1: 7, 3: 2, 6: 3, 7: 6}


def test_tables_by_alignment(spark):
    rows = [(1, 72.0 if c == 0 else 200.0 + r, 700.0 - 16 * r, f"{r}{c}") for r in range(3) for c in range(2)] + [(1, 72.0, 500.0, "prose"), (2, 10.0, 10.0, "alone")]
    df = spark.createDataFrame(rows, "page int, x double, y double, text string")
    got = {(r.page, r.table_no, r.row, r.col): r.text for r in G.detect_tables(df, ["page"]).collect()}
    assert got == {(1, 0, r, c): f"{r}{c}" for r in range(3) for c in range(2)}


def test_choice_without_overlap(spark):
    rows = [(1, 1, 0.9, [1, 2]), (1, 2, 0.8, [2, 3]), (1, 3, 0.7, [3]), (1, 4, 0.9, [4])]
    df = spark.createDataFrame(rows, "page int, id bigint, score double, lines array<bigint>")
    assert {r.id for r in G.choose(df, ["page"]).collect()} == {1, 3, 4}
    assert {r.id for r in G.choose(df, ["page"], most=1).collect()} == {1}


def test_set_overlap(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(G.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_recogniser_rows(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = "\n".join([head, "5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t96.5\tHello", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t1\t2\t50\t20\t9\t5\t80\t "])
    got = ocr.tsv_words(spark.createDataFrame([(7, tsv)], "page int, tsv string"), ["page"]).collect()
    assert [(r.page, r.text, r.confidence, r.bbox) for r in got] == [(7, "Hello", 0.965, [10.0, 20.0, 40.0, 25.0])]


def test_greedy_decoding_and_need(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(ocr.greedy_decode(F.col("s"), ["-", "a", "b"])).collect()] == ["aab", ""]
    pages = spark.createDataFrame([("x", 0.6, 0.6, 0.0), ("y" * 99, 0.2, 0.2, 0.01), ("y" * 99, 0.2, 0.1, 0.0)], "t string, a double, b double, c double")
    assert [r[0] for r in pages.select(ocr.needs_ocr(F.col("t"), F.col("a"), F.col("b"), F.col("c"))).collect()] == ["full", "partial", "none"]
