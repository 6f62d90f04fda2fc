import pytest
from pyspark.sql import functions as F

from foliospark.operators import chunking as C
from foliospark.operators import paths as X


def test_outline_keeps_children_of_entries_without_page(spark):
    rows = [(1, 1, None, "a", 0), (1, 2, 1, "b", None), (1, 3, 2, "c", 5), (2, 1, None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id int, id int, parent_id int, title string, page int")
    assert {tuple(r) for r in C.flatten_outline(df).collect()} == {(1, 1, "a", 0), (1, 3, "c", 5)}


def test_split_box(spark):
    df = spark.createDataFrame([([0.0, 0.0, 70.0, 9.0], "ab ab cd")], "b array<double>, t string")
    got = df.select(C.split_box(F.col("b"), F.col("t")).alias("w")).first()["w"]
    assert [(w.word, w.x0, w.x1) for w in got] == [("ab", 0.0, 17.5), ("ab", 26.25, 43.75), ("cd", 52.5, 70.0)]


def test_paths(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1},{"c":"x"}]}}'), (2, "{}"), (3, "broken"), (4, None)], "id int, j string")
    got = lambda p: [tuple(r) for r in X.resolve(df, "j", p, ["id"]).orderBy("value").collect()]
    assert got("$data.a.b[*].c") == [(1, "1"), (1, "x")]
    assert got("a.b[1].c") == [(1, "x")] and got("a.nothing") == []
    with pytest.raises(ValueError):
        X.parse("a..b")


def test_permissions(spark):
    got = spark.range(1).select(X.permissions(F.lit(0b100)).alias("p")).first()["p"].asDict()
    assert got["print"] and not got["copy"]


def test_flat_metadata(spark):
    df = spark.createDataFrame([(1, ("s", [1.0, 2.0]))], "id int, metadata struct<source:string,bbox:array<double>>")
    assert [tuple(r) for r in C.flat_metadata(df).collect()] == [(1, "s", "[1.0,2.0]")]
    assert C.budget(10) == 40
