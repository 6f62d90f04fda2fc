import random
from datetime import datetime

from foliospark.operators.hierarchy import CYCLE, descendants, hierarchy

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
SCHEMA = "entry_id bigint, style_id string, name string, based_on string, loaded_at timestamp, target string"


def sheet(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def result(df):
    return {(r.entry_id, r.style_id): (r.root_id, r.depth) for r in df.collect()}


ROWS = [
    (1, "a", "Base", None, T0),
    (1, "b", "Body", " BASE ", T0),
    (1, "c", None, "b", T0),
    (1, "c", None, "a", T1),  # the later state holds
    (1, "c", None, "a", T1),  # resent
    (1, "x", "Ring one", "y", T0),
    (1, "y", "Ring two", "ring one", T0),
    (1, "z", "", "x", T0),
    (1, "s", "Self", "s", T0),
    (1, "g", "Gone", "nowhere", T0),
    (2, "b", "Other sheet", "a", T0),
    (2, None, "No id", "b", T0),
    (None, "q", "No sheet", None, T0),
    (3, "late", "Unknown time", "a", None),
]


def test_roots_rings_and_states(spark):
    got = result(hierarchy(sheet(spark, ROWS)))
    assert got == {
        (1, "a"): ("a", 0), (1, "b"): ("a", 1), (1, "c"): ("a", 1), (1, "x"): (CYCLE, -1), (1, "y"): (CYCLE, -1), (1, "z"): (CYCLE, -1),
        (1, "s"): (CYCLE, -1), (1, "g"): ("g", 0), (2, "b"): ("b", 0), (3, "late"): ("late", 0),
    }


def test_empty(spark):
    assert hierarchy(sheet(spark, [])).collect() == []


def test_divided_sheets_give_the_same_as_whole_ones(spark):
    random.seed(3)
    rows = [(1, f"s{i}", f"n{i}", None if i == 0 else f"s{random.randrange(max(0, i - 3), i)}", T0) for i in range(300)]
    rows += [(1, f"r{i}", None, f"r{(i + 1) % 40}", T0) for i in range(40)] + [(1, "in", None, "r7", T0)]
    rows += [(2, f"s{i}", None, f"s{i - 1}" if i else None, T0) for i in range(150)]
    df = sheet(spark, rows).cache()
    whole = {(r.entry_id, r.style_id): (r.root_id, r.depth, r.path) for r in hierarchy(df, True).collect()}
    parts = {(r.entry_id, r.style_id): (r.root_id, r.depth, r.path) for r in hierarchy(df, True, block_nodes=20).collect()}
    assert whole == parts
    assert whole[2, "s149"][1] == 149 and whole[1, "in"] == (CYCLE, -1, None)
    assert len(whole[2, "s149"][2]) == 150


def test_descendants(spark):
    got = {(r.ancestor_id, r.style_id, r.distance) for r in descendants(sheet(spark, ROWS)).where("entry_id = 1").collect()}
    assert got == {("a", "b", 1), ("a", "c", 1)}
