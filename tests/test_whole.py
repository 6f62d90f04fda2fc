"""Queries read whole tables and whole texts."""

import __spark_entry__ as entry


def run(spark, tmp_path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return entry.queries()[name](spark, str(tmp_path)).collect()


def test_grid_of_all_rows(spark, tmp_path):
    rows = [(1, n, flag) for n, flag in [(1, "A"), (2, "N"), (5, "R"), (7, "N")]]
    got = {(r.row, r.col): r.text for r in run(spark, tmp_path, "grid_expand", lineitem=(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string"))}
    filled = {(0, 1): "A1", (0, 2): "A1", (1, 2): "N2", (4, 2): "R5", (4, 3): "R5", (6, 1): "N7", (6, 2): "N7"}
    assert got == {(r, c): filled.get((r, c), "") for r in range(7) for c in range(4)}


def test_ranges_of_all_pages(spark, tmp_path):
    rows = [(1, p) for p in (0, 1, 2, 3, 5, 6, 8)] + [(2, 2), (None, 1), (2, None)]
    got = {(r.entry_id, r["first"], r["last"]) for r in run(spark, tmp_path, "page_ranges", page_lines=(rows, "entry_id bigint, page int"))}
    assert got == {(1, 0, 3), (1, 5, 6), (1, 8, 8), (2, 2, 2)}


DOCUMENT = "doc_id bigint, text string, lang string, source string"


def test_wrapped_lines_of_whole_texts(spark, tmp_path):
    long = "This paragraph  is longer than forty signs and is wrapped."
    rows = [(1, f"Head\n\n{long}\n \nEnd", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s"), (4, "one\n", "en", "s")]
    got = {r.doc_id: (r.n_lines, r.wrapped) for r in run(spark, tmp_path, "wrapped_lines", documents=(rows, DOCUMENT))}
    assert got == {1: (6, "Head||This paragraph is longer than forty|signs and is wrapped.||End"), 2: (0, ""), 4: (2, "one|")}


def test_code_fences_of_whole_texts(spark, tmp_path):
    rows = [(1, "plain\ntext", "en", "s"), (2, "a ``` b\n````` c `", "en", "s"), (3, None, "en", "s")]
    got = {r.doc_id: r.fence for r in run(spark, tmp_path, "code_fences", documents=(rows, DOCUMENT))}
    assert got == {1: "```", 2: "``````", 3: "```"}


def test_similarity_to_the_line_before(spark, tmp_path):
    lines = [(1, 1, 0, 0, "heading", "Größe"), (2, 1, 0, 1, "body", "grösse"), (3, 1, 0, 2, "body", None), (4, 1, 1, 0, "heading", "Abc"), (5, 1, 1, 1, "heading", "abd"), (6, 2, 0, 0, "body", "alone")]
    schema = "line_id bigint, entry_id bigint, page int, line_no int, kind string, text string, read_at timestamp"
    got = {r.line_id: r.similarity for r in run(spark, tmp_path, "neighbour_similarity", page_lines=([(*x, None) for x in lines], schema))}
    assert got == {2: round(1 - 2 / 6, 9), 5: round(1 - 1 / 3, 9)}
