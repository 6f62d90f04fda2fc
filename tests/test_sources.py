import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliospark.sources import corpus
from foliospark.sources.html import parse_html


def cells(html):
    return [(b["text"], b["row"], b["col"], b["row_span"], b["col_span"], b["header"]) for b in parse_html(html) if b["kind"] == "tableCell"]


def test_spans_take_their_places():
    html = "<table><tr><th rowspan=2>Port</th><th colspan=2>Depth</th></tr><tr><td>low<td>high</tr><tr><td>North<td>4<td>9</table>"
    assert cells(html) == [
        ("Port", 0, 0, 2, 1, True), ("Depth", 0, 1, 1, 2, True), ("low", 1, 1, 1, 1, False), ("high", 1, 2, 1, 1, False),
        ("North", 2, 0, 1, 1, False), ("4", 2, 1, 1, 1, False), ("9", 2, 2, 1, 1, False),
    ]


def test_tables_in_tables_follow():
    html = "<table><tr><td>north<table><tr><td>n1<td>n2</table></td><td>south</td></tr></table><p>after"
    assert [(b["kind"], b["text"]) for b in parse_html(html)] == [("tableCell", "north"), ("tableCell", "south"), ("tableCell", "n1"), ("tableCell", "n2"), ("paragraph", "after")]


def test_lists_number_and_nest():
    html = "<ol start=7><li>seven<ul><li>inner</ul>goes on</li><li>eight</ol><ul><li>plain</ul>"
    assert [(b["text"], b["level"], b["ordinal"]) for b in parse_html(html)] == [("seven goes on", 1, 7), ("inner", 2, None), ("eight", 1, 8), ("plain", 1, None)]


def test_inline_marks():
    html = "<p>A <b>bold </b><i>lean</i> <a href='x (1).html'>go <s>old</s></a> <code>a`b</code> 2 * 3 \\ <img src='p.png' alt='sea'></p>"
    assert [b["text"] for b in parse_html(html)] == ["A **bold** *lean* [go](x%20%281%29.html) [~~old~~](x%20%281%29.html) ``a`b`` 2 * 3 \\\\ ![sea](p.png)"]


def test_preformatted_text_stays():
    assert [b["text"] for b in parse_html("<pre>\n  a   b\n c\n</pre><blockquote>said  it</blockquote><p> </p>")] == ["  a   b\n c", "said it"]


def test_scan_and_lists(spark, tmp_path):
    for name in ("a.pdf", "deep/b.PDF", "deep/er/c.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    found = corpus.scan(spark, str(tmp_path / "in"))
    assert found.count() == 3 and found.agg(F.sum("size")).first()[0] == 5 + 10 + 13
    assert corpus.scan(spark, str(tmp_path / "in"), "*.pdf").count() == 1
    assert found.where(corpus.named_like(F.col("path"), "*.pdf", "c.*")).count() == 3
    (tmp_path / "list.txt").write_text("# all\na.pdf\r\n\n  /abs/b.pdf \ns3://x/c.pdf")
    got = [r.path for r in corpus.listed(spark, str(tmp_path / "list.txt"), "/base/").orderBy("position").collect()]
    assert got == ["/base/a.pdf", "/abs/b.pdf", "s3://x/c.pdf"]
    assert {r.path.rsplit("/", 1)[1] for r in corpus.contents(spark, str(tmp_path / "in"), "*.txt").collect()} == {"c.txt"}


def test_result_files_of_any_shape(spark, tmp_path):
    row = StructType().add("file", "string").add("ssim", "double")
    shapes = {"list": [{"file": "a", "ssim": 0.5}], "wrapped": {"results": [{"file": "b"}]}, "keyed": {"c": {"ssim": 1.0}, "d": {"file": "e"}}, "empty": []}
    for name, value in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = {(r.file, r.ssim) for r in corpus.result_rows(spark, str(tmp_path), row).collect()}
    assert got == {("a", 0.5), ("b", None), ("c", 1.0), ("e", None)}


def test_run_history(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"config": {"run_id": f"r{i}", "timestamp": f"2024-01-0{i}T00:00:00Z"}, "results": [{"file": "a"}] * i}))
    got = corpus.run_history(spark, str(tmp_path), StructType().add("file", "string")).groupBy("run_id").count().collect()
    assert {tuple(r) for r in got} == {("r1", 1), ("r2", 2)}


def test_bookmarks_round_trip(spark):
    deep = {"title": "deep"}
    for i in range(60):
        deep = {"title": f"t{i}", "page": i, "children": [deep]}
    trees = [[{"title": "A", "page": 0, "children": [{"title": "A1"}]}, {"title": "B", "page": 3}], [deep], []]
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(9, "no json"), (10, None)], "doc_id bigint, json string")
    rows = corpus.bookmarks(docs)
    assert {(r.at, r.level, r.title, r.page) for r in rows.where("doc_id = 0").collect()} == {(0, 1, "A", 0), (1, 2, "A1", None), (2, 1, "B", 3)}
    assert rows.where("doc_id = 1").agg(F.max("level")).first()[0] == 61
    assert {r.doc_id: json.loads(r.json) for r in corpus.bookmarks_json(rows).collect()} == {0: trees[0], 1: trees[1]}


def test_pictures(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (20).to_bytes(2, "little") + (300).to_bytes(2, "little")
    rows = spark.createDataFrame([(1, 0, 2, bytearray(png)), (1, 0, 1, bytearray(gif)), (1, 1, 1, bytearray(b"\xff\xd8\xff\xe0")), (2, 0, 1, bytearray(b"none")), (2, 0, 2, None)], "doc_id bigint, page int, at int, content binary")
    got = {(r.doc_id, r.page, r.number, r.format, r.width, r.height) for r in corpus.page_pictures(rows).collect()}
    assert got == {(1, 0, 2, "png", 640, 480), (1, 0, 1, "gif", 20, 300), (1, 1, 1, "jpeg", None, None), (2, 0, 1, None, None, None), (2, 0, 2, None, None, None)}


def test_tables_are_written_as_a_whole(spark, tmp_path):
    target = str(tmp_path / "out")
    for n in (3, 2):
        corpus.write_table(spark.range(n), target)
        assert spark.read.json(target).count() == n and not (tmp_path / "out._writing").exists()
    corpus.write_table(spark.range(2), target, "csv")
    assert spark.read.option("header", "true").csv(target).columns == ["id"]
