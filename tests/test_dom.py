import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import bidi
from foliospark.functions import text as T
from foliospark.operators import dom, recognition

XML = "<form><row><total>1</total><note/></row><row><total>2 &amp; 3</total></row><sum>9</sum></form>"


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<form><sum>4</sum></form>"), (3, "<broken"), (4, None), (5, "<!DOCTYPE x><x/>")], "doc_id bigint, content string")
    return dom.from_xml(docs).cache()


def at(nodes):
    return {(r.doc_id, r.path): r.id for r in dom.paths(nodes).collect()}


def test_xml_round_trip(nodes):
    assert {r.doc_id: r.xml for r in dom.to_xml(nodes).collect()} == {1: XML, 2: "<form><sum>4</sum></form>"}
    assert at(nodes).keys() >= {(1, "form[0].row[1].total[0]"), (1, "form[0].row[0].note[0]"), (2, "form[0].sum[0]")}


@pytest.mark.parametrize("path,values", [("form.row[*].total", ["1", "2 & 3"]), ("form.row.total", ["1"]), ("form.row[1].*", ["2 & 3"]), ("form.nothing", []), ("form.sum", ["4", "9"])])
def test_paths_mean_nodes(nodes, path, values):
    assert sorted(r.value for r in dom.resolve(nodes, path).collect()) == values


def test_single_nodes(nodes):
    assert {(r.doc_id, r.value) for r in dom.resolve_single(nodes, "form.sum").collect()} == {(1, "9"), (2, "4")}
    with pytest.raises(Exception, match="several"):
        dom.resolve_single(nodes, "form.row[*].total").collect()
    with pytest.raises(ValueError):
        dom.path_pattern("a..b")


def test_edits(spark, nodes):
    place = at(nodes)
    one = nodes.where("doc_id = 1")
    row0, row1, sum_, top = (place[1, p] for p in ("form[0].row[0]", "form[0].row[1]", "form[0].sum[0]", "form[0]"))
    written = lambda df: dom.to_xml(df).first().xml
    assert written(dom.remove(one, spark.createDataFrame([(1, row0)], "doc_id bigint, id bigint"))) == "<form><row><total>2 &amp; 3</total></row><sum>9</sum></form>"
    assert "<all>9</all>" in written(dom.rename(one, spark.createDataFrame([(1, sum_, "all")], "doc_id bigint, id bigint, new_name string")))
    more = spark.createDataFrame([(1, 99, top, 1, "new", "x")], dom.NODE)
    assert written(dom.insert(one, more)).index("<new>x</new>") == written(one).index("<row>", 8)
    moves = "doc_id bigint, id bigint, new_parent bigint, new_at int"
    assert written(dom.move(one, spark.createDataFrame([(1, sum_, row1, 5)], moves))).endswith("<sum>9</sum></row></form>")
    assert written(dom.move(one, spark.createDataFrame([(1, top, row1, 0), (1, row0, row0, 0)], moves))) == XML
    assert "<sum>7</sum>" in written(dom.set_values(one, spark.createDataFrame([(1, "form[0].sum[0]", "7"), (1, "no", "1")], "doc_id bigint, path string, new_value string")))


def test_envelope_and_packets(spark):
    packets = spark.createDataFrame([(1, 2, "<datasets><a/></datasets>"), (1, 1, "<template/>")], "doc_id bigint, at int, xml string")
    made = dom.envelope(packets)
    back = dom.from_xml(made.select("doc_id", F.col("xdp").alias("content")))
    assert [r.name for r in dom.packets(back).orderBy("at").collect()] == ["template", "datasets"]


def test_fields(spark):
    bit = lambda *names: sum(1 << (dom.FLAGS[n] - 1) for n in names)
    rows = [("Tx", None, "text"), ("Tx", bit("multiline", "comb"), "multiline"), ("Tx", bit("comb"), "comb"), ("Btn", bit("radio"), "radio"), ("Btn", 0, "check"), ("Ch", bit("combo"), "combo"), ("Sig", 0, "signature"), ("x", 0, None)]
    got = spark.createDataFrame(rows, "k string, f int, want string").select(dom.field_kind(F.col("k"), F.col("f")).alias("kind"), "want").collect()
    assert all(r.kind == r.want for r in got)
    on = F.lit("Yes")
    states = spark.range(1).select(
        dom.toggled(F.lit("Off"), on, F.lit("check"), F.lit(0)), dom.toggled(on, on, F.lit("check"), F.lit(0)), dom.toggled(on, on, F.lit("radio"), F.lit(bit("no_toggle_off"))),
        dom.chosen_options(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "cbz")), F.lit(0)), dom.chosen_options(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "cbz")), F.lit(bit("multi_select"))),
        dom.comb_width(F.lit(50.0), F.lit(5)),
    ).first()
    assert tuple(states) == ("Yes", "Off", "Yes", ["b"], ["b", "c"], 10.0)
    buttons = spark.createDataFrame([(1, "g", "a"), (1, "g", "b"), (1, "h", "a")], "doc_id bigint, name string, on string")
    chosen = spark.createDataFrame([(1, "g", "b")], buttons.schema)
    assert {(r.name, r.on): r.state for r in dom.radio_states(buttons, chosen).collect()} == {("g", "a"): "Off", ("g", "b"): "b", ("h", "a"): "Off"}


def test_lines_in_both_directions(spark):
    hebrew = "שלום"
    assert bidi.logical("plain") == "plain" and bidi.logical(hebrew[::-1]) == hebrew
    assert bidi.logical(f"see {hebrew[::-1]} 12") == f"see {hebrew} 12" or bidi.logical(f"see {hebrew[::-1]} 12") == f"see 12 {hebrew}"
    rows = spark.createDataFrame([(hebrew[::-1],), (None,)], "t string").select(bidi.logical_order("t").alias("t")).collect()
    assert [r.t for r in rows] == [hebrew, None]


def test_recognition_results(tmp_path):
    field = np.zeros((20, 30))
    field[2:6, 3:10] = 0.9
    field[10:14, 5:9] = 0.4
    field[16:17, 20:28] = 0.9
    assert [b[:4] for b in recognition.boxes_from_map(field)] == [(3, 2, 10, 6)]
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [20, 0, 30, 10]], dtype=float)
    assert recognition.without_overlaps(boxes, np.array([0.5, 0.9, 0.1])) == [1, 2] and recognition.without_overlaps(boxes[:0], np.array([])) == []
    assert recognition.fitted(200, 100, 50) == (0.25, 0, 12) and np.allclose(recognition.probabilities(np.array([[1.0, 1.0]])), 0.5)
    with pytest.raises(recognition.ModelMissing):
        recognition.model_path(str(tmp_path), "none.onnx")


def test_scalars(spark):
    row = spark.range(1).select(
        T.fold_ligatures(F.lit("ﬁne ﬅ")), T.escape_url(F.lit("a b(c)")), T.code39(F.lit("A")), T.code39(F.lit("é")), T.normal_code(F.lit(" a\r\nb ")), T.escape_run(F.lit("*x*\\")),
        T.file_digest_matches(F.lit(b"x"), F.upper(F.sha2(F.lit(b"x"), 256))), T.file_digest_matches(F.lit(None).cast("binary"), F.lit("00")),
    ).first()
    assert tuple(row) == ("fine st", "a%20b%28c%29", "nwnnwnwnnnwnnnnwnnwnnwnnwnwnn", None, "a b", "*x*\\\\", True, False)


def test_calculations_run_until_nothing_changes(spark, nodes):
    scripts = [
        (1, "form[0].sum[0]", 1, 'Get("form.row[0].total") + Get("form.row[1].total")'), (1, "form[0].row[1].total[0]", 2, "40 + 2"), (1, "form[0].row[0].note[0]", 3, "total * 2"),
        (1, "form[0].row[0].total[0]", 4, "nofunction(1)"), (1, "no[0]", 5, "1"), (2, "form[0].sum[0]", 1, 'if (Exists("form.none")) then 1 else Put("form.sum", 8) endif'),
    ]
    got = {(r.doc_id, r.path): (r.value, bool(r.error)) for r in dom.calculated(nodes, spark.createDataFrame(scripts, "doc_id bigint, path string, at int, script string")).collect()}
    assert got[1, "form[0].sum[0]"] == ("43", False) and got[1, "form[0].row[0].note[0]"] == ("2", False)
    assert got[1, "form[0].row[0].total[0]"] == ("1", True) and got[2, "form[0].sum[0]"] == ("8", False)


def test_validations(spark, nodes):
    scripts = [(1, "form[0].sum[0]", 1, "sum > 10"), (2, "form[0].sum[0]", 1, "sum > 1"), (1, "form[0].row[0].total[0]", 2, "nofunction(1)")]
    assert [tuple(r) for r in dom.invalid(nodes, spark.createDataFrame(scripts, "doc_id bigint, path string, at int, script string")).collect()] == [(1, "form[0].sum[0]")]
