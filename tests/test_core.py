import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliospark import runtime
from foliospark.functions import text as T
from foliospark.operators import pages, render, search, structure
from foliospark.sources import blocks, forms


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,key", [("Page  12", "page #"), ("xiv", "#"), ("mild", "mild"), ("", ""), ("IV", "#")])
def test_furniture_key(spark, text, key):
    assert one(spark, text, T.furniture_key) == key


@pytest.mark.parametrize("text,value", [("$1,200.50", 1200.5), ("(3)", -3.0), ("12%", 0.12), ("1d", None), ("x", None), ("1e3", 1000.0)])
def test_typed_number(spark, text, value):
    assert one(spark, text, T.typed_number) == value


@pytest.mark.parametrize("n,roman,letters", [(4, "iv", "d"), (1994, "mcmxciv", "rrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrrr"), (27, "xxvii", "aa")])
def test_numerals(spark, n, roman, letters):
    assert one(spark, n, T.roman, "int") == roman
    assert one(spark, n, T.letters, "int") == letters


@pytest.mark.parametrize("text,seconds", [("D:20240102030405+01'00'", 1704161045), ("D:2024", 1704067200), ("nonsense", None)])
def test_pdf_date(spark, text, seconds):
    assert one(spark, text, T.pdf_date) == seconds


def test_wrap_keeps_words(spark):
    assert one(spark, "aa bb  cccccccc d", lambda c: T.wrap(c, 5)) == ["aa bb", "cccccccc", "d"]
    assert one(spark, "", lambda c: T.wrap(c, 5)) == []


def test_coerced(spark):
    assert tuple(one(spark, " 7 ", T.coerced)) == ("number", "7")
    assert tuple(one(spark, "1", T.coerced)) == ("boolean", "true")
    assert tuple(one(spark, " x", T.coerced)) == ("text", " x")
    assert tuple(one(spark, None, T.coerced)) == ("null", None)


def test_overlapping_search(spark):
    assert one(spark, "aaaa", lambda c: search.occurrences(c, "aa")) == 3
    assert one(spark, "A.a.", lambda c: search.offsets(c, "a.")) == [0, 2]


def test_redaction_tells_no_match_from_no_text(spark):
    df = spark.createDataFrame([(1, "a@b.cd x"), (1, "none"), (2, None)], "k int, text string")
    got = {r.k: (r.matches, r.changed, r.unreadable) for r in search.redaction_report(df, ["k"], "[a-z]+@[a-z.]+").collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1)}


def test_page_spec(spark):
    assert one(spark, "3, 1-2,2", pages.parse_spec) == [1, 2, 3]
    with pytest.raises(Exception):  # noqa: B017
        one(spark, "3-1", pages.parse_spec)


def test_section_stack_is_cut_and_not_padded(spark):
    rows = [(1, 0, 1, "A"), (1, 1, 3, "B"), (1, 2, 3, "C"), (1, 3, None, "D")]
    df = spark.createDataFrame(rows, "doc int, at bigint, level int, text string")
    got = {r.at: r.path for r in structure.section_paths(df, "doc", "at").collect()}
    assert got == {0: [], 1: ["A"], 2: ["A", "B"], 3: []}


def test_table_chunks_repeat_the_header(spark):
    rows = [(1, r, c, t) for r, line in enumerate([("h", "k"), ("aaaa", "b"), ("cccc", "d"), ("e", "f")]) for c, t in enumerate(line)]
    df = spark.createDataFrame(rows, "t int, row int, col int, text string")
    got = [(r.part, r.parts, r.text) for r in render.table_chunks(df, ["t"], 14).orderBy("part").collect()]
    assert got == [(1, 3, "h | k\naaaa | b"), (2, 3, "h | k\ncccc | d"), (3, 3, "h | k\ne | f")]
    assert [r.text for r in render.table_chunks(df, ["t"], 1000).collect()] == ["h | k\naaaa | b\ncccc | d\ne | f"]


def test_html_blocks(spark):
    html = (
        "<html><head><title>t</title></head><body><nav>menu</nav><script>x='</p>'</script><h2>Head</h2><p>One <b>two<p>three"
        "<ul><li>a<ul><li>b</ul></ul><p hidden>no</p><table><tr><th>k<td>v<tr><td>1<td>2</table><footer>f</footer></body></html>"
    )
    got = [(b["kind"], b["text"], b.get("level"), b.get("row"), b.get("col")) for b in blocks.parse_html(html)]
    assert got == [
        ("heading", "Head", 2, None, None), ("paragraph", "One **two**", None, None, None), ("paragraph", "**three**", None, None, None),
        ("listItem", "**a**", 1, None, None), ("listItem", "**b**", 2, None, None),
        ("tableCell", "**k**", None, 0, 0), ("tableCell", "**v**", None, 0, 1), ("tableCell", "**1**", None, 1, 0), ("tableCell", "**2**", None, 1, 1),
    ]


def test_markdown_and_text_blocks():
    got = [(b["kind"], b["text"], b.get("level")) for b in blocks.parse_markdown("# T\n\npara\nmore\n\n- a\n  - b\n3. c\n\n```\nx # y\n```\n")]
    assert got == [("heading", "T", 1), ("paragraph", "para more", None), ("listItem", "a", 1), ("listItem", "b", 2), ("listItem", "c", 1), ("paragraph", "x # y", None)]
    assert [b["kind"] for b in blocks.parse_text("A note.\n\n- first\n* second\n3. third")] == ["paragraph", "listItem", "listItem", "listItem"]


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


EPUB = {
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
    "o/p.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
    "o/a.xhtml": "<html><body><h1>One</h1><p>text</p></body></html>",
}
DOCX = {
    "word/document.xml": '<d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></d>",
    "word/styles.xml": '<s xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></s>',
}
XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>hello</t></si></sst>",
    "xl/worksheets/s.xml": '<w><c r="B2" t="s"><v>0</v></c><c r="AA1"><f>1+1</f><v>2</v></c></w>',
}


def test_office_files(spark):
    files = [(1, packed(EPUB)), (2, packed(DOCX)), (3, packed(XLSX)), (4, b"PKbroken"), (5, None)]
    df = spark.createDataFrame(files, "doc_id bigint, content binary")
    got = {}
    for r in blocks.read_blocks(df, "office").orderBy("doc_id", "index").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text, r.row, r.col))
    assert got[1] == [("heading", "One", None, None), ("paragraph", "text", None, None)]
    assert got[2] == [("heading", "Top", None, None), ("paragraph", "Body", None, None), ("tableCell", "x", 0, 0)]
    assert got[3] == [("heading", "S", None, None), ("tableCell", "hello", 1, 1), ("tableCell", "2", 0, 26)]
    errors = blocks.read_blocks(df, "office").where("error is not null")
    assert {r.doc_id for r in errors.collect()} == {4, 5}
    assert blocks.read_blocks(df, "office", "skip").where("error is not null").count() == 0
    assert blocks.epub_metadata(packed(EPUB)) == {"title": "Book"}
    kinds = {r.doc_id: r.k for r in df.select("doc_id", blocks.sniff(F.col("content")).alias("k")).collect()}
    assert kinds[1] == "office"


def test_form_fields_round_trip(spark):
    df = spark.createDataFrame([(1, "a.b", "x<y"), (1, "c", None)], "doc_id bigint, name string, value string")
    back = forms.read_fields(forms.to_xfdf(df).withColumnRenamed("xfdf", "content"), "xfdf")
    assert {(r.name, r.value) for r in back.collect()} == {("a.b", "x<y"), ("c", "")}
    assert forms.parse_fdf(r"<< /T (n\(1\)) /V (v) >> << /V /Yes /T (box) >>") == [("n(1)", "v"), ("box", "Yes")]


def test_pairs_between_salts_hot_keys(spark):
    rows = [("k", i, i < 30) for i in range(50)] + [("l", 99, True), (None, 1, True), (None, 2, False)]
    df = spark.createDataFrame(rows, "key string, id bigint, is_left boolean")
    got = {(r.left_id, r.right_id) for r in runtime.pairs_between(df, "key", budget=7).collect()}
    assert got == {(a, b) for a in range(30) for b in range(30, 50)}


def _sample():
    return [n for n in entry.oracle_sql() if n.startswith("p4_") or not re.match(r"p[0-9]+_", n)]


@pytest.fixture(scope="session")
def tables():
    import compare

    return compare.views("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", _sample())
def test_same_as_sql(spark, tables, name):
    import compare

    got = compare.canon(entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas())
    want = compare.canon(tables.execute(entry.oracle_sql()[name]).df())
    assert [str(r) for r in got] == [str(r) for r in want]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert isinstance(duckdb.__version__, str)
