"""Queries over page lines: structure recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import render as R
from ..operators import structure as S
from ..runtime import table


def _lines(spark, sf_dir, *columns):
    return S.lines(table(spark, sf_dir, "page_lines"), *columns)


def text_blocks(spark, sf_dir):
    return S.text_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def block_words(spark, sf_dir):
    return S.words(_lines(spark, sf_dir, "text"), ["line_id"])


def line_word_counts(spark, sf_dir):
    words = S.words(_lines(spark, sf_dir, "text"), ["line_id"])
    return words.groupBy("line_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("word").rlike("[0-9]")).alias("digits"))


def line_paragraphs(spark, sf_dir):
    return S.paragraphs(_lines(spark, sf_dir, "entry_id", "page", "line_no", "block", "kind", "text"))


def furniture_keys(spark, sf_dir):
    return S.furniture(_lines(spark, sf_dir, "entry_id", "page", "text"))


def reading_order(spark, sf_dir):
    return S.reading_order(_lines(spark, sf_dir, "entry_id", "page", "line_no", "kind")).select("line_id", "index")


def continuations(spark, sf_dir):
    return S.continuations(_lines(spark, sf_dir, "entry_id", "page", "line_no", "kind", "text"))


def nearest_heading(spark, sf_dir):
    return S.nearest_heading(_lines(spark, sf_dir, "entry_id", "page", "line_no", "kind", "text"))


def line_context(spark, sf_dir):
    return S.context(_lines(spark, sf_dir, "entry_id", "page", "line_no", "words", "digits"), ["words", "digits"])


def list_ordinals(spark, sf_dir):
    return S.list_ordinals(_lines(spark, sf_dir, "entry_id", "page", "line_no", "kind"))


def page_extents(spark, sf_dir):
    return S.extents(_lines(spark, sf_dir, "entry_id", "page", "bbox"), ["entry_id", "page"])


def clip_margins(spark, sf_dir):
    rows = _lines(spark, sf_dir, "entry_id", "page", "bbox")
    return S.clip(rows.where(F.col("bbox").isNotNull()), S.extents(rows, ["entry_id", "page"]).drop("boxes"), 0.05)


def table_extents(spark, sf_dir):
    rows = _lines(spark, sf_dir, "entry_id", "page", "table_id", "bbox").where("table_id is not null")
    return S.extents(rows, ["entry_id", "page", "table_id"])


def page_markdown(spark, sf_dir):
    rows = _lines(spark, sf_dir, "entry_id", "page", "line_no", "kind", "text").where("text is not null").withColumn("level", F.lit(2))
    return R.document_markdown(rows, ["entry_id", "page"], ["line_no", "line_id"])


def heading_gaps(spark, sf_dir):
    styles = table(spark, sf_dir, "style_info").where("outline is not null and style_id is not null")
    rows = S.latest(styles, ["entry_id", "style_id"], "loaded_at", ["outline"]).withColumn("level", F.col("outline") + 1)
    return S.heading_gaps(rows, ["entry_id"], ["style_id"]).select("entry_id", "style_id", "level", "previous")


def section_path(spark, sf_dir):
    headings = (
        _lines(spark, sf_dir, "entry_id", "page", "line_no", "kind", "text")
        .where("kind = 'heading' and text is not null")
        .select(F.concat_ws("-", "entry_id", "page").alias("doc"), "line_no", (F.col("line_no") % 3 + 1).alias("level"), "text")
        .groupBy("doc", "line_no")
        .agg(F.max(F.struct("level", "text")).alias("h"))
        .select("doc", "line_no", "h.level", "h.text")
    )
    return S.section_paths(headings, "doc", "line_no").select("doc", "line_no", F.array_join("path", " / ").alias("path"))


def item_markers(spark, sf_dir):
    rows = _lines(spark, sf_dir, "kind", "text").where("kind = 'listItem' and text is not null")
    return rows.select("line_id", T.item_marker(F.col("text")).alias("marker"), T.item_text(F.col("text")).alias("item"))


def numeric_tokens(spark, sf_dir):
    words = S.words(_lines(spark, sf_dir, "kind", "text").where("kind = 'tableCell'"), ["line_id"])
    return words.where(T.is_numeric_token(F.col("word"))).select("line_id", "word_no", T.typed_number(F.col("word")).alias("number"))


def grid_fill_stats(spark, sf_dir):
    rows = _lines(spark, sf_dir, "kind", "grid_fill", "grid_columns").where("grid_fill < 1e300")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grid_fill"), 6).alias("mean_fill"), F.max(F.when(F.col("grid_columns") < 1e300, F.col("grid_columns"))).alias("most_columns"))


L = """L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1)"""
_SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_ROMAN = T.ROMAN
_MARK = rf"^([{T.BULLETS}]|[0-9]{{1,9}}[.)]) "
_KEY = "regexp_replace(lower(" + _SQUEEZE.format("text") + "), '[0-9]+', '#', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        text_blocks, block_words, line_word_counts, line_paragraphs, furniture_keys, reading_order, continuations, nearest_heading, line_context,
        list_ordinals, page_extents, clip_margins, table_extents, page_markdown, heading_gaps, section_path, item_markers, numeric_tokens, grid_fill_stats,
    )
}

_WORDS = f"""WITH {L}, W AS (
  SELECT line_id, list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> '') AS ws FROM L WHERE text IS NOT NULL
), X AS (SELECT line_id, unnest(range(0, len(ws))) AS i, ws FROM W), words AS (
  SELECT line_id, CAST(i AS INT) AS word_no, ws[i + 1] AS word FROM X)"""

ORACLES = {
    "text_blocks": rf"""WITH S AS (
  SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), R AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, ls FROM S), T AS (
  SELECT doc_id, line_no, trim(ls[line_no + 1], ' ') AS line FROM R
), F AS (
  SELECT *, regexp_matches(line, '{_MARK}') AS item,
    lag(line, 1, '') OVER w AS before, coalesce(lag(regexp_matches(line, '{_MARK}')) OVER w, false) AS item_before
  FROM T WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), B AS (
  SELECT *, sum(CASE WHEN item OR before = '' OR item_before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block
  FROM F WHERE line <> ''
), G AS (SELECT doc_id, block, bool_or(item) AS item, string_agg(line, ' ' ORDER BY line_no) AS line FROM B GROUP BY ALL)
SELECT doc_id, CAST(block - 1 AS INT) AS index, CASE WHEN item THEN 'listItem' ELSE 'paragraph' END AS kind,
  CASE WHEN item THEN trim(regexp_replace(line, '{_MARK}', ''), ' ') ELSE line END AS text FROM G""",
    "block_words": _WORDS + " SELECT * FROM words",
    "line_word_counts": _WORDS
    + " SELECT line_id, count(*) AS words, count(*) FILTER (regexp_matches(word, '[0-9]')) AS digits FROM words GROUP BY 1",
    "line_paragraphs": rf"""WITH {L} SELECT entry_id, page, block, min(kind) AS kind,
  {_SQUEEZE.format(r"replace(regexp_replace(string_agg(coalesce(text, ''), chr(10) ORDER BY line_no, line_id), '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ')")} AS text,
  count(*) AS n_lines FROM L WHERE block IS NOT NULL GROUP BY 1, 2, 3""".replace(r"\p{L}", r"\pL"),
    "furniture_keys": f"""WITH {L}, K AS (
  SELECT entry_id, page, {_KEY} AS k FROM L WHERE length(text) <= 160 AND trim(text, ' ') <> ''
), N AS (SELECT entry_id, page, CASE WHEN regexp_matches(k, '{_ROMAN}') AND k <> '' THEN '#' ELSE k END AS key FROM K)
SELECT entry_id, key, count(DISTINCT page) AS pages, count(*) AS lines FROM N GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3""",
    "reading_order": f"""WITH {L} SELECT line_id, CAST(row_number() OVER (PARTITION BY entry_id, page
  ORDER BY kind IN ('header', 'footer') NULLS FIRST, line_no NULLS FIRST, line_id) - 1 AS INT) AS index FROM L""",
    "continuations": rf"""WITH {L}, B AS (SELECT * FROM L WHERE kind NOT IN ('header', 'footer') AND text IS NOT NULL), E AS (
  SELECT entry_id, page, arg_min(struct_pack(kind := kind, text := text), line_no * 1000000000000 + line_id) AS head,
    arg_max(struct_pack(kind := kind, text := text), line_no * 1000000000000 + line_id) AS tail FROM B GROUP BY 1, 2
) SELECT b.entry_id, b.page FROM E b JOIN E a ON a.entry_id = b.entry_id AND a.page + 1 = b.page
WHERE a.tail.kind = 'paragraph' AND b.head.kind = 'paragraph' AND NOT regexp_matches(rtrim(a.tail.text, ' '), '[.!?:;]$')
  AND regexp_matches(ltrim(b.head.text, ' '), '^\p{{Ll}}')""",
    "nearest_heading": f"""WITH {L} SELECT line_id, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS)
  OVER (PARTITION BY entry_id, page ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM L""",
    "line_context": f"WITH {L} SELECT line_id, "
    + ", ".join(
        f"{'lag' if way == 'before' else 'lead'}({c}, {k}) OVER w AS {c}_{way}_{k}" for c in ("words", "digits") for way in ("before", "after") for k in (1, 2)
    )
    + " FROM L WINDOW w AS (PARTITION BY entry_id, page ORDER BY line_no, line_id)",
    "list_ordinals": f"""WITH {L}, R AS (SELECT *, sum(CASE WHEN kind = 'listItem' THEN 0 ELSE 1 END)
  OVER (PARTITION BY entry_id, page ORDER BY line_no, line_id) AS run FROM L)
SELECT line_id, CAST(row_number() OVER (PARTITION BY entry_id, page, run ORDER BY line_no, line_id) AS INT) AS ordinal FROM R WHERE kind = 'listItem'""",
    "page_extents": f"""WITH {L} SELECT entry_id, page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1, count(*) AS boxes
FROM L WHERE len(bbox) = 4 GROUP BY 1, 2""",
    "clip_margins": f"""WITH {L}, E AS (SELECT entry_id, page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1
  FROM L WHERE len(bbox) = 4 GROUP BY 1, 2)
SELECT line_id FROM L JOIN E USING (entry_id, page)
WHERE (bbox[1] + bbox[3]) / 2 BETWEEN x0 + (x1 - x0) * 0.05 AND x1 - (x1 - x0) * 0.05
  AND (bbox[2] + bbox[4]) / 2 BETWEEN y0 + (y1 - y0) * 0.05 AND y1 - (y1 - y0) * 0.05""",
    "table_extents": f"""WITH {L} SELECT entry_id, page, table_id, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1, count(*) AS boxes
FROM L WHERE len(bbox) = 4 AND table_id IS NOT NULL GROUP BY 1, 2, 3""",
    "page_markdown": rf"""WITH {L}, M AS (SELECT entry_id, page, line_no, line_id, CASE
  WHEN kind = 'heading' THEN '## ' || text
  WHEN kind = 'listItem' THEN '- ' || trim(regexp_replace(text, '{_MARK}', ''), ' ')
  WHEN regexp_matches(text, '^[0-9]+[.)] ') THEN regexp_replace(text, '^([0-9]+)', '\\\1')
  ELSE regexp_replace(text, '^([#<>+*-])', '\\\1') END AS md
  FROM L WHERE text IS NOT NULL AND kind NOT IN ('header', 'footer') AND trim(text, ' ') <> '')
SELECT entry_id, page, string_agg(md, chr(10) || chr(10) ORDER BY line_no, line_id) AS markdown FROM M GROUP BY 1, 2""",
    "heading_gaps": """WITH S AS (SELECT entry_id, style_id, outline + 1 AS level FROM style_info WHERE outline IS NOT NULL AND style_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entry_id, style_id ORDER BY loaded_at DESC NULLS LAST) = 1),
P AS (SELECT *, lag(level) OVER (PARTITION BY entry_id ORDER BY style_id) AS previous FROM S)
SELECT entry_id, style_id, level, previous FROM P WHERE level > coalesce(previous, 0) + 1""",
    "section_path": f"""WITH RECURSIVE {L}, H AS (
  SELECT entry_id || '-' || page AS doc, line_no, arg_max(struct_pack(level := line_no % 3 + 1, text := text), text) AS h
  FROM L WHERE kind = 'heading' AND text IS NOT NULL AND entry_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2
), N AS (SELECT doc, line_no, h.level AS level, h.text AS text, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS i FROM H
), W AS (
  SELECT doc, line_no, i, CAST([] AS VARCHAR[]) AS path, [text] AS stack FROM N WHERE i = 1
  UNION ALL
  SELECT n.doc, n.line_no, n.i, list_slice(w.stack, 1, n.level - 1), list_concat(list_slice(w.stack, 1, n.level - 1), [n.text])
  FROM W w JOIN N n ON n.doc = w.doc AND n.i = w.i + 1
) SELECT doc, CAST(line_no AS BIGINT) AS line_no, array_to_string(path, ' / ') AS path FROM W""",
    "item_markers": f"""WITH {L} SELECT line_id, regexp_extract(text, '{_MARK}', 1) AS marker, trim(regexp_replace(text, '{_MARK}', ''), ' ') AS item
FROM L WHERE kind = 'listItem' AND text IS NOT NULL""",
    "numeric_tokens": _WORDS.replace("FROM L WHERE text IS NOT NULL", "FROM L WHERE text IS NOT NULL AND kind = 'tableCell'")
    + r""" SELECT line_id, word_no, CASE WHEN word LIKE '%\%' ESCAPE '\' THEN try_cast(rtrim(replace(word, ',', ''), '%') AS DOUBLE) / 100
  WHEN regexp_matches(word, '^\(.*\)$') THEN -try_cast(trim(replace(word, ',', ''), '()') AS DOUBLE) ELSE
  CASE WHEN regexp_matches(replace(word, ',', ''), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$') THEN try_cast(replace(word, ',', '') AS DOUBLE) END END AS number FROM words
WHERE regexp_matches(regexp_replace(word, '[()\[\]†‡*,%±]', '', 'g'), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$')""",
    "grid_fill_stats": f"""WITH {L} SELECT kind, count(*) AS n, round(avg(grid_fill), 6) AS mean_fill, max(CASE WHEN CAST(grid_columns AS VARCHAR) <> 'nan' THEN grid_columns END) AS most_columns
FROM L WHERE grid_fill IS NOT NULL AND CAST(grid_fill AS VARCHAR) <> 'nan' GROUP BY 1""",
}
