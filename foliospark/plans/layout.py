"""Queries over the layout of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as Y
from ..operators import structure as S
from ..runtime import table


def _lines(spark, sf_dir, *columns):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "line_no", "kind", "bbox", *columns)
    return Y.sized(rows.where("entry_id is not null and page is not null"))


def body_sizes(spark, sf_dir):
    return Y.body_sizes(_lines(spark, sf_dir, "text"))


def heading_levels(spark, sf_dir):
    return Y.heading_levels(_lines(spark, sf_dir, "text"))


def paragraph_numbers(spark, sf_dir):
    return Y.paragraph_numbers(_lines(spark, sf_dir))


def list_levels(spark, sf_dir):
    return Y.list_levels(_lines(spark, sf_dir))


def head_frequency(spark, sf_dir):
    return Y.head_frequency(_lines(spark, sf_dir, "text"))


def page_number_lines(spark, sf_dir):
    return Y.page_number_lines(_lines(spark, sf_dir, "text"))


def subtitles(spark, sf_dir):
    return Y.subtitles(_lines(spark, sf_dir), 1.0)


def overlapping_lines(spark, sf_dir):
    return Y.overlapping_lines(_lines(spark, sf_dir))


def word_boxes(spark, sf_dir):
    return Y.word_boxes(_lines(spark, sf_dir, "text"))


def regrouped_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir, "text")
    words = Y.word_boxes(rows).join(rows.select("line_id", "entry_id", "page"), "line_id")
    return Y.lines_of_words(words, ["entry_id", "page"])


def tables_over_pages(spark, sf_dir):
    return Y.tables_over_pages(_lines(spark, sf_dir, "table_id"))


def kept_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    some = F.when(F.col("f") == "N", " ").otherwise(F.col("f"))
    cells = rows.select("l_orderkey", F.col("l_linenumber").alias("row"), F.posexplode(F.array(some, "s")).alias("col", "text"))
    return Y.kept_columns(cells, ["l_orderkey"])


def figure_names(spark, sf_dir):
    hulls = S.extents(_lines(spark, sf_dir, "table_id").where("table_id is not null"), ["entry_id", "page", "table_id"])
    return Y.figure_names(hulls).select("entry_id", "table_id", "page", "name")


def style_features(spark, sf_dir):
    return Y.style_features(_lines(spark, sf_dir, "text"))


def table_distance(spark, sf_dir):
    return Y.table_distance(_lines(spark, sf_dir, "table_id"))


def lines_outside_tables(spark, sf_dir):
    rows = _lines(spark, sf_dir, "table_id")
    boxes = S.extents(rows.where("table_id is not null"), ["entry_id", "page", "table_id"])
    return Y.outside(rows, boxes.select("entry_id", "page", *[F.col(c).alias(f"b{i}") for i, c in enumerate(("x0", "y0", "x1", "y1"))])).select("line_id")


def recognition_need(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "text").where("entry_id is not null and page is not null")
    return Y.recognition_need(rows, 1200)


QUERIES = {
    f.__name__: f
    for f in (
        body_sizes, heading_levels, paragraph_numbers, list_levels, head_frequency, page_number_lines, subtitles, overlapping_lines, word_boxes, regrouped_lines, tables_over_pages,
        kept_columns, figure_names, style_features, table_distance, lines_outside_tables, recognition_need,
    )
}

_L = """L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1),
B AS (SELECT line_id, entry_id, page, line_no, kind, text, table_id, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1, round(bbox[4] - bbox[2], 1) AS size
  FROM L WHERE entry_id IS NOT NULL AND page IS NOT NULL AND len(bbox) = 4)"""
_BODY = """Z AS (SELECT entry_id, size, sum(coalesce(length(text), 0)) AS n FROM B GROUP BY 1, 2),
Y AS (SELECT entry_id, size AS body FROM Z QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n DESC, size) = 1)"""
_HULL = "H AS (SELECT entry_id, page, table_id, min(x0) AS b0, min(y0) AS b1, max(x1) AS b2, max(y1) AS b3 FROM B WHERE table_id IS NOT NULL GROUP BY 1, 2, 3)"
_KEY = r"regexp_replace(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), '[0-9]+', '#', 'g')"

ORACLES = {
    "body_sizes": f"WITH {_L}, {_BODY} SELECT entry_id, body AS size FROM Y",
    "heading_levels": f"""WITH {_L}, {_BODY} SELECT line_id, CAST(least(3, dense_rank() OVER (PARTITION BY entry_id ORDER BY size DESC)) AS INT) AS level FROM B JOIN Y USING (entry_id) WHERE size > body""",
    "paragraph_numbers": f"""WITH {_L}, S AS (SELECT *, CASE WHEN lag(y0) OVER w - y1 <= 0.6 * size AND abs(size - lag(size) OVER w) <= 0.1 * lag(size) OVER w AND kind = lag(kind) OVER w AND kind <> 'listItem' THEN 0 ELSE 1 END AS s
  FROM B WINDOW w AS (PARTITION BY entry_id, page ORDER BY line_no, line_id))
SELECT line_id, CAST(sum(s) OVER (PARTITION BY entry_id, page ORDER BY line_no, line_id) AS INT) AS paragraph FROM S""",
    "list_levels": f"WITH {_L} SELECT line_id, CAST(dense_rank() OVER (PARTITION BY entry_id, page ORDER BY floor(x0 / 4)) AS INT) AS level FROM B WHERE kind = 'listItem'",
    "head_frequency": f"WITH {_L} SELECT line_id, count(*) OVER (PARTITION BY entry_id, page, string_split_regex(trim(text, ' '), '\\s+')[1], round(x0)) AS times FROM B WHERE trim(text, ' ') <> ''",
    "page_number_lines": f"""WITH {_L}, E AS (SELECT entry_id, page, min(x0) AS l, max(x1) AS r, min(y0) AS low FROM B WHERE kind NOT IN ('header', 'footer') GROUP BY 1, 2),
K AS (SELECT *, {_KEY} AS k FROM B) SELECT line_id FROM K JOIN E USING (entry_id, page)
WHERE (contains(k, '#') OR (k <> '' AND regexp_matches(k, '{T.ROMAN}'))) AND y1 <= low AND abs(x0 - l) > 0.01 * (r - l)""",
    "subtitles": f"""WITH {_L}, P AS (SELECT line_id, y1, lag(line_id) OVER w AS heading_id, lag(kind) OVER w AS k, lag(y0) OVER w AS low, lag(size) OVER w AS s FROM B WINDOW w AS (PARTITION BY entry_id, page ORDER BY line_no, line_id))
SELECT line_id, heading_id FROM P WHERE k = 'heading' AND low - y1 <= s""",
    "overlapping_lines": f"""WITH {_L} SELECT a.line_id AS line_a, b.line_id AS line_b FROM B a JOIN B b ON a.entry_id = b.entry_id AND a.page = b.page AND a.line_id < b.line_id
WHERE least(a.y1, b.y1) - greatest(a.y0, b.y0) > least(a.y1 - a.y0, b.y1 - b.y0) / 2""",
    "word_boxes": rf"""WITH {_L}, P AS (SELECT line_id, x0, x1, y0, y1, text, unnest(range(1, length(text) + 1)) AS i FROM B WHERE trim(text, ' ') <> ''),
S AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY i) - 1 AS n, regexp_extract(substr(text, i), '^\S+') AS word, (x1 - x0) / length(text) AS unit FROM P
  WHERE NOT regexp_matches(substr(text, i, 1), '\s') AND (i = 1 OR regexp_matches(substr(text, i - 1, 1), '\s')))
SELECT line_id, CAST(n AS INT) AS word_no, word, round(x0 + unit * (i - 1), 3) AS x0, round(x0 + unit * (i - 1) + unit * length(word), 3) AS x1, y0, y1 FROM S""",
    "regrouped_lines": rf"""WITH {_L} SELECT entry_id, page, CAST(row_number() OVER (PARTITION BY entry_id, page ORDER BY y1 DESC) - 1 AS INT) AS line,
  array_to_string(list_filter(string_split_regex(trim(text, ' '), '\s+'), lambda x: x <> ''), ' ') AS text FROM B WHERE trim(text, ' ') <> ''""",
    "tables_over_pages": f"""WITH {_L}, {_HULL}, E AS (SELECT entry_id, page, arg_min(struct_pack(t := table_id), line_no * 1000000000000 + line_id) AS f, arg_max(struct_pack(t := table_id), line_no * 1000000000000 + line_id) AS l
  FROM B WHERE kind NOT IN ('header', 'footer') GROUP BY 1, 2)
SELECT a.entry_id, a.page, a.l.t AS table_id, b.f.t AS next_table_id FROM E a JOIN E b ON a.entry_id = b.entry_id AND b.page = a.page + 1
JOIN H x ON x.entry_id = a.entry_id AND x.page = a.page AND x.table_id = a.l.t JOIN H y ON y.entry_id = b.entry_id AND y.page = b.page AND y.table_id = b.f.t WHERE abs(x.b0 - y.b0) <= 3""",
    "kept_columns": """WITH R AS (SELECT l_orderkey, l_linenumber AS row, [CASE WHEN max(l_returnflag) = 'N' THEN ' ' ELSE max(l_returnflag) END, max(l_linestatus)] AS c FROM lineitem GROUP BY 1, 2),
C AS (SELECT l_orderkey, row, unnest([0, 1]) AS col, unnest(c) AS text FROM R), K AS (SELECT l_orderkey, col FROM C GROUP BY 1, 2 HAVING count(*) FILTER (trim(text) <> '') > 0),
N AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY col) - 1 AS INT) AS n FROM K) SELECT C.l_orderkey, C.row, n AS col, C.text FROM C JOIN N USING (l_orderkey, col)""",
    "figure_names": f"""WITH {_L}, {_HULL} SELECT entry_id, table_id, page, 'figure-' || (page + 1) || '-' || row_number() OVER (PARTITION BY entry_id, page ORDER BY b3 DESC, b0) AS name FROM H""",
    "style_features": rf"""WITH {_L}, {_BODY} SELECT line_id, round(size / body, 6) AS size_ratio, round(len(regexp_extract_all(text, '\p{{Lu}}')) / length(text), 6) AS upper, round(len(regexp_extract_all(text, '[0-9]')) / length(text), 6) AS digits,
  CAST(len(string_split_regex(trim(text, ' '), '\s+')) AS INT) AS words, rtrim(text, ' ') LIKE '%:' AS colon FROM B JOIN Y USING (entry_id) WHERE trim(text, ' ') <> ''""",
    "table_distance": f"WITH {_L}, {_HULL} SELECT line_id, round(min(greatest(0, b1 - y1, y0 - b3)), 3) AS distance FROM B JOIN H USING (entry_id, page) WHERE B.table_id IS NULL GROUP BY 1",
    "lines_outside_tables": f"WITH {_L}, {_HULL} SELECT line_id FROM B WHERE NOT EXISTS (SELECT 1 FROM H WHERE H.entry_id = B.entry_id AND H.page = B.page AND x0 >= b0 AND x1 <= b2 AND y0 >= b1 AND y1 <= b3)",
    "recognition_need": f"""WITH {_L} SELECT entry_id, page, coalesce(sum(length(trim(text, ' '))), 0)::BIGINT AS signs, CASE WHEN coalesce(sum(length(trim(text, ' '))), 0) < 1200 THEN 'full' ELSE 'none' END AS need
FROM L WHERE entry_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2""",
}
