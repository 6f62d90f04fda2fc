"""Queries over texts and pages: scalars, search, redaction, page operations, tables and form values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import pages as P
from ..operators import render as R
from ..operators import search as X
from ..operators import structure as S
from ..runtime import table

QUERY = "page"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"[A-Z]{2}-[0-9]{4,5}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "page_lines").select("entry_id", "page").where("entry_id is not null and page is not null").distinct()


def text_normalised(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"))


def dedupe_exact(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def neighbour_similarity(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "line_no", "text").where("entry_id is not null").select("entry_id", "page", "line_no", "line_id", F.lower("text").alias("text"))
    before = F.lag("text").over(Window.partitionBy("entry_id").orderBy("page", "line_no", "line_id"))
    pairs = rows.withColumn("before", before).where("before is not null and text is not null")
    return pairs.select("line_id", F.round(T.similarity(F.col("before"), F.col("text")), 9).alias("similarity"))


def search_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", X.occurrences(F.col("text"), QUERY).cast("bigint").alias("n")).where("n > 0")


def search_hits(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "text").where("text is not null").select("line_id", "text")
    return X.hits(rows, ["line_id"], "as")


def pages_containing(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "text")
    return rows.where(F.contains(F.lower("text"), F.lit("ledger"))).select("entry_id", (F.col("page") + 1).alias("page_no")).distinct()


def redact_literal(spark, sf_dir):
    rows = X.redact(_docs(spark, sf_dir).where("text is not null"), "Ticket", "#")
    return rows.where("matches > 0").select("doc_id", F.md5("text").alias("digest"), F.col("matches").cast("bigint").alias("matches"))


def redact_pattern_report(spark, sf_dir):
    return X.redaction_report(_docs(spark, sf_dir), ["source"], NUMBER)


def find_replace(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(F.contains("text", F.lit("ledger")))
    return rows.select("doc_id", F.md5(F.replace(F.col("text"), F.lit("ledger"), F.lit("register"))).alias("digest"))


def bates_numbers(spark, sf_dir):
    return X.numbered(_docs(spark, sf_dir).select("doc_id"), "doc_id", "FOL").select("doc_id", "stamp")


def wrapped_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text is not null").select("doc_id", T.wrap_text(F.col("text"), 40).alias("lines"))
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("wrapped"))


def code_fences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fence(F.col("text")).alias("fence"))


def page_window(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "line_no").select("entry_id", "page", "line_no", "line_id", F.lit(True).alias("continues_previous"))
    return P.window(rows, 1, 2, order=("page", "line_no", "line_id")).select("line_id", "continues_previous")


def page_specs(spark, sf_dir):
    n = F.col("page_count")
    spec = F.concat(F.lit("1-"), F.least(F.lit(3), n).cast("string"), F.lit(","), n.cast("string"))
    rows = table(spark, sf_dir, "manifest_docs").where("page_count >= 1").select("entry_id", P.parse_spec(spec).alias("pages"))
    return rows.select("entry_id", F.explode("pages").alias("page_no"))


def page_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "manifest_docs").where("page_count is not null").select("entry_id", P.batches(F.col("page_count"), 10).alias("b"))
    return rows.select("entry_id", F.explode("b").alias("b")).select("entry_id", "b.first", "b.last")


def page_ranges(spark, sf_dir):
    return P.ranges(_pages(spark, sf_dir), "entry_id", "page")


def page_delete(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return P.delete(pages, pages.where("page = 0"), "entry_id", "page")


def page_extract(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    wanted = pages.select("entry_id", "page", (-F.col("page")).alias("position"))
    return P.extract(pages, wanted, "entry_id", "page", "position").select("entry_id", "page", "new_page")


def page_merge(spark, sf_dir):
    return P.merge(_pages(spark, sf_dir), F.floor(F.col("entry_id") / 10).cast("bigint"), ["entry_id", "page"]).select("merged_id", "entry_id", "page", "new_page")


def _cells(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"), F.max("l_quantity").cast("int").cast("string").alias("q")
    )
    body = rows.select("l_orderkey", F.col("l_linenumber").alias("row"), F.posexplode(F.array("q", "l_returnflag", "l_linestatus")).alias("col", "text"))
    heads = rows.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, ["quantity", "flag", "status"]))).alias("col", "text"))
    return body.unionByName(heads)


def table_texts(spark, sf_dir):
    return R.table_texts(_cells(spark, sf_dir), ["l_orderkey"])


def table_markdown(spark, sf_dir):
    return R.table_markdown(_cells(spark, sf_dir), ["l_orderkey"])


def table_chunks(spark, sf_dir):
    return R.table_chunks(_cells(spark, sf_dir), ["l_orderkey"], 40)


def grid_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    cells = rows.select(
        "l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_linenumber").alias("order"),
        (F.col("l_linenumber") - 1).alias("row"), (F.col("l_linenumber") % 3).alias("col"), F.lit(1).alias("row_span"), (F.col("l_linenumber") % 2 + 1).alias("col_span"),
    )
    return R.grid(cells, ["l_orderkey"])


def coerced_props(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.get_json_object("props", "$.k")).when(F.col("event_id") % 4 == 2, "true").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.coerced(value).alias("v")).select("event_id", "v.type", "v.value")


def json_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return rows.where("k is not null").groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


def plain_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.plain_number(F.round("c_acctbal", 0)).alias("balance"))


_P = "P AS (SELECT DISTINCT entry_id, page FROM page_lines WHERE entry_id IS NOT NULL AND page IS NOT NULL)"
_L = """L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1)"""
_CELLS = """R AS (SELECT l_orderkey, l_linenumber AS row, [CAST(CAST(max(l_quantity) AS INT) AS VARCHAR), max(l_returnflag), max(l_linestatus)] AS c FROM lineitem GROUP BY 1, 2
UNION ALL SELECT DISTINCT l_orderkey, 0, ['quantity', 'flag', 'status'] FROM lineitem)"""

QUERIES = {
    f.__name__: f
    for f in (
        text_normalised, dedupe_exact, neighbour_similarity, search_counts, search_hits, pages_containing, redact_literal, redact_pattern_report, find_replace,
        bates_numbers, wrapped_lines, code_fences, page_window, page_specs, page_batches, page_ranges, page_delete, page_extract, page_merge,
        table_texts, table_markdown, table_chunks, grid_expand, coerced_props, json_paths, plain_numbers,
    )
}

ORACLES = {
    "text_normalised": r"""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0e-\x1f\x7f\r]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) AS digest
FROM documents WHERE text IS NOT NULL""",
    "dedupe_exact": "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "search_counts": "SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'page', ''))) // 4 AS n FROM documents WHERE contains(lower(text), 'page')",
    "search_hits": f"""WITH {_L}, H AS (SELECT line_id, text, unnest(list_filter(range(1, length(text)), lambda i: substr(lower(text), i, 2) = 'as')) AS i FROM L WHERE text IS NOT NULL)
SELECT line_id, CAST(i - 1 AS INT) AS "offset", substr(text, i, 2) AS matched FROM H""",
    "pages_containing": f"WITH {_L} SELECT DISTINCT entry_id, page + 1 AS page_no FROM L WHERE contains(lower(text), 'ledger')",
    "redact_literal": """SELECT doc_id, md5(replace(text, 'Ticket', '######')) AS digest, (length(text) - length(replace(text, 'Ticket', ''))) // 6 AS matches
FROM documents WHERE contains(text, 'Ticket')""",
    "redact_pattern_report": f"""SELECT source, coalesce(sum(len(regexp_extract_all(text, '{NUMBER}'))), 0)::BIGINT AS matches,
  count(*) FILTER (regexp_matches(text, '{NUMBER}')) AS changed, count(*) FILTER (text IS NULL) AS unreadable FROM documents GROUP BY 1""",
    "find_replace": "SELECT doc_id, md5(replace(text, 'ledger', 'register')) AS digest FROM documents WHERE contains(text, 'ledger')",
    "bates_numbers": "SELECT doc_id, 'FOL' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 6, '0') AS stamp FROM documents",
    "code_fences": "SELECT doc_id, repeat('`', CAST(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0)) AS INT)) AS fence FROM documents",
    "page_window": f"""WITH {_L} SELECT line_id, row_number() OVER (PARTITION BY entry_id ORDER BY page, line_no, line_id) > 1 AS continues_previous
FROM L WHERE page >= 1 AND page < 3""",
    "page_specs": """SELECT entry_id, unnest(list_sort(list_distinct(list_append(range(1, least(3, page_count) + 1), page_count)))) ::INT AS page_no
FROM manifest_docs WHERE page_count >= 1""",
    "page_batches": """WITH B AS (SELECT entry_id, page_count, unnest(range(1, page_count + 1, 10)) AS f FROM manifest_docs WHERE page_count IS NOT NULL)
SELECT entry_id, CAST(f AS INT) AS "first", CAST(least(f + 9, page_count) AS INT) AS "last" FROM B""",
    "page_ranges": f"""WITH {_P}, I AS (SELECT entry_id, page, page - row_number() OVER (PARTITION BY entry_id ORDER BY page) AS i FROM P)
SELECT entry_id, min(page) AS "first", max(page) AS "last" FROM I GROUP BY entry_id, i""",
    "page_delete": f"WITH {_P} SELECT entry_id, page, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY page) - 1 AS INT) AS new_page FROM P WHERE page <> 0",
    "page_extract": f"WITH {_P} SELECT entry_id, page, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY page DESC) - 1 AS INT) AS new_page FROM P",
    "page_merge": f"""WITH {_P} SELECT entry_id // 10 AS merged_id, entry_id, page,
  CAST(row_number() OVER (PARTITION BY entry_id // 10 ORDER BY entry_id, page) - 1 AS INT) AS new_page FROM P""",
    "table_texts": f"""WITH {_CELLS} SELECT l_orderkey, string_agg(array_to_string(c, ' | '), chr(10) ORDER BY row) AS text FROM R GROUP BY 1""",
    "table_markdown": f"""WITH {_CELLS} SELECT l_orderkey, string_agg('| ' || array_to_string(c, ' | ') || ' |' || CASE WHEN row = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY row) AS markdown
FROM R GROUP BY 1""",
    "table_chunks": f"""WITH RECURSIVE {_CELLS}, T AS (SELECT l_orderkey, array_to_string(c, ' | ') AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY row) AS i FROM R),
H AS (SELECT l_orderkey, line AS header FROM T WHERE i = 1), Z AS (SELECT l_orderkey, sum(length(line) + 1) - 1 AS whole FROM T GROUP BY 1),
W AS (
  SELECT t.l_orderkey, t.i, t.line, length(h.header) + 1 + length(t.line) AS size, 1 AS part FROM T t JOIN H h USING (l_orderkey) WHERE t.i = 2
  UNION ALL
  SELECT t.l_orderkey, t.i, t.line, CASE WHEN w.size + 1 + length(t.line) > 40 THEN length(h.header) + 1 + length(t.line) ELSE w.size + 1 + length(t.line) END,
    CASE WHEN w.size + 1 + length(t.line) > 40 THEN w.part + 1 ELSE w.part END
  FROM W w JOIN T t ON t.l_orderkey = w.l_orderkey AND t.i = w.i + 1 JOIN H h ON h.l_orderkey = t.l_orderkey
), Q AS (SELECT w.l_orderkey, w.i, w.line, CASE WHEN z.whole <= 40 THEN 1 ELSE w.part END AS part FROM W w JOIN Z z USING (l_orderkey)),
M AS (SELECT l_orderkey, max(part) AS parts FROM Q GROUP BY 1)
SELECT q.l_orderkey, q.part, m.parts, h.header || chr(10) || string_agg(q.line, chr(10) ORDER BY q.i) AS text
FROM Q q JOIN M m USING (l_orderkey) JOIN H h USING (l_orderkey) GROUP BY q.l_orderkey, q.part, m.parts, h.header""",
    "grid_expand": """WITH C AS (SELECT l_orderkey, max(l_returnflag) || l_linenumber AS text, l_linenumber AS o, l_linenumber - 1 AS row, l_linenumber % 3 AS c0, l_linenumber % 2 AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
E AS (SELECT l_orderkey, text, o, row, unnest(range(c0, c0 + s + 1)) AS col FROM C),
G AS (SELECT l_orderkey, row, col, arg_max(text, o) AS text FROM E GROUP BY 1, 2, 3),
S AS (SELECT l_orderkey, max(row) AS r, max(col) AS c FROM G GROUP BY 1),
A AS (SELECT l_orderkey, unnest(range(0, r + 1)) AS row, c FROM S), B AS (SELECT l_orderkey, row, unnest(range(0, c + 1)) AS col FROM A)
SELECT l_orderkey, CAST(row AS INT) AS row, CAST(col AS INT) AS col, coalesce(text, '') AS text FROM B LEFT JOIN G USING (l_orderkey, row, col)""",
    "coerced_props": r"""WITH V AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN 'true' ELSE event_type END AS c FROM events),
K AS (SELECT *, CASE WHEN c IS NULL OR trim(c) = '' THEN 'null' WHEN trim(c) IN ('true', 'false', '0', '1') THEN 'boolean'
  WHEN regexp_matches(trim(c), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'number' ELSE 'text' END AS type FROM V)
SELECT event_id, type, CASE type WHEN 'null' THEN NULL WHEN 'boolean' THEN CASE WHEN trim(c) IN ('true', '1') THEN 'true' ELSE 'false' END
  WHEN 'number' THEN CAST(CAST(c AS BIGINT) AS VARCHAR) ELSE c END AS value FROM K""",
    "json_paths": """SELECT event_type, CAST(sum(k) AS BIGINT) AS total, count(*) AS n FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
WHERE k IS NOT NULL GROUP BY 1""",
    "plain_numbers": "SELECT c_custkey, CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) AS balance FROM customer",
}
