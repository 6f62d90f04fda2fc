"""Queries that put pages and trees of documents in another order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import hierarchy as H
from ..operators import pages as P
from ..operators import structure as S
from ..runtime import table
from .hierarchy import _TREE


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "page_lines").select("entry_id", "page").where("entry_id is not null and page is not null").distinct()


def page_insert(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return P.insert(pages, pages.where("page < 2"), "entry_id", "page", 2)


def page_rearrange(spark, sf_dir):
    return P.rearrange(_pages(spark, sf_dir), "entry_id", "page", F.col("page") % 2)


def page_split(spark, sf_dir):
    return P.split_pages(_pages(spark, sf_dir), "entry_id", "page")


def page_range_split(spark, sf_dir):
    spans = spark.createDataFrame([("a", 0, 1), ("b", 1, 3), ("c", 4, 1_000_000)], "part string, first int, last int")
    return P.split_ranges(_pages(spark, sf_dir), spans, "entry_id", "page")


def page_written_ranges(spark, sf_dir):
    n = F.col("page_count")
    spec = F.concat(F.lit("2-"), n.cast("string"), F.lit(", 1,"), n.cast("string"))
    rows = table(spark, sf_dir, "manifest_docs").where("page_count >= 2").select("entry_id", F.posexplode(P.written_ranges(spec, n)).alias("at", "r"))
    return rows.select("entry_id", "at", "r.first", "r.last")


def page_turns(spark, sf_dir):
    boxes = S.extents(S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "bbox"), ["entry_id", "page"])
    inner = P.cropped(F.array("x0", "y0", "x1", "y1"), 10.0, 10.0, 10.0, 10.0)
    rows = boxes.withColumn("inner", inner).where("entry_id is not null and page is not null")
    return rows.select("entry_id", "page", P.turned(F.col("page") * 90, 270).alias("rotation"), F.round(F.col("inner")[2] - F.col("inner")[0], 3).alias("width"))


def page_bookmarks(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "kind", "text").where("entry_id is not null and page is not null")
    counts = rows.groupBy("entry_id").agg((F.max("page") + 1).alias("pages")).withColumn("merged_id", F.floor(F.col("entry_id") / 10).cast("bigint"))
    marks = rows.where("kind = 'heading' and text is not null").select("entry_id", F.col("text").alias("title"), "page")
    return P.merged_bookmarks(marks, counts, "entry_id", "merged_id")


def copy_references(spark, sf_dir):
    return P.first_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.sha2("text", 256))


def page_copies(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "kind", "text").where("text is not null")
    return P.first_copies(rows, "line_id", F.sha2(F.concat_ws("\n", "kind", "text"), 256))


def _tree(spark, sf_dir):
    return H.hierarchy(table(spark, sf_dir, "style_info"), with_path=True)


def tree_preorder(spark, sf_dir):
    rows = _tree(spark, sf_dir).where("depth >= 0")
    return rows.select("entry_id", "style_id", (F.row_number().over(Window.partitionBy("entry_id").orderBy("path")) - 1).alias("index"))


def tree_names(spark, sf_dir):
    """Qualified names by the names of the ancestors; a node without name goes by its id."""
    styles = table(spark, sf_dir, "style_info")
    named = H.latest(styles.where("entry_id is not null and style_id is not null"), ["entry_id", "style_id"], "loaded_at", ["name"])
    part = named.select("entry_id", F.col("style_id").alias("part"), F.coalesce(F.when(F.trim("name") != "", F.trim("name")), F.col("style_id")).alias("label"))
    steps = _tree(spark, sf_dir).where("depth >= 0").select("entry_id", "style_id", F.posexplode("path").alias("at", "part")).join(part, ["entry_id", "part"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    return steps.groupBy("entry_id", "style_id").agg(F.array_join(ordered, ".").alias("name"))


def tree_used(spark, sf_dir):
    """Styles that some style with an outline level rests on, and these: what nothing refers to is left out."""
    styles = table(spark, sf_dir, "style_info")
    used = H.latest(styles.where("entry_id is not null and style_id is not null"), ["entry_id", "style_id"], "loaded_at", ["outline"]).where("outline is not null").select("entry_id", "style_id")
    above = H.descendants(styles).join(used, ["entry_id", "style_id"], "left_semi").select("entry_id", F.col("ancestor_id").alias("style_id"))
    return used.unionByName(above).distinct()


def tree_pruned(spark, sf_dir):
    """Trees without the nodes at depth 2 and what hangs below them."""
    return _tree(spark, sf_dir).where("depth between 0 and 1").select("entry_id", "style_id")


def tree_moved(spark, sf_dir):
    """Depths after the children of each root were moved below the root's first child."""
    rows = _tree(spark, sf_dir).where("depth >= 0").withColumn("top", F.get("path", F.lit(1)))
    first = rows.where("depth = 1").groupBy("entry_id", "root_id").agg(F.min("style_id").alias("first"))
    moved = rows.join(first, ["entry_id", "root_id"], "left").withColumn("depth", F.col("depth") + F.when((F.col("depth") >= 1) & (F.col("top") != F.col("first")), 1).otherwise(0))
    return moved.select("entry_id", "style_id", "depth")


def tree_json(spark, sf_dir):
    """Each sheet as one JSON object from path to outline level."""
    styles = table(spark, sf_dir, "style_info")
    level = H.latest(styles.where("entry_id is not null and style_id is not null"), ["entry_id", "style_id"], "loaded_at", ["outline"]).select("entry_id", "style_id", "outline")
    rows = _tree(spark, sf_dir).where("depth >= 0").join(level, ["entry_id", "style_id"]).select("entry_id", F.array_join("path", "/").alias("path"), "outline")
    ordered = F.array_sort(F.collect_list(F.struct("path", F.coalesce(F.col("outline").cast("string"), F.lit("null")).alias("v"))))
    return rows.groupBy("entry_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda x: F.concat(F.lit('"'), x["path"], F.lit('":'), x["v"])), ","), F.lit("}")).alias("json"))


def token_classes(spark, sf_dir):
    rows = S.words(S.lines(table(spark, sf_dir, "page_lines"), "text"), ["line_id"])
    w = F.col("word")
    return rows.select("line_id", "word_no", T.is_year(w).alias("year"), T.has_letters(w).alias("letters"), T.is_upper(w).alias("upper"), T.has_leader(w).alias("leader"), T.is_line_number(w).alias("number"))


def edge_spaces(spark, sf_dir):
    rows = table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", T.edge_spaces(F.col("text")).alias("e")).distinct()
    return rows.select("chunk_id", F.length("e.lead").alias("lead"), F.md5("e.core").alias("core"), F.length("e.trail").alias("trail"))


def escaped_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(T.escape_run(F.col("text"), True, True)).alias("escaped"), F.md5(T.normal_code(F.col("text"))).alias("code"))


def bar_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.code39(F.translate(F.upper("p_brand"), "#", "-")).alias("bars"))


def text_widths(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", T.text_width(F.col("c_name"), {"C": 7.2, "u": 5.0, "#": 5.5}, 6.0, 0.5).alias("width"))


def page_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "manifest_docs").where("page_count >= 1").select("entry_id", F.col("page_count").alias("n"))
    style = F.element_at(F.array(*map(F.lit, ["r", "R", "a", "A", "D"])), (F.col("entry_id") % 5 + 1).cast("int"))
    return rows.select("entry_id", T.page_label(F.col("n"), style, F.lit("p-")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        page_insert, page_rearrange, page_split, page_range_split, page_written_ranges, page_turns, page_bookmarks, copy_references, page_copies, tree_preorder, tree_names, tree_used,
        tree_pruned, tree_moved, tree_json, token_classes, edge_spaces, escaped_runs, bar_codes, text_widths, page_labels,
    )
}

_P = "P AS (SELECT DISTINCT entry_id, page FROM page_lines WHERE entry_id IS NOT NULL AND page IS NOT NULL)"
_L = "L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1)"
_OWN = """, own AS (SELECT entry_id, style_id, name, outline FROM style_info WHERE entry_id IS NOT NULL AND style_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entry_id, style_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
_ROMAN = "repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]"
_LETTERS = "repeat(chr(CAST(97 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT))"

ORACLES = {
    "page_insert": f"""WITH {_P}, O AS (SELECT entry_id, page, false AS inserted, CASE WHEN row_number() OVER (PARTITION BY entry_id ORDER BY page) < 2 THEN 0 ELSE 2 END AS k FROM P), A AS (SELECT * FROM O UNION ALL SELECT entry_id, page, true, 1 FROM P WHERE page < 2)
SELECT entry_id, page, inserted, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY k, page) - 1 AS INT) AS new_page FROM A""",
    "page_rearrange": f"WITH {_P} SELECT entry_id, page, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY page % 2, page) - 1 AS INT) AS new_page FROM P",
    "page_split": f"WITH {_P} SELECT entry_id, page, entry_id || '-' || (page + 1) AS part FROM P",
    "page_range_split": f"""WITH {_P}, R AS (SELECT * FROM (VALUES ('a', 0, 1), ('b', 1, 3), ('c', 4, 1000000)) v(part, f, l))
SELECT entry_id, part, page, CAST(row_number() OVER (PARTITION BY entry_id, part ORDER BY page) - 1 AS INT) AS new_page FROM P JOIN R ON page BETWEEN f AND l""",
    "page_written_ranges": """SELECT entry_id, "at", CASE "at" WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE page_count END AS "first", CASE "at" WHEN 1 THEN 1 ELSE page_count END AS "last"
FROM manifest_docs, (SELECT unnest([0, 1, 2]) AS "at") WHERE page_count >= 2""",
    "page_turns": f"""WITH {_L}, E AS (SELECT entry_id, page, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM L WHERE len(bbox) = 4 AND entry_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2)
SELECT entry_id, page, (page * 90 + 270) % 360 AS rotation, CASE WHEN x1 - x0 > 20 AND y1 - y0 > 20 THEN round((x1 - 10) - (x0 + 10), 3) END AS width FROM E""",
    "page_bookmarks": f"""WITH {_L}, X AS (SELECT * FROM L WHERE entry_id IS NOT NULL AND page IS NOT NULL), N AS (SELECT entry_id, entry_id // 10 AS merged_id, max(page) + 1 AS n FROM X GROUP BY 1),
S AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY merged_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM N)
SELECT merged_id, entry_id, text AS title, CAST(page + shift AS BIGINT) AS page FROM X JOIN S USING (entry_id) WHERE kind = 'heading' AND text IS NOT NULL""",
    "copy_references": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS \"first\" FROM documents WHERE text IS NOT NULL",
    "page_copies": f"WITH {_L} SELECT line_id, min(line_id) OVER (PARTITION BY concat_ws(chr(10), kind, text)) AS \"first\" FROM L WHERE text IS NOT NULL",
    "tree_preorder": _TREE + "SELECT entry_id, style_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY path) - 1 AS INT) AS index FROM tree",
    "tree_names": _TREE + _OWN + """, steps AS (SELECT entry_id, style_id, i, path[i] AS part FROM (SELECT *, unnest(generate_series(1, depth + 1)) AS i FROM tree))
SELECT s.entry_id, s.style_id, string_agg(coalesce(CASE WHEN trim(o.name) <> '' THEN trim(o.name) END, o.style_id), '.' ORDER BY i) AS name FROM steps s JOIN own o ON o.entry_id = s.entry_id AND o.style_id = s.part GROUP BY 1, 2""",
    "tree_used": _TREE + _OWN + """, used AS (SELECT entry_id, style_id FROM own WHERE outline IS NOT NULL)
SELECT entry_id, style_id FROM used UNION SELECT t.entry_id, unnest(t.path) FROM tree t JOIN used u USING (entry_id, style_id)""",
    "tree_pruned": _TREE + "SELECT entry_id, style_id FROM tree WHERE depth < 2",
    "tree_moved": _TREE + """, f AS (SELECT entry_id, root_id, min(style_id) AS first FROM tree WHERE depth = 1 GROUP BY 1, 2)
SELECT entry_id, style_id, CAST(depth + CASE WHEN depth >= 1 AND path[2] <> first THEN 1 ELSE 0 END AS INT) AS depth FROM tree LEFT JOIN f USING (entry_id, root_id)""",
    "tree_json": _TREE + _OWN + """ SELECT entry_id, '{' || string_agg('"' || array_to_string(path, '/') || '":' || coalesce(CAST(outline AS VARCHAR), 'null'), ',' ORDER BY array_to_string(path, '/')) || '}' AS json
FROM tree JOIN own USING (entry_id, style_id) GROUP BY 1""",
    "token_classes": rf"""WITH {_L}, W AS (SELECT line_id, list_filter(string_split_regex(trim(text, ' '), '\s+'), lambda x: x <> '') AS ws FROM L WHERE text IS NOT NULL), X AS (SELECT line_id, unnest(range(0, len(ws))) AS i, ws FROM W),
T AS (SELECT line_id, CAST(i AS INT) AS word_no, ws[i + 1] AS w FROM X)
SELECT line_id, word_no, regexp_matches(w, '^[(\[]?(19|20)[0-9]{{2}}[)\],;:.]?$') AS "year", regexp_matches(w, '\p{{L}}.*\p{{L}}.*\p{{L}}') AS letters, regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '\p{{Ll}}') AS upper,
  regexp_matches(w, '\.{{3,}}|…|(\. ){{3,}}') AS leader, regexp_matches(w, '^[(\[]?[0-9]{{1,3}}[a-z]?[)\].:]?$') AS number FROM T""",
    "edge_spaces": r"""SELECT DISTINCT chunk_id, length(regexp_extract(text, '^[ \t\n\x0B\f\r]*')) AS lead, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS core,
  CASE WHEN regexp_full_match(text, '[ \t\n\x0B\f\r]*') THEN 0 ELSE length(regexp_extract(text, '[ \t\n\x0B\f\r]*$')) END AS trail FROM chunks WHERE text IS NOT NULL""",
    "escaped_runs": r"""WITH C AS (SELECT doc_id, text, regexp_replace(text, '\r\n|[\r\n]', ' ', 'g') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(text, '([\\*~\[\]])', '\\\1', 'g')) AS escaped, md5(CASE WHEN c LIKE ' %' AND c LIKE '% ' AND trim(c, ' ') <> '' THEN substr(c, 2, length(c) - 2) ELSE c END) AS code FROM C""",
    "bar_codes": f"""SELECT p_partkey, '{T.CODE_39["*"]}n' || array_to_string(list_transform(string_split(replace(upper(p_brand), '#', '-'), ''),
  lambda c: map([{", ".join(f"'{k}'" for k in T.CODE_39)}], [{", ".join(f"'{v}'" for v in T.CODE_39.values())}])[c]), 'n') || 'n{T.CODE_39["*"]}' AS bars FROM part""",
    "text_widths": "SELECT c_custkey, round(list_sum(list_transform(string_split(c_name, ''), lambda c: CASE c WHEN 'C' THEN 7.2 WHEN 'u' THEN 5.0 WHEN '#' THEN 5.5 ELSE 6.0 END)) + 0.5 * (length(c_name) - 1), 6) AS width FROM customer",
    "page_labels": f"""WITH X AS (SELECT entry_id, page_count AS n FROM manifest_docs WHERE page_count >= 1)
SELECT entry_id, 'p-' || CASE entry_id % 5 WHEN 0 THEN {_ROMAN} WHEN 1 THEN upper({_ROMAN}) WHEN 2 THEN {_LETTERS} WHEN 3 THEN upper({_LETTERS}) ELSE CAST(n AS VARCHAR) END AS label FROM X""",
}
