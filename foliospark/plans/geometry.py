"""Queries over positions, styles and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import geometry as G
from ..operators import hierarchy as H
from ..operators import quality as Q
from ..operators import render as R
from ..operators import structure as S
from ..runtime import table
from .hierarchy import _TREE
from .lines import _MARK


def _lines(spark, sf_dir, *columns):
    return S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", *columns).where("entry_id is not null and page is not null")


def table_words(spark, sf_dir):
    rows = _lines(spark, sf_dir, "table_id", "bbox")
    hulls = S.extents(rows.where("table_id is not null"), ["entry_id", "page", "table_id"])
    outer = hulls.select("entry_id", "page", F.col("table_id").alias("box_id"), F.array("x0", "y0", "x1", "y1").alias("box"))
    inner = rows.where("bbox is not null").select("entry_id", "page", F.col("line_id").alias("id"), "bbox")
    return G.contained(inner, outer, ["entry_id", "page"]).select("id", "box_id")


def lines_above(spark, sf_dir):
    return G.nearest_above(_lines(spark, sf_dir, "bbox").withColumnRenamed("line_id", "id"), ["entry_id", "page"])


def covered_area(spark, sf_dir):
    return G.union_area(_lines(spark, sf_dir, "bbox"), ["entry_id", "page"]).withColumn("area", F.round("area", 3))


def aligned_tables(spark, sf_dir):
    rows = _lines(spark, sf_dir, "kind", "bbox", "text").where("kind = 'tableCell' and bbox is not null and text is not null")
    words = S.words(rows, ["entry_id", "page", "bbox"])
    spans = words.select("entry_id", "page", (F.col("bbox")[0] + F.col("word_no") * 60).alias("x"), F.col("bbox")[1].alias("y"), F.col("word").alias("text"))
    return G.detect_tables(spans, ["entry_id", "page"])


def chosen_blocks(spark, sf_dir):
    rows = _lines(spark, sf_dir, "block", "line_no").where("block is not null").groupBy("entry_id", "page", "block").agg(
        F.count(F.lit(1)).cast("double").alias("score"), F.array_sort(F.collect_set(F.col("line_no").cast("bigint"))).alias("lines")
    )
    return G.choose(rows.withColumn("id", F.col("block").cast("bigint")), ["entry_id", "page"])


def block_json(spark, sf_dir):
    rows = _lines(spark, sf_dir, "line_no", "kind", "text").where("text is not null and kind is not null and line_no is not null")
    one = F.to_json(F.struct("line_no", "kind", "text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", one.alias("j")))), lambda b: b["j"])
    return rows.groupBy("entry_id", "page").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("json"))


def page_chunks(spark, sf_dir):
    rows = _lines(spark, sf_dir, "line_no", "kind", "text", "table_id")
    text = R.document_markdown(rows.where("text is not null").withColumn("level", F.lit(1)), ["entry_id", "page"], ["line_no", "line_id"])
    tables = rows.where("table_id is not null").groupBy("entry_id", "page").agg(F.countDistinct("table_id").alias("tables"))
    sections = rows.where("kind = 'heading' and text is not null").groupBy("entry_id", "page").agg(F.min(F.struct("line_no", "line_id", "text"))["text"].alias("section"))
    joined = text.join(tables, ["entry_id", "page"], "left").join(sections, ["entry_id", "page"], "left")
    return joined.select("entry_id", "page", F.length("markdown").alias("chars"), F.coalesce("tables", F.lit(0)).alias("tables"), "section")


def effective_outline(spark, sf_dir):
    styles = table(spark, sf_dir, "style_info")
    own = H.latest(styles.select("entry_id", "style_id", "outline", "loaded_at").where("entry_id is not null and style_id is not null"), ["entry_id", "style_id"], "loaded_at")
    own = own.select("entry_id", "style_id", "outline")
    above = H.descendants(styles).select("entry_id", "style_id", "ancestor_id", "distance")
    given = own.where("outline is not null").select("entry_id", F.col("style_id").alias("ancestor_id"), F.col("outline").alias("inherited"))
    nearest = above.join(given, ["entry_id", "ancestor_id"]).groupBy("entry_id", "style_id").agg(F.min(F.struct("distance", "inherited"))["inherited"].alias("inherited"))
    return own.join(nearest, ["entry_id", "style_id"], "left").select("entry_id", "style_id", F.coalesce("outline", "inherited").alias("outline"))


def run_regressions(spark, sf_dir):
    runs = Q.with_previous(
        Q.run_summary(Q.results(table(spark, sf_dir, "doc_differential"), *Q.SUMMARY)), "run_id", ["total", "passed", "errors", "mean_ssim"]
    ).where("previous_total is not null")
    now, before = F.col("errors") / F.col("total") * 100, F.col("previous_errors") / F.col("previous_total") * 100
    ok, ok_before = F.col("passed") / F.col("total") * 100, F.col("previous_passed") / F.col("previous_total") * 100
    rule = lambda name, level, hit: F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), hit.alias("hit"))
    rules = F.array(
        rule("error_rate", "trigger", now - before > 1.0),
        rule("match_rate", "trigger", ok_before - ok > 3.0),
        rule("mean_ssim", "warning", F.col("previous_mean_ssim") - F.col("mean_ssim") > 0.005),
    )
    return runs.select("run_id", F.explode(rules).alias("r")).where("r.hit").select("run_id", "r.rule", "r.level")


def known_failures(spark, sf_dir):
    rows = Q.results(table(spark, sf_dir, "doc_differential"), "run_id", "entry_id", "render_verdict", "error")
    failed = rows.where("render_verdict = 'Regression' or error is not null").select("entry_id").distinct()
    return rows.join(failed, "entry_id", "left_semi").groupBy("entry_id").agg(F.countDistinct("run_id").alias("runs"))


def first_per_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    small = rows.select("source", "doc_id", F.length("text").alias("chars"), F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"))
    first = small.withColumn("r", F.row_number().over(Window.partitionBy("source", "part").orderBy("chars", "doc_id"))).where("r <= 5")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("chars", "doc_id"))).where("rank <= 5").select("source", "doc_id", "chars", "rank")


L = """L AS (SELECT * FROM (SELECT * FROM page_lines WHERE line_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1) WHERE entry_id IS NOT NULL AND page IS NOT NULL)"""
D = """D AS (SELECT * FROM doc_differential WHERE result_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at DESC NULLS LAST) = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        table_words, lines_above, covered_area, aligned_tables, chosen_blocks, block_json, page_chunks, effective_outline, run_regressions, known_failures, first_per_source,
    )
}
ORACLES = {
    "table_words": f"""WITH {L}, H AS (SELECT entry_id, page, table_id, min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1
  FROM L WHERE table_id IS NOT NULL AND len(bbox) = 4 GROUP BY 1, 2, 3)
SELECT line_id AS id, H.table_id AS box_id FROM L JOIN H USING (entry_id, page)
WHERE (bbox[1] + bbox[3]) / 2 BETWEEN x0 AND x1 AND (bbox[2] + bbox[4]) / 2 BETWEEN y0 AND y1""",
    "lines_above": f"""WITH {L}, B AS (SELECT entry_id, page, line_id AS id, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM L WHERE len(bbox) = 4),
P AS (SELECT a.id, b.id AS above, round(b.y0 - a.y1, 6) AS gap FROM B a JOIN B b USING (entry_id, page)
  WHERE a.id <> b.id AND b.y0 >= a.y1 - 0.01 AND b.x0 < a.x1 AND b.x1 > a.x0 AND floor(a.y1 / 100) IN (floor(b.y0 / 100), floor(b.y0 / 100) - 1))
SELECT id, above FROM P QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, above) = 1""",
    "block_json": f"""WITH {L} SELECT entry_id, page, '[' || string_agg(CAST(to_json(struct_pack(line_no := line_no, kind := kind, text := text)) AS VARCHAR), ',' ORDER BY line_no, line_id) || ']' AS json
FROM L WHERE text IS NOT NULL AND kind IS NOT NULL AND line_no IS NOT NULL GROUP BY 1, 2""",
    "effective_outline": _TREE
    + """, own AS (SELECT entry_id, style_id, outline FROM style_info WHERE entry_id IS NOT NULL AND style_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entry_id, style_id ORDER BY loaded_at DESC NULLS LAST) = 1),
steps AS (SELECT entry_id, style_id, depth, path, unnest(generate_series(1, depth)) AS i FROM tree WHERE depth > 0),
near AS (SELECT s.entry_id, s.style_id, o.outline AS inherited FROM steps s JOIN own o ON o.entry_id = s.entry_id AND o.style_id = s.path[s.i]
  WHERE o.outline IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.entry_id, s.style_id ORDER BY s.i DESC) = 1)
SELECT entry_id, style_id, coalesce(outline, inherited) AS outline FROM own LEFT JOIN near USING (entry_id, style_id)""",
    "covered_area": f"""WITH {L}, B AS (SELECT entry_id, page, bbox[1] AS x0, bbox[2] AS y0, bbox[3] AS x1, bbox[4] AS y1 FROM L WHERE len(bbox) = 4),
X AS (SELECT entry_id, page, x0 AS x FROM B UNION SELECT entry_id, page, x1 FROM B), S AS (SELECT *, lead(x) OVER (PARTITION BY entry_id, page ORDER BY x) AS nx FROM X),
C AS (SELECT S.entry_id, S.page, x, nx, y0, y1, max(y1) OVER (PARTITION BY S.entry_id, S.page, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM S JOIN B ON S.entry_id = B.entry_id AND S.page = B.page AND x0 <= x AND x1 >= nx AND y1 > y0 WHERE nx IS NOT NULL),
A AS (SELECT entry_id, page, sum((nx - x) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) AS area FROM C GROUP BY 1, 2)
SELECT entry_id, page, round(coalesce(area, 0), 3) AS area FROM (SELECT DISTINCT entry_id, page FROM B) LEFT JOIN A USING (entry_id, page)""",
    "page_chunks": rf"""WITH {L}, M AS (SELECT entry_id, page, line_no, line_id, CASE
  WHEN kind = 'heading' THEN '# ' || text WHEN kind = 'listItem' THEN '- ' || trim(regexp_replace(text, '{_MARK}', ''), ' ')
  WHEN regexp_matches(text, '^[0-9]+[.)] ') THEN regexp_replace(text, '^([0-9]+)', '\\\1') ELSE regexp_replace(text, '^([#<>+*-])', '\\\1') END AS md
  FROM L WHERE text IS NOT NULL AND kind NOT IN ('header', 'footer') AND trim(text, ' ') <> ''),
D AS (SELECT entry_id, page, string_agg(md, chr(10) || chr(10) ORDER BY line_no, line_id) AS markdown FROM M GROUP BY 1, 2),
T AS (SELECT entry_id, page, count(DISTINCT table_id) AS n FROM L WHERE table_id IS NOT NULL GROUP BY 1, 2),
H AS (SELECT entry_id, page, text AS section FROM L WHERE kind = 'heading' AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id, page ORDER BY line_no, line_id) = 1)
SELECT entry_id, page, length(markdown) AS chars, coalesce(n, 0) AS tables, section FROM D LEFT JOIN T USING (entry_id, page) LEFT JOIN H USING (entry_id, page)""",
    "run_regressions": f"""WITH {D}, S AS (SELECT run_id, count(*) AS total, count(*) FILTER (render_verdict = 'Match') AS passed, count(error) AS errors, round(avg(render_ssim), 9) AS ssim FROM D GROUP BY 1),
P AS (SELECT *, lag(total) OVER w AS t, lag(passed) OVER w AS p, lag(errors) OVER w AS e, lag(ssim) OVER w AS s FROM S WINDOW w AS (ORDER BY run_id))
SELECT run_id, 'error_rate' AS rule, 'trigger' AS level FROM P WHERE errors / total * 100 - e / t * 100 > 1.0
UNION ALL SELECT run_id, 'match_rate', 'trigger' FROM P WHERE p / t * 100 - passed / total * 100 > 3.0
UNION ALL SELECT run_id, 'mean_ssim', 'warning' FROM P WHERE s - ssim > 0.005""",
    "known_failures": f"""WITH {D} SELECT entry_id, count(DISTINCT run_id) AS runs FROM D
WHERE entry_id IN (SELECT entry_id FROM D WHERE render_verdict = 'Regression' OR error IS NOT NULL) GROUP BY 1""",
    "first_per_source": """SELECT source, doc_id, length(text) AS chars, CAST(row_number() OVER w AS INT) AS rank FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
WINDOW w AS (PARTITION BY source ORDER BY length(text), doc_id) QUALIFY row_number() OVER w <= 5""",
}
