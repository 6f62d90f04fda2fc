"""Queries over differential results and events: run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pages as P
from ..operators import quality as Q
from ..runtime import table


def _results(spark, sf_dir, *columns):
    return Q.results(table(spark, sf_dir, "doc_differential"), *columns)


def failure_clusters(spark, sf_dir):
    failed = _results(spark, sf_dir, "render_verdict", "error", "pages_compared").where("error is not null")
    return Q.clusters(failed, ["render_verdict"], "error", "pages_compared", "result_id")


def score_bands(spark, sf_dir):
    rows = _results(spark, sf_dir, "run_id", "render_ssim").select("run_id", Q.band(F.col("render_ssim")).alias("band")).where("band is not null")
    return rows.groupBy("run_id", "band").agg(F.count(F.lit(1)).alias("n"))


def band_pivot(spark, sf_dir):
    rows = _results(spark, sf_dir, "run_id", "text_similarity").select("run_id", Q.band(F.col("text_similarity")).alias("band"))
    names = [f"{a:g}-{b:g}" for a, b in Q.BANDS]
    return rows.groupBy("run_id").agg(*[F.count_if(F.col("band") == n).alias("band_" + str(i)) for i, n in enumerate(names)])


def run_summary(spark, sf_dir):
    return Q.run_summary(_results(spark, sf_dir, *Q.SUMMARY))


def baseline_delta(spark, sf_dir):
    runs = Q.with_previous(Q.run_summary(_results(spark, sf_dir, *Q.SUMMARY)), "run_id", ["effective_rate"])
    change = F.col("effective_rate") - F.col("previous_effective_rate")
    return runs.select("run_id", F.round(change, 9).alias("change"), F.coalesce(change < -0.01, F.lit(False)).alias("regressed"))


def verdict_trend(spark, sf_dir):
    rows = _results(spark, sf_dir, "run_id", "render_verdict").where("render_verdict is not null and run_id is not null")
    return Q.trend(Q.filled_series(rows, "render_verdict", "run_id"), "render_verdict", "run_id", "n")


def daily_event_trend(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return Q.trend(Q.filled_series(rows, "event_type", "day"), "event_type", "day", "n")


def score_tail(spark, sf_dir):
    return _results(spark, sf_dir, "run_id", "text_similarity").groupBy("run_id").agg(
        F.median("text_similarity").alias("median"), F.percentile("text_similarity", 0.05).alias("p5"), F.count_if(F.col("text_similarity") < 0.95).alias("below_95")
    )


def regressed_entries(spark, sf_dir):
    rows = _results(spark, sf_dir, "entry_id", "run_ts", "render_verdict").where("entry_id is not null")
    last = rows.groupBy("entry_id").agg(F.max(F.struct("run_ts", "result_id", "render_verdict")).alias("now"), F.min(F.struct("run_ts", "result_id", "render_verdict")).alias("then"))
    return last.where("then.render_verdict = 'Match' and now.render_verdict = 'Regression'").select("entry_id", F.col("now.render_verdict").alias("verdict"))


def unchecked_entries(spark, sf_dir):
    return table(spark, sf_dir, "manifest_docs").select("entry_id").join(_results(spark, sf_dir, "entry_id").select("entry_id"), "entry_id", "left_anti")


def cached_results(spark, sf_dir):
    manifest = table(spark, sf_dir, "manifest_docs").select("entry_id", "page_count")
    best = _results(spark, sf_dir, "entry_id", "render_ssim").groupBy("entry_id").agg(F.max("render_ssim").alias("best_ssim"), F.count(F.lit(1)).alias("runs"))
    return manifest.join(best, "entry_id", "left").select("entry_id", "page_count", "best_ssim", F.coalesce("runs", F.lit(0)).alias("runs"))


def gold_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "manifest_docs").where("lang is not null").select("entry_id", "lang")
    return Q.stratified(rows, "lang", "entry_id", 25)


def f1_sweep(spark, sf_dir):
    rows = _results(spark, sf_dir, "text_similarity", "text_verdict").select("text_similarity", (F.col("text_verdict") == "Match").alias("label"))
    return Q.f1_sweep(rows, "text_similarity", "label")


def event_pairs(spark, sf_dir):
    return Q.co_occurrence(table(spark, sf_dir, "events"), "user_id", "event_type")


def event_impact(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    total = F.sum("n").over(Window.partitionBy())  # one row per type of event
    scored = rows.withColumn("frequency", Q.frequency(F.col("n"), total))
    return scored.select("event_type", "n", "users", "frequency", (F.col("frequency") * F.col("users")).cast("bigint").alias("score"))


def review_queue(spark, sf_dir):
    rows = _results(spark, sf_dir, "error", "text_similarity", "oracle_fault")
    bucket = (
        F.when(F.col("error").isNotNull() & (Q.category(F.col("error")) == "unknown"), "unknown")
        .when(F.col("text_similarity") < 0.5, "low")
        .when(F.col("oracle_fault"), "fault")
    )
    return rows.select("result_id", bucket.alias("bucket")).where("bucket is not null")


def compared_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "page_lines").where("entry_id is not null and page is not null").groupBy("entry_id", "page").agg(F.countDistinct("line_id").alias("n"))
    chunks = table(spark, sf_dir, "chunks").select("entry_id", F.col("metadata.page").alias("page"), "chunk_id").where("entry_id is not null and page is not null")
    return P.compare(lines, chunks.groupBy("entry_id", "page").agg(F.countDistinct("chunk_id").alias("n")), ["entry_id", "page"], "n")


D = """D AS (SELECT * FROM doc_differential WHERE result_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at DESC NULLS LAST) = 1)"""
_CATEGORY = "CASE WHEN error IS NULL OR error = '' THEN 'none' " + " ".join(f"WHEN {' AND '.join(f'contains(lower(error), {p!r})' for p in parts)} THEN '{n}'" for t, parts, n in Q.CATEGORIES if not t) + " ELSE 'unknown' END"
_PATTERN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN length(error) > 120 THEN left(error, 120) || '...' ELSE error END,
  '[0-9]+ 0 R', '{obj} 0 R', 'g'), '(offset|position|index|page|object)\s+[0-9]+', '\1 {N}', 'gi'), '0x[0-9a-fA-F]+', '{hex}', 'g'), '/[\w/.-]+\.pdf', '{path}', 'g')"""
_SEVERITY = """CASE WHEN category IN ('panic', 'out_of_memory') THEN 'critical' WHEN category = 'timeout' THEN 'high'
  WHEN category IN ('invalid_xref', 'corrupt_stream', 'malformed_object', 'invalid_header') THEN 'medium' ELSE 'low' END"""


def _bands(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {a} AND {c} < {b} THEN '{a:g}-{b:g}'" for a, b in Q.BANDS) + " END"


def _trend(rows: str, key: str, step: str) -> str:
    return f"""R AS ({rows}), C AS (SELECT {key}, {step}, count(*) AS n FROM R GROUP BY 1, 2),
F AS (SELECT k.{key}, s.{step}, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {key} FROM C) k CROSS JOIN (SELECT DISTINCT {step} FROM C) s
  LEFT JOIN C c ON c.{key} = k.{key} AND c.{step} = s.{step}),
P AS (SELECT *, lag(n) OVER (PARTITION BY {key} ORDER BY {step}) AS p FROM F)
SELECT {key}, {step}, n, CASE WHEN p IS NULL OR (p = 0 AND n > 0) THEN 'NEW' WHEN p > 0 AND n = 0 THEN 'FIXED'
  WHEN n > p * CAST(1.1 AS DOUBLE) THEN 'UP' WHEN n < p * CAST(0.9 AS DOUBLE) THEN 'DOWN' ELSE 'STABLE' END AS indicator FROM P"""


_SUMMARY = f"""WITH {D}, S AS (SELECT run_id, count(*) AS total, count(*) FILTER (render_verdict = 'Match') AS passed, count(*) FILTER (oracle_fault) AS faults,
  count(error) AS errors, round(avg(render_ssim), 9) AS mean_ssim, round(avg(text_similarity), 9) AS mean_text,
  CASE WHEN count(*) - count(*) FILTER (oracle_fault) = 0 THEN 1.0
    ELSE round(count(*) FILTER (render_verdict = 'Match' AND NOT coalesce(oracle_fault, false)) / (count(*) - count(*) FILTER (oracle_fault)), 9) END AS effective_rate
  FROM D GROUP BY 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        failure_clusters, score_bands, band_pivot, run_summary, baseline_delta, verdict_trend, daily_event_trend, score_tail, regressed_entries,
        unchecked_entries, cached_results, gold_sample, f1_sweep, event_pairs, event_impact, review_queue, compared_pages,
    )
}

ORACLES = {
    "failure_clusters": f"""WITH {D}, R AS (SELECT render_verdict, {_CATEGORY} AS category, {_PATTERN} AS pattern, coalesce(pages_compared, 0) AS size, result_id FROM D WHERE error IS NOT NULL),
G AS (SELECT render_verdict, category, pattern, count(*) AS n, array_to_string(list_slice(list(CAST(result_id AS VARCHAR) ORDER BY size, result_id), 1, 5), ',') AS examples FROM R GROUP BY 1, 2, 3)
SELECT render_verdict, category, pattern, n, {_SEVERITY} AS severity,
  n * CASE {_SEVERITY} WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END AS priority, examples FROM G""",
    "score_bands": f"WITH {D} SELECT run_id, {_bands('render_ssim')} AS band, count(*) AS n FROM D WHERE {_bands('render_ssim')} IS NOT NULL GROUP BY 1, 2",
    "band_pivot": f"WITH {D} SELECT run_id, " + ", ".join(f"count(*) FILTER (text_similarity >= {a} AND text_similarity < {b}) AS band_{i}" for i, (a, b) in enumerate(Q.BANDS)) + " FROM D GROUP BY 1",
    "run_summary": _SUMMARY + " SELECT * FROM S",
    "baseline_delta": _SUMMARY
    + """, P AS (SELECT run_id, effective_rate - lag(effective_rate) OVER (ORDER BY run_id) AS change FROM S)
SELECT run_id, round(change, 9) AS change, coalesce(change < -0.01, false) AS regressed FROM P""",
    "verdict_trend": f"WITH {D}, " + _trend("SELECT * FROM D WHERE render_verdict IS NOT NULL AND run_id IS NOT NULL", "render_verdict", "run_id"),
    "daily_event_trend": "WITH " + _trend("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events", "event_type", "day"),
    "score_tail": f"""WITH {D} SELECT run_id, median(text_similarity) AS median, quantile_cont(text_similarity, 0.05) AS p5,
  count(*) FILTER (text_similarity < 0.95) AS below_95 FROM D GROUP BY 1""",
    "regressed_entries": f"""WITH {D}, N AS (SELECT entry_id, first(render_verdict ORDER BY run_ts, result_id) AS was,
  first(render_verdict ORDER BY run_ts DESC, result_id DESC) AS verdict FROM D WHERE entry_id IS NOT NULL GROUP BY 1)
SELECT entry_id, verdict FROM N WHERE was = 'Match' AND verdict = 'Regression'""",
    "unchecked_entries": f"WITH {D} SELECT entry_id FROM manifest_docs m WHERE NOT EXISTS (SELECT 1 FROM D WHERE D.entry_id = m.entry_id)",
    "cached_results": f"""WITH {D}, B AS (SELECT entry_id, max(render_ssim) AS best_ssim, count(*) AS runs FROM D GROUP BY 1)
SELECT m.entry_id, page_count, best_ssim, coalesce(runs, 0) AS runs FROM manifest_docs m LEFT JOIN B ON B.entry_id = m.entry_id""",
    "gold_sample": """WITH R AS (SELECT entry_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42' || entry_id), entry_id) AS INT) AS rank
  FROM manifest_docs WHERE lang IS NOT NULL) SELECT * FROM R WHERE rank <= 25""",
    "f1_sweep": f"""WITH {D}, T AS (SELECT unnest(range(0, 21)) AS bin), R AS (
  SELECT least(floor(round(text_similarity * 20, 9)), 20) AS b, text_verdict = 'Match' AS label FROM D WHERE text_similarity IS NOT NULL AND text_verdict IS NOT NULL),
C AS (SELECT bin, count(*) FILTER (label AND b >= bin) AS tp, count(*) FILTER (NOT label AND b >= bin) AS fp, count(*) FILTER (label AND b < bin) AS fn FROM T CROSS JOIN R GROUP BY 1)
SELECT bin / 20 AS threshold, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1 FROM C""",
    "event_pairs": """WITH E AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL)
SELECT a.event_type AS code_a, b.event_type AS code_b, count(*) AS n FROM E a JOIN E b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""",
    "event_impact": """WITH E AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
P AS (SELECT *, 100.0 * n / sum(n) OVER () AS pct FROM E), F AS (SELECT *, CASE WHEN pct > 30 THEN 5 WHEN pct > 15 THEN 4 WHEN pct > 5 THEN 3 WHEN pct >= 2 THEN 2 ELSE 1 END AS frequency FROM P)
SELECT event_type, n, users, frequency, frequency * users AS score FROM F""",
    "review_queue": f"""WITH {D}, R AS (SELECT result_id, CASE WHEN error IS NOT NULL AND {_CATEGORY} = 'unknown' THEN 'unknown' WHEN text_similarity < 0.5 THEN 'low'
  WHEN oracle_fault THEN 'fault' END AS bucket FROM D) SELECT * FROM R WHERE bucket IS NOT NULL""",
    "compared_pages": """WITH A AS (SELECT entry_id, page, count(DISTINCT line_id) AS n FROM page_lines WHERE entry_id IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2),
B AS (SELECT entry_id, metadata.page AS page, count(DISTINCT chunk_id) AS n FROM chunks WHERE entry_id IS NOT NULL AND metadata.page IS NOT NULL GROUP BY 1, 2)
SELECT entry_id, page, CASE WHEN A.n IS NULL THEN 'added' WHEN B.n IS NULL THEN 'removed' ELSE 'common' END AS status, A.n AS before, B.n AS after
FROM A FULL JOIN B USING (entry_id, page)""",
}
