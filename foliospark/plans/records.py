"""Queries over result records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import records as R
from ..operators import structure as S
from ..runtime import table
from .quality import _CATEGORY

# Severity of the codes that the queries use.
SEVERITY = {"CRASH-001": 5, "CRASH-002": 5, "ORACLE-001": 1, "BIND-001": 4, "BIND-002": 3, "LAYOUT-001": 4, "LAYOUT-002": 3, "RENDER-001": 5, "RENDER-002": 2, "UNKNOWN": 3}


def _results(spark, sf_dir, *columns):
    return Q.results(table(spark, sf_dir, "doc_differential"), *columns)


def _graded(spark, sf_dir):
    """Results with exit code, verdicts, status and codes."""
    rows = _results(spark, sf_dir, "run_id", "run_ts", "entry_id", "error", "oracle_fault", "render_ssim", "text_similarity", "pages_compared")
    code = F.when(F.col("error").contains("timed out"), 4).when(F.col("error").contains("password"), 2).when(F.col("error").isNotNull(), 1).otherwise(0)
    pages = F.when(F.col("pages_compared") >= 2, "pass").when(F.col("pages_compared") == 1, "partial").otherwise("fail")
    fault = F.coalesce("oracle_fault", F.lit(False))
    rows = rows.withColumn("exit_code", code).withColumn("fault", fault).withColumn("data", R.verdict(F.col("text_similarity")))
    rows = rows.withColumn("visual", R.verdict(F.col("render_ssim"), ((0.95, "pass"), (0.8, "partial")))).withColumn("pages", pages)
    c = F.col
    rows = rows.withColumn("status", R.composite_status(c("exit_code"), c("visual"), c("data"), c("pages"), F.lit("pass"), c("fault")))
    tests = {
        "CRASH-001": c("exit_code") == 1, "CRASH-002": c("exit_code") == 4, "ORACLE-001": c("fault"), "BIND-001": c("data") == "fail", "BIND-002": c("data") == "partial",
        "LAYOUT-001": c("pages") == "fail", "LAYOUT-002": c("pages") == "partial", "RENDER-001": c("visual") == "fail", "RENDER-002": c("visual") == "partial",
    }
    rows = rows.withColumn("codes", R.failure_codes(tests, c("status") == "fully_correct")).withColumn("primary", R.primary_code(c("codes")))
    return rows.withColumn("sure", R.confidence(c("codes"), c("primary")))


def queried_results(spark, sf_dir):
    rows = _results(spark, sf_dir, "render_verdict", "render_ssim", "text_similarity", "pages_compared")
    found = R.query(rows, ["render_verdict=Match", "text_similarity>=0.5", "pages_compared<30"], "render_ssim", limit=40, tie="result_id")
    return found.select("result_id", F.round("render_ssim", 9).alias("render_ssim"))


def queried_chunks(spark, sf_dir):
    return R.query(table(spark, sf_dir, "chunks").select("chunk_id", "metadata"), ["metadata.page>=2", "metadata.confidence<0.9"]).select("chunk_id", "metadata.page").distinct()


def status_scorecard(spark, sf_dir):
    return R.scorecard(_graded(spark, sf_dir), "status", ["render_ssim", "text_similarity"])


def taxonomy_codes(spark, sf_dir):
    c = F.col
    review = R.needs_review(c("codes"), c("primary"), c("sure"))
    return _graded(spark, sf_dir).select("result_id", F.array_join("codes", ",").alias("codes"), "primary", c("sure").alias("confidence"), review.alias("review"))


def code_shares(spark, sf_dir):
    return R.code_shares(_graded(spark, sf_dir), "primary", "render_ssim", "result_id")


def impact_tiers(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(0))
    counted = rows.where("primary is not null and primary not like 'ORACLE%'").groupBy("primary").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0)).join(total, "one")
    grave = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col("primary"))
    scored = counted.withColumn("score", Q.frequency(F.col("n"), F.col("total")) * grave)
    return scored.select("primary", "n", "score", R.tier(F.col("primary"), F.col("score"), grave, ["BIND-002"]).alias("tier"))


def prefix_failures(spark, sf_dir):
    names = table(spark, sf_dir, "manifest_docs").select("entry_id", R.name_prefix(F.col("document")).alias("prefix")).distinct()
    failed = _results(spark, sf_dir, "entry_id", "render_verdict").where("render_verdict <> 'Match'")
    return failed.join(names, "entry_id").groupBy("prefix").agg(F.countDistinct("result_id").alias("n"))


def gate_bands(spark, sf_dir):
    rows = _results(spark, sf_dir, "render_ssim").select(R.gate_band(F.col("render_ssim")).alias("band")).where("band is not null")
    counted = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0))
    total = rows.groupBy(F.lit(0).alias("one")).agg(F.count(F.lit(1)).alias("total"))
    return counted.join(total, "one").select("band", "n", R.percent(F.col("n"), F.col("total")).alias("share"))


def _entries(spark, sf_dir):
    errors = _results(spark, sf_dir, "entry_id", "error").groupBy("entry_id").agg(F.min("error").alias("error"))
    rows = table(spark, sf_dir, "manifest_docs").select("entry_id", "document", "page_count", "lead_text", "author", "split").join(errors, "entry_id", "left")
    form = F.when(F.col("author").isNull(), "none").otherwise("static")
    reason = R.excluded_because("xfa-with-reference", F.col("document"), F.col("error"), 3 * F.length("lead_text"), F.col("page_count"), form, F.col("split").isNotNull())
    return rows.select("entry_id", reason.alias("reason"))


def excluded_entries(spark, sf_dir):
    return _entries(spark, sf_dir).where("reason is not null")


def exclusion_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def entry_completeness(spark, sf_dir):
    words = table(spark, sf_dir, "manifest_docs").select("entry_id", F.explode(F.split(F.lower("lead_text"), r"[^\p{L}\p{N}]+")).alias("value"))
    lines = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "text").where("text is not null")
    return R.contained_values(words, lines, "entry_id", "value", "text")


def code_changes(spark, sf_dir):
    return R.code_changes(_graded(spark, sf_dir), "run_id", "primary", 1)


def review_buckets(spark, sf_dir):
    c = F.col
    rows = _graded(spark, sf_dir).where("entry_id is not null")
    before = F.lag("status").over(S.Window.partitionBy("entry_id").orderBy("run_ts", "result_id"))
    bucket = R.review_bucket(c("codes"), c("primary"), c("sure"), c("before"), c("status"))
    return rows.withColumn("before", before).select("result_id", bucket.alias("bucket")).where("bucket is not null")


def run_bars(spark, sf_dir):
    runs = Q.run_summary(_results(spark, sf_dir, *Q.SUMMARY)).where("run_id is not null")
    return R.last_runs(runs, "run_id", 10).select("run_id", R.bar(F.col("effective_rate")).alias("bar"))


def leniency_report(spark, sf_dir):
    rows = _results(spark, sf_dir, "run_id", "error").where("error is not null")
    named = rows.select("run_id", Q.category(F.col("error")).alias("code")).withColumn("grade", Q.severity(F.col("code")))
    return R.leniency(named, "run_id", "code", "grade")


def bench_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 7).cast("string")).alias("name"), "value", "ts")
    mean = lambda rows: rows.groupBy("name").agg(F.round(F.avg("value"), 6).alias("value"))
    return R.bench_changes(mean(events.where("ts < '2024-01-16'")), mean(events.where("ts >= '2024-01-16'")), "name", "value", 5.0)


def agreement_by_entry(spark, sf_dir):
    rows = S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "line_no", "block", "kind").where("entry_id is not null")
    after = S.Window.partitionBy("entry_id", "page").orderBy("line_no", "line_id")
    pairs = rows.withColumn("next_block", F.lead("block").over(after)).withColumn("next_kind", F.lead("kind").over(after))
    same, like = F.col("block") == F.col("next_block"), F.col("kind") == F.col("next_kind")
    counted = pairs.groupBy("entry_id").agg(F.count_if(same == like).alias("agreed"), F.count(same).alias("counted"))
    return counted.withColumn("pct", R.agreement(F.col("agreed"), F.col("counted")))


QUERIES = {
    f.__name__: f
    for f in (
        queried_results, queried_chunks, status_scorecard, taxonomy_codes, code_shares, impact_tiers, prefix_failures, gate_bands, excluded_entries, exclusion_counts,
        entry_completeness, code_changes, review_buckets, run_bars, leniency_report, bench_changes, agreement_by_entry,
    )
}

_D = """D AS (SELECT * FROM doc_differential WHERE result_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at DESC NULLS LAST) = 1)"""
_G = f"""{_D}, A AS (SELECT result_id, run_id, run_ts, entry_id, render_ssim, text_similarity,
  CASE WHEN contains(error, 'timed out') THEN 4 WHEN contains(error, 'password') THEN 2 WHEN error IS NOT NULL THEN 1 ELSE 0 END AS x, coalesce(oracle_fault, false) AS f,
  CASE WHEN text_similarity >= 0.9 THEN 2 WHEN text_similarity >= 0.5 THEN 1 ELSE 0 END AS d,
  CASE WHEN render_ssim >= 0.95 THEN 2 WHEN render_ssim >= 0.8 THEN 1 ELSE 0 END AS v,
  CASE WHEN pages_compared >= 2 THEN 2 WHEN pages_compared = 1 THEN 1 ELSE 0 END AS p FROM D),
B AS (SELECT *, CASE x WHEN 1 THEN 'crash' WHEN 2 THEN 'encrypted' WHEN 4 THEN 'xfa_error' ELSE CASE WHEN f THEN 'oracle_fault' WHEN v = 0 THEN 'render_fail'
  WHEN d = 0 OR p = 0 THEN 'partial_render' WHEN d = 1 OR p = 1 THEN 'major_deviation' WHEN v = 1 THEN 'minor_deviation' ELSE 'fully_correct' END END AS status FROM A),
C AS (SELECT *, list_filter([CASE WHEN x = 1 THEN 'CRASH-001' END, CASE WHEN x = 4 THEN 'CRASH-002' END, CASE WHEN f THEN 'ORACLE-001' END, CASE d WHEN 0 THEN 'BIND-001' WHEN 1 THEN 'BIND-002' END,
  CASE p WHEN 0 THEN 'LAYOUT-001' WHEN 1 THEN 'LAYOUT-002' END, CASE v WHEN 0 THEN 'RENDER-001' WHEN 1 THEN 'RENDER-002' END], lambda c: c IS NOT NULL) AS hit FROM B),
E AS (SELECT *, CASE WHEN status = 'fully_correct' THEN [] WHEN len(hit) = 0 THEN ['UNKNOWN'] ELSE hit END AS codes FROM C),
G AS (SELECT *, codes[1] AS "primary", CASE WHEN len(codes) = 0 THEN 'high' WHEN codes[1] = 'UNKNOWN' THEN 'low' WHEN len(codes) >= 2 THEN 'high' ELSE 'medium' END AS sure FROM E)"""
_X = rf"""{_D}, N AS (SELECT entry_id, min(error) AS error FROM D GROUP BY 1),
X AS (SELECT m.entry_id, CASE WHEN regexp_matches(lower(document), 'ghostscript-|mozilla-|pdfium-') THEN 'adversarial_filename' WHEN regexp_matches(lower(error), 'encrypt|password') THEN 'encrypted'
  WHEN coalesce(3 * length(lead_text), 0) < 1024 THEN 'file_too_small' WHEN author IS NOT NULL AND coalesce(page_count, 0) = 0 THEN 'zero_page_xfa' WHEN error <> '' THEN 'parse_error'
  WHEN author IS NULL THEN 'non_xfa' WHEN split IS NULL THEN 'no_pdfrest_reference' END AS reason FROM manifest_docs m LEFT JOIN N USING (entry_id))"""
_GRAVE = "CASE \"primary\" " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items()) + " END"

ORACLES = {
    "queried_results": f"""WITH {_D} SELECT result_id, round(render_ssim, 9) AS render_ssim FROM D
WHERE render_verdict = 'Match' AND text_similarity >= 0.5 AND pages_compared < 30 ORDER BY D.render_ssim NULLS LAST, result_id LIMIT 40""",
    "queried_chunks": "SELECT DISTINCT chunk_id, metadata.page AS page FROM chunks WHERE metadata.page >= 2 AND metadata.confidence < 0.9",
    "status_scorecard": f"""WITH {_G} SELECT status, count(*) AS n, round(avg(render_ssim), 4) AS mean_render_ssim, round(avg(text_similarity), 4) AS mean_text_similarity,
  round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM G GROUP BY 1""",
    "taxonomy_codes": f"""WITH {_G} SELECT result_id, array_to_string(codes, ',') AS codes, CASE WHEN list_contains(codes, 'CRASH-001') THEN 'CRASH-001' ELSE "primary" END AS "primary", sure AS confidence,
  len(codes) > 0 AND sure = 'low' AS review FROM G""",
    "code_shares": f"""WITH {_G}, S AS (SELECT "primary", count(*) AS n, round(avg(render_ssim), 4) AS mean_score, array_to_string(list_sort(list(result_id))[1:3], ',') AS samples FROM G WHERE "primary" IS NOT NULL GROUP BY 1)
SELECT "primary", n, round(100 * n / (SELECT count("primary") FROM G), 2) AS pct_of_failed, round(100 * n / (SELECT count(*) FROM G), 2) AS pct_of_all, mean_score, samples FROM S""",
    "impact_tiers": f"""WITH {_G}, S AS (SELECT "primary", count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM G) AS pct, {_GRAVE} AS grave FROM G WHERE "primary" IS NOT NULL AND "primary" NOT LIKE 'ORACLE%' GROUP BY 1),
T AS (SELECT *, grave * CASE WHEN pct > 30 THEN 5 WHEN pct > 15 THEN 4 WHEN pct > 5 THEN 3 WHEN pct >= 2 THEN 2 ELSE 1 END AS score FROM S)
SELECT "primary", n, score, CASE WHEN "primary" = 'BIND-002' THEN 'known_limitation' WHEN score >= 25 AND grave >= 4 THEN 'must_fix' WHEN score >= 12 THEN 'should_fix' ELSE 'accept' END AS tier FROM T""",
    "prefix_failures": f"""WITH {_D}, N AS (SELECT DISTINCT entry_id, CASE WHEN contains(document, '__') THEN split_part(document, '__', 1) WHEN contains(document, '-') THEN split_part(document, '-', 1) ELSE 'plain' END AS prefix FROM manifest_docs)
SELECT prefix, count(DISTINCT result_id) AS n FROM D JOIN N USING (entry_id) WHERE render_verdict <> 'Match' GROUP BY 1""",
    "gate_bands": f"""WITH {_D}, B AS (SELECT CASE WHEN render_ssim >= 0.9 AND render_ssim < 0.94 THEN '0.90-0.94' WHEN render_ssim >= 0.8 AND render_ssim < 0.9 THEN '0.80-0.90' WHEN render_ssim >= 0.7 AND render_ssim < 0.8 THEN '0.70-0.80'
  WHEN render_ssim >= 0.5 AND render_ssim < 0.7 THEN '0.50-0.70' WHEN render_ssim >= 0 AND render_ssim < 0.5 THEN '0.00-0.50' END AS band FROM D)
SELECT band, count(*) AS n, printf('%.1f%%', 100.0 * count(*) / sum(count(*)) OVER ()) AS share FROM B WHERE band IS NOT NULL GROUP BY 1""",
    "excluded_entries": f"WITH {_X} SELECT entry_id, reason FROM X WHERE reason IS NOT NULL",
    "exclusion_counts": f"WITH {_X} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM X GROUP BY 1",
    "entry_completeness": r"""WITH L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1),
W AS (SELECT DISTINCT entry_id, unnest(string_split_regex(lower(lead_text), '[^\p{L}\p{N}]+')) AS v FROM manifest_docs), T AS (SELECT DISTINCT entry_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS v FROM L WHERE text IS NOT NULL),
C AS (SELECT W.entry_id, count(*) AS total, count(T.v) AS matched FROM W LEFT JOIN T ON W.entry_id = T.entry_id AND W.v = T.v WHERE W.v <> '' GROUP BY 1)
SELECT entry_id, total, matched, round(matched / total, 6) AS score, CASE WHEN round(matched / total, 6) >= 0.9 THEN 'pass' WHEN round(matched / total, 6) >= 0.5 THEN 'partial' ELSE 'fail' END AS verdict FROM C""",
    "code_changes": f"""WITH {_G}, N AS (SELECT run_id, "primary", count(*) AS n FROM G WHERE "primary" IS NOT NULL GROUP BY 1, 2), R AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS b FROM (SELECT DISTINCT run_id FROM G)),
P AS (SELECT N.run_id, N."primary", coalesce(O.n, 0) AS before, N.n FROM N JOIN R USING (run_id) LEFT JOIN N O ON O.run_id = R.b AND O."primary" = N."primary" WHERE R.b IS NOT NULL)
SELECT *, CASE WHEN before = 0 THEN 'new_code' ELSE 'code_growth' END AS rule FROM P WHERE (before = 0 AND n > 1) OR (before > 0 AND (n - before) / before > 0.2)""",
    "review_buckets": f"""WITH {_G}, P AS (SELECT *, lag(status) OVER (PARTITION BY entry_id ORDER BY run_ts, result_id) AS b FROM G WHERE entry_id IS NOT NULL)
SELECT result_id, CASE WHEN "primary" = 'UNKNOWN' THEN 1 ELSE 4 END AS bucket FROM P WHERE "primary" = 'UNKNOWN' OR (b = 'fully_correct' AND status <> 'fully_correct')""",
    "run_bars": f"""WITH {_D}, S AS (SELECT run_id, count(*) - count(*) FILTER (oracle_fault) AS c, count(*) FILTER (render_verdict = 'Match' AND NOT coalesce(oracle_fault, false)) AS m FROM D WHERE run_id IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10),
R AS (SELECT run_id, CAST(round(20 * CASE WHEN c = 0 THEN 1.0 ELSE round(m / c, 9) END) AS INT) AS k FROM S) SELECT run_id, repeat('#', k) || repeat('.', 20 - k) AS bar FROM R""",
    "leniency_report": f"""WITH {_D}, N AS (SELECT run_id, {_CATEGORY} AS code FROM D WHERE error IS NOT NULL), S AS (SELECT *, code NOT IN ('panic', 'out_of_memory', 'timeout', 'invalid_xref', 'corrupt_stream', 'malformed_object', 'invalid_header') AS low FROM N)
SELECT run_id, count(*) AS events, count(DISTINCT code) AS codes, count(*) FILTER (low) AS warnings, count(*) FILTER (NOT low) AS errors FROM S GROUP BY 1""",
    "bench_changes": """WITH V AS (SELECT event_type || '/' || (user_id % 7) AS name, value, ts FROM events), A AS (SELECT name, round(avg(value), 6) AS before FROM V WHERE ts < '2024-01-16' GROUP BY 1), B AS (SELECT name, round(avg(value), 6) AS now FROM V WHERE ts >= '2024-01-16' GROUP BY 1),
P AS (SELECT name, before, now, round(100 * (now - before) / nullif(before, 0), 3) AS pct FROM A FULL JOIN B USING (name))
SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN pct > 5 THEN 'slower' WHEN pct < -5 THEN 'faster' ELSE 'same' END AS status FROM P""",
    "agreement_by_entry": """WITH L AS (SELECT * FROM page_lines WHERE line_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1),
P AS (SELECT entry_id, block = lead(block) OVER w AS s, kind = lead(kind) OVER w AS k FROM L WHERE entry_id IS NOT NULL WINDOW w AS (PARTITION BY entry_id, page ORDER BY line_no, line_id))
SELECT entry_id, count(*) FILTER (s = k) AS agreed, count(s) AS counted, CASE WHEN count(s) > 0 THEN round(100 * count(*) FILTER (s = k) / count(s), 3) END AS pct FROM P GROUP BY 1""",
}
