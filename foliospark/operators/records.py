"""Result records: filters, score cards, failure codes, tiers, exclusions, completeness and changes between runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StructType
from pyspark.sql.window import Window

_FILTER = re.compile(r"([A-Za-z_][\w.]*)(<=|>=|!=|<|>|=)(.+)", re.S)

# Failure codes, the more important ones first.
PRIORITY = (
    "CRASH-001", "CRASH-002", "CRASH-003", "ORACLE-001", "FLAT-001", "BIND-001", "BIND-002", "LAYOUT-001", "LAYOUT-002",
    "RENDER-001", "RENDER-002", "RENDER-003", "BIND-003", "PERF-001", "ORACLE-002", "LAYOUT-003", "UNKNOWN",
)

# Statuses by exit code, which come before any other.
EXIT_STATUS = {1: "crash", 2: "encrypted", 3: "degenerate", 4: "xfa_error"}

# File name parts of hostile corpora, least size in bytes, and the modes in the order in which they exclude more.
HOSTILE_PARTS, LEAST_BYTES = ("ghostscript-", "mozilla-", "pdfium-"), 1024
MODES = ("all", "non-adversarial", "xfa-only", "xfa-with-reference")

# Half-open score bands of failed results, by lower and upper bound.
GATE_BANDS = ((0.90, 0.94), (0.80, 0.90), (0.70, 0.80), (0.50, 0.70), (0.0, 0.50))

# Least share of matched values for each verdict; less is a failure.
COMPLETENESS = ((0.90, "pass"), (0.50, "partial"))

# Least total score and severity of a tier.
TIERS = ((25, 4, "must_fix"), (12, 0, "should_fix"))


def parse_filter(text: str) -> tuple[str, str, float | str]:
    """``field op value`` of a filter such as ``score<0.9``; a value that reads as a number is one."""
    m = _FILTER.fullmatch(text)
    if not m:
        raise ValueError(f"not a filter: {text!r}")
    field, op, value = m.groups()
    try:
        return field, op, float(value)
    except ValueError:
        return field, op, value


def field_type(schema: StructType, path: str) -> DataType:
    """The type of a field by its dot path."""
    return reduce(lambda at, name: at[name].dataType, path.split("."), schema)


def matches(schema: StructType, field: str, op: str, value: float | str) -> Column:
    """Whether a row passes a filter; never null.

    A missing value passes no filter.  Values of another kind than the field are unequal
    to it; where they would have to be ordered, they are compared as text.
    """
    column, kind = F.col(field), field_type(schema, field)
    numeric = isinstance(kind, (NumericType, BooleanType))
    if isinstance(value, float) == numeric:
        left = column.cast("double") if numeric else column.cast("string")
        test = {"=": left == value, "!=": left != value, "<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value}[op]
    elif op in ("=", "!="):
        test = F.lit(op == "!=") & column.isNotNull()
    else:
        plain = f"{value:g}" if isinstance(value, float) else value
        test = column.cast("string") == plain
    return F.coalesce(test, F.lit(False))


def query(rows: DataFrame, filters: Iterable[str], sort: str | None = None, descending: bool = False, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows that pass all filters, sorted with missing values last, ties by ``tie``; ``limit`` keeps the first ones."""
    kept = reduce(lambda df, text: df.where(matches(rows.schema, *parse_filter(text))), filters, rows)
    if sort:
        first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
        kept = kept.orderBy(first, *([tie] if tie else []))
    return kept if limit is None else kept.limit(limit)


def percent(n: Column, total: Column, digits: int = 1) -> Column:
    """``n`` of ``total`` as a percentage with so many digits, as text; 0 of nothing is 0."""
    return F.format_string(f"%.{digits}f%%", F.coalesce(100.0 * n / F.nullif(total, F.lit(0)), F.lit(0.0)))


def scorecard(rows: DataFrame, status: str, scores: Sequence[str]) -> DataFrame:
    """One row a status: how many, their percentage of all with two digits, and the means of the scores that are there."""
    counted = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in scores])
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)  # one row for each of the few statuses
    return counted.withColumn("pct", share)


def verdict(score: Column, bounds: Sequence[tuple[float, str]] = COMPLETENESS) -> Column:
    """The verdict on a share; none is a failure."""
    return reduce(lambda chain, b: chain.when(score >= b[0], b[1]), bounds, F.when(F.lit(False), "")).otherwise("fail")


def composite_status(exit_code: Column, visual: Column, data: Column, structural: Column, flatten: Column, fault: Column) -> Column:
    """One status of a document from its exit code and the four verdicts 'pass', 'partial' and 'fail'."""
    chain = F.when(F.lit(False), "")
    for code, name in EXIT_STATUS.items():
        chain = chain.when(exit_code == code, name)
    return (
        chain.when(fault, "oracle_fault").when(flatten == "fail", "flatten_issue").when(visual == "fail", "render_fail")
        .when((data == "fail") | (structural == "fail"), "partial_render").when((data == "partial") | (structural == "partial"), "major_deviation")
        .when(visual == "partial", "minor_deviation").otherwise("fully_correct")
    )


def failure_codes(tests: dict[str, Column], correct: Column) -> Column:
    """The codes whose test holds, in the order given; 'UNKNOWN' if there is none, nothing for correct results."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in tests.items()]))
    return F.when(correct, F.array().cast("array<string>")).when(F.size(hit) == 0, F.array(F.lit("UNKNOWN"))).otherwise(hit)


def primary_code(codes: Column) -> Column:
    """The most important of some codes, null without any; codes without a place come by their order."""
    ranked = F.array(*map(F.lit, PRIORITY))
    known = F.filter(ranked, lambda c: F.array_contains(codes, c))
    return F.coalesce(F.get(known, F.lit(0)), F.get(codes, F.lit(0)))


def confidence(codes: Column, primary: Column) -> Column:
    """How sure the primary code is: several codes support each other, an unknown one is a guess."""
    return F.when(primary.isNull(), "high").when(primary == "UNKNOWN", "low").when((F.size(codes) >= 2) & (primary != "ORACLE-002"), "high").otherwise("medium")


def needs_review(codes: Column, primary: Column, sure: Column) -> Column:
    """Whether someone should look at the result."""
    return (F.size(codes) > 0) & ((sure == "low") | (primary == "UNKNOWN") | F.array_contains(codes, "ORACLE-002"))


def code_shares(rows: DataFrame, code: str, score: str, name: str, samples: int = 3) -> DataFrame:
    """One row a code: count, percent of the failed and of all rows, mean score and the first samples by name.

    ``rows`` are all results, with a null code where nothing failed.  Samples are cut within
    hash parts first.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("_all"), F.count(code).alias("_failed")).withColumn("_one", F.lit(0))
    counted = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("mean_score"))
    part = rows.where(F.col(code).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(name), F.lit(32)))
    top = part.withColumn("_r", F.row_number().over(Window.partitionBy(code, "_part").orderBy(name))).where(F.col("_r") <= samples)
    shown = top.groupBy(code).agg(F.array_join(F.slice(F.array_sort(F.collect_list(name)), 1, samples), ",").alias("samples"))
    share = lambda total: F.round(100 * F.col("n") / F.col(total), 2)
    joined = counted.join(shown, code).withColumn("_one", F.lit(0)).join(totals, "_one")
    return joined.select(code, "n", share("_failed").alias("pct_of_failed"), share("_all").alias("pct_of_all"), "mean_score", "samples")


def name_prefix(name: Column) -> Column:
    """The corpus a file name stands for: what comes before a double underscore, else before a dash, else 'plain'."""
    return F.when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(1))).when(name.contains("-"), F.split_part(name, F.lit("-"), F.lit(1))).otherwise("plain")


def gate_band(score: Column) -> Column:
    """The band of a failed score, null above all of them."""
    return reduce(lambda chain, b: chain.when((score >= b[0]) & (score < b[1]), f"{b[0]:.2f}-{b[1]:.2f}"), GATE_BANDS, F.when(F.lit(False), ""))


def excluded_because(mode: str, name: Column, error: Column, size: Column, pages: Column, form: Column, reference: Column) -> Column:
    """Why an entry is left out of a corpus in ``mode``, null if it stays; the first reason counts.

    ``form`` is the kind of form ('none', 'static', 'dynamic'), ``reference`` whether there is a reference result.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == MODES[0]:
        return F.lit(None).cast("string")
    plain, message = F.lower(name), F.lower(F.coalesce(error, F.lit("")))
    forms = F.coalesce(form, F.lit("none"))
    reasons = [
        (reduce(lambda a, b: a | b, [plain.contains(p) for p in HOSTILE_PARTS]), "adversarial_filename"),
        (message.contains("encrypt") | message.contains("password"), "encrypted"),
        (F.coalesce(size, F.lit(0)) < LEAST_BYTES, "file_too_small"),
        (forms.isin("static", "dynamic") & (F.coalesce(pages, F.lit(0)) == 0), "zero_page_xfa"),
        (message != "", "parse_error"),
        *([(forms == "none", "non_xfa")] if MODES.index(mode) >= 2 else []),
        *([(~F.coalesce(reference, F.lit(False)), "no_pdfrest_reference")] if MODES.index(mode) >= 3 else []),
    ]
    return reduce(lambda chain, r: chain.when(F.coalesce(r[0], F.lit(False)), r[1]), reasons, F.when(F.lit(False), ""))


def tier(code: Column, total: Column, severity: Column, known: Sequence[str] = ()) -> Column:
    """Priority tier of a code by its total score and severity; known limitations come first."""
    chain = F.when(code.isin(*known) if known else F.lit(False), "known_limitation")
    for least, grave, name in TIERS:
        chain = chain.when((total >= least) & (severity >= grave), name)
    return chain.otherwise("accept")


def contained_values(values: DataFrame, texts: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """``key, total, matched, score, verdict``: how many different values of each key its text holds.

    Values and texts meet by the words of both, so a text is read once whatever the number
    of values; keys without values are complete.
    """
    wanted = values.where(F.trim(value) != "").select(key, F.lower(F.trim(value)).alias("_v")).distinct()
    there = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("_v")).distinct().withColumn("_there", F.lit(True))
    counted = wanted.join(there, [key, "_v"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count("_there").alias("matched"))
    score = F.round(F.col("matched") / F.col("total"), 6)
    return counted.withColumn("score", score).withColumn("verdict", verdict(F.col("score")))


def agreement(agreed: Column, counted: Column) -> Column:
    """Percentage with three digits, null if nothing was counted."""
    return F.when(counted > 0, F.round(100 * agreed / counted, 3))


def code_changes(rows: DataFrame, run: str, code: str, more_than: int = 5, growth: float = 0.2) -> DataFrame:
    """``run, code, before, n, rule``: codes that are new or grew against the run before.

    'new_code' is one that was not there and now counts more than ``more_than``,
    'code_growth' one that grew by more than the share ``growth``.
    """
    counts = rows.where(F.col(code).isNotNull()).groupBy(run, code).agg(F.count(F.lit(1)).alias("n"))
    runs = rows.select(run).distinct().withColumn("_before", F.lag(run).over(Window.orderBy(run)))  # one row a run
    previous = counts.select(F.col(run).alias("_before"), code, F.col("n").alias("before"))
    paired = counts.join(runs.where("_before is not null"), run).join(previous, ["_before", code], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    rule = F.when((F.col("before") == 0) & (F.col("n") > more_than), "new_code").when((F.col("before") > 0) & ((F.col("n") - F.col("before")) / F.col("before") > growth), "code_growth")
    return paired.withColumn("rule", rule).where("rule is not null").select(run, code, "before", "n", "rule")


def review_bucket(codes: Column, primary: Column, sure: Column, before: Column, now: Column) -> Column:
    """The queue of a result: 1 unknown, 2 unsure, 3 the oracle may be wrong, 4 worse than in the run before; null if none."""
    worse = (before == "fully_correct") & (now != "fully_correct")
    return F.when(primary == "UNKNOWN", 1).when(sure == "low", 2).when(F.array_contains(codes, "ORACLE-002"), 3).when(worse, 4)


def last_runs(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` latest rows of a history."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def bar(value: Column, width: int = 20) -> Column:
    """A value from 0 to 1 as a bar of signs."""
    filled = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * width).cast("int")
    return F.concat(F.call_function("repeat", F.lit("#"), filled), F.call_function("repeat", F.lit("."), F.lit(width) - filled))


def leniency(events: DataFrame, run: str, code: str, grade: str) -> DataFrame:
    """One row a run: lenient events, their different codes, warnings and errors."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct(code).alias("codes"), F.count_if(F.col(grade) == "low").alias("warnings"), F.count_if(F.col(grade) != "low").alias("errors")
    )


def bench_changes(before: DataFrame, now: DataFrame, name: str, value: str, threshold: float = 10.0) -> DataFrame:
    """``name, before, now, pct, status``: benchmarks matched by name; 'slower' or 'faster' beyond ``threshold`` percent, 'new' or 'gone' without partner."""
    a, b = before.select(name, F.col(value).alias("before")), now.select(name, F.col(value).alias("now"))
    pct = F.round(100 * (F.col("now") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)), 3)
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("pct") > threshold, "slower").when(F.col("pct") < -threshold, "faster").otherwise("same")
    return a.join(b, name, "full_outer").withColumn("pct", pct).withColumn("status", status)
