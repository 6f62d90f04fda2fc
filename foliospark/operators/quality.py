"""Run analytics: clusters, bands, trends, regressions, samples and calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .hierarchy import latest

#: Half-open bands of a score.
BANDS = ((0.0, 0.5), (0.5, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 1.0))

# Weight of a severity.
WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 3.0, "low": 1.0}

# Fragments of lower-case messages by category, each a test (empty: any) and
# fragments that must all be there; the first match wins.
CATEGORIES = (
    *(("", (p,), "encrypted") for p in ("decryption", "passwordprotected", "password protected", "encrypted")),
    *(("", (p,), "out_of_memory") for p in ("out of memory", "alloc")),
    *(("", (p,), "timeout") for p in ("timeout", "timed out")),
    *(("", (p,), "manipulation_error") for p in ("insertion index", "merge panic", "split panic", "merge failed", "split failed")),
    *(("manipulation", (p,), "manipulation_error") for p in ("page count", "parts, expected")),
    *(("", (p,), "oracle_quality") for p in ("similarity", "oracle")),
    *(("", (p,), "oracle_missing") for p in ("pdftotext", "pdfinfo")),
    *((t, (p,), "oracle_quality") for t in ("text_oracle", "metadata_oracle") for p in ("our engine failed", "extraction", "mismatch", "page_count:", "title:", "author:")),
    ("", ("panic",), "panic"),
    *(("", (p,), "invalid_xref") for p in ("xref", "cross-reference")),
    *(("", ("stream", p), "corrupt_stream") for p in ("corrupt", "invalid")),
    *(("", (p,), "unsupported_filter") for p in ("filter", "flatedecode", "dctdecode", "jbig2", "ccitt")),
    *(("", (p,), "invalid_header") for p in ("header", "%pdf")),
    *(("", (p,), "malformed_object") for p in ("object", "expected", "parse", "syntax")),
    ("", ("cmap",), "invalid_cmap"),
    *(("", (p,), "missing_font") for p in ("font", "glyph")),
    *(("", (p,), "encoding_error") for p in ("encoding", "utf", "codec")),
    *(("", (p,), "unsupported_color_space") for p in ("colorspace", "color space")),
    *(("", (p,), "transparency_error") for p in ("transparency", "blend")),
    *(("", (p,), "image_decode_error") for p in ("image", "decode", "jpeg", "png")),
    ("compliance", (), "compliance_violation"),
    *(("", (p,), "invalid_form_field") for p in ("form", "field", "acroform")),
    ("", ("annot",), "broken_annotation"),
    *(("", (p,), "invalid_signature") for p in ("sign", "certificate")),
)

# Severity by status, then by category; all others are low.
STATUS_SEVERITY = {"crash": "critical", "timeout": "high"}
CATEGORY_SEVERITY = {
    "panic": "critical", "out_of_memory": "critical", "timeout": "high",
    "invalid_xref": "medium", "corrupt_stream": "medium", "malformed_object": "medium", "invalid_header": "medium",
}

# Percent of all documents above which a cluster has the frequency score.
FREQUENCIES = ((30, 5), (15, 4), (5, 3))
#: Percent from which the score is 2; below it is 1.
SELDOM = 2


def results(diff: DataFrame, *columns: str) -> DataFrame:
    """Results in the state received last with the wanted ``columns`` (all if none is named); rows without id are left out."""
    return latest(diff.where("result_id is not null"), ["result_id"], "received_at", list(columns) or None)


def _chosen(value: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), otherwise)


def category(message: Column, test: Column | None = None) -> Column:
    """The category of a message, 'none' without one, 'unknown' if nothing fits; some fragments hold for one ``test`` only."""
    text = F.lower(message)
    chain = F.when(message.isNull() | (message == ""), "none")
    for only, parts, name in CATEGORIES:
        if only and test is None:
            continue
        hit = reduce(lambda a, b: a & b, [text.contains(p) for p in parts], F.lit(True))
        chain = chain.when(hit & (test == only) if only else hit, name)
    return chain.otherwise("unknown")


def severity(name: Column, status: Column | None = None) -> Column:
    """The severity of a failure by its status, else by its category."""
    by_category = _chosen(name, CATEGORY_SEVERITY, F.lit("low"))
    return by_category if status is None else _chosen(status, STATUS_SEVERITY, by_category)


def frequency(n: Column, total: Column) -> Column:
    """Score 1 to 5 of a number of documents by its share of all."""
    percent = F.coalesce(n / F.nullif(total, F.lit(0)) * 100, F.lit(0.0))
    chain = F.when(F.lit(False), 0)
    for above, score in FREQUENCIES:
        chain = chain.when(percent > above, score)
    return chain.when(percent >= SELDOM, 2).otherwise(1)


def weight(name: Column) -> Column:
    chain = F.lit(0.0)
    for key, value in WEIGHTS.items():
        chain = F.when(name == key, F.lit(value)).otherwise(chain)
    return chain


def clusters(failures: DataFrame, keys: list[str], message: str, size: str, name: str, examples: int = 5) -> DataFrame:
    """Failures by keys, category and message pattern, with the ``examples`` smallest of each.

    The examples of a partition are cut before the shuffle, so a cluster of any size
    passes a bounded number of rows on.
    """
    rows = failures.select(*keys, category(F.col(message)).alias("category"), T.error_pattern(F.col(message)).alias("pattern"), F.coalesce(size, F.lit(0)).alias("size"), F.col(name).alias("name"))
    by = [*keys, "category", "pattern"]
    first = Window.partitionBy(*by, "_part").orderBy("size", "name")
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("name", "size"), F.lit(32)))
    top = parts.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= examples)
    shown = top.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("size", "name"))), 1, examples).alias("e"))
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    grade = severity(counted["category"])
    match = [counted[c].eqNullSafe(shown[c]) for c in by]
    return counted.join(shown, match).select(
        *[counted[c] for c in by], counted["n"], grade.alias("severity"), (counted["n"] * weight(grade)).alias("priority"),
        F.array_join(F.transform("e", lambda e: e["name"].cast("string")), ",").alias("examples"),
    )


#: Columns that :func:`run_summary` reads.
SUMMARY = ("run_id", "render_verdict", "oracle_fault", "error", "render_ssim", "text_similarity")


def band(score: Column, bands: Sequence[tuple[float, float]] = BANDS) -> Column:
    """The band of a score as ``low-high``; null outside all bands."""
    chain = F.lit(None).cast("string")
    for low, high in bands:
        chain = F.when((score >= low) & (score < high), F.lit(f"{low:g}-{high:g}")).otherwise(chain)
    return chain


def run_summary(rows: DataFrame) -> DataFrame:
    """One row per run: counts by verdict, means of the scores that are there, and the rate of matches."""
    ok = F.count_if(F.col("render_verdict") == "Match")
    fault = F.count_if("oracle_fault")
    counted = F.count(F.lit(1)) - fault
    matched = F.count_if((F.col("render_verdict") == "Match") & ~F.coalesce("oracle_fault", F.lit(False)))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), ok.alias("passed"), fault.alias("faults"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.round(F.avg("render_ssim"), 9).alias("mean_ssim"), F.round(F.avg("text_similarity"), 9).alias("mean_text"),
        F.when(counted == 0, 1.0).otherwise(F.round(matched / counted, 9)).alias("effective_rate"),
    )


def with_previous(runs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Run rows with the values of the run before; there are few runs, one row each."""
    before = Window.orderBy(order)
    return runs.select("*", *[F.lag(c).over(before).alias(f"previous_{c}") for c in columns])


def trend(series: DataFrame, key: str, step: str, value: str, share: float = 0.1) -> DataFrame:
    """``indicator`` of each step: NEW, FIXED, UP, DOWN or STABLE against the step before (change of at least ``share``)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(step))
    now = F.col(value)
    indicator = (
        F.when(before.isNull() | ((before == 0) & (now > 0)), "NEW")
        .when((before > 0) & (now == 0), "FIXED")
        .when(now > before * (1 + share), "UP")
        .when(now < before * (1 - share), "DOWN")
        .otherwise("STABLE")
    )
    return series.withColumn("previous", before).withColumn("indicator", indicator).drop("previous")


def filled_series(rows: DataFrame, key: str, step: str) -> DataFrame:
    """Counts of every key at every step, 0 where there is none: ``key, step, n``.

    Keys and steps are the few values of a dimension, so their grid is built by exploding
    the set of steps next to each key.
    """
    counts = rows.groupBy(key, step).agg(F.count(F.lit(1)).alias("n"))
    # Both sides join on a constant, so the set of steps is joined by key and not as a nested loop.
    steps = counts.groupBy(F.lit(0).alias("_all")).agg(F.array_sort(F.collect_set(step)).alias("_steps"))
    grid = counts.select(key, F.lit(0).alias("_all")).distinct().join(steps, "_all").select(key, F.explode("_steps").alias(step))
    return grid.join(counts, [key, step], "left").select(key, step, F.coalesce("n", F.lit(0)).alias("n"))


def stratified(rows: DataFrame, stratum: str, key: str, target: int, seed: str = "42") -> DataFrame:
    """The same ``target`` rows of each stratum at every run, by a hash of seed and key.

    A first cut within hash parts keeps a large stratum out of a single task.
    """
    draw = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    hashed = rows.withColumn("draw", draw).withColumn("_part", F.substring("draw", -2, 2))
    first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("draw", key))).where(F.col("_r") <= target)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("draw", key))).where(F.col("rank") <= target).drop("_r", "_part", "draw")


def f1_sweep(scored: DataFrame, score: str, label: str, steps: int = 20) -> DataFrame:
    """``threshold, tp, fp, fn, f1`` of a score against a label for ``steps + 1`` thresholds from 0 to 1.

    Scores are counted in their threshold interval first; the sweep runs over those few counts.
    """
    place = F.least(F.floor(F.round(F.col(score) * steps, 9)), F.lit(steps)).cast("int")
    bins = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(place.alias("bin")).agg(
        F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n")
    )
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    grid = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0)
    total = F.sum("p").over(Window.partitionBy())
    counted = grid.select("bin", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), total.alias("_all"))
    counted = counted.withColumn("fn", F.col("_all") - F.col("tp"))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return counted.select((F.col("bin") / steps).alias("threshold"), "tp", "fp", "fn", F.round(f1, 9).alias("f1"))


def co_occurrence(rows: DataFrame, group: str, code: str) -> DataFrame:
    """``code_a, code_b, n``: groups in which two codes occur together; a group holds a bounded set of codes."""
    sets = rows.where(F.col(code).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(code)).alias("c"))
    a = sets.select(group, "c", F.posexplode("c").alias("i", "code_a"))
    pairs = a.select("code_a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("code_b"))
    return pairs.groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("n"))
