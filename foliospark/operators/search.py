"""Search, redaction and replacement in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut

#: Signs that a regular expression gives a meaning.
_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|])")


def literal(text: str) -> str:
    """A pattern for the text itself."""
    return _SPECIAL.sub(r"\\\1", text)


def occurrences(c: Column, query: str, case_sensitive: bool = False) -> Column:
    """How often the query occurs, overlapping occurrences included."""
    if not query:
        raise ValueError("the query is empty")
    return F.regexp_count(c, F.lit(("" if case_sensitive else "(?iu)") + f"(?={literal(query)})"))


def offsets(c: Column, query: str, case_sensitive: bool = False) -> Column:
    """Offsets (in signs, from 0) of all occurrences, overlapping ones included."""
    if not query:
        raise ValueError("the query is empty")
    text, wanted = (c, query) if case_sensitive else (F.lower(c), query.lower())
    at = F.when(F.length(text) >= len(wanted), F.sequence(F.lit(1), F.length(text) - len(wanted) + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: F.substring(text, i, F.lit(len(wanted))) == wanted), lambda i: i - 1)


def hits(rows: DataFrame, keys: list[str], query: str, case_sensitive: bool = False) -> DataFrame:
    """One row per occurrence: keys, ``offset``, ``matched``; only rows that hold the query are taken apart."""
    some = rows.where(occurrences(F.col("text"), query, case_sensitive) > 0)
    found = some.select(*keys, "text", F.explode(offsets(F.col("text"), query, case_sensitive)).alias("offset"))
    return found.select(*keys, "offset", F.substring("text", F.col("offset") + 1, F.lit(len(query))).alias("matched"))


def redact(rows: DataFrame, pattern: str, mask: str = "█", regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """Rows with ``text`` masked sign by sign and the number of ``matches``; null texts stay null with null matches."""
    p = ("" if case_sensitive else "(?iu)") + (pattern if regex else literal(pattern))
    if regex:
        return rows.withColumn("matches", F.regexp_count("text", F.lit(p))).withColumn("text", F.regexp_replace("text", p, mask * 3))
    return rows.withColumn("matches", F.regexp_count("text", F.lit(p))).withColumn("text", F.regexp_replace("text", p, mask * len(pattern)))


def redaction_report(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """``matches``, ``changed`` and ``unreadable`` rows by key: no match and no text are told apart."""
    n = F.regexp_count("text", F.lit(pattern))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("matches"), F.count_if(n > 0).alias("changed"), F.count_if(F.col("text").isNull()).alias("unreadable")
    )


def numbered(rows: DataFrame, order: str, prefix: str, start: int = 1, width: int = 6) -> DataFrame:
    """Rows with a consecutive ``stamp`` such as ``ABC000001`` over the whole table, in the order of a unique key.

    Rows are split into ranges of about equal size whatever the keys are, ranked within
    them, and the sizes of the ranges summed up, so no task sorts them all.  The split is
    written once, as a second one could draw other bounds.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    number = F.col("_i") + F.col("_before") + (start - 1)
    joined = ranked.join(F.broadcast(sizes.select("_part", offset.alias("_before"))), "_part")  # one row a range
    return joined.withColumn("stamp", F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))).drop("_part", "_i", "_before")
