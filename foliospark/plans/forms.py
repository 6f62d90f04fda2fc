"""Queries with the form expression language, and streams."""

from __future__ import annotations

from ..functions import expressions as E
from ..runtime import table

AMOUNT = "Round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2)"
GRADE = """if l_quantity >= 40 then "large" elseif l_quantity >= 20 then "medium" else "small" endif"""
LOOP = """var s = 0
for i = 1 upto l_linenumber do
  s = s + i
endfor
s"""


def expression_amounts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", E.compiled(AMOUNT, rows).cast("double").alias("amount"))


def expression_grades(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.withColumn("grade", E.compiled(GRADE, rows)).groupBy("grade").count().withColumnRenamed("count", "n")


def expression_loops(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.withColumn("total", E.compiled(LOOP, rows))


QUERIES = {f.__name__: f for f in (expression_amounts, expression_grades, expression_loops)}
ORACLES = {
    "expression_amounts": """SELECT l_orderkey, l_linenumber, l_partkey,
  floor(abs(l_extendedprice * (1 - l_discount) * (1 + l_tax)) * 100 + 0.5 + 1e-9) / 100 AS amount FROM lineitem""",
    "expression_grades": "SELECT CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS grade, count(*) AS n FROM lineitem GROUP BY 1",
    "expression_loops": "SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_linenumber * (l_linenumber + 1) // 2 AS VARCHAR) AS total FROM lineitem",
}
