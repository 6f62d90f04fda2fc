"""Queries over style sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..runtime import table


def p4_found(spark, sf_dir):
    return H.hierarchy(table(spark, sf_dir, "style_info")).select("entry_id", "style_id", "root_id", "depth")


def p4_paths(spark, sf_dir):
    tree = H.hierarchy(table(spark, sf_dir, "style_info"), with_path=True)
    return tree.select("entry_id", "style_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p4_descendants(spark, sf_dir):
    return H.descendants(table(spark, sf_dir, "style_info"))


_TREE = r"""
WITH RECURSIVE nodes AS (
  SELECT entry_id, style_id, name, based_on FROM style_info
  WHERE entry_id IS NOT NULL AND style_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entry_id, style_id ORDER BY loaded_at DESC NULLS LAST) = 1
), keys AS (
  SELECT entry_id, lower(trim(style_id)) AS key, 0 AS prio, style_id FROM nodes
  UNION ALL SELECT entry_id, lower(trim(name)), 1, style_id FROM nodes
), hits AS (
  SELECT entry_id, key, style_id FROM keys WHERE key <> ''
  QUALIFY row_number() OVER (PARTITION BY entry_id, key ORDER BY prio, style_id) = 1
), links AS (
  SELECT n.entry_id, n.style_id, h.style_id AS parent FROM nodes n
  LEFT JOIN hits h ON h.entry_id = n.entry_id AND h.key = lower(trim(n.based_on))
), tree AS (
  SELECT entry_id, style_id, style_id AS root_id, 0 AS depth, [style_id] AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.entry_id, l.style_id, t.root_id, t.depth + 1, list_append(t.path, l.style_id)
  FROM links l JOIN tree t ON t.entry_id = l.entry_id AND t.style_id = l.parent
)
"""
_ALL = """FROM links l LEFT JOIN tree t USING (entry_id, style_id)"""

QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}
ORACLES = {
    "p4_found": _TREE
    + "SELECT entry_id, style_id, coalesce(t.root_id, '(cycle)') AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth "
    + _ALL,
    "p4_paths": _TREE
    + "SELECT entry_id, style_id, coalesce(t.root_id, '(cycle)') AS root_id, CAST(coalesce(t.depth, -1) AS INT) AS depth, "
    + "array_to_string(t.path, '/') AS path "
    + _ALL,
    "p4_descendants": _TREE
    + """, steps AS (SELECT entry_id, style_id, depth, path, unnest(generate_series(1, depth)) AS i FROM tree WHERE depth > 0)
SELECT entry_id, path[i] AS ancestor_id, style_id, CAST(depth - i + 1 AS INT) AS distance FROM steps""",
}
