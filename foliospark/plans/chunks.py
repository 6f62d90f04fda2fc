"""Queries over chunks and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import docling as K
from ..operators import paths as X
from ..operators import structure as S
from ..operators.hierarchy import latest
from ..runtime import table


def _lines(spark, sf_dir, *columns):
    return S.lines(table(spark, sf_dir, "page_lines"), "entry_id", "page", "line_no", "kind", "text", *columns).where("entry_id is not null and page is not null")


def line_sections(spark, sf_dir):
    return C.sections(_lines(spark, sf_dir))


def block_chunks(spark, sf_dir):
    return C.block_chunks(_lines(spark, sf_dir, "table_id"))


def chunk_metadata(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", "metadata", "made_at"), ["chunk_id"], "made_at")
    flat = C.flat_metadata(rows.drop("made_at"))
    return flat.select("chunk_id", "metadata_source", "metadata_page", F.lower(F.trim("metadata_kind")).alias("metadata_kind"), "metadata_section", "metadata_level", "metadata_table_part")


def chunk_kinds(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", "text", "metadata", "made_at"), ["chunk_id"], "made_at")
    kind = F.lower(F.trim("metadata.kind")).alias("kind")
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def section_chunks(spark, sf_dir):
    rows = latest(table(spark, sf_dir, "chunks").where("chunk_id is not null").select("chunk_id", "entry_id", "metadata", "made_at"), ["chunk_id"], "made_at")
    path = rows.where("metadata.section_path is not null").select("chunk_id", F.posexplode("metadata.section_path").alias("depth", "heading"))
    return path.groupBy("depth", "heading").agg(F.countDistinct("chunk_id").alias("chunks"))


def resolved_paths(spark, sf_dir):
    return X.resolve(table(spark, sf_dir, "events"), "props", "$.k", ["event_id"])


def docling_items(spark, sf_dir):
    return K.text_items(_lines(spark, sf_dir, "bbox"))


def docling_pages(spark, sf_dir):
    return K.page_documents(_lines(spark, sf_dir, "bbox"))


L = """L AS (SELECT * FROM (SELECT * FROM page_lines WHERE line_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY read_at DESC NULLS LAST) = 1) WHERE entry_id IS NOT NULL AND page IS NOT NULL)"""
_SECTION = """S AS (SELECT line_id, last_value(CASE WHEN kind = 'heading' AND trim(text, ' ') <> '' THEN trim(text, ' ') END IGNORE NULLS)
  OVER (PARTITION BY entry_id ORDER BY page, line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM L)"""
_C = """C AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY made_at DESC NULLS LAST) = 1)"""

QUERIES = {f.__name__: f for f in (line_sections, block_chunks, chunk_metadata, chunk_kinds, section_chunks, resolved_paths, docling_items, docling_pages)}
ORACLES = {
    "docling_items": f"""WITH {L}, T AS (SELECT *, row_number() OVER w - 1 AS n,
    kind = 'listItem' AND coalesce(lag(kind) OVER (PARTITION BY entry_id, page ORDER BY line_no, line_id) <> 'listItem', true) AS opens
  FROM L WHERE kind <> 'tableCell' AND trim(text, ' ') <> '' WINDOW w AS (PARTITION BY entry_id ORDER BY page, line_no, line_id)),
G AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY page, line_no, line_id) - 1 AS g FROM T)
SELECT entry_id, '#/texts/' || n AS self_ref,
  CASE WHEN kind = 'listItem' THEN '#/groups/' || CAST(g AS INT) WHEN kind IN ('header', 'footer') THEN '#/furniture' ELSE '#/body' END AS parent,
  CASE kind WHEN 'heading' THEN 'section_header' WHEN 'listItem' THEN 'list_item' WHEN 'header' THEN 'page_header' WHEN 'footer' THEN 'page_footer'
    WHEN 'caption' THEN 'caption' ELSE 'text' END AS label,
  CASE WHEN kind IN ('header', 'footer') THEN 'furniture' ELSE 'body' END AS content_layer, text, page + 1 AS page_no, line_id FROM G""",
    "line_sections": f"WITH {L}, {_SECTION} SELECT line_id, section FROM S",
    "block_chunks": f"""WITH {L}, {_SECTION}, K AS (
  SELECT entry_id, page, line_no, line_id, kind, trim(text, ' ') AS text, section, kind = 'tableCell' AND table_id IS NOT NULL AS t,
    CASE WHEN kind = 'tableCell' AND table_id IS NOT NULL THEN 't' || table_id ELSE 'l' || line_id END AS k
  FROM L JOIN S USING (line_id) WHERE kind NOT IN ('header', 'footer') AND trim(text, ' ') <> ''),
G AS (SELECT entry_id, page, k, bool_or(t) AS t, string_agg(text, chr(10) ORDER BY line_no, line_id) AS text, count(*) AS n,
  first(kind ORDER BY line_no, line_id) AS kind, first(section ORDER BY line_no, line_id) AS section,
  min(line_no * 1000000000000 + line_id) AS o FROM K GROUP BY 1, 2, 3)
SELECT entry_id, page, CAST(row_number() OVER (PARTITION BY entry_id, page ORDER BY o) - 1 AS INT) AS chunk_no, CASE WHEN t THEN 'table' ELSE kind END AS kind,
  text, CASE WHEN kind <> 'heading' THEN section END AS section, CAST(n AS INT) AS n_lines FROM G""",
    "chunk_metadata": f"""WITH {_C} SELECT chunk_id, metadata.source AS metadata_source, metadata.page AS metadata_page, lower(trim(metadata.kind, ' ')) AS metadata_kind,
  metadata.section AS metadata_section, metadata.level AS metadata_level, metadata.table_part AS metadata_table_part FROM C""",
    "chunk_kinds": f"""WITH {_C} SELECT lower(trim(metadata.kind, ' ')) AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest FROM C GROUP BY 1""",
    "section_chunks": f"""WITH {_C}, P AS (SELECT chunk_id, metadata.section_path AS p, unnest(range(0, len(metadata.section_path))) AS depth FROM C)
SELECT CAST(depth AS INT) AS depth, p[depth + 1] AS heading, count(DISTINCT chunk_id) AS chunks FROM P GROUP BY 1, 2""",
    "resolved_paths": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
}
