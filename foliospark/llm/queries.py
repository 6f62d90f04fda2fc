"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import cut, spread, table
from . import grouped_split, leak_scan, lookalikes, mojibake, names, packing, segment, split_overlap, truncation


def _relations(spark, sf_dir):
    return split_overlap.relations(table(spark, sf_dir, "manifest_docs"), table(spark, sf_dir, "doc_differential"))


def p1_found(spark, sf_dir):
    pairs = split_overlap.related_pairs(_relations(spark, sf_dir))
    return pairs.select(*split_overlap.ordered(F.col("train_id"), F.col("held_id"))).distinct()


def p1_report(spark, sf_dir):
    manifest = table(spark, sf_dir, "manifest_docs")
    return split_overlap.overlap_report(cut(_relations(spark, sf_dir)), split_overlap.overlap_fractions(manifest), manifest)


def p1_classes(spark, sf_dir):
    return split_overlap.overlap_classes(_relations(spark, sf_dir))


def p1_fractions(spark, sf_dir):
    return split_overlap.overlap_fractions(table(spark, sf_dir, "manifest_docs"))


def p3_found(spark, sf_dir):
    return grouped_split.groups(table(spark, sf_dir, "manifest_docs"))


def p3_split(spark, sf_dir):
    return grouped_split.assign(table(spark, sf_dir, "manifest_docs"))


def _page_texts(spark, sf_dir):
    return mojibake.page_texts(table(spark, sf_dir, "page_lines"), table(spark, sf_dir, "chunks"))


def p2_found(spark, sf_dir):
    texts = _page_texts(spark, sf_dir)
    odd = cut(spread(lookalikes.suspicious(texts)))
    found = lookalikes.unified(texts, odd=odd).select("item_kind", "row_id").distinct()
    # Only rows that may be a case here are looked at again; the words are counted over all.
    wrong = mojibake.garbled(texts, odd).select("item_kind", "row_id").distinct()
    return found.join(wrong, ["item_kind", "row_id"], "left_anti")


def p2_canonical(spark, sf_dir):
    return lookalikes.unified(_page_texts(spark, sf_dir)).distinct()


def p5_found(spark, sf_dir):
    return segment.oversized_ids(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p5_pieces(spark, sf_dir):
    return segment.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p7_pack(spark, sf_dir):
    return packing.pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p7_fill(spark, sf_dir):
    return packing.fill(p7_pack(spark, sf_dir), table(spark, sf_dir, "token_budgets"))


def p6_found(spark, sf_dir):
    return mojibake.garbled(_page_texts(spark, sf_dir)).select("item_kind", "row_id").distinct()


def p6_restored(spark, sf_dir):
    return mojibake.garbled(_page_texts(spark, sf_dir)).distinct()


def p8_found(spark, sf_dir):
    return leak_scan.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_clean(spark, sf_dir):
    return leak_scan.cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return truncation.truncated(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_sources(spark, sf_dir):
    return truncation.by_source(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_classes": p1_classes,
    "p1_fractions": p1_fractions,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p3_found": p3_found,
    "p3_split": p3_split,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_sources": p9_sources,
}
_DOCUMENT = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(translate(document, '"
    + names._WIDE.replace("'", "''") + "　', '" + names._PLAIN.replace("'", "''") + r" ')), '[\s\p{Z}\p{Cf}]+', '', 'g'), '^.*[/\\]', ''), "
    r"'(\.(pdf|docx?|xlsx?|pptx?|html?|txt|md|xml|epub|tiff?|gz|zip))+$', ''), '[-_.#,;:]+(p|pg|page|s|seite)[-_.=]?[0-9]{1,5}$', ''), '[^\p{L}\p{N}]+', '', 'g')"
)
_AUTHOR = r"array_to_string(list_sort(list_filter(string_split_regex(lower(nfc_normalize(author)), '[^\p{L}\p{N}]+'), lambda x: x <> '')), ' ')"
_UNKNOWN = ", ".join(f"'{w}'" for w in sorted(names.NOT_KNOWN))

ORACLES = {
    "p3_found": f"""WITH RECURSIVE n AS (SELECT entry_id, source, entity_id, {_DOCUMENT} AS d, {_AUTHOR} AS a,
  regexp_replace(lower(author), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS plain FROM manifest_docs),
k AS (SELECT entry_id, 'd' || d AS key FROM n WHERE d <> '' UNION ALL SELECT entry_id, 'a' || a FROM n WHERE a <> '' AND plain NOT IN ({_UNKNOWN})
  UNION ALL SELECT entry_id, 's' || source FROM n WHERE trim(source) <> '' UNION ALL SELECT entry_id, 'e' || entity_id FROM n WHERE entity_id <> 0),
e AS (SELECT DISTINCT x.entry_id AS u, y.entry_id AS v FROM k x JOIN k y USING (key) WHERE x.entry_id <> y.entry_id),
r AS (SELECT u AS node, v AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach)
SELECT node AS entry_id, min(reach) AS group_id FROM r GROUP BY 1""",
    "p5_found": """SELECT DISTINCT c.chunk_id FROM chunks c
JOIN chunk_limits l ON lower(trim(c.metadata.kind)) = lower(trim(l.kind))
WHERE length(c.text) > l.max_chars""",
}
