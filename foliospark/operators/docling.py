"""Docling items of documents: text items with references, parents, labels and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .structure import FURNITURE, ORDER

# Label of each kind of block.
LABELS = {"paragraph": "text", "heading": "section_header", "listItem": "list_item", "header": "page_header", "footer": "page_footer", "caption": "caption"}


def label(kind: Column) -> Column:
    chain = F.lit("text")
    for k, v in LABELS.items():
        chain = F.when(kind == k, v).otherwise(chain)
    return chain


def numbered(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Rows with ``name``: how many rows with ``flag`` their document has up to and including each, over its pages.

    Pages are counted first and summed up, so a long document is not sorted in one task.
    """
    marked = rows.withColumn("_f", flag.cast("int"))
    pages = marked.groupBy("entry_id", "page").agg(F.sum("_f").alias("_n"))
    before = Window.partitionBy("entry_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.select("entry_id", "page", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    inside = Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:]).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_i", F.sum("_f").over(inside)).join(carried, ["entry_id", "page"]).withColumn(name, (F.col("_i") + F.col("_c")).cast("int")).drop("_f", "_i", "_c")


def text_items(rows: DataFrame) -> DataFrame:
    """``entry_id, self_ref, parent, label, content_layer, text, page_no, line_id``: the text items of each document in reading order.

    A run of list items on a page is a group; running heads belong to the furniture;
    pages count from 1 here.  Table cells are items of their table and left out.
    """
    texts = rows.where((F.col("kind") != "tableCell") & (F.trim("text") != ""))
    counted = numbered(texts, F.lit(1), "_no")
    item = F.col("kind") == "listItem"
    before = F.lag("kind").over(Window.partitionBy("entry_id", "page").orderBy(*ORDER[1:]))
    opens = item & ~F.coalesce(before == "listItem", F.lit(False))
    grouped = numbered(counted.withColumn("_opens", opens), F.col("_opens"), "_group")
    layer = F.when(F.col("kind").isin(*FURNITURE), "furniture").otherwise("body")
    parent = F.when(item, F.concat(F.lit("#/groups/"), (F.col("_group") - 1).cast("string"))).otherwise(F.concat(F.lit("#/"), layer))
    return grouped.select(
        "entry_id", F.concat(F.lit("#/texts/"), (F.col("_no") - 1).cast("string")).alias("self_ref"), parent.alias("parent"), label(F.col("kind")).alias("label"),
        layer.alias("content_layer"), "text", (F.col("page") + 1).alias("page_no"), "line_id",
    )


def provenance(page: Column, box: Column, text: Column) -> Column:
    """Where an item stands: page from 1, box from the bottom left, span of signs."""
    corner = F.struct(box[0].alias("l"), box[3].alias("t"), box[2].alias("r"), box[1].alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    return F.struct((page + 1).alias("page_no"), F.when(box.isNotNull(), corner).alias("bbox"), F.array(F.lit(0), F.length(text)).alias("charspan"))


def page_documents(rows: DataFrame) -> DataFrame:
    """``entry_id, page_no, json``: each page as a document of its text items."""
    items = text_items(rows).join(rows.select("line_id", "bbox", "page"), "line_id")
    one = F.struct("self_ref", F.struct(F.col("parent").alias("$ref")).alias("parent"), "content_layer", "label", F.array(provenance(F.col("page"), F.col("bbox"), F.col("text"))).alias("prov"), "text")
    place = F.substring_index("self_ref", "/", -1).cast("int")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), F.to_json(one).alias("j")))), lambda x: x["j"])
    body = F.concat(F.lit('{"schema_name":"DoclingDocument","texts":['), F.array_join(ordered, ","), F.lit("]}"))
    return items.groupBy("entry_id", "page_no").agg(body.alias("json"))
