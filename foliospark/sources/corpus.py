"""Corpus folders, list files, result files, run histories, bookmarks, pictures; and tables written out."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.window import Window


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, size, modified`` of the files below a folder whose name matches ``glob``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``doc_id, path, content`` of the files below a folder, for the block readers; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def listed(spark: SparkSession, list_file: str, base: str = "") -> DataFrame:
    """``position, path``: the files that a list names line by line; blank lines and those after a ``#`` are left out.

    Relative paths start at ``base``.  The position is that of the line in its file.
    """
    lines = spark.read.option("wholetext", "true").text(list_file).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("position", "line"))
    path = F.trim("line")
    rows = lines.where((path != "") & ~path.startswith("#"))
    absolute = path.startswith("/") | path.rlike("^[a-z][a-z0-9+.-]*:")
    return rows.select("position", F.when(absolute, path).otherwise(F.concat(F.lit(base.rstrip("/") + "/" if base else ""), path)).alias("path"))


def named_like(path: Column, *globs: str) -> Column:
    """Whether the last part of a path matches one of the patterns, whatever the letter case."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    test = F.lit(False)
    for glob in globs:
        test = test | name.rlike(f"^{fnmatch.translate(glob.lower())}$")
    return test


def result_rows(spark: SparkSession, path: str, row: StructType, key: str = "file") -> DataFrame:
    """Result rows of JSON files that hold a list, an object with ``results``, or an object of rows by ``key``.

    Of a keyed object the key fills the field ``key`` where the row has none.
    """
    text = spark.read.option("wholetext", "true").text(path).select("value")
    as_list = F.from_json("value", ArrayType(row))
    wrapped = F.from_json("value", StructType().add("results", ArrayType(row)))["results"]
    head = F.trim("value")
    by_key = F.from_json("value", MapType(StringType(), row))
    fill = lambda k, v: F.struct(*[F.coalesce(v[f.name], k).alias(f.name) if f.name == key else v[f.name].alias(f.name) for f in row])
    keyed = F.transform(F.map_entries(by_key), lambda e: fill(e["key"], e["value"]))
    rows = F.when(head.startswith("["), as_list).when(F.get_json_object("value", "$.results").isNotNull(), wrapped).otherwise(keyed)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def run_history(spark: SparkSession, folder: str, row: StructType) -> DataFrame:
    """Rows of run files ``{config: {run_id, timestamp}, results: [...]}`` with ``run_id`` and ``run_ts``."""
    shape = StructType().add("config", StructType().add("run_id", StringType()).add("timestamp", StringType())).add("results", ArrayType(row))
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.from_json("value", shape).alias("f"))
    runs = files.select(F.col("f.config.run_id").alias("run_id"), F.try_to_timestamp("f.config.timestamp").alias("run_ts"), F.explode("f.results").alias("r"))
    return runs.select("run_id", "run_ts", "r.*")


def _bookmarks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["json"]):
            try:
                waiting = [(b, 1) for b in reversed(json.loads(text))]
            except (TypeError, ValueError):
                continue
            at = 0
            while waiting:
                mark, level = waiting.pop()
                page = mark.get("page")
                rows.append((doc_id, at, level, str(mark.get("title", "")), page if isinstance(page, int) else None))
                at += 1
                waiting += [(b, level + 1) for b in reversed(mark.get("children") or [])]
        yield pd.DataFrame(rows, columns=["doc_id", "at", "level", "title", "page"]).astype({"page": "Int32"})


def bookmarks(documents: DataFrame) -> DataFrame:
    """``doc_id, at, level, title, page`` of bookmark trees of any depth given as ``doc_id, json``.

    A tree is a list of objects with ``title``, ``page`` and ``children``; what is no such list has no rows.
    """
    return documents.select("doc_id", "json").mapInPandas(_bookmarks, "doc_id bigint, at int, level int, title string, page int")


def _tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for marks in batch["marks"]:
            top: list[dict] = []
            path = [(0, top)]
            for m in marks:
                while path[-1][0] >= m["level"]:
                    path.pop()
                node = {"title": m["title"], **({} if m["page"] is None or m["page"] != m["page"] else {"page": int(m["page"])})}
                path[-1][1].append(node)
                path.append((m["level"], node.setdefault("children", [])))
            out.append(json.dumps(_without_empty(top), ensure_ascii=False))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "json": out})


def _without_empty(nodes: list[dict]) -> list[dict]:
    waiting = list(nodes)
    while waiting:
        node = waiting.pop()
        waiting += node["children"]
        if not node["children"]:
            del node["children"]
    return nodes


def bookmarks_json(marks: DataFrame) -> DataFrame:
    """``doc_id, json``: bookmark rows as trees again; a document's outline is bounded."""
    rows = marks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "level", "title", "page"))).alias("marks"))
    return rows.mapInPandas(_tree, "doc_id bigint, json string")


def picture_format(content: Column) -> Column:
    """'png', 'jpeg', 'gif', 'bmp', 'tiff', 'webp' or 'jp2' by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    starts = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "47494638": "gif", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff", "0000000C6A502020": "jp2"}
    chain = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for mark, name in starts.items():
        chain = chain.when(head.startswith(mark), name)
    return chain


def picture_size(content: Column) -> Column:
    """``width, height`` of PNG, GIF and BMP pictures from their headers, else null."""
    def number(first: int, n: int, little: bool) -> Column:
        part = F.substring(content, first, n)
        digits = F.hex(part)
        if little:
            digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
        return F.conv(digits, 16, 10).cast("int")

    kind = picture_format(content)
    size = lambda w, h, n, little: F.struct(number(w, n, little).alias("width"), number(h, n, little).alias("height"))
    return F.when(kind == "png", size(17, 21, 4, False)).when(kind == "gif", size(7, 9, 2, True)).when(kind == "bmp", size(19, 23, 4, True))


def page_pictures(pictures: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pictures ``doc_id, page, at, content`` with number, format, size and digest; equal ones have the same digest."""
    n = F.row_number().over(Window.partitionBy(doc, "page").orderBy("at"))
    size = picture_size(F.col("content"))
    return pictures.select(doc, "page", n.alias("number"), picture_format(F.col("content")).alias("format"), size["width"].alias("width"), size["height"].alias("height"), F.sha2("content", 256).alias("digest"))


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write rows as 'json', 'csv' or 'parquet' beside ``path`` first and rename them: readers see all of it or nothing."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}._writing"
    writer = df.write.mode("overwrite")
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(beside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(hadoop.Path(beside), target):
        raise OSError(f"could not rename {beside}")
