"""Form data exchange: FDF and XFDF to field rows and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r"\(((?:[^()\\]|\\.)*)\)"
_FIELD = re.compile(rf"/T\s*{_STRING}\s*/V\s*(?:{_STRING}|/([^\s/<>\[\]()]+))|/V\s*(?:{_STRING}|/([^\s/<>\[\]()]+))\s*/T\s*{_STRING}", re.S)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m.group(1), 8)) if m.group(1)[0] in "01234567" else _ESCAPES.get(m.group(1), m.group(1)), text, flags=re.S)


def parse_fdf(content: str) -> list[tuple[str, str]]:
    out = []
    for m in _FIELD.finditer(content):
        t1, v1, n1, v2, n2, t2 = m.groups()
        name, value = (t1, v1 if v1 is not None else n1) if t1 is not None else (t2, v2 if v2 is not None else n2)
        out.append((_unescape(name), _unescape(value or "")))
    return out


def parse_xfdf(content: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []

    def walk(e, path: list[str]) -> None:
        for f in e:
            if f.tag.rpartition("}")[2] == "field":
                here = [*path, f.attrib.get("name", "")]
                out.extend((".".join(here), "".join(v.itertext())) for v in f if v.tag.rpartition("}")[2] == "value")
                walk(f, here)
            elif f.tag.rpartition("}")[2] == "fields":
                walk(f, path)

    walk(ElementTree.fromstring(content), [])
    return out


def read_fields(documents: DataFrame, kind: str) -> DataFrame:
    """``doc_id, name, value`` of the fields of FDF or XFDF texts; unreadable ones have a null name."""
    parse = {"fdf": parse_fdf, "xfdf": parse_xfdf}[kind]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows += [(doc_id, n, v) for n, v in parse(content or "")]
                except ElementTree.ParseError:
                    rows.append((doc_id, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "value"])

    return documents.select("doc_id", "content").mapInPandas(read, "doc_id bigint, name string, value string")


def escape_xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def to_xfdf(fields: DataFrame) -> DataFrame:
    """``doc_id, xfdf``: the fields of each document, by name."""
    one = F.concat(F.lit('<field name="'), escape_xml(F.col("name")), F.lit('"><value>'), escape_xml(F.coalesce("value", F.lit(""))), F.lit("</value></field>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("x")))), lambda s: s["x"])
    body = F.array_join(ordered, "")
    return fields.where("name is not null").groupBy("doc_id").agg(
        F.concat(F.lit('<xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>'), body, F.lit("</fields></xfdf>")).alias("xfdf")
    )
