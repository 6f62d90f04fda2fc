"""Blocks from markup, Markdown and office files.

Each reader takes a table with ``doc_id`` and ``content`` (text or bytes) and gives one
row per block.  Documents are independent, so a reader is one pass without a shuffle.
A document that cannot be read gives one row with ``error`` and nothing else.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import parse_html

SCHEMA = "doc_id bigint, index int, kind string, text string, level int, page int, row int, col int, ordinal int, row_span int, col_span int, header boolean, href string, error string"
_COLUMNS = ["doc_id", "index", "kind", "text", "level", "page", "row", "col", "ordinal", "row_span", "col_span", "header", "href", "error"]

#: Bytes that a packed file may unpack to at most.
LARGEST = 256 * 1024 * 1024

Block = dict


def sniff(content: Column) -> Column:
    """'pdf' if the first 1024 bytes name it, 'office' for a packed file, else 'unknown'; names are not consulted."""
    head = F.substring(content, 1, 1024)
    found = F.instr(F.decode(head, "ISO-8859-1"), "%PDF-") > 0
    return F.when(found, "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "office").otherwise("unknown")


def parse_markdown(content: str) -> list[Block]:
    """Headings, list items, fenced code, pipe tables and paragraphs of Markdown."""
    out: list[Block] = []
    lines: list[str] = []
    fence, row = "", -1

    def flush() -> None:
        if lines:
            out.append({"kind": "paragraph", "text": " ".join(lines)})
            lines.clear()

    for line in content.splitlines():
        stripped = line.strip()
        if fence:
            if stripped.startswith(fence):
                flush()
                fence = ""
            else:
                lines.append(line)
            continue
        opened = re.match(r"(`{3,}|~{3,})", stripped)
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", stripped)
        item = re.match(r"( *)([-*+]|[0-9]{1,9}[.)]) +(.*)", line)
        if stripped.startswith("|") and stripped.endswith("|") and len(stripped) > 1:
            flush()
            cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", stripped[1:-1])]
            if not all(re.fullmatch(":?-+:?", c) for c in cells):
                row += 1
                out += [{"kind": "tableCell", "text": c, "row": row, "col": i} for i, c in enumerate(cells)]
            continue
        row = -1
        if opened:
            flush()
            fence = opened.group(1)
        elif heading:
            flush()
            out.append({"kind": "heading", "text": heading.group(2), "level": len(heading.group(1))})
        elif item:
            flush()
            out.append({"kind": "listItem", "text": item.group(3).strip(), "level": len(item.group(1)) // 2 + 1})
        elif not stripped:
            flush()
        else:
            lines.append(stripped)
    flush()
    return out


def parse_text(content: str) -> list[Block]:
    out: list[Block] = []
    for part in re.split(r"\n[^\S\n]*\n", content.replace("\r\n", "\n")):
        paragraph: list[str] = []
        for line in [*part.split("\n"), None]:
            item = re.match(r"\s*([-*•]|[0-9]{1,9}[.)]) +(.*)", line) if line else None
            if (item or line is None) and paragraph:
                out.append({"kind": "paragraph", "text": " ".join(paragraph)})
                paragraph = []
            if item:
                out.append({"kind": "listItem", "text": item.group(2).strip(), "level": 1})
            elif line and line.strip():
                paragraph.append(line.strip())
    return out


def _open(content: bytes) -> zipfile.ZipFile:
    packed = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in packed.infolist()) > LARGEST:
        raise ValueError("the packed file unpacks to too many bytes")
    return packed


def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _texts(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == name)


def _below(e, name: str):
    return (x for x in e.iter() if _local(x) == name)


def parse_epub(content: bytes) -> list[Block]:
    """Chapters in spine order; ``page`` is the chapter, ``href`` its file."""
    packed = _open(content)
    container = ElementTree.fromstring(packed.read("META-INF/container.xml"))
    root = next(_below(container, "rootfile")).attrib["full-path"]
    package = ElementTree.fromstring(packed.read(root))
    base = root.rpartition("/")[0]
    files = {i.attrib["id"]: i.attrib["href"] for i in _below(package, "item")}
    out = []
    for chapter, ref in enumerate(_below(package, "itemref")):
        href = files[ref.attrib["idref"]]
        page = packed.read(f"{base}/{href}" if base else href).decode("utf-8", "replace")
        out += [b | {"page": chapter, "href": href} for b in parse_html(page)]
    return out


def epub_metadata(content: bytes) -> dict[str, str]:
    packed = _open(content)
    root = next(_below(ElementTree.fromstring(packed.read("META-INF/container.xml")), "rootfile")).attrib["full-path"]
    package = ElementTree.fromstring(packed.read(root))
    names = ("title", "creator", "language", "identifier", "publisher", "date")
    return {n: t for n in names for e in _below(package, n) if (t := (e.text or "").strip())}


def parse_docx(content: bytes) -> list[Block]:
    """Paragraphs, headings by style name, list items and table cells of a word document."""
    packed = _open(content)
    names: dict[str, str] = {}
    if "word/styles.xml" in packed.namelist():
        for style in _below(ElementTree.fromstring(packed.read("word/styles.xml")), "style"):
            name = next(_below(style, "name"), None)
            names[_attr(style, "styleId") or ""] = (_attr(name, "val") or "") if name is not None else ""
    body = next(_below(ElementTree.fromstring(packed.read("word/document.xml")), "body"))
    out: list[Block] = []
    for child in body:
        if _local(child) == "tbl":
            for r, tr in enumerate(x for x in child if _local(x) == "tr"):
                for c, tc in enumerate(x for x in tr if _local(x) == "tc"):
                    out.append({"kind": "tableCell", "text": " ".join(filter(None, (_texts(p).strip() for p in _below(tc, "p")))), "row": r, "col": c})
        elif _local(child) == "p" and (text := _texts(child).strip()):
            style = next(_below(child, "pStyle"), None)
            name = names.get(_attr(style, "val") or "", _attr(style, "val") or "") if style is not None else ""
            heading = re.fullmatch(r"(?i)heading ?([1-9])", name)
            number = next(_below(child, "numPr"), None)
            if heading:
                out.append({"kind": "heading", "text": text, "level": int(heading.group(1))})
            elif number is not None:
                depth = next(_below(number, "ilvl"), None)
                out.append({"kind": "listItem", "text": text, "level": int(_attr(depth, "val") or 0) + 1 if depth is not None else 1})
            else:
                out.append({"kind": "paragraph", "text": text})
    return out


def parse_xlsx(content: bytes) -> list[Block]:
    """A heading and the filled cells of each sheet; formulas show their stored value."""
    packed = _open(content)
    shared = []
    if "xl/sharedStrings.xml" in packed.namelist():
        shared = [_texts(s) for s in _below(ElementTree.fromstring(packed.read("xl/sharedStrings.xml")), "si")]
    links = {r.attrib["Id"]: r.attrib["Target"] for r in _below(ElementTree.fromstring(packed.read("xl/_rels/workbook.xml.rels")), "Relationship")}
    out: list[Block] = []
    for page, sheet in enumerate(_below(ElementTree.fromstring(packed.read("xl/workbook.xml")), "sheet")):
        out.append({"kind": "heading", "text": sheet.attrib["name"], "level": 1, "page": page})
        target = links[_attr(sheet, "id") or ""].lstrip("/")
        root = ElementTree.fromstring(packed.read(target if target.startswith("xl/") else f"xl/{target}"))
        for cell in _below(root, "c"):
            place = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.attrib.get("r", ""))
            value = _texts(cell, "v") or _texts(cell)
            if not place or value == "":
                continue
            if cell.attrib.get("t") == "s":
                value = shared[int(value)]
            column = 0
            for letter in place.group(1):
                column = column * 26 + ord(letter) - 64
            out.append({"kind": "tableCell", "text": value, "row": int(place.group(2)) - 1, "col": column - 1, "page": page})
    return out


def parse_pptx(content: bytes) -> list[Block]:
    """Text of the slides in order; titles are headings, the slide is the page."""
    packed = _open(content)
    slides = sorted((n for n in packed.namelist() if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.search(r"[0-9]+", n).group()))
    out: list[Block] = []
    for page, name in enumerate(slides):
        for shape in _below(ElementTree.fromstring(packed.read(name)), "sp"):
            place = next(_below(shape, "ph"), None)
            title = place is not None and place.attrib.get("type") in ("title", "ctrTitle")
            for p in _below(shape, "p"):
                if text := _texts(p).strip():
                    out.append({"kind": "heading" if title else "paragraph", "text": text, "level": 1 if title else None, "page": page})
    return out


PARSERS: dict[str, Callable] = {
    "html": parse_html,
    "markdown": parse_markdown,
    "text": parse_text,
    "epub": parse_epub,
    "docx": parse_docx,
    "xlsx": parse_xlsx,
    "pptx": parse_pptx,
}


def _office(content: bytes) -> str:
    names = _open(content).namelist()
    for name, marker in (("epub", "META-INF/container.xml"), ("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml")):
        if marker in names:
            return name
    return "pptx"


def _read(batches: Iterator[pd.DataFrame], kind: str, strict: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, content in zip(batch["doc_id"], batch["content"]):
            try:
                if content is None:
                    raise ValueError("no content")
                blocks = PARSERS[_office(content) if kind == "office" else kind](content)
                rows += [{"doc_id": doc_id, "index": i, **b} for i, b in enumerate(blocks)]
            except Exception as e:  # noqa: BLE001
                if strict:
                    raise
                rows.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"})
        frame = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
        for c in ("index", "level", "page", "row", "col", "ordinal", "row_span", "col_span"):
            frame[c] = frame[c].astype("Int32")
        yield frame.astype({c: object for c in ("kind", "text", "href", "error")}).where(frame.notna(), None)


def read_blocks(documents: DataFrame, kind: str, policy: str = "collect") -> DataFrame:
    """Blocks of ``doc_id, content``; ``kind`` is one of the parsers or 'office'.

    ``policy`` for documents that cannot be read: 'collect' keeps a row with ``error``,
    'skip' leaves them out, 'fail' raises.
    """
    if kind not in (*PARSERS, "office") or policy not in ("collect", "skip", "fail"):
        raise ValueError(f"unknown kind {kind!r} or policy {policy!r}")
    found = documents.select("doc_id", "content").mapInPandas(lambda it: _read(it, kind, policy == "fail"), SCHEMA)
    return found.where("error is null") if policy == "skip" else found
