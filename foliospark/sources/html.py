"""Blocks from HTML: headings, paragraphs, nested lists, tables with spans, inline marks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements whose content is not shown.
HIDDEN = frozenset(["head", "script", "style", "nav", "footer", "del", "template", "noscript", "svg"])
# Elements without content, and those that end a block.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
BREAKS = frozenset(["p", "div", "section", "article", "header", "main", "aside", "ul", "ol", "table", "blockquote", "pre", "body", "figure", "form", "dl", "dt", "dd"])
# Inline elements and the mark around their text.
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "strike": "~~"}
#: Largest span of a cell.
SPAN = 1000

Block = dict


def url(text: str) -> str:
    """A target with blanks and round brackets percent-encoded."""
    return text.strip().replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def code_span(text: str) -> str:
    """Code in a fence of backticks that the text does not hold."""
    flat = re.sub(r"\r\n|[\r\n]", " ", text)
    fence = "`" * (1 + max((len(m) for m in re.findall("`+", flat)), default=0))
    return f"{fence} {flat} {fence}" if flat.startswith("`") or flat.endswith("`") else f"{fence}{flat}{fence}"


class Runs:
    """Text in the making: runs of equal style, rendered with their marks."""

    def __init__(self) -> None:
        self.runs: list[tuple[str, tuple[str, ...], str | None, bool]] = []

    def add(self, text: str, marks: tuple[str, ...] = (), link: str | None = None, code: bool = False) -> None:
        if self.runs and self.runs[-1][1:] == (marks, link, code):
            text = self.runs.pop()[0] + text
        self.runs.append((text, marks, link, code))

    def text(self, verbatim: bool = False) -> str:
        if verbatim:
            return "".join(r[0] for r in self.runs).strip("\n").rstrip()
        out, blank = [], True
        for text, marks, link, code in self.runs:
            text = re.sub(r"\s+", " ", text)
            if blank:
                text = text.lstrip()
            if not text:
                continue
            blank = text.endswith(" ")
            core = text.strip()
            if not (marks or code or link is not None):
                text = text.replace("\\", "\\\\")
            elif core and (marks or link is not None or code):
                lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
                inner = code_span(core) if code else re.sub(r"([\\*~\[\]])" if link is not None and marks else r"([\\\[\]])" if link is not None else r"([\\*~])", r"\\\1", core)
                for mark in marks:
                    inner = f"{mark}{inner}{mark}"
                text = lead + (f"[{inner}]({url(link)})" if link is not None else inner) + trail
            out.append(text)
        return "".join(out).strip()


class _Table:
    """Rows and columns that cells take, with what longer cells reach down into."""

    def __init__(self) -> None:
        self.row, self.taken, self.blocks = -1, {}, []

    def next_row(self) -> None:
        self.row += 1
        self.col = 0

    def place(self, rows: int, cols: int) -> int:
        if self.row < 0:
            self.next_row()
        while self.taken.get(self.col, 0) > self.row:
            self.col += 1
        at = self.col
        for c in range(at, at + cols):
            self.taken[c] = self.row + rows
        self.col += cols
        return at


class _Html(HTMLParser):
    """Keeps the blocks that are open: a list item or cell goes on after what is nested in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Block] = []  # items and cells around the place
        self.tables: list[_Table] = []
        self.waiting: list[list[Block]] = []  # tables inside the outermost one
        self.lists: list[list] = []  # kind and next number
        self.hidden: list[str] = []
        self.marks: list[str] = []
        self.links: list[str] = []
        self.code = self.pre = 0
        self.own: Block | None = None  # heading or paragraph without an item or cell around it

    def put(self, block: Block) -> Block:
        block["runs"] = Runs()
        (self.tables[-1].blocks if self.tables else self.blocks).append(block)
        return block

    def at(self) -> Block:
        if self.open:
            return self.open[-1]
        if self.own is None:
            self.own = self.put({"kind": "paragraph"})
        return self.own

    def write(self, text: str) -> None:
        if not text.strip() and not self.open and self.own is None:
            return
        self.at()["runs"].add(text, tuple(dict.fromkeys(reversed(self.marks))), self.links[-1] if self.links else None, bool(self.code) and not self.pre)

    def close_down_to(self, kind: str) -> None:
        while self.open and any(b["tag"] == kind for b in self.open):
            if self.open.pop()["tag"] == kind:
                break

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        concealed = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if self.hidden or tag in HIDDEN or concealed:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if tag == "br":
            self.write("\n" if self.pre else " ")
        elif tag == "img":
            if a.get("alt") or a.get("src"):
                self.at()["runs"].add(f"![{a.get('alt') or ''}]({url(a.get('src') or '')})")
        elif tag in MARKS:
            self.marks.append(MARKS[tag])
        elif tag == "code":
            self.code += 1
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif re.fullmatch("h[1-6]", tag):
            self.own, self.marks = None, []
            if not self.open:
                self.own = self.put({"kind": "heading", "level": int(tag[1])})
        elif tag == "li":
            if self.open and self.open[-1]["tag"] == "li" and self.open[-1]["depth"] >= len(self.lists):
                self.open.pop()
            self.own = None
            number = None
            if self.lists and self.lists[-1][0] == "ol":
                number = self.lists[-1][1]
                self.lists[-1][1] += 1
            self.open.append(self.put({"kind": "listItem", "level": max(1, len(self.lists)), "ordinal": number, "tag": "li", "depth": len(self.lists)}))
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.tables[-1].next_row()
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            rows, cols = (min(SPAN, max(1, int(v))) if (v := a.get(n) or "1").isdigit() else 1 for n in ("rowspan", "colspan"))
            col = self.tables[-1].place(rows, cols)
            cell = {"kind": "tableCell", "row": self.tables[-1].row, "col": col, "row_span": rows, "col_span": cols, "header": tag == "th", "tag": "cell", "depth": len(self.tables)}
            self.open.append(self.put(cell))
        elif tag in BREAKS:
            self.own = None
            if self.open and tag not in ("ul", "ol", "table"):
                self.write(" ")
            if tag == "table":
                self.tables.append(_Table())
            elif tag == "pre":
                self.pre += 1
                if not self.open:
                    self.own = self.put({"kind": "paragraph", "verbatim": True})
            elif tag in ("ul", "ol"):
                start = a.get("start") or "1"
                self.lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])

    def close_cell(self) -> None:
        while self.open and (self.open[-1]["tag"] != "cell" or self.open[-1]["depth"] >= len(self.tables)):
            if self.open[-1]["tag"] == "cell" and self.open[-1]["depth"] < len(self.tables):
                break
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in MARKS:
            if MARKS[tag] in self.marks:
                self.marks.reverse()
                self.marks.remove(MARKS[tag])
                self.marks.reverse()
        elif tag == "code":
            self.code = max(0, self.code - 1)
        elif tag == "a":
            if self.links:
                self.links.pop()
        elif tag == "li":
            self.close_down_to("li")
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "table" and self.tables:
            self.close_cell()
            done = self.tables.pop().blocks
            if self.tables:
                self.waiting.append(done)
            else:
                self.blocks += done + [b for t in self.waiting for b in t]
                self.waiting = []
        elif tag in BREAKS or re.fullmatch("h[1-6]", tag):
            self.own = None
            if tag == "pre":
                self.pre = max(0, self.pre - 1)
            elif tag in ("ul", "ol") and self.lists:
                while self.open and self.open[-1]["tag"] == "li" and self.open[-1]["depth"] >= len(self.lists):
                    self.open.pop()
                self.lists.pop()
            if self.open:
                self.write(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.write(data)


def parse_html(content: str) -> list[Block]:
    """Blocks in the order of their beginnings; tables inside a table follow it.

    ``level`` is that of a heading, or the depth of a list item from 1; ``ordinal`` the number
    of an item of a numbered list; cells have ``row, col, row_span, col_span, header``.
    Empty paragraphs, headings and items give no block, empty cells do.
    """
    parser = _Html()
    parser.feed(content)
    parser.close()
    while parser.tables:
        parser.handle_endtag("table")
    out = []
    for block in parser.blocks:
        text = block.pop("runs").text(block.pop("verbatim", False))
        block.pop("tag", None)
        block.pop("depth", None)
        if text or block["kind"] == "tableCell":
            out.append({**block, "text": text})
    return out
