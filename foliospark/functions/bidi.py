"""Order of signs in lines that run in both directions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Classes of signs that run from right to left, of numbers, and of what goes between numbers.
RIGHT, NUMBER, BETWEEN = frozenset(["R", "AL"]), frozenset(["EN", "AN"]), frozenset(["ES", "ET", "CS"])


def levels(line: str) -> list[int]:
    """The embedding level of each sign: 0 from left to right, 1 from right to left, 2 for numbers in text from right to left.

    Signs without a direction take that of the text on both sides, else that of the line.
    """
    kinds = [unicodedata.bidirectional(c) for c in line]
    first = next((k for k in kinds if k == "L" or k in RIGHT), "L")
    base = 0 if first == "L" else 1
    out: list[int | None] = []
    strong = base
    for i, k in enumerate(kinds):
        if k == "L":
            strong = 0
            out.append(2 if base else 0)
        elif k in RIGHT:
            strong = 1
            out.append(1)
        elif k in NUMBER or (k in BETWEEN and 0 < i < len(kinds) - 1 and kinds[i - 1] in NUMBER and kinds[i + 1] in NUMBER):
            out.append(2 if base or strong else 0)
        else:
            out.append(None)
    at = 0
    while at < len(out):
        if out[at] is not None:
            at += 1
            continue
        end = at
        while end < len(out) and out[end] is None:
            end += 1
        before = out[at - 1] if at else base
        after = out[end] if end < len(out) else base
        both_right = before in (1, 2 if not base else 1) and after in (1, 2 if not base else 1)
        both_left = before == after == 2 and base == 1
        level = 1 if both_right else 2 if both_left else base
        out[at:end] = [level] * (end - at)
        at = end
    return [x or 0 for x in out]


def logical(line: str) -> str:
    """A line in the order it is read, given in the order it is shown: runs are turned from the highest level down."""
    if line.isascii() or not any(unicodedata.bidirectional(c) in RIGHT for c in line):
        return line
    level, signs = levels(line), list(line)
    for least in range(max(level), 0, -1):
        at = 0
        while at < len(signs):
            end = at
            while end < len(signs) and level[end] >= least:
                end += 1
            if end > at:
                signs[at:end], level[at:end] = signs[at:end][::-1], level[at:end][::-1]
            at = end + 1 if end == at else end
    return "".join(signs)


@F.pandas_udf(StringType())
def logical_order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`logical` of each line; null stays null."""
    for batch in batches:
        yield batch.map(logical, na_action="ignore")
