"""Tables from geometry: aligned rows of chunks, ruled lattices, cells from pair relations, spans, repeated positions.

A page holds a bounded number of boxes, so a page is worked on in one piece; pages are
independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Points within which two edges are the same, and line heights between two rows of a table at most.
EDGE, ROW_GAP = 3.0, 2.5
#: Rows of a table at least, and at least if it is WIDE columns wide.
MIN_ROWS, MIN_WIDE_ROWS, WIDE = 3, 2, 3
#: White space between two columns, and between two row groups, from which a proposal is split.
COLUMN_WHITE, ROW_WHITE, ROW_FACTOR = 8.0, 6.0, 2.0
#: Points within which rules meet.
RULE = 2.0


def rows_of(boxes: np.ndarray) -> list[list[int]]:
    """Boxes gathered to rows from the top: those that overlap the row's height by more than half of the lower one."""
    out: list[list[int]] = []
    low = high = 0.0
    for i in sorted(range(len(boxes)), key=lambda k: (-boxes[k][3], boxes[k][0])):
        y0, y1 = boxes[i][1], boxes[i][3]
        if out and min(high, y1) - max(low, y0) > min(high - low, y1 - y0) / 2:
            out[-1].append(i)
            low, high = min(low, y0), max(high, y1)
        else:
            out.append([i])
            low, high = y0, y1
    return [sorted(r, key=lambda k: boxes[k][0]) for r in out]


def _fits(row: list[int], columns: list[tuple[float, float]], boxes: np.ndarray) -> int | None:
    """How many chunks stand at an edge of a column; None if a chunk crosses the white between two columns."""
    hits = 0
    for k in row:
        x0, x1 = boxes[k][0], boxes[k][2]
        under = [c for c in columns if min(c[1], x1) - max(c[0], x0) > EDGE]
        if len(under) > 1:
            return None
        hits += any(abs(c[0] - x0) <= EDGE or abs(c[1] - x1) <= EDGE for c in columns)
    return hits


def aligned(boxes: np.ndarray) -> list[list[list[int]]]:
    """Proposed tables as rows of chunk numbers: consecutive rows of several chunks whose edges stand below each other."""
    found: list[list[list[int]]] = []
    run: list[list[int]] = []
    columns: list[tuple[float, float]] = []

    def close() -> None:
        wide = max((len(r) for r in run), default=0)
        while run and len(run[-1]) < 2:
            run.pop()
        if len(run) >= (MIN_WIDE_ROWS if wide >= WIDE else MIN_ROWS):
            found.append(list(run))
        run.clear()
        columns.clear()

    before = None
    for row in rows_of(boxes):
        top, low = max(boxes[k][3] for k in row), min(boxes[k][1] for k in row)
        far = before is not None and before - top > ROW_GAP * (top - low)
        hits = None if far or not run else _fits(row, columns, boxes)
        if run and (hits is None or hits < min(2, len(row))):
            close()
        if run or len(row) >= 2:
            run.append(row)
            for k in row:
                x0, x1 = boxes[k][0], boxes[k][2]
                for i, c in enumerate(columns):
                    if min(c[1], x1) - max(c[0], x0) > 0:
                        columns[i] = (min(c[0], x0), max(c[1], x1))
                        break
                else:
                    columns.append((x0, x1))
        before = low
    close()
    return found


def split_at_white(boxes: np.ndarray) -> list[list[int]]:
    """The parts of a proposal: at the widest white column, the most central of equals, else at the widest gap between rows, else all of it."""
    order = np.argsort(boxes[:, 0], kind="stable")
    middle = (boxes[:, 0].min() + boxes[:, 2].max()) / 2
    reach, best = boxes[order[0]][2], None
    for k in order[1:]:
        white = boxes[k][0] - reach
        if white >= COLUMN_WHITE:
            best = max(best or (-1.0, 0.0, 0.0), (round(white, 3), -abs((boxes[k][0] + reach) / 2 - middle), boxes[k][0]))
        reach = max(reach, boxes[k][2])
    if best:
        return [[i for i in range(len(boxes)) if (boxes[i][0] < best[2]) == left] for left in (True, False)]
    rows = rows_of(boxes)
    gaps = [min(boxes[k][1] for k in a) - max(boxes[k][3] for k in b) for a, b in zip(rows, rows[1:])]
    if gaps and max(gaps) > ROW_FACTOR * float(np.median(gaps)) and max(gaps) >= ROW_WHITE:
        at = int(np.argmax(gaps)) + 1
        return [sorted(k for r in part for k in r) for part in (rows[:at], rows[at:])]
    return [list(range(len(boxes)))]


def components(n: int, pairs: Sequence[tuple[int, int]]) -> list[int]:
    """The smallest member of the component of each of ``n`` things."""
    home = list(range(n))

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _snapped(values: Sequence[float]) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > RULE:
            out.append(v)
    return out


def lattice(rules: np.ndarray) -> list[tuple[int, int, int, int, tuple[float, float, float, float]]]:
    """Cells that ruled lines ``x0, y0, x1, y1`` enclose: first and last row, first and last column, box; rows count from the top.

    Where a rule between two fields is missing they are one cell; what is no rectangle is left out.
    """
    level = [r for r in rules if abs(r[3] - r[1]) <= RULE]
    upright = [r for r in rules if abs(r[2] - r[0]) <= RULE]
    xs, ys = _snapped([r[0] for r in upright]), _snapped([r[1] for r in level])[::-1]
    if len(xs) < 2 or len(ys) < 2:
        return []
    cols, rows = len(xs) - 1, len(ys) - 1
    ruled_x = lambda x, low, high: any(abs(r[0] - x) <= RULE and min(r[1], r[3]) <= low + RULE and max(r[1], r[3]) >= high - RULE for r in upright)
    ruled_y = lambda y, a, b: any(abs(r[1] - y) <= RULE and min(r[0], r[2]) <= a + RULE and max(r[0], r[2]) >= b - RULE for r in level)
    pairs = [(r * cols + c, r * cols + c + 1) for r in range(rows) for c in range(cols - 1) if not ruled_x(xs[c + 1], ys[r + 1], ys[r])]
    pairs += [(r * cols + c, (r + 1) * cols + c) for r in range(rows - 1) for c in range(cols) if not ruled_y(ys[r + 1], xs[c], xs[c + 1])]
    groups: dict[int, list[int]] = {}
    for field, home in enumerate(components(rows * cols, pairs)):
        groups.setdefault(home, []).append(field)
    out = []
    for fields in groups.values():
        rs, cs = [f // cols for f in fields], [f % cols for f in fields]
        r0, r1, c0, c1 = min(rs), max(rs), min(cs), max(cs)
        if len(fields) == (r1 - r0 + 1) * (c1 - c0 + 1):
            out.append((r0, r1, c0, c1, (xs[c0], ys[r1 + 1], xs[c1 + 1], ys[r0])))
    return sorted(out)


def grid_from_pairs(boxes: np.ndarray, same_cell: Sequence[tuple[int, int]], same_row: Sequence[tuple[int, int]], same_col: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``cell, row, col`` of each word from the words that share a cell, a row or a column.

    Cells are components; rows are numbered from the top and columns from the left by the
    middle of their words.
    """
    n = len(boxes)
    cell = components(n, same_cell)
    middle = lambda members, axis: float(np.mean([(boxes[i][axis] + boxes[i][axis + 2]) / 2 for i in members]))

    def numbered(pairs: Sequence[tuple[int, int]], axis: int, sign: int) -> dict[int, int]:
        home = components(n, [*same_cell, *pairs])
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(home):
            groups.setdefault(h, []).append(i)
        order = sorted(groups, key=lambda h: (sign * middle(groups[h], axis), h))
        place = {h: k for k, h in enumerate(order)}
        return {i: place[h] for i, h in enumerate(home)}

    row, col = numbered(same_row, 1, -1), numbered(same_col, 0, 1)
    return [(cell[i], row[i], col[i]) for i in range(n)]


def widened(grid: list[list[str]], reach: Callable[[int, int], int]) -> list[tuple[int, int, int, str]]:
    """``row, col, span, text``: filled cells, each over the empty ones to its right as far as ``reach`` says its text goes."""
    out = []
    for r, cells in enumerate(grid):
        for c, text in enumerate(cells):
            if text:
                span = 1
                while c + span < len(cells) and not cells[c + span] and c + span <= reach(r, c):
                    span += 1
                out.append((r, c, span, text))
    return out


def largest_cluster(positions: np.ndarray, tolerance: float, seeds: int = 64) -> np.ndarray:
    """The members of the largest group of positions within ``tolerance`` of one of them, of several the first.

    Seeds are spread evenly over the sorted positions, all of them if there are no more than ``seeds``.
    """
    if len(positions) == 0:
        return np.empty(0, dtype=np.int64)
    order = np.argsort(positions, kind="stable")
    sorted_ = positions[order]
    picks = np.unique(np.linspace(0, len(order) - 1, min(seeds, len(order))).astype(int))
    low, high = np.searchsorted(sorted_, sorted_[picks] - tolerance, "left"), np.searchsorted(sorted_, sorted_[picks] + tolerance, "right")
    best = int(np.argmax(high - low))
    return np.sort(order[low[best] : high[best]])


def aligned_tables(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, id, table, row, col``: chunks ``id, x0, y0, x1, y1`` of each page that stand in an aligned table."""

    def work(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id", ignore_index=True)
        boxes = page[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float)
        rows = [(page["id"][k], t, r, c) for t, found in enumerate(aligned(boxes)) for r, row in enumerate(found) for c, k in enumerate(row)]
        out = pd.DataFrame(rows, columns=["id", "table", "row", "col"])
        for k in reversed(keys):
            out.insert(0, k, page[k].iloc[0])
        return out

    some = chunks.select(*keys, "id", "x0", "y0", "x1", "y1").dropna()
    schema = ", ".join(f"{n} {t}" for n, t in some.select(*keys, "id").dtypes) + ", table int, row int, col int"
    return some.groupBy(*keys).applyInPandas(work, schema)


def ruled_tables(rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, last_row, col, last_col, x0, y0, x1, y1``: cells that the rules of each page enclose."""

    def work(page: pd.DataFrame) -> pd.DataFrame:
        rows = [(r0, r1, c0, c1, *box) for r0, r1, c0, c1, box in lattice(page[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float))]
        out = pd.DataFrame(rows, columns=["row", "last_row", "col", "last_col", "x0", "y0", "x1", "y1"])
        for k in reversed(keys):
            out.insert(0, k, page[k].iloc[0])
        return out

    some = rules.select(*keys, "x0", "y0", "x1", "y1").dropna()
    schema = ", ".join(f"{n} {t}" for n, t in some.select(*keys).dtypes) + ", row int, last_row int, col int, last_col int, x0 double, y0 double, x1 double, y1 double"
    return some.groupBy(*keys).applyInPandas(work, schema)
