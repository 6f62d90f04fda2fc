"""Results of recognition models: boxes from maps, boxes that do not overlap, probabilities, and models that are not there."""

from __future__ import annotations

import os

import numpy as np

from .tables import components


class ModelMissing(FileNotFoundError):
    """A model file is not there; models are never fetched."""


def model_path(folder: str, name: str) -> str:
    """The path of a model, or :class:`ModelMissing`."""
    path = os.path.join(folder, name)
    if not os.path.isfile(path):
        raise ModelMissing(path)
    return path


def boxes_from_map(probability: np.ndarray, threshold: float = 0.3, least_score: float = 0.6, least_side: int = 3) -> list[tuple[int, int, int, int, float]]:
    """``x0, y0, x1, y1, score`` of the areas of a text map above ``threshold``, from the top left.

    Areas meet at sides and corners.  Those whose mean is below ``least_score``, or that are
    narrower than ``least_side``, are left out.
    """
    rows, cols = np.nonzero(probability > threshold)
    at = {(r, c): i for i, (r, c) in enumerate(zip(rows.tolist(), cols.tolist()))}
    pairs = [(i, at[n]) for (r, c), i in at.items() for n in ((r, c + 1), (r + 1, c - 1), (r + 1, c), (r + 1, c + 1)) if n in at]
    home = np.array(components(len(at), pairs), dtype=np.int64)
    out = []
    for h in np.unique(home):
        r, c = rows[home == h], cols[home == h]
        score = float(probability[r, c].mean())
        x0, y0, x1, y1 = int(c.min()), int(r.min()), int(c.max()) + 1, int(r.max()) + 1
        if score >= least_score and min(x1 - x0, y1 - y0) >= least_side:
            out.append((x0, y0, x1, y1, score))
    return sorted(out, key=lambda b: (b[1], b[0]))


def without_overlaps(boxes: np.ndarray, scores: np.ndarray, most: float = 0.5) -> list[int]:
    """The boxes that remain when each takes away those of less score that share more than ``most`` of the area of both."""
    order = sorted(range(len(boxes)), key=lambda i: (-scores[i], i))
    kept: list[int] = []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) if len(boxes) else np.empty(0)
    for i in order:
        def share(k: int) -> float:
            w = min(boxes[i][2], boxes[k][2]) - max(boxes[i][0], boxes[k][0])
            h = min(boxes[i][3], boxes[k][3]) - max(boxes[i][1], boxes[k][1])
            both = max(0.0, w) * max(0.0, h)
            return both / (area[i] + area[k] - both) if both else 0.0

        if all(share(k) <= most for k in kept):
            kept.append(i)
    return kept


def fitted(width: int, height: int, side: int) -> tuple[float, int, int]:
    """The factor by which a picture is scaled to fit a square of ``side``, and the edges left and above it."""
    factor = side / max(width, height)
    return factor, (side - round(width * factor)) // 2, (side - round(height * factor)) // 2


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Scores of classes as probabilities, along the last axis."""
    shifted = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)
