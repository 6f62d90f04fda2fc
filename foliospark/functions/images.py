"""Comparison of page pictures: structural similarity, tiles, differences, hashes and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the windows, how far they are apart, and the side of a tile.
WINDOW, STRIDE, TILE = 8, 4, 32
# The constants that keep the similarity of even windows defined, for values up to 255.
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
# Least similarity of a match; of a passed and of a doubtful rendering.
MATCH, PASSED, DOUBTFUL = 0.75, 0.98, 0.90


def grey(pixels: np.ndarray) -> np.ndarray:
    """A picture of red, green and blue (and opacity) as brightness from 0 to 255."""
    if pixels.ndim == 2:
        return pixels.astype(np.float64)
    return pixels[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of the windows of two brightness pictures, over what both cover; 1 where that is smaller than a window."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    if h < WINDOW or w < WINDOW:
        return 1.0
    views = [np.lib.stride_tricks.sliding_window_view(x[:h, :w], (WINDOW, WINDOW))[::STRIDE, ::STRIDE] for x in (a, b)]
    ma, mb = (v.mean(axis=(2, 3)) for v in views)
    va, vb = (v.var(axis=(2, 3)) for v in views)
    cov = (views[0] * views[1]).mean(axis=(2, 3)) - ma * mb
    return float((((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma**2 + mb**2 + C1) * (va + vb + C2))).mean())


def tile_ssim(a: np.ndarray, b: np.ndarray, tile: int = TILE) -> float:
    """The least similarity of the tiles of two pictures."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    return min((ssim(a[y : y + tile, x : x + tile], b[y : y + tile, x : x + tile]) for y in range(0, h, tile) for x in range(0, w, tile)), default=1.0)


def difference(a: np.ndarray, b: np.ndarray, least: float = 16.0) -> tuple[np.ndarray, float]:
    """The second picture with red where it differs from the first by more than ``least``, and the share of such places."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    other = np.abs(a[:h, :w] - b[:h, :w]) > least
    out = np.repeat(b[:h, :w, None], 3, axis=2).astype(np.uint8)
    out[other] = (255, 0, 0)
    return out, float(other.mean()) if other.size else 0.0


def picture_hash(a: np.ndarray, side: int = 8) -> int:
    """A hash of ``side`` squared bits: which fields of the picture are brighter than its middle one."""
    rows, cols = (np.linspace(0, n, side + 1).astype(int) for n in a.shape)
    fields = np.array([[a[r0 : max(r0 + 1, r1), c0 : max(c0 + 1, c1)].mean() for c0, c1 in zip(cols, cols[1:])] for r0, r1 in zip(rows, rows[1:])])
    return int("".join("1" if v else "0" for v in (fields > np.median(fields)).ravel()), 2)


def match_verdict(score: Column) -> Column:
    """'Match' or 'Regression', null without a score."""
    return F.when(score >= MATCH, "Match").when(score.isNotNull(), "Regression")


def render_verdict(score: Column, worst_tile: Column, same_size: Column) -> Column:
    """'Pass', 'Warn' or 'Fail' of a rendering by its similarity and that of its worst tile; another size fails."""
    worst = F.least(score, worst_tile)
    return F.when(~same_size | score.isNull(), "Fail").when(worst >= PASSED, "Pass").when(worst >= DOUBTFUL, "Warn").otherwise("Fail")


def compare_pictures(pairs: DataFrame) -> DataFrame:
    """``id, ssim, tile_ssim, differing, hash_distance, same_size, verdict`` of ``id, width_a, height_a, a, width_b, height_b, b``.

    ``a`` and ``b`` are red, green, blue and opacity, row by row; a pair with a picture that
    is missing or of another length has no scores and fails.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                same = (r.width_a, r.height_a) == (r.width_b, r.height_b)
                if r.a is None or r.b is None or len(r.a) != 4 * r.width_a * r.height_a or len(r.b) != 4 * r.width_b * r.height_b:
                    rows.append((r.id, None, None, None, None, bool(same)))
                    continue
                a, b = (grey(np.frombuffer(p, dtype=np.uint8).reshape(h, w, 4)) for p, w, h in ((r.a, r.width_a, r.height_a), (r.b, r.width_b, r.height_b)))
                far = (picture_hash(a) ^ picture_hash(b)).bit_count()
                rows.append((r.id, ssim(a, b), tile_ssim(a, b), difference(a, b)[1], far, bool(same)))
            yield pd.DataFrame(rows, columns=["id", "ssim", "tile_ssim", "differing", "hash_distance", "same_size"]).astype({"hash_distance": "Int32"})

    scored = pairs.mapInPandas(work, "id bigint, ssim double, tile_ssim double, differing double, hash_distance int, same_size boolean")
    return scored.withColumn("verdict", render_verdict(F.col("ssim"), F.col("tile_ssim"), F.col("same_size")))
