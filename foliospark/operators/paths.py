"""Paths into nested JSON: ``a.b[2].c``, ``[*]`` for every element."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"([A-Za-z_#][\w#-]*|\*)(?:\[(\d+|\*)\])?$")

# Names of the root of a path.
ROOTS = frozenset(["xfa", "$data", "$record", "$form", "$template", "$"])


def parse(path: str) -> list[tuple[str, int | str | None]]:
    """Segments of a path as ``(name, index)``; the index is a number, '*' or None for the first."""
    out = []
    for i, part in enumerate(path.split(".")):
        if i == 0 and part in ROOTS:
            continue
        m = _SEGMENT.fullmatch(part)
        if not m:
            raise ValueError(f"bad path segment {part!r}")
        index = m.group(2)
        out.append((m.group(1), int(index) if index and index != "*" else index))
    return out


def resolve(df: DataFrame, json: str, path: str, keys: list[str]) -> DataFrame:
    """Keys and ``value``: what the path finds in each JSON text.

    A name without index is its first match, ``[*]`` gives one row per element, and a
    missing segment gives no row rather than an error.
    """
    rows = df.select(*keys, F.try_parse_json(F.col(json)).alias("_v"))
    for name, index in parse(path):
        if name == "*":
            rows = rows.select(*keys, F.explode(F.expr("map_values(try_variant_get(_v, '$', 'map<string,variant>'))")).alias("_v"))
            continue
        rows = rows.select(*keys, F.try_variant_get("_v", f"$.{name}", "variant").alias("_v"))
        if index == "*":
            rows = rows.select(*keys, F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_v"))
        elif index is not None:
            rows = rows.select(*keys, F.try_variant_get("_v", f"$[{index}]", "variant").alias("_v"))
        rows = rows.where("_v is not null")
    return rows.select(*keys, F.try_variant_get("_v", "$", "string").alias("value")).where("value is not null")


def permissions(bits: Column) -> Column:
    """Flags of a permission number by name."""
    # Bit positions of the permissions.
    names = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill": 9, "extract": 10, "assemble": 11, "print_high": 12}
    return F.struct(*[(bits.bitwiseAND(F.lit(1 << (n - 1))) != 0).alias(name) for name, n in names.items()])
