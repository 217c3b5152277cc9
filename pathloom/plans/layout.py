"""A second layout for key tables: clustered on interleaved ranks of path and value.

``(path, value)`` order prunes path prefixes strongly and values only inside a prefix.
Interleaving the bits of both ranks prunes each of them to about the square root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 8


def _bucket(column: str, bounds: list) -> Column:
    """Number of bounds that are not above the column."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column))) if bounds else F.lit(0)


def quantiles(keys: DataFrame, column: str, parts: int) -> list:
    """Up to ``parts - 1`` bounds that cut a column evenly, from a bounded sample of 100 rows a part."""
    rows = sorted(r[0] for r in keys.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(*keys.columns)).limit(100 * parts).collect())
    return sorted({rows[len(rows) * i // parts] for i in range(1, parts)}) if rows else []


def interleave(a: Column, b: Column, bits: int = BITS) -> Column:
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, x in ((2 * i + 1, a), (2 * i, b)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(F.lit(1)), k))
    return out


def interleaved(keys: DataFrame, parts: int = 64) -> DataFrame:
    """keys in the order of interleaved bucket numbers, ready to write."""
    z = interleave(_bucket("path", quantiles(keys, "path", parts)), _bucket("value", quantiles(keys, "value", parts)))
    return keys.withColumn("_z", z).repartitionByRange("_z", "path").sortWithinPartitions("_z", "path", "value").drop("_z")
