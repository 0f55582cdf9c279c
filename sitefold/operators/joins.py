"""Joins of a large side with a lookup table that is unique per key.

The lookup side is materialised and measured first. Within the bound it is
broadcast, so the large side is not shuffled at all; beyond it, both sides are
shuffled once, and what is uneven is split at run time by adaptive execution.
Where that is switched off, the large side is spread so that no key gathers in
one task, at the price of a lookup side repeated for every slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.session import cut_lineage

SLICES = 16
BROADCAST_BYTES = 32 << 20
_SLICE = "__slice"
# Settings by which adaptive execution splits the left side of any join named below, by map output.
SPLITTING = (
    "spark.sql.adaptive.enabled",
    "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.adaptive.forceOptimizeSkewedJoin",
)
_HOW = ("inner", "left", "left_semi", "left_anti")


def measured_bytes(table: DataFrame) -> int:
    """Size of a materialised table, written out as text."""
    row_bytes = F.octet_length(F.to_json(F.struct("*"))) + 64
    return table.agg(F.sum(row_bytes)).first()[0] or 0


def fits_broadcast(table: DataFrame, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table, written out as text, stays within the bound."""
    return measured_bytes(table) <= bound


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: list[str], slices: int = SLICES
) -> DataFrame:
    """Shuffle join in which the left rows of one key go to ``slices`` join keys.

    The slice is a hash of ``spread_by``; the right side is repeated once per
    slice. What is still uneven is split at run time by adaptive execution.
    """
    if how not in _HOW:
        raise ValueError(f"unsupported join type: {how}")
    sliced = left.withColumn(_SLICE, F.pmod(F.xxhash64(*spread_by), F.lit(slices)).cast("int"))
    repeated = right.withColumn(_SLICE, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return sliced.join(repeated, [*keys, _SLICE], how).drop(_SLICE)


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: list[str], bound: int = BROADCAST_BYTES
) -> DataFrame:
    """Join to a materialised lookup table, by broadcast if it fits and by shuffle otherwise.

    The lookup side holds a key once and the left side streams past it, so a hot key takes no memory; its partition is split.
    While a partition's share of the lookup side is within the bound it is hashed, so that the left side isn't sorted.
    """
    if how not in _HOW:
        raise ValueError(f"unsupported join type: {how}")
    size, conf = measured_bytes(right), left.sparkSession.conf
    if size <= bound:
        return left.join(F.broadcast(right), keys, how)
    if all(conf.get(name) == "true" for name in SPLITTING):
        hashed = size <= bound * int(conf.get("spark.sql.shuffle.partitions"))
        return left.join(right.hint("shuffle_hash") if hashed else right, keys, how)
    return spread_join(left, right, keys, how, spread_by)


def materialised(table: DataFrame) -> DataFrame:
    """The table on shared storage, so that measuring and joining it do not compute it twice."""
    return cut_lineage(table)
