"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a global number 0..N-1 that depends on the rows alone, not on files or partitions: rows are dealt to
buckets by a hash of their key columns, bucket sizes are summed up in bucket order, and rows are numbered within their
bucket. A balanced-modulus Feistel network permutes 0..N-1; numbers that leave the range walk the cycle until they are
back in it. The permuted number p gives ``shard = p mod shards`` and ``slot = p div shards``, so shard sizes differ by
one row at most (the law ``rows``), slots have no gaps, and ``row_number_at`` computes which row stands in a slot.

Defined cases: null keys are values like others. Rows with equal keys, sizes and checksums are interchangeable; they
get consecutive numbers. A null text has no bytes (size 1, checksum 0). Extra columns of the input are not read. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitefold.llm.common import landed, scale_of
from sitefold.operators.joins import lookup_join

SHARDS = 16
SEED = 20_240_517
ROUNDS = 6
#: Buckets for numbering: 4,096 at least, and so many that a bucket holds some 100,000 rows.
LEAST_BUCKETS, BUCKET_ROWS = 4096, 100_000
#: Buckets whose sizes one task adds up, and equal rows that are written out at once.
GROUP_BUCKETS, COPY_BLOCK = 4096, 1 << 16
#: Steps of the cycle walk written out in the plan; see ``permuted``.
WALK = 64


def _sides(n: int) -> tuple[int, int]:
    """Moduli a and b of the two halves, a * b >= n and a * b - n < a."""
    a = 1
    while a * a < n:
        a *= 2
    a = max(2, a)
    return a, max(2, -(-n // a))


def _round(half: str, number: int, seed: int) -> str:
    return f"xxhash64({half}, {seed + number}L)"


def _feistel(x: str, n: int, seed: int, inverse: bool = False) -> str:
    """SQL text of one pass over 0..a*b-1: x = left * b + right, the halves are shifted in turn."""
    a, b = _sides(n)
    state = f"struct({x} div {b}L AS l, {x} % {b}L AS r)"
    steps = list(range(ROUNDS))
    for k in reversed(steps) if inverse else steps:
        sign = "-" if inverse else "+"
        if k % 2 == 0:
            moved = f"struct(pmod(s.l {sign} pmod({_round('s.r', k, seed)}, {a}L), {a}L) AS l, s.r AS r)"
        else:
            moved = f"struct(s.l AS l, pmod(s.r {sign} pmod({_round('s.l', k, seed)}, {b}L), {b}L) AS r)"
        state = f"transform(array({state}), s -> {moved})[0]"
    return f"transform(array({state}), s -> s.l * {b}L + s.r)[0]"


def permuted(x: str, n: int, seed: int = SEED, inverse: bool = False) -> str:
    """SQL text of the permutation of 0..n-1 at ``x``.

    Less than one value in b lies outside the range, so a walk of 64 steps fails with a chance below b ** -64; for
    the n for which that is not negligible, fewer than 64 values lie outside and the walk cannot be longer.
    """
    once = _feistel(x, n, seed, inverse)
    again = _feistel("y", n, seed, inverse)
    walk = f"aggregate(sequence(1, {WALK}), y0, (y, i) -> if(y < {n}L, y, {again}))"
    walked = f"transform(array({walk}), y -> if(y < {n}L, y, cast(raise_error('cycle walk too long') AS bigint)))[0]"
    return f"transform(array({once}), y0 -> if(y0 < {n}L, y0, {walked}))[0]"


def numbered(rows: DataFrame, keys: list[str], copies: str, buckets: int) -> DataFrame:
    """Add ``row_number``: the first global number of each row, which stands for ``copies`` equal rows."""
    keyed = rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {buckets}) AS int)"))
    sizes = keyed.groupBy("bucket").agg(F.sum(copies).alias("in_bucket"))
    # Sums in two levels: of groups of buckets, then within each, so no task orders all buckets.
    grouped = landed(sizes.withColumn("range", F.expr(f"bucket div {GROUP_BUCKETS}")))
    earlier = Window.unboundedPreceding, -1
    ranges = grouped.groupBy("range").agg(F.sum("in_bucket").alias("in_range"))
    range_starts = ranges.select("range", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(*earlier)), F.lit(0)).alias("range_start"))
    before = Window.partitionBy("range").orderBy("bucket").rowsBetween(*earlier)
    starts = grouped.join(range_starts, "range").select(
        "bucket", (F.col("range_start") + F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).alias("bucket_start")
    )
    within = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("in_order", F.coalesce(F.sum(copies).over(within), F.lit(0)))
    return (
        lookup_join(ordered, landed(starts), ["bucket"], "inner", keys)  # a row per bucket: measured, then broadcast or spread
        .withColumn("row_number", F.col("bucket_start") + F.col("in_order"))
        .drop("bucket", "bucket_start", "in_order")
    )


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """Key, size, text_crc32, row_number, shard and slot of every row of ``docs``; native operators only."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    keys = [key, "size", "text_crc32"]
    distinct = landed(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    total, most = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    ordered = numbered(distinct, keys, "copies", scale_of(total, BUCKET_ROWS, LEAST_BUCKETS))
    # Equal rows are written out in blocks, which are dealt to tasks where a group has several: no array holds a whole group.
    blocks = ordered.withColumn("row_end", F.expr("row_number + copies - 1")).select(
        *keys, "row_end", F.expr(f"explode(sequence(row_number, row_end, {COPY_BLOCK}L)) AS block_start")
    )
    if most > COPY_BLOCK:
        blocks = blocks.repartition("block_start")
    each = blocks.select(*keys, F.expr(f"explode(sequence(block_start, least(block_start + {COPY_BLOCK - 1}L, row_end))) AS row_number"))
    placed = each.withColumn("place", F.expr(permuted("row_number", max(1, total), seed)))
    return placed.select(
        *keys,
        "row_number",
        F.expr(f"cast(place % {shards} AS int)").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )


def row_number_at(shard_column: str, slot_column: str, total: int, shards: int = SHARDS, seed: int = SEED):
    """Column: the global row number that stands at a shard and slot."""
    place = f"(cast({slot_column} AS bigint) * {shards} + {shard_column})"
    return F.expr(permuted(place, total, seed, inverse=True))
