"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.session import cut_lineage

#: Rows per Arrow batch: whole texts are long, so batches are kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(df: DataFrame) -> DataFrame:
    """Hand texts to Python in short batches; the setting is read when a plan runs, so it stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def landed(df: DataFrame) -> DataFrame:
    """The table written to shared storage: computed once, safe from lost executors."""
    return cut_lineage(df)


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of a key that is unique, ties by the key.

    A plain top-k hands on k rows per task, so rows far above the wanted quantile are left out before it: what is
    ordered is about twice what is wanted, however many tasks there are.
    """
    rank = F.xxhash64(F.col(key))
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(rank < F.lit(-(1 << 63) + (1 << 64) * 2 * most // n))
    return rows.orderBy(rank, key).limit(most)


def scale_of(amount: int | None, per_part: int, least: int = 1) -> int:
    """How many parts keep each part near ``per_part``."""
    return max(least, -(-int(amount or 0) // per_part))
