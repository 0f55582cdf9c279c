"""How captured responses lie in storage.

Captures are read by endpoint (or method) and reduced by site. A table partitioned by the one and bucketed by the other lets
a scan of one endpoint read nothing else, and lets a listing's end be found without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The column that captures of each kind are partitioned by, and the one that orders the calls of a site.
LAYOUT = {"endpoint": "page", "method": "offset", "content_type": "id"}
BUCKETS = 512


def write_captures(captures: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Write listing pages, lookups or XML-RPC calls as a table partitioned by kind and bucketed by site.

    ``path`` puts the files elsewhere than in the warehouse. A bucket is one file per partition, written by one task and
    sorted by site and call; choose ``buckets`` so that one holds some hundred megabytes of a kind's bodies. With ``append``
    a later capture is added under the same layout.
    """
    kind = next((c for c in LAYOUT if c in captures.columns), None)
    if kind is None or "site" not in captures.columns:
        raise ValueError(f"captures need the column site and one of {', '.join(LAYOUT)}")
    # Dealt as the buckets are, so each is written by one task.
    dealt = captures.repartition(buckets, "site")
    writer = dealt.write.mode(mode).partitionBy(kind).bucketBy(buckets, "site").sortBy("site", LAYOUT[kind])
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(table)


def read_captures(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
