"""Discovery of unlisted records as lookups arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitefold.operators.discovery import DEFAULT_MAX_ID
from sitefold.schemas import API_ITEMS, CONTENT_TYPES
from sitefold.session import landed, shared_dir
from sitefold.sources.rest import found_items

_KEY = ["site", "content_type", "id"]
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_lookups(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(API_ITEMS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(landing)


def discovered_stream(lookups: DataFrame, known: DataFrame, max_id: int = DEFAULT_MAX_ID) -> DataFrame:
    """Found lookups that no listing holds.

    The known ids are made distinct and landed once, as a static side that micro-batches read by column.
    ``start_discovery`` writes each (site, content_type, id) once.
    """
    in_range = lookups.filter(F.col("id").between(1, max_id) & F.col("content_type").isin(*CONTENT_TYPES))
    return found_items(in_range).join(landed(known.select(*_KEY).distinct()), _KEY, "left_anti")


def start_discovery(found: DataFrame, output: str, name: str, **trigger) -> StreamingQuery:
    """Append discovered lookups to Parquet; progress is the query's own progress report.

    What was written before is remembered by key in the stream's own state, kept by the RocksDB store on local disks and as
    change logs beside the checkpoint: a micro-batch looks up its own keys and reads nothing of the output, however long
    the stream has run. Each micro-batch goes to a folder of its own, so one that is repeated after a failure replaces it.
    An output belongs to one stream name.
    """
    spark = found.sparkSession
    folder = shared_dir(spark).rstrip("/")
    # An empty first batch, so that the output can be read before anything is found.
    spark.createDataFrame([], found.schema).write.mode("overwrite").parquet(f"{output}/batch_id=-1")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    # A stream takes the settings it starts with; the session keeps its own.
    given = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        return _started(found, write_batch, f"{folder}/streams/{name}", trigger)
    finally:
        for key, value in given.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _started(found: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        found.dropDuplicates(_KEY).writeStream.outputMode("append")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
