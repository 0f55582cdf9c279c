"""Files that an earlier export has left, as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.schemas import EXISTING_FILES
from sitefold.storage import store_uri


def existing_files(spark: SparkSession, folder: str, site: str | None = None) -> DataFrame:
    """(site, file, bytes) of the files below a media folder, however deep; only names and lengths are read.

    The folder holds one folder per site (``<folder>/<site>/<file>``), or with ``site`` the files of that one. Files beside
    the sites' folders don't count; empty files do. A folder that doesn't exist holds none. Sites are listed by tasks,
    each by one; nothing is gathered on the driver.
    """
    uri = store_uri(folder.rstrip("/"))

    def list_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for _ in batches:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            yield pa.RecordBatch.from_pydict({"site": pa.array([f.base_name for f in found if f.type == fs.FileType.Directory], pa.string())})

    def list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                below = root if site is not None else f"{root}/{name}"
                found = store.get_file_info(fs.FileSelector(below, recursive=True, allow_not_found=True))
                files = [f for f in found if f.type == fs.FileType.File]
                columns = [pa.array([name] * len(files), pa.string()), pa.array([f.base_name for f in files], pa.string()), pa.array([f.size for f in files], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["site", "file", "bytes"])

    one = spark.range(1, numPartitions=1)
    sites = one.select(F.lit(site).alias("site")) if site is not None else one.mapInArrow(list_sites, "site string").repartition("site")
    return sites.mapInArrow(list_files, f"{EXISTING_FILES}, bytes BIGINT")
