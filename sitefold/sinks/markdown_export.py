"""Markdown documents as a dataset or as a tree of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.links import is_inside
from sitefold.functions.sqltext import lit
from sitefold.operators.joins import materialised
from sitefold.storage import store_uri


def write_documents(documents: DataFrame, output: str) -> None:
    """(site, path, content) as Parquet; the form to keep for very many documents."""
    documents.select("site", "path", "content").write.mode("overwrite").parquet(output)


def write_tree(documents: DataFrame, output: str) -> None:
    """One file per document at ``<output>/<site>/<path>``, written by the tasks.

    ``output`` is an absolute path or a URI of one of ``storage.SCHEMES`` on storage that all executors share; another
    scheme fails before the job starts. A document whose path would leave its site's folder fails the job, and so
    does a site that is no plain folder name.

    Files are first written below ``<output>/.staging-...``. Only when all tasks have succeeded do the sites' folders take the
    places of what an earlier run has left there, a site at a time, in tasks dealt by site. A job that fails leaves the
    tree as it was and removes what it has staged. Paths are unique and texts fixed, so a repeated task writes the same files.
    """
    uri = store_uri(output.rstrip("/"))
    staging = f".staging-{uuid.uuid4().hex}"
    whole = F.concat(F.lit("/tree/"), "site", F.lit("/"), "path")
    plain = F.col("site").rlike(r"\A[^/\x00]+\z") & ~F.col("site").isin(".", "..") & ~F.col("site").startswith(".staging-")
    inside = plain & is_inside("__whole", "__folder") & is_inside("__whole", lit("/tree"))
    checked = (
        documents.withColumn("__whole", whole)
        .withColumn("__folder", F.concat(F.lit("/tree/"), "site"))
        .withColumn("path", F.when(inside, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path outside its site: "), "__whole"))))
    )

    def write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        made: set[str] = set()
        for batch in batches:
            for site, path, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                target = f"{root}/{staging}/{site}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as stream:
                    stream.write(content.encode("utf-8"))
            yield batch.select(["site"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for site in batch.column(0).to_pylist():
                source, target = f"{root}/{staging}/{site}", f"{root}/{site}"
                if store.get_file_info(source).type == fs.FileType.NotFound:
                    continue  # a task that is repeated has moved it already
                if store.type_name in ("local", "hdfs"):
                    if store.get_file_info(target).type != fs.FileType.NotFound:
                        store.delete_dir(target)
                    store.move(source, target)
                    continue
                # Object stores have no folders: files are moved one by one, then those of earlier runs go.
                fresh = {f.path[len(source) + 1 :] for f in store.get_file_info(fs.FileSelector(source, recursive=True)) if f.type == fs.FileType.File}
                present = store.get_file_info(fs.FileSelector(target, recursive=True, allow_not_found=True))
                for name in fresh:
                    store.move(f"{source}/{name}", f"{target}/{name}")
                for old in present:
                    if old.type == fs.FileType.File and old.path[len(target) + 1 :] not in fresh:
                        store.delete_file(old.path)
            yield batch

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    try:
        written = checked.select("site", "path", "content").mapInArrow(write_rows, "site string")
        sites = materialised(written.distinct())
        sites.repartition("site").mapInArrow(publish, "site string").write.format("noop").mode("overwrite").save()
    finally:
        if store.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{staging}")
