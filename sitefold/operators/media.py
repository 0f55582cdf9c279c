"""Media names, size variants and the manifest of local copies."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.links import is_valid_url
from sitefold.functions.names import media_file_name, size_file_name

DEFAULT_RETRIES = 3
# Fixed value: folder that rewritten links point into.
LINK_FOLDER = "media"


def media_dir(output: str, output_format: str) -> str:
    """Folder of local copies: beside a ``.json`` file, else inside the output folder. It is absolute or a URI."""
    if "://" not in output:
        output = os.path.abspath(output)
    if output_format == "json" and output.endswith(".json"):
        return output.removesuffix(".json") + "_media"
    return output.rstrip("/") + "/media"


def attempt_outcomes(attempts: DataFrame, retries: int = DEFAULT_RETRIES) -> DataFrame:
    """(site, media_id, attempts, downloaded): did one of the first ``retries + 1`` attempts succeed.

    Attempts of one item are reduced before the shuffle, however many there are.
    """
    return (
        attempts.filter(F.col("attempt") <= retries + 1)
        .groupBy("site", "media_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.bool_or(F.col("status") == 200).alias("downloaded"),
        )
    )


def media_urls(media: DataFrame) -> DataFrame:
    """One row per URL a media item answers to: its own and those of its sizes.

    Items without a usable URL contribute nothing. (site, ord, media_id,
    size_name, url, file); ``size_name`` is NULL for the item itself.
    """
    own = F.array(F.struct(F.lit(None).cast("string").alias("size_name"), F.col("source_url").alias("url")))
    sizes = F.transform(
        F.map_entries(F.coalesce("media_details.sizes", F.create_map().cast(_sizes_type(media)))),
        lambda entry: F.struct(entry["key"].alias("size_name"), entry["value"]["source_url"].alias("url")),
    )
    rows = (
        media.filter("source_url != ''")
        .filter(is_valid_url("source_url"))
        .select("site", "ord", F.col("id").alias("media_id"), "source_url", "mime_type", F.explode(F.concat(own, sizes)).alias("variant"))
        .select("site", "ord", "media_id", "source_url", "mime_type", "variant.size_name", "variant.url")
        .filter("url != ''")
    )
    name = F.when(
        F.col("size_name").isNull(), media_file_name("media_id", "url", "mime_type")
    ).otherwise(size_file_name("media_id", "url", "source_url", "mime_type"))
    return rows.select("site", "ord", "media_id", "size_name", "url", name.alias("file"))


def _sizes_type(media: DataFrame):
    return media.select("media_details.sizes").schema[0].dataType


def media_variants(media: DataFrame) -> DataFrame:
    """Size variants only, with the path their links are rewritten to."""
    return media_urls(media).filter("size_name IS NOT NULL").withColumn("local_path", link_path(F.col("file")))


def link_path(file: Column) -> Column:
    return F.concat(F.lit(LINK_FOLDER + "/"), file)


def media_manifest(
    media: DataFrame,
    existing_files: DataFrame,
    attempts: DataFrame,
    folder: str,
    retries: int = DEFAULT_RETRIES,
    enabled: bool = True,
) -> DataFrame:
    """Local file, path and outcome of every media item; no bytes are fetched.

    An item without a usable URL fails, one whose file is already there counts
    as downloaded, any other depends on its attempts. ``resolved`` tells whether
    the link written into content leads to a file.
    """
    if not enabled:
        media = media.filter(F.lit(False))
    usable = (F.col("source_url") != "") & is_valid_url("source_url")
    named = media.select(
        "site",
        "ord",
        F.col("id").alias("media_id"),
        "source_url",
        F.when(usable, media_file_name("id", "source_url", "mime_type")).alias("file"),
    )
    present = existing_files.select("site", "file").distinct().withColumn("present", F.lit(True))
    outcomes = attempt_outcomes(attempts, retries).select("site", "media_id", F.col("downloaded").alias("fetched"))
    # Rows without a file carry a key of their own instead of meeting at NULL.
    keyed = named.withColumn("file_key", F.coalesce("file", F.concat(F.lit("\u0000"), F.col("ord").cast("string"))))
    joined = keyed.join(present.withColumnRenamed("file", "file_key"), ["site", "file_key"], "left").join(
        outcomes, ["site", "media_id"], "left"
    )
    status = (
        F.when(F.col("source_url") == "", "no_url")
        .when(F.col("file").isNull(), "bad_url")
        .when(F.col("present"), "present")
        .when(F.col("fetched"), "downloaded")
        .otherwise("failed")
    )
    downloaded = F.col("status").isin("present", "downloaded")
    in_link_folder = folder.rstrip("/").rsplit("/", 1)[-1] == LINK_FOLDER
    return joined.withColumn("status", status).select(
        "site",
        "ord",
        "media_id",
        "source_url",
        "file",
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")).alias("local_path"),
        "status",
        downloaded.alias("downloaded"),
        (downloaded & F.lit(in_link_folder)).alias("resolved"),
    )


def downloaded_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("site").agg(F.sum(F.col("downloaded").cast("long")).alias("media_downloaded"))
