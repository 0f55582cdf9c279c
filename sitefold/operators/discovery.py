"""Records the listings left out, found by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.schemas import CONTENT_TYPES, FOUND_BASE, found_ord
from sitefold.sources.rest import decode_items, found_items

# Ids generated per row of the first expansion step, so that a range of any
# length is produced by many tasks and never as one array.
ID_BLOCK = 1 << 16
DEFAULT_MAX_ID = 10_000


def _check_type(content_type: str) -> None:
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"unsupported content type: {content_type}")


def known_ids(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Distinct (site, content_type, id) of listed posts, pages and media."""
    endpoint = F.when(F.col("content_type") == "page", "pages").otherwise("posts")
    return (
        posts.select("site", endpoint.alias("content_type"), "id")
        .unionByName(media.select("site", F.lit("media").alias("content_type"), "id"))
        .distinct()
    )


def candidate_ids(ranges: DataFrame) -> DataFrame:
    """All ids of ``ranges(site, content_type, first_id, last_id)``; an inverted range has none."""
    blocks = (
        ranges.filter("first_id <= last_id")
        .select(
            "site",
            "content_type",
            "last_id",
            F.explode(F.sequence("first_id", "last_id", F.lit(ID_BLOCK).cast("long"))).alias("block_start"),
        )
        .repartition("site", "content_type", "block_start")
    )
    block_end = F.least(F.col("block_start") + (ID_BLOCK - 1), F.col("last_id"))
    return blocks.select("site", "content_type", F.explode(F.sequence("block_start", block_end)).alias("id"))


def gap_ids(ranges: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of the ranges that no listing holds.

    Known ids are made distinct first, which collapses repeated ids before the
    shuffle and leaves them partitioned for the anti-join.
    """
    distinct = known.select("site", "content_type", "id").distinct()
    return candidate_ids(ranges).join(distinct, ["site", "content_type", "id"], "left_anti")


def discovered_items(
    api_items: DataFrame, known: DataFrame, max_id: int = DEFAULT_MAX_ID, enabled: bool = True
) -> DataFrame:
    """Lookups of ids 1 to ``max_id`` that are not listed and answered with a record.

    The range is a filter on the lookups, so no candidate table is built; status
    and id filters reach the Parquet scan.
    """
    in_range = found_items(api_items.filter(F.col("id").between(1, max_id))).filter(
        F.col("content_type").isin(*CONTENT_TYPES)
    )
    if not enabled:
        in_range = in_range.filter(F.lit(False))
    distinct = known.select("site", "content_type", "id").distinct()
    return in_range.join(distinct, ["site", "content_type", "id"], "left_anti")


def items_in_range(api_items: DataFrame, content_type: str, first_id: int, last_id: int) -> DataFrame:
    """Typed records of one content type that answered within a range of ids, listed or not."""
    _check_type(content_type)
    return decode_items(api_items.filter(F.col("id").between(first_id, last_id)), content_type)


def discovery_counts(items: DataFrame) -> DataFrame:
    """Discovered items per site and content type."""
    return items.groupBy("site", "content_type").agg(F.count(F.lit(1)).alias("found"))


def discovered_records(items: DataFrame, content_type: str) -> DataFrame:
    """Discovered lookups of one content type as records, ordered after every listed one."""
    _check_type(content_type)
    decoded = decode_items(items, content_type)
    records = decoded.withColumn("ord", found_ord(F.col("looked_up"))).drop("looked_up")
    if content_type == "media":
        return records
    return records.withColumn("content_type", F.lit("page" if content_type == "pages" else "post"))


def merge_discovered(listed: DataFrame, discovered: DataFrame) -> DataFrame:
    """Listed records followed by discovered ones; duplicates stay."""
    return listed.unionByName(discovered)


def is_discovered(ord_column: str = "ord"):
    return F.col(ord_column) >= FOUND_BASE
