"""Counts per site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.operators.discovery import is_discovered
from sitefold.schemas import STAT_COLUMNS


def export_stats(
    sites: DataFrame,
    posts: DataFrame,
    media: DataFrame,
    categories: DataFrame,
    tags: DataFrame,
    users: DataFrame,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """The eight counters of every site.

    Each table is read once and reduced to one row per site before the shuffle;
    the union of those rows is summed, so no join and no wide row is involved.
    """
    page = F.col("content_type") == "page"
    found = F.count_if(is_discovered())
    every = F.count(F.lit(1))

    def counted(rows: DataFrame, **counters: Column) -> DataFrame:
        per_site = rows.groupBy("site").agg(*[c.alias(name) for name, c in counters.items()])
        missing = [F.lit(0).cast("bigint").alias(name) for name in STAT_COLUMNS if name not in counters]
        return per_site.select("site", *counters, *missing)

    parts = [
        counted(sites, total_posts=F.lit(0).cast("bigint")),
        counted(posts, total_posts=F.count_if(~page), total_pages=F.count_if(page), brute_force_found=found),
        counted(media, total_media=every, brute_force_found=found),
        counted(categories, total_categories=every),
        counted(tags, total_tags=every),
        counted(users, total_users=every),
    ]
    if manifest is not None:
        parts.append(counted(manifest, media_downloaded=F.count_if("downloaded")))
    return (
        reduce(DataFrame.unionByName, parts).groupBy("site").agg(*[F.sum(name).alias(name) for name in STAT_COLUMNS])
    )
