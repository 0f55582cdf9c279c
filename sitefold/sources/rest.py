"""Listings and single lookups captured from the JSON API.

``api_pages`` holds one row per requested listing page, ``api_items`` one per
lookup by id. A (site, endpoint, page) or (site, content_type, id) is captured once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.functions.sqltext import lit
from sitefold.operators.joins import BROADCAST_BYTES, fits_broadcast, materialised
from sitefold.schemas import (
    CONTENT_TYPES,
    ENDPOINT_ROWS,
    MEDIA,
    POST,
    listed_ord,
    struct_type,
    zero_filled_fields,
)

# Pages of one listing that share a join key. Whatever share of the rows one
# site holds, no key ever gathers more than this many bodies.
PAGE_BLOCK = 64


def is_json_null(body: Column) -> Column:
    return body.rlike(r"\A\s*null\s*\z")


def is_json_object(body: Column) -> Column:
    """Whether a body decodes into a record; ``null`` does, into an empty one."""
    closed = F.json_object_keys(body).isNotNull() & body.rlike(r"\}\s*\z")
    return is_json_null(body) | closed


def _row_count(body: Column) -> Column:
    """Records in a JSON array body, 0 for ``null``; NULL where it is no array of objects and nulls.

    The decoder decides, in one pass: one element of another kind makes the whole array undecodable. It would take a lone
    record for an array, so the brackets are looked at as well.
    """
    array = body.rlike(r"\A\s*\[") & body.rlike(r"\]\s*\z")
    return F.when(is_json_null(body), F.lit(0)).when(array, F.size(F.from_json(body, "ARRAY<STRUCT<id: STRING>>")))


def page_outcome(status: Column, count: Column) -> Column:
    """``stop`` ends a listing, ``error`` fails it, ``rows`` continues it.

    ``count`` is the number of records of an answered page, NULL if unreadable.
    """
    return (
        F.when((status == 400) | ((status == 200) & (count == 0)), "stop")
        .when((status == 200) & (count > 0), "rows")
        .otherwise("error")
    )


def page_cuts(api_pages: DataFrame) -> DataFrame:
    """Where each listing ends: (site, endpoint, stop_page, error_page, end_page, failed).

    Pages count up from the first. A listing ends before its first ``stop``; an
    ``error`` before that fails the listing as a whole. Only two small integers
    per listing are aggregated, partially before the shuffle; bodies stay put.
    """
    outcome = F.col("outcome")
    count = F.when(F.col("status") == 200, _row_count(F.coalesce("body", F.lit(""))))
    return (
        api_pages.select("site", "endpoint", "page", "status", count.alias("count"))
        .select("site", "endpoint", "page", page_outcome(F.col("status"), F.col("count")).alias("outcome"))
        .groupBy("site", "endpoint")
        .agg(
            F.min(F.when(outcome == "stop", F.col("page"))).alias("stop_page"),
            F.min(F.when(outcome == "error", F.col("page"))).alias("error_page"),
            F.max("page").alias("last_page"),
        )
        .select(
            "site",
            "endpoint",
            "stop_page",
            "error_page",
            F.coalesce("stop_page", F.col("last_page") + 1).alias("end_page"),
            (
                F.col("error_page").isNotNull()
                & (F.col("stop_page").isNull() | (F.col("error_page") < F.col("stop_page")))
            ).alias("failed"),
        )
    )


def failed_listings(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    cuts = page_cuts(api_pages) if cuts is None else cuts
    return cuts.filter("failed").select("site", "endpoint", "error_page")


def surviving_pages(
    api_pages: DataFrame, cuts: DataFrame | None = None, bound: int = BROADCAST_BYTES
) -> DataFrame:
    """Listing pages before the end of listings that did not fail.

    The cuts are materialised and measured. Within ``bound`` bytes they are
    broadcast, so bodies are not shuffled. Beyond that, a cut is spread over
    blocks of pages and the join key is (site, endpoint, block): whatever share
    of the rows one site holds, no key gathers more than a block.
    """
    cuts = materialised(page_cuts(api_pages)) if cuts is None else cuts
    ends = cuts.filter("NOT failed AND end_page > 0").select("site", "endpoint", "end_page")
    answered = api_pages.filter("status = 200")
    if fits_broadcast(ends, bound):
        joined = answered.join(F.broadcast(ends), ["site", "endpoint"])
    else:
        last_block = F.floor((F.col("end_page") - 1) / PAGE_BLOCK).cast("int")
        blocks = ends.withColumn("page_block", F.explode(F.sequence(F.lit(0), last_block)))
        joined = answered.withColumn("page_block", F.floor(F.col("page") / PAGE_BLOCK).cast("int")).join(
            blocks, ["site", "endpoint", "page_block"]
        )
    return joined.filter("page < end_page").select(*api_pages.columns)


def scan_listing(api_pages: DataFrame, endpoint: str, cuts: DataFrame | None = None) -> DataFrame:
    """Typed records of one endpoint, with ``site`` and ``ord`` in front.

    Pass materialised ``cuts`` to share them between endpoints; otherwise those
    of this endpoint are computed, and partitioned captures are pruned to it.
    """
    if endpoint not in ENDPOINT_ROWS:
        raise ValueError(f"unknown endpoint: {endpoint}")
    ddl = ENDPOINT_ROWS[endpoint]
    mine = F.col("endpoint") == endpoint
    pages = surviving_pages(api_pages.filter(mine), None if cuts is None else cuts.filter(mine))
    return _records(pages, ddl)


def _records(pages: DataFrame, ddl: str, *labels: Column) -> DataFrame:
    """Records of listing pages in their order, decoded once per body."""
    record = F.posexplode(F.from_json("body", f"ARRAY<STRUCT<{ddl}>>")).alias("position", "record")
    return pages.select("site", "endpoint", "page", record).select(
        "site",
        listed_ord(F.col("page"), F.col("position")).alias("ord"),
        *labels,
        *zero_filled_fields("record", ddl),
    )


def scan_posts(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Posts and pages in one table and one scan, told apart by ``content_type``."""
    mine = F.col("endpoint").isin("posts", "pages")
    pages = surviving_pages(api_pages.filter(mine), None if cuts is None else cuts.filter(mine))
    content_type = F.when(F.col("endpoint") == "pages", "page").otherwise("post")
    return _records(pages, POST, content_type.alias("content_type"))


def scan_media(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return scan_listing(api_pages, "media", cuts)


def scan_categories(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return scan_listing(api_pages, "categories", cuts)


def scan_tags(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return scan_listing(api_pages, "tags", cuts)


def scan_users(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return scan_listing(api_pages, "users", cuts)


def _wrong_kind_sql(value: str, kind: T.DataType, depth: int = 0) -> str:
    """Whether a JSON value can't be read as the type; ``null`` can always."""
    shape, item = f"schema_of_variant({value})", f"e{depth}"
    if isinstance(kind, T.VariantType):
        return "false"
    if isinstance(kind, T.ArrayType):
        inner = f"exists(try_variant_get({value}, '$', 'array<variant>'), {item} -> {_wrong_kind_sql(item, kind.elementType, depth + 1)})"
        return f"coalesce({shape} <> 'VOID' AND (NOT startswith({shape}, 'ARRAY<') OR {inner}), false)"
    if isinstance(kind, T.MapType):
        inner = f"exists(map_values(try_variant_get({value}, '$', 'map<string, variant>')), {item} -> {_wrong_kind_sql(item, kind.valueType, depth + 1)})"
        return f"coalesce({shape} <> 'VOID' AND (NOT startswith({shape}, 'OBJECT<') OR {inner}), false)"
    if isinstance(kind, T.StructType):
        fields = [_wrong_kind_sql(f"try_variant_get({value}, {lit(f'$[{chr(34)}{f.name}{chr(34)}]')}, 'variant')", f.dataType, depth) for f in kind]
        return f"coalesce({shape} <> 'VOID' AND (NOT startswith({shape}, 'OBJECT<') OR {' OR '.join(fields)}), false)"
    wanted = {T.StringType: "STRING", T.BooleanType: "BOOLEAN"}.get(type(kind), "BIGINT")
    return f"coalesce({shape} NOT IN ({lit(wanted)}, 'VOID'), false)"


def rejected_fields(api_pages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(site, endpoint, page, position, field, found) of fields whose JSON type isn't the entity's.

    They are read as zero values. ``position`` counts a page's records from 0, ``found`` is the type as it came; a record's
    fields below the first level are reported as the one they belong to. Pages beyond a listing's end don't count, nor do
    failed listings. Bodies are decoded once more for this, so an export looks only if it is ``strict``.
    """
    listings = api_pages.filter(F.col("endpoint").isin(*ENDPOINT_ROWS))
    pages = surviving_pages(listings, cuts)
    parts = []
    for ddl in dict.fromkeys(ENDPOINT_ROWS.values()):
        own = [name for name, rows in ENDPOINT_ROWS.items() if rows == ddl]
        records = pages.filter(F.col("endpoint").isin(*own)).select(
            "site", "endpoint", "page", F.posexplode(F.from_json("body", "ARRAY<MAP<STRING, VARIANT>>")).alias("position", "record")
        )
        fields = [
            f"CASE WHEN {_wrong_kind_sql(f'try_element_at(record, {lit(f.name)})', f.dataType)} THEN {lit(f.name)} END"
            for f in struct_type(ddl)
            if not isinstance(f.dataType, T.VariantType)
        ]
        wrong = records.withColumn("field", F.expr(f"explode(array_compact(array({', '.join(fields)})))"))
        parts.append(wrong.select("site", "endpoint", "page", "position", "field", F.expr("schema_of_variant(record[field])").alias("found")))
    return reduce(DataFrame.unionByName, parts)


def item_outcome(status: Column, body: Column) -> Column:
    """``found``, ``missing`` (404) or ``error`` (any other status, or a body that is no record)."""
    readable = is_json_object(F.coalesce(body, F.lit("")))
    return F.when((status == 200) & readable, "found").when(status == 404, "missing").otherwise("error")


def found_items(api_items: DataFrame) -> DataFrame:
    """Lookups that answered with a record. The status filter reaches the Parquet scan."""
    return api_items.filter("status = 200").filter(
        item_outcome(F.col("status"), F.col("body")) == "found"
    )


def decode_items(api_items: DataFrame, content_type: str) -> DataFrame:
    """Typed records of found lookups of one content type; ``looked_up`` is the id asked for."""
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"unsupported content type: {content_type}")
    ddl = MEDIA if content_type == "media" else POST
    found = found_items(api_items.filter(F.col("content_type") == content_type)).select(
        "site", F.col("id").alias("looked_up"), F.from_json("body", ddl).alias("record")
    )
    return found.select("site", "looked_up", *zero_filled_fields("record", ddl))
