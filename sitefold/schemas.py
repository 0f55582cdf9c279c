"""Row types of the entities and of the captured responses.

Field names and types are fixed values given by the content API. Fields whose
JSON type varies (widths, file sizes, free-form ``meta``) are VARIANT, so a number
and a quoted number both survive; read them with ``try_variant_get``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.functions.sqltext import lit

_RENDERED = "STRUCT<rendered: STRING, protected: BOOLEAN>"
_LINK_KEYS = (
    "self",
    "collection",
    "about",
    "author",
    "replies",
    "version-history",
    "predecessor-version",
    "wp:featuredmedia",
    "wp:attachment",
    "wp:term",
    "curies",
)
_LINKS = "STRUCT<" + ", ".join(f"`{key}`: ARRAY<STRUCT<href: STRING>>" for key in _LINK_KEYS) + ">"

POST = f"""
    id BIGINT, date STRING, date_gmt STRING, guid STRUCT<rendered: STRING>, modified STRING,
    modified_gmt STRING, slug STRING, status STRING, type STRING, link STRING,
    title {_RENDERED}, content {_RENDERED}, excerpt {_RENDERED},
    author BIGINT, featured_media BIGINT, comment_status STRING, ping_status STRING,
    sticky BOOLEAN, template STRING, format STRING, meta VARIANT,
    categories ARRAY<BIGINT>, tags ARRAY<BIGINT>, _links {_LINKS}
"""
MEDIA_SIZES = "MAP<STRING, STRUCT<file: STRING, width: VARIANT, height: VARIANT, mime_type: STRING, source_url: STRING>>"
MEDIA = f"""
    id BIGINT, date STRING, date_gmt STRING, guid STRUCT<rendered: STRING>, modified STRING,
    modified_gmt STRING, slug STRING, status STRING, type STRING, link STRING,
    title {_RENDERED}, author BIGINT, comment_status STRING, ping_status STRING, template STRING,
    meta VARIANT, description {_RENDERED}, caption {_RENDERED},
    alt_text STRING, media_type STRING, mime_type STRING,
    media_details STRUCT<width: VARIANT, height: VARIANT, file: STRING,
      sizes: {MEDIA_SIZES},
      image_meta: VARIANT, length: VARIANT, filesize: VARIANT>,
    post BIGINT, source_url STRING, _links {_LINKS}
"""
_TERM_HEAD = "id BIGINT, count BIGINT, description STRING, link STRING, name STRING, slug STRING, taxonomy STRING"
CATEGORY = f"{_TERM_HEAD}, parent BIGINT, meta VARIANT, _links {_LINKS}"
TAG = f"{_TERM_HEAD}, meta VARIANT, _links {_LINKS}"
USER = f"""
    id BIGINT, name STRING, url STRING, description STRING, link STRING, slug STRING,
    avatar_urls MAP<STRING, STRING>, meta VARIANT, _links {_LINKS}
"""
SITE = """
    name STRING, description STRING, url STRING, home_url STRING, admin_email STRING,
    timezone STRING, date_format STRING, time_format STRING, start_of_week BIGINT, language STRING
"""

API_PAGES = "site STRING, endpoint STRING, page INT, status INT, body STRING"
API_ITEMS = "site STRING, content_type STRING, id BIGINT, status INT, body STRING"
RPC_PAGES = "site STRING, method STRING, offset INT, status INT, body STRING"
ATTEMPTS = "site STRING, media_id BIGINT, attempt INT, status INT"
EXISTING_FILES = "site STRING, file STRING"

# Listing endpoints and the entity each one holds.
ENDPOINT_ROWS = {
    "posts": POST,
    "pages": POST,
    "media": MEDIA,
    "categories": CATEGORY,
    "tags": TAG,
    "users": USER,
}
CONTENT_TYPES = ("posts", "pages", "media")
STAT_COLUMNS = (
    "total_posts",
    "total_pages",
    "total_media",
    "total_categories",
    "total_tags",
    "total_users",
    "media_downloaded",
    "brute_force_found",
)

# ``ord`` packs (discovered?, page, position) into one long: page and position
# are 31 bits each, and records found by id come after every listed one.
POSITION_BITS = 31
FOUND_BASE = 1 << 62


@lru_cache
def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def listed_ord(page: Column, position: Column) -> Column:
    return F.shiftleft(page.cast("long"), POSITION_BITS) + position.cast("long")


def found_ord(record_id: Column) -> Column:
    return F.lit(FOUND_BASE) + record_id


def _zero_sql(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "''"
    if isinstance(data_type, T.BooleanType):
        return "false"
    if isinstance(data_type, (T.IntegerType, T.LongType)):
        return f"CAST(0 AS {data_type.simpleString()})"
    if isinstance(data_type, T.ArrayType):
        return f"CAST(array() AS {data_type.simpleString()})"
    if isinstance(data_type, T.MapType):
        return f"CAST(map() AS {data_type.simpleString()})"
    return f"CAST(NULL AS {data_type.simpleString()})"


def zero_filled_sql(value: str | None, data_type: T.DataType) -> str:
    """The value with every missing part replaced by its type's zero value; all of it for None."""
    if isinstance(data_type, T.StructType):
        fields = [
            f"{lit(f.name)}, {zero_filled_sql(value and f'{value}.`{f.name}`', f.dataType)}" for f in data_type
        ]
        return f"named_struct({', '.join(fields)})"
    if isinstance(data_type, T.VariantType):
        return value or "CAST(NULL AS VARIANT)"
    zero = _zero_sql(data_type)
    return f"coalesce({value}, {zero})" if value else zero


def zero_filled_fields(record: str, ddl: str) -> list[Column]:
    """All columns of an entity out of a decoded record."""
    return [
        F.expr(zero_filled_sql(f"{record}.`{f.name}`", f.dataType)).alias(f.name) for f in struct_type(ddl)
    ]


def entity_columns(ddl: str, fields: dict[str, Column]) -> list[Column]:
    """All columns of an entity, those without a given value at their zero value."""
    return [
        (fields[f.name] if f.name in fields else F.expr(zero_filled_sql(None, f.dataType))).alias(f.name)
        for f in struct_type(ddl)
    ]
