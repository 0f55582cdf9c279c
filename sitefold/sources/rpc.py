"""Responses captured from the XML-RPC API.

``rpc_pages`` holds one row per call; ``offset`` is 0 for calls that do not page. Every function takes captured calls, or
decoded ones (``decode_calls``), by which an export parses each call once. Values nest to any depth: below a record they
become JSON text (``functions/rpcvalues``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.rpcrecords import records_of
from sitefold.functions.rpcvalues import SCALAR_TYPES, json_text_sql, protected_sql, unescaped_sql
from sitefold.functions.sqltext import bind, lit
from sitefold.operators.joins import BROADCAST_BYTES, fits_broadcast, materialised
from sitefold.schemas import CATEGORY, MEDIA, MEDIA_SIZES, POST, SITE, TAG, USER, listed_ord, struct_type, zero_filled_sql
from sitefold.session import work_folder

# Methods by entity, and the page size of calls that page.
METHODS = {
    "posts": "wp.getPosts",
    "pages": "wp.getPages",
    "media": "wp.getMediaLibrary",
    "terms": "wp.getTerms",
    "users": "wp.getUsers",
    "options": "wp.getOptions",
}
PAGED_METHODS = ("wp.getPosts", "wp.getPages", "wp.getMediaLibrary")
PAGE_SIZE = 100  # what the calls asked for; captures made with another size state it
SITE_NAME = "WordPress Site"
BATCH_CALLS = 256  # bodies handed to Python at once

# What a value may hold; a text without a type is its own.
_SCALARS = (*SCALAR_TYPES, "_VALUE")
_XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}
_ROOT = r"(?s)\A\s*(?:<\?xml.*?\?>)?\s*<methodResponse\s*(?:/>\s*|>.*</methodResponse\s*>\s*)\z"
# Values of members below a record are not decoded but kept as text, so no depth is fixed here.
_VALUE = "STRUCT<" + ", ".join(f"`{name}`: STRING" for name in (*_SCALARS, "struct", "array")) + ">"
_MEMBERS = f"STRUCT<member: ARRAY<STRUCT<name: STRING, value: {_VALUE}>>>"
_RESPONSE = (
    f"params STRUCT<param: ARRAY<STRUCT<value: STRUCT<array: STRUCT<data: STRUCT<value: ARRAY<STRUCT<struct: {_MEMBERS}>>>>, "
    f"struct: {_MEMBERS}>>>>, fault STRING"
)
#: Calls as they are decoded: one row per call, a record being its members with their text or, if nested, their JSON.
DECODED_CALLS = (
    "site STRING, offset INT, status INT, outcome STRING, records INT, "
    "items ARRAY<ARRAY<STRUCT<name: STRING, text: STRING, nested: STRING>>>, method STRING"
)


def _decoded(rpc_pages: DataFrame) -> DataFrame:
    """The calls with their outcome, the number of records and the records, in one pass over the bodies.

    Plain lists of records, which most answers are, are decoded in batches; what is left of the bodies goes through the XML parser.
    """
    # Bodies are long, so batches are kept short; the setting is read when a plan runs, so it stays.
    rpc_pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_CALLS))
    plain = records_of(F.when(F.col("status") == 200, F.col("body")))
    body = F.coalesce("body", F.lit(""))
    unread = F.col("plain").isNull() & (F.col("status") == 200) & body.rlike(_ROOT)
    answer = F.when(unread, F.from_xml(F.expr(protected_sql("coalesce(body, '')")), F.lit(_RESPONSE), _XML_OPTIONS))
    nested = (
        f"CASE WHEN m.value.struct IS NOT NULL THEN {json_text_sql(_wrapped('struct'))} "
        f"WHEN m.value.array IS NOT NULL THEN {json_text_sql(_wrapped('array'))} END"
    )
    text = f"coalesce({', '.join(f'm.value.`{name}`' for name in _SCALARS)}, '')"
    member = f"m -> named_struct('name', m.name, 'text', {unescaped_sql(text)}, 'nested', {nested})"
    records, options = "value.array.data.value", "value.struct.member"
    items = (
        f"CASE WHEN plain IS NOT NULL THEN plain WHEN {options} IS NOT NULL THEN array(transform({options}, {member})) "
        f"ELSE transform({records}, r -> transform(r.struct.member, {member})) END"
    )
    failed = F.col("plain").isNull() & (F.col("answer").isNull() | F.col("answer.fault").isNotNull())
    return (
        rpc_pages.withColumn("plain", plain)
        .withColumn("answer", answer)
        .withColumn("value", F.expr("try_element_at(answer.params.param, 1).value"))
        .select(
            "site",
            F.col("offset").cast("int").alias("offset"),
            F.col("status").cast("int").alias("status"),
            F.when(failed, "error").otherwise("ok").alias("outcome"),
            F.when(~failed, F.coalesce(F.size("plain"), F.size(F.expr(records)), F.lit(0))).alias("records"),
            F.when(~failed, F.expr(items)).alias("items"),
            "method",
        )
    )


def _wrapped(kind: str) -> str:
    return f"concat('<{kind}>', m.value.`{kind}`, '</{kind}>')"


def decode_calls(rpc_pages: DataFrame) -> DataFrame:
    """All calls decoded once and landed by method; outcomes, cuts and every entity are read from there by column."""
    spark = rpc_pages.sparkSession
    path = work_folder(spark)
    _decoded(rpc_pages).write.partitionBy("method").parquet(path)
    return spark.read.schema(DECODED_CALLS).parquet(path)


def _calls(rpc_pages: DataFrame) -> DataFrame:
    """Decoded calls are taken as they are; captured ones are decoded first."""
    return rpc_pages if "items" in rpc_pages.columns else decode_calls(rpc_pages)


def rpc_outcomes(rpc_pages: DataFrame) -> DataFrame:
    """``ok`` or ``error`` per call; a fault, a status other than 200 and unreadable XML are errors."""
    calls = rpc_pages if "items" in rpc_pages.columns else _decoded(rpc_pages)
    return calls.select(
        "site", "method", "offset", "status", "outcome", F.greatest("records", F.lit(0)).alias("records")
    )


def offset_cuts(rpc_pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Last offset of each paged call sequence: the first one with fewer records than a page holds.

    An error at or before it fails the sequence. Calls that do not page end at offset 0.
    """
    paged = F.col("method").isin(*PAGED_METHODS)
    short = (F.col("outcome") == "ok") & ((F.col("records") < page_size) | ~paged)
    return (
        rpc_outcomes(rpc_pages)
        .groupBy("site", "method")
        .agg(
            F.min(F.when(short, F.col("offset"))).alias("short_offset"),
            F.min(F.when(F.col("outcome") == "error", F.col("offset"))).alias("error_offset"),
            F.max("offset").alias("max_offset"),
        )
        .select(
            "site",
            "method",
            "short_offset",
            "error_offset",
            F.coalesce("short_offset", "max_offset").alias("last_offset"),
            (
                F.col("error_offset").isNotNull()
                & (F.col("short_offset").isNull() | (F.col("error_offset") < F.col("short_offset")))
            ).alias("failed"),
        )
    )


# Offsets of one sequence that share a join key, as for listing pages.
OFFSET_BLOCK = 64 * PAGE_SIZE


def _surviving_calls(rpc_pages: DataFrame, bound: int = BROADCAST_BYTES, page_size: int = PAGE_SIZE) -> DataFrame:
    """Calls up to the end of sequences that did not fail, joined as listing pages are."""
    cuts = materialised(offset_cuts(rpc_pages, page_size).filter(~F.col("failed")).select("site", "method", "last_offset"))
    answered = rpc_pages.filter("status = 200")
    if fits_broadcast(cuts, bound):
        joined = answered.join(F.broadcast(cuts), ["site", "method"])
    else:
        last_block = F.floor(F.col("last_offset") / OFFSET_BLOCK).cast("int")
        blocks = cuts.withColumn("block", F.explode(F.sequence(F.lit(0), last_block)))
        joined = answered.withColumn("block", F.floor(F.col("offset") / OFFSET_BLOCK).cast("int")).join(
            blocks, ["site", "method", "block"]
        )
    return joined.filter("offset <= last_offset").select(*rpc_pages.columns)


def _found(name: str) -> str:
    """Position of a member in ``names``, NULL where it is missing."""
    return f"nullif(array_position(names, {lit(name)}), 0L)"


def _text(*names: str) -> str:
    found = [f"nullif(try_element_at(texts, CAST({_found(name)} AS INT)), '')" for name in names]
    return f"coalesce({', '.join(found)}, '')"


def _number(*names: str) -> str:
    return f"coalesce(try_cast({_text(*names)} AS BIGINT), 0L)"


def _flag(name: str) -> str:
    return f"{_text(name)} IN ('1', 'true')"


def _time(*names: str) -> str:
    return f"regexp_replace({_text(*names)}, {lit(r'\A(\d{4})(\d{2})(\d{2})T')}, '$1-$2-$3T')"


def _rendered(value: str) -> str:
    return f"named_struct('rendered', {value}, 'protected', false)"


def _nested(name: str) -> str:
    """JSON of a member that is a record or a list."""
    return f"try_element_at(nested, CAST({_found(name)} AS INT))"


def _term_ids(taxonomy: str) -> str:
    terms = f"from_json({_nested('terms')}, 'ARRAY<STRUCT<term_id: STRING, taxonomy: STRING>>')"
    ids = f"transform(filter({terms}, t -> t.taxonomy = {lit(taxonomy)}), t -> coalesce(try_cast(t.term_id AS BIGINT), 0L))"
    return f"coalesce({ids}, CAST(array() AS ARRAY<BIGINT>))"


def _thumbnail() -> str:
    """Id of the featured image: a record of its own, or a plain number."""
    return f"coalesce(try_cast(get_json_object({_nested('post_thumbnail')}, '$.attachment_id') AS BIGINT), {_number('post_thumbnail')})"


def _custom_fields() -> str:
    """Custom fields as they came, values of any depth among them, below the name of their member."""
    fields = _nested("custom_fields")
    return f"CASE WHEN {fields} IS NOT NULL THEN try_parse_json(concat('{{\"custom_fields\":', {fields}, '}}')) END"


def _details() -> str:
    """Size, file and scaled versions of an image; those lie beside the file itself."""
    kinds = "map<string, struct<file: string, width: variant, height: variant, `mime-type`: string>>"
    folder = f"regexp_extract({_text('link')}, {lit(r'\A[^?#]*/')}, 0)"

    def part(d: str, name: str, kind: str) -> str:
        return f"try_variant_get({d}, '$.{name}', {lit(kind)})"

    def filled(d: str) -> str:
        url = f"CASE WHEN s.file <> '' THEN concat({folder}, s.file) ELSE '' END"
        size = f"named_struct('file', coalesce(s.file, ''), 'width', s.width, 'height', s.height, 'mime_type', coalesce(s.`mime-type`, ''), 'source_url', coalesce({url}, ''))"
        sizes = f"coalesce(transform_values({part(d, 'sizes', kinds)}, (k, s) -> {size}), CAST(map() AS {MEDIA_SIZES}))"
        variants = {name: part(d, name, "variant") for name in ("width", "height", "image_meta", "length", "filesize")}
        fields = {"width": variants["width"], "height": variants["height"], "file": f"coalesce({part(d, 'file', 'string')}, '')", "sizes": sizes}
        fields |= {name: variants[name] for name in ("image_meta", "length", "filesize")}
        return f"named_struct({', '.join(f'{lit(k)}, {v}' for k, v in fields.items())})"

    return bind(f"try_parse_json({_nested('metadata')})", filled)


# Members of each method's records by the field they fill.
_POST_FIELDS = {
    "id": _number("post_id"),
    "date": _time("post_date"),
    "date_gmt": _time("post_date_gmt"),
    "guid": f"named_struct('rendered', {_text('guid')})",
    "modified": _time("post_modified"),
    "modified_gmt": _time("post_modified_gmt"),
    "slug": _text("post_name"),
    "status": _text("post_status"),
    "type": _text("post_type"),
    "link": _text("link"),
    "title": _rendered(_text("post_title")),
    "content": _rendered(_text("post_content")),
    "excerpt": _rendered(_text("post_excerpt")),
    "author": _number("post_author"),
    "featured_media": _thumbnail(),
    "comment_status": _text("comment_status"),
    "ping_status": _text("ping_status"),
    "sticky": _flag("sticky"),
    "format": _text("post_format"),
    "categories": _term_ids("category"),
    "tags": _term_ids("post_tag"),
    "meta": _custom_fields(),
}
_PAGE_FIELDS = {
    "id": _number("page_id"),
    "date": _time("dateCreated"),
    "date_gmt": _time("date_created_gmt"),
    "slug": _text("wp_slug"),
    "status": _text("page_status"),
    "type": "'page'",
    "link": _text("link", "permaLink"),
    "title": _rendered(_text("title")),
    "content": _rendered(_text("description")),
    "excerpt": _rendered(_text("excerpt")),
    "author": _number("wp_author_id"),
    "template": _text("wp_page_template"),
    "meta": _custom_fields(),
}
_MEDIA_FIELDS = {
    "id": _number("attachment_id"),
    "date_gmt": _time("date_created_gmt"),
    "link": _text("link"),
    "source_url": _text("link"),
    "title": _rendered(_text("title")),
    "caption": _rendered(_text("caption")),
    "description": _rendered(_text("description")),
    "mime_type": _text("type"),
    "post": _number("parent"),
    "media_details": _details(),
}
_TERM_FIELDS = {
    "id": _number("term_id"),
    "count": _number("count"),
    "description": _text("description"),
    "name": _text("name"),
    "slug": _text("slug"),
    "taxonomy": _text("taxonomy"),
    "parent": _number("parent"),
}
_USER_FIELDS = {
    "id": _number("user_id"),
    "name": _text("display_name", "username"),
    "url": _text("url"),
    "description": _text("bio"),
    "slug": _text("nicename", "username"),
}


def _members(calls: DataFrame) -> DataFrame:
    """Names, texts and nested values of the members of every record, as parallel arrays: a field is a plain lookup."""
    return calls.selectExpr("site", "offset", "posexplode(items) AS (position, members)").select(
        "site",
        listed_ord(F.col("offset"), F.col("position")).alias("ord"),
        *[F.expr(f"coalesce(transform(members, m -> m.{part}), CAST(array() AS ARRAY<STRING>))").alias(f"{part}s") for part in ("name", "text")],
        F.expr("coalesce(members.nested, CAST(array() AS ARRAY<STRING>))").alias("nested"),
    )


def _records(rpc_pages: DataFrame, method: str, ddl: str, fields: dict[str, str], page_size: int = PAGE_SIZE) -> DataFrame:
    """Records of one method in all columns of the entity; those it does not carry are zero."""
    calls = _surviving_calls(_calls(rpc_pages).filter(F.col("method") == method), page_size=page_size)
    columns = [f"{fields.get(f.name) or zero_filled_sql(None, f.dataType)} AS `{f.name}`" for f in struct_type(ddl)]
    return _members(calls).selectExpr("site", "ord", *columns)


def rpc_posts(rpc_pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Posts and pages, in the columns of the JSON API."""
    calls = _calls(rpc_pages)
    posts = _records(calls, METHODS["posts"], POST, _POST_FIELDS, page_size)
    pages = _records(calls, METHODS["pages"], POST, _PAGE_FIELDS, page_size)
    return posts.withColumn("content_type", F.lit("post")).unionByName(pages.withColumn("content_type", F.lit("page")))


def rpc_media(rpc_pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    return _records(rpc_pages, METHODS["media"], MEDIA, _MEDIA_FIELDS, page_size=page_size)


def rpc_categories(rpc_pages: DataFrame) -> DataFrame:
    return _records(rpc_pages, METHODS["terms"], CATEGORY, _TERM_FIELDS).filter("taxonomy = 'category'")


def rpc_tags(rpc_pages: DataFrame) -> DataFrame:
    return _records(rpc_pages, METHODS["terms"], TAG, _TERM_FIELDS).filter("taxonomy = 'post_tag'")


def rpc_users(rpc_pages: DataFrame) -> DataFrame:
    return _records(rpc_pages, METHODS["users"], USER, _USER_FIELDS)


def rpc_site_info(rpc_pages: DataFrame) -> DataFrame:
    """One row per site whose options call succeeded; missing options keep their defaults."""
    calls = _surviving_calls(_calls(rpc_pages).filter(F.col("method") == METHODS["options"]))
    options = _members(calls.withColumn("items", F.expr("CASE WHEN size(items) > 0 THEN items ELSE array(NULL) END")))

    def option(name: str, default: str = "''") -> str:
        return f"coalesce(nullif(get_json_object({_nested(name)}, '$.value'), ''), {default})"

    fields = {
        "name": option("blog_title", lit(SITE_NAME)),
        "description": option("blog_tagline"),
        "url": option("blog_url", "concat('https://', site)"),
        "home_url": option("home_url"),
        "timezone": option("time_zone"),
        "date_format": option("date_format"),
        "time_format": option("time_format"),
    }
    columns = [f"{fields.get(f.name) or zero_filled_sql(None, f.dataType)} AS `{f.name}`" for f in struct_type(SITE)]
    return options.selectExpr("site", *columns)
