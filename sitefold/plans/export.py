"""From captured responses to an export of many sites."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.links import url_host
from sitefold.functions.names import EMPTY_DOMAIN, domain_name
from sitefold.operators import discovery, documents, media, rewrite, stats, taxonomy
from sitefold.plans.options import ExportOptions
from sitefold.operators.joins import materialised
from sitefold.schemas import ATTEMPTS, CONTENT_TYPES, ENDPOINT_ROWS, EXISTING_FILES
from sitefold.session import landed, landing_scope
from sitefold.sinks import json_export, markdown_export
from sitefold.sources import rest, rpc, site


@dataclass(frozen=True)
class Content:
    """Typed tables of all sites."""

    sites: DataFrame
    posts: DataFrame
    media: DataFrame
    categories: DataFrame
    tags: DataFrame
    users: DataFrame


class IncompleteCapture(ValueError):
    """A listing failed, or a field had another type than its entity's, and ``strict`` was set."""


def _require_none(found: DataFrame, what: str) -> None:
    example = found.first()
    if example is not None:
        raise IncompleteCapture(f"{what}, for example {example.asDict()}")


def content_from_api(api_pages: DataFrame, sites: DataFrame, strict: bool = False) -> Content:
    """Content of the JSON API. ``sites(site, url)`` names the sites to export.

    A failed listing is empty, and a field of another JSON type is zero; with ``strict`` either raises.
    """
    listings = api_pages.filter(F.col("endpoint").isin(*ENDPOINT_ROWS))
    cuts = materialised(rest.page_cuts(listings))
    if strict:
        _require_none(rest.failed_listings(listings, cuts), "failed listing")
        _require_none(rest.rejected_fields(listings, cuts), "field of another type")
    return Content(
        sites=site.site_info(api_pages, sites),
        posts=rest.scan_posts(listings, cuts),
        media=rest.scan_media(listings, cuts),
        categories=rest.scan_categories(listings, cuts),
        tags=rest.scan_tags(listings, cuts),
        users=rest.scan_users(listings, cuts),
    )


def content_from_rpc(rpc_pages: DataFrame, strict: bool = False) -> Content:
    """Content of the XML-RPC API, in the same columns; every call is parsed once.

    A call sequence that failed gives no records; with ``strict`` it raises.
    """
    calls = rpc.decode_calls(rpc_pages)
    if strict:
        _require_none(rpc.offset_cuts(calls).filter("failed").select("site", "method", "error_offset"), "failed call")
    return Content(
        sites=rpc.rpc_site_info(calls),
        posts=rpc.rpc_posts(calls),
        media=rpc.rpc_media(calls),
        categories=rpc.rpc_categories(calls),
        tags=rpc.rpc_tags(calls),
        users=rpc.rpc_users(calls),
    )


def with_discovered(content: Content, api_items: DataFrame, max_id: int) -> Content:
    """Add records found by id to the listed ones."""
    known = discovery.known_ids(content.posts, content.media)
    items = discovery.discovered_items(api_items, known, max_id)
    records = {kind: discovery.discovered_records(items, kind) for kind in CONTENT_TYPES}
    posts = discovery.merge_discovered(
        content.posts, records["posts"].unionByName(records["pages"])
    )
    return replace(content, posts=posts, media=discovery.merge_discovered(content.media, records["media"]))


def land(content: Content, folder: str) -> Content:
    """Write the typed tables once and continue from Parquet.

    Later steps then read only the columns they need instead of decoding
    responses again.
    """
    landed = {}
    for name in Content.__dataclass_fields__:
        path = f"{folder.rstrip('/')}/{name}"
        table = getattr(content, name)
        table.write.mode("overwrite").parquet(path)
        landed[name] = table.sparkSession.read.schema(table.schema).parquet(path)
    return Content(**landed)


@dataclass(frozen=True)
class Prepared:
    """``source`` is the content as it came; the rewritten one is made when it is first read."""

    source: Content
    manifest: DataFrame
    stats: DataFrame
    options: ExportOptions

    @cached_property
    def rewritten(self) -> Content:
        """The content with links to local files, for a single reader; replacements are found when it is first asked for."""
        if not self.options.download_media:
            return self.source
        posts = rewrite.rewrite_media_links(self.source.posts, self.source.media, exact=self.options.exact_rewrite)
        return replace(self.source, posts=posts)

    @cached_property
    def content(self) -> Content:
        """The same landed: posts and pages of a Markdown export are read by several jobs."""
        if not self.options.download_media:
            return self.source
        return replace(self.rewritten, posts=landed(self.rewritten.posts))


def prepare(
    content: Content,
    output: str,
    options: ExportOptions,
    existing_files: DataFrame | None = None,
    attempts: DataFrame | None = None,
) -> Prepared:
    """Media manifest, rewritten links and counters, common to both formats."""
    spark = content.posts.sparkSession
    existing_files = existing_files if existing_files is not None else spark.createDataFrame([], EXISTING_FILES)
    attempts = attempts if attempts is not None else spark.createDataFrame([], ATTEMPTS)
    folder = media.media_dir(output, options.output_format)
    manifest = media.media_manifest(
        content.media, existing_files, attempts, folder, options.retries, options.download_media
    )
    counters = stats.export_stats(
        content.sites, content.posts, content.media, content.categories, content.tags, content.users, manifest
    )
    return Prepared(content, manifest, counters, options)


def _tables(content: Content) -> dict[str, DataFrame]:
    return {name: getattr(content, name) for name in ("posts", "media", "categories", "tags", "users")}


def json_lines(prepared: Prepared, options: ExportOptions) -> DataFrame:
    """Rewritten posts are read in one pass only, so nothing is landed; what comes first in a list is told by the content as it came."""
    records = json_export.entity_rows(_tables(prepared.rewritten), options.run_time)
    listed = json_export.entity_rows(_tables(prepared.source), options.run_time)
    return json_export.document_lines(
        prepared.source.sites, records, prepared.stats, options.run_time, json_export.EXPORT_KEYS, listed
    )


def metadata_lines(prepared: Prepared, options: ExportOptions) -> DataFrame:
    """Without posts and pages, so nothing is rewritten for it."""
    tables = {name: rows for name, rows in _tables(prepared.source).items() if name != "posts"}
    records = json_export.entity_rows(tables, options.run_time)
    return json_export.document_lines(
        prepared.source.sites, records, prepared.stats, options.run_time, json_export.METADATA_KEYS
    )


def markdown_documents(prepared: Prepared, options: ExportOptions) -> DataFrame:
    content = prepared.content
    paths = taxonomy.category_paths(content.categories)
    return (
        documents.site_readmes(content.sites, options.readme_time)
        .unionByName(documents.post_documents(content.posts, paths, options.run_time))
        .unionByName(documents.page_documents(content.posts, options.run_time))
    )


def export(
    content: Content,
    output: str,
    options: ExportOptions,
    existing_files: DataFrame | None = None,
    attempts: DataFrame | None = None,
    api_items: DataFrame | None = None,
    as_files: bool = False,
    by_entity: bool = False,
) -> DataFrame:
    """Write the export below ``output`` and return the counters of every site.

    A JSON export is one document per site in ordered part files, or with ``by_entity`` JSON lines in a folder per
    entity, each line valid by itself. Markdown goes to Parquet, or with ``as_files`` to a tree of files.
    """
    if options.discover and api_items is not None:
        content = with_discovered(content, api_items, options.max_id)
    prepared = prepare(content, output, options, existing_files, attempts)
    root = output.removesuffix(".json").rstrip("/")
    with landing_scope(content.posts.sparkSession):  # the counters read the content as it came
        if options.output_format == "json" and by_entity:
            records = json_export.entity_rows(_tables(prepared.rewritten), options.run_time)
            json_export.write_entities(records, f"{root}/entities")
        elif options.output_format == "json":
            json_export.write_document_lines(json_lines(prepared, options), f"{root}/export")
        else:
            pages = markdown_documents(prepared, options)
            if as_files:
                markdown_export.write_tree(pages, root)
            else:
                markdown_export.write_documents(pages, f"{root}/documents")
            json_export.write_document_lines(metadata_lines(prepared, options), f"{root}/metadata")
    return prepared.stats


def export_captures(
    api_pages: DataFrame, sites: DataFrame, output: str, options: ExportOptions, **inputs: DataFrame | bool | None
) -> DataFrame:
    """Decode captured responses and export them; ``options.strict`` decides whether a failed listing raises."""
    return export(content_from_api(api_pages, sites, options.strict), output, options, **inputs)


def export_rpc_captures(rpc_pages: DataFrame, output: str, options: ExportOptions, **inputs: DataFrame | bool | None) -> DataFrame:
    """The same for captured XML-RPC calls; the decoded calls go when the counters are known."""
    with landing_scope(rpc_pages.sparkSession):
        return materialised(export(content_from_rpc(rpc_pages, options.strict), output, options, **inputs))


def default_outputs(sites: DataFrame, run_time: str) -> DataFrame:
    """(site, output): the folder an export of each site goes to by default.

    The host without ``www.``, made safe for a file system, then date and time
    of the run. ``output`` is NULL where the URL does not parse.
    """
    day, _, clock = run_time.removesuffix("Z").partition("T")
    suffix = f".{day}{clock.replace(':', '')}"
    hosts = sites.select("site", url_host("url").alias("host"))
    bare = F.regexp_replace(F.coalesce(F.nullif("host", F.lit("")), F.lit(EMPTY_DOMAIN)), r"\Awww\.", "")
    output = F.when(F.col("host").isNotNull(), F.concat(F.lit("export/"), domain_name("bare"), F.lit(suffix)))
    return hosts.withColumn("bare", bare).select("site", output.alias("output"))


def read_captures(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A capture table from plain Parquet files; ``sources/captures`` writes and reads the layout that scans prune best."""
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}")
