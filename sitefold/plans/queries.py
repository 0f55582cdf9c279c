"""The queries by which the operators are checked and timed, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.folders import link_folder
from sitefold.functions.links import is_inside, url_host
from sitefold.functions.markup import html_to_markdown
from sitefold.functions.names import MIME_EXTENSIONS, domain_name, folder_name, markdown_file_name, media_file_name, mime_extension
from sitefold.functions.sqltext import lit
from sitefold.functions.times import is_time, parse_time, print_time
from sitefold.operators import discovery, documents, media, rewrite, stats, taxonomy
from sitefold.plans import export, stand_ins
from sitefold.plans.options import ExportOptions
from sitefold.plans.stand_ins import RUN_TIME, cat, read
from sitefold.session import shared_dir
from sitefold.sinks import json_export
from sitefold.sources import rest, rpc, site
from sitefold.streaming.discovery import discovered_stream, read_lookups, start_discovery

Query = Callable[[SparkSession, str], DataFrame]
MEDIA_FOLDER = "/export/media"


def q_html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_to_markdown("html").alias("markdown"))


def q_link_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("link"))
    orders = read(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), stand_ins.order_link().alias("link")
    )
    return pages.unionByName(orders).select("kind", "id", link_folder("link").alias("folder"))


def q_markdown_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), stand_ins.page_slug().alias("slug"))
    orders = read(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), cat(F.col("o_orderpriority"), ":a/b\\", F.col("o_orderkey")).alias("slug")
    )
    return pages.unionByName(orders).select("kind", "id", markdown_file_name("slug", "id").alias("file_name"))


def q_sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    name = cat("  ", F.col("p_name"), " / ", F.col("p_brand"), '--<"', F.col("p_type"), '">?*|\\ ')
    return part.select("p_partkey", name.alias("name")).select("p_partkey", folder_name("name").alias("folder"))


def q_site_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("site", F.col("page_id").cast("string"))
    outputs = export.default_outputs(pages, RUN_TIME).select("site", "output")
    odd = pages.withColumn("odd", cat("--", F.col("url"), "--"))
    names = odd.select("site", "page_id", url_host("url").alias("host"), domain_name("odd").alias("odd_name"))
    return names.join(outputs, "site").drop("site")


def q_parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(kind == "view", stamp)
        .when(kind == "purchase", cat(stamp, "Z"))
        .when(kind == "click", cat(stamp, "-05:30"))
        .when(kind == "signup", cat(stamp, ".5+02:00"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    events = read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return events.select(
        "event_id",
        F.date_format(parse_time("raw"), "yyyy-MM-dd HH:mm:ss").alias("utc"),
        is_time("raw").alias("parsed"),
        print_time("raw", RUN_TIME).alias("printed"),
    )


def q_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = stand_ins.order_posts(spark, sf_dir)
    broken = F.col("title").withField("rendered", cat(F.col("title.rendered"), "\n", F.col("slug"), "\r\\"))
    return posts.withColumn("title", broken).select("site", "id", documents.front_matter("post", RUN_TIME).alias("front_matter"))


def q_post_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = taxonomy.category_paths(stand_ins.store_categories(spark, sf_dir))
    posts = stand_ins.page_posts(spark, sf_dir, "post").unionByName(stand_ins.order_posts(spark, sf_dir))
    return documents.post_documents(posts, paths, RUN_TIME)


def q_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_documents(stand_ins.page_posts(spark, sf_dir, "page"), RUN_TIME)


def q_site_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = site.site_info(
        stand_ins.customer_site_pages(spark, sf_dir), _customer_sites(spark, sf_dir)
    )
    return documents.site_readmes(sites, ExportOptions(run_time=RUN_TIME).readme_time)


def q_category_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.category_paths(stand_ins.store_categories(spark, sf_dir)).select("site", "id", "depth", "path")


def q_category_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = taxonomy.category_paths(stand_ins.store_categories(spark, sf_dir))
    return taxonomy.with_category_folder(stand_ins.order_posts(spark, sf_dir), paths).select("site", "id", "folder")


def q_gap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.gap_ids(stand_ins.lookup_ranges(spark, sf_dir), stand_ins.listed_ids(spark, sf_dir))


def q_id_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of all ids looked up as posts and as media, one page in the middle, and an inverted range."""
    items = stand_ins.lookups(spark, sf_dir)
    ends = {r[0]: (r[1], r[2]) for r in items.groupBy("content_type").agg(F.min("id"), F.max("id")).collect()}
    quarter = {kind: (last - first) // 4 for kind, (first, last) in ends.items()}
    middle = sum(ends["pages"]) // 2
    ranges = [(kind, ends[kind][0] + quarter[kind], ends[kind][1] - quarter[kind]) for kind in ("posts", "media")]
    ranges += [("pages", middle, middle), ("pages", ends["pages"][1], ends["pages"][0])]
    found = [discovery.items_in_range(items, *r).select("id", "slug", F.lit(r[0]).alias("content_type")) for r in ranges]
    return reduce(DataFrame.unionByName, found)


def q_item_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stand_ins.lookups(spark, sf_dir)
    return items.select("content_type", "id", rest.item_outcome(F.col("status"), F.col("body")).alias("outcome"))


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovered_items(stand_ins.lookups(spark, sf_dir), stand_ins.listed_ids(spark, sf_dir), 1 << 40)


def q_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).select("site", "content_type", "id")


def q_discover_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_counts(_discovered(spark, sf_dir))


def q_discover_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result from a stream that reads the lookups as landed files."""
    folder = f"{shared_dir(spark).rstrip('/')}/discover-{uuid.uuid4().hex}"
    lookups = stand_ins.lookups(spark, sf_dir).withColumn("status", F.col("status").cast("int"))
    lookups.write.parquet(f"{folder}/landing")
    found = discovered_stream(read_lookups(spark, f"{folder}/landing"), stand_ins.listed_ids(spark, sf_dir), 1 << 40)
    start_discovery(found, f"{folder}/found", uuid.uuid4().hex).awaitTermination()
    return spark.read.parquet(f"{folder}/found").select("site", "content_type", "id")


def q_merge_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = stand_ins.order_posts(spark, sf_dir)
    found = discovery.discovered_records(_discovered(spark, sf_dir), "pages")
    merged = discovery.merge_discovered(listed, found)
    return merged.select("site", "content_type", "id", "slug", discovery.is_discovered().alias("discovered"))


def q_media_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stand_ins.page_media(spark, sf_dir).select("id", "source_url", "mime_type")
    # Names on both sides of the limit of 200 bytes.
    long = items.withColumn("source_url", F.concat(F.lit("https://cdn.example.com/"), F.repeat(F.lit("ab"), (F.col("id") % 60 + 70).cast("int")), F.lit(".jpeg")))
    return items.unionByName(long).select("id", media_file_name("id", "source_url", "mime_type").alias("file"))


def q_mime_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    known = F.array(*[F.lit(m) for m in MIME_EXTENSIONS])
    mime = F.when(kind == "error", F.col("props")).otherwise(F.element_at(known, (F.col("event_id") % len(MIME_EXTENSIONS) + 1).cast("int")))
    events = read(spark, sf_dir, "events").select("event_id", mime.alias("mime"))
    return events.select("event_id", mime_extension("mime").alias("extension"))


def q_path_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    up = F.when(F.col("url").startswith("http:"), "../").otherwise("")
    below = F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1)
    path = cat(MEDIA_FOLDER, "/", stand_ins.page_host(), "/", up, up, below)
    return pages.select("page_id", path.alias("path")).select("page_id", is_inside("path", lit(MEDIA_FOLDER)).alias("inside"))


def q_media_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_variants(stand_ins.page_media(spark, sf_dir)).select("site", "media_id", "size_name", "url", "local_path")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_manifest(
        stand_ins.page_media(spark, sf_dir), stand_ins.present_files(spark, sf_dir), stand_ins.download_attempts(spark, sf_dir), MEDIA_FOLDER
    )


def q_media_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).select("site", "media_id", "local_path", "status", "downloaded", "resolved")


def q_media_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.downloaded_counts(_manifest(spark, sf_dir))


def q_attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.attempt_outcomes(stand_ins.download_attempts(spark, sf_dir))


def _rewritten(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
    posts = rewrite.rewrite_media_links(stand_ins.linked_posts(spark, sf_dir), stand_ins.linked_media(spark, sf_dir), **how)
    return posts.select("site", "content_type", "id", F.col("content.rendered").alias("content"), F.col("excerpt.rendered").alias("excerpt"))


def q_media_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir)


def q_media_rewrite_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also of URLs that an earlier replacement has formed."""
    return _rewritten(spark, sf_dir, exact=True)


def q_media_rewrite_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rewritten(spark, sf_dir, enabled=False)


def q_discover_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listed posts, with nothing found by id beside them."""
    items = discovery.discovered_items(stand_ins.lookups(spark, sf_dir), stand_ins.listed_ids(spark, sf_dir), 1 << 40, enabled=False)
    merged = discovery.merge_discovered(stand_ins.order_posts(spark, sf_dir), discovery.discovered_records(items, "posts"))
    return merged.select("site", "content_type", "id", "slug", discovery.is_discovered().alias("discovered"))


def q_rejected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rest.rejected_fields(stand_ins.typed_listing(spark, sf_dir))


def q_pagination_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rest.page_cuts(stand_ins.event_listing(spark, sf_dir))


def q_surviving_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rest.surviving_pages(stand_ins.event_listing(spark, sf_dir))


def q_scan_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = rest.scan_posts(stand_ins.order_listing(spark, sf_dir))
    return posts.select(
        "site", "content_type", "ord", "id", "date", "modified", "slug", "status", "link", F.col("title.rendered").alias("title"),
        F.col("content.rendered").alias("content"), F.col("excerpt.rendered").alias("excerpt"), "author", "featured_media",
        F.coalesce(taxonomy.first_category(F.col("categories")), F.lit(0)).alias("category"), F.size("tags").alias("tags"), "sticky", "template",
    )


def q_scan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rest.scan_media(stand_ins.media_listing(spark, sf_dir))
    details = F.col("media_details")
    return items.select(
        "site", "ord", "id", "source_url", "alt_text",
        F.try_variant_get(details["width"], "$", "bigint").alias("width"),
        F.try_variant_get(details["height"], "$", "bigint").alias("height"),
        F.schema_of_variant(details["height"]).alias("height_kind"),
        details["sizes"]["thumb"]["source_url"].alias("thumb"),
    )


def q_scan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = stand_ins.term_listing(spark, sf_dir)
    categories = rest.scan_categories(listing).select("site", "id", "name", "slug", "taxonomy", "parent", "count")
    tags = rest.scan_tags(listing).withColumn("parent", F.lit(0).cast("bigint"))
    return categories.unionByName(tags.select(*categories.columns))


def q_scan_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = rest.scan_users(stand_ins.user_listing(spark, sf_dir))
    return users.select("site", "ord", "id", "name", "slug", "url", "description", F.col("avatar_urls")["24"].alias("avatar"))


def _customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(cat("c-", key).alias("site"), cat("https://given/", key).alias("url"))


def q_site_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.site_info(stand_ins.customer_site_pages(spark, sf_dir), _customer_sites(spark, sf_dir))


def q_offset_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc.offset_cuts(stand_ins.order_calls(spark, sf_dir))


def q_rpc_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc.rpc_outcomes(stand_ins.event_calls(spark, sf_dir)).select("site", "offset", "outcome", "records")


def q_rpc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = rpc.rpc_posts(stand_ins.post_calls(spark, sf_dir))
    return posts.select(
        "site", "content_type", "id", "date", "slug", "status", "author", "link", "featured_media",
        F.col("title.rendered").alias("title"), F.col("content.rendered").alias("content"),
        F.try_variant_get("meta", "$.custom_fields[0].id", "bigint").alias("custom_id"),
        F.try_variant_get("meta", "$.custom_fields[0].value.a[0].b[0].c", "string").alias("custom_value"),
    )


def q_rpc_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc.rpc_users(stand_ins.customer_calls(spark, sf_dir)).select("site", "id", "name", "slug", "url")


def q_rpc_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rpc.rpc_media(stand_ins.customer_calls(spark, sf_dir))
    thumbnail = F.col("media_details")["sizes"]["thumbnail"]
    return items.select(
        "site", "id", "source_url", "mime_type", F.col("title.rendered").alias("title"), F.col("media_details")["file"].alias("file"),
        F.try_variant_get(F.col("media_details")["width"], "$", "bigint").alias("width"), thumbnail["source_url"].alias("thumbnail"),
        F.try_variant_get(thumbnail["width"], "$", "bigint").alias("thumbnail_width"),
    )


def q_rpc_site_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpc.rpc_site_info(stand_ins.customer_calls(spark, sf_dir)).select("site", "name", "description", "url", "home_url", "timezone", "language")


def q_rpc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = stand_ins.customer_calls(spark, sf_dir)
    categories = rpc.rpc_categories(calls).select("site", "id", "slug", "parent")
    return categories.unionByName(rpc.rpc_tags(calls).select("site", "id", "slug", F.lit(0).cast("bigint").alias("parent")))


def q_export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = stand_ins.store_content(spark, sf_dir)
    found = discovery.discovered_records(_discovered(spark, sf_dir), "posts").withColumn("site", F.lit("site-0"))
    posts = discovery.merge_discovered(content.posts, found)
    present = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        stand_ins.store_site("s_nationkey").alias("site"), cat(F.col("s_suppkey"), "_", F.col("s_suppkey"), ".png").alias("file")
    )
    attempts = stand_ins.download_attempts(spark, sf_dir)
    manifest = media.media_manifest(content.media, present, attempts, MEDIA_FOLDER)
    return stats.export_stats(content.sites, posts, content.media, content.categories, content.tags, content.users, manifest)


def _prepared_store(spark: SparkSession, sf_dir: str) -> tuple[export.Prepared, ExportOptions]:
    options = ExportOptions(run_time=RUN_TIME, output_format="markdown")
    return export.prepare(stand_ins.store_content(spark, sf_dir), "/export", options), options


def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_lines(*_prepared_store(spark, sf_dir))


def q_export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.metadata_lines(*_prepared_store(spark, sf_dir))


def q_export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = stand_ins.store_content(spark, sf_dir)
    tables = {name: getattr(content, name) for name in ("posts", "media", "categories", "tags", "users")}
    return json_export.entity_rows(tables, RUN_TIME)


def q_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page as a Markdown file in the folder its address names."""
    pages = read(spark, sf_dir, "pages")
    folder = F.nullif(link_folder("url"), F.lit(""))
    path = F.concat_ws("/", F.lit("posts"), F.coalesce(folder, F.lit(taxonomy.UNCATEGORIZED)), markdown_file_name("slug", "page_id"))
    return pages.withColumn("slug", stand_ins.page_slug()).select("page_id", path.alias("path"), html_to_markdown("html").alias("content"))


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_")
}
