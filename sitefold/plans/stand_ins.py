"""The benchmark tables read as content and as captured responses.

``orders`` stand for the posts of 25 stores (one per nation), ``customer``,
``nation`` and ``region`` for their categories and users, ``pages`` for posts,
pages and media of the hosts they name, ``events`` for answers of servers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.plans.export import Content
from sitefold.schemas import CATEGORY, MEDIA, POST, SITE, TAG, USER, entity_columns, struct_type
from sitefold.session import landed

RUN_TIME = "2024-06-01T12:30:45Z"
# Ids per listing page of a capture: about 100 records of one store.
IDS_PER_PAGE = 2500
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cat(*parts: Column | str) -> Column:
    """Concatenate columns and plain text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def store_site(nation: str) -> Column:
    return cat("site-", F.col(nation))


def _rendered(value: Column) -> Column:
    return F.struct(value.alias("rendered"), F.lit(False).alias("protected"))


def order_link() -> Column:
    """A dated permalink, one below category folders, or one below a single folder."""
    tail = cat("/order-", F.col("o_orderkey"))
    return (
        F.when(F.col("o_orderstatus") == "F", cat("https://shop.example.com", F.date_format("o_orderdate", "/yyyy/MM/dd"), tail))
        .when(
            F.col("o_orderpriority").isin("1-URGENT", "4-NOT SPECIFIED"),
            cat("https://shop.example.com/blog/", F.col("o_orderpriority"), F.date_format("o_orderdate", "/yyyy"), "/a%2Fb+c", tail, "/?x=/y/z#top"),
        )
        .otherwise(cat("https://shop.example.com", tail))
    )


def order_posts(spark: SparkSession, sf_dir: str, **further: Column) -> DataFrame:
    """Orders as posts of the store of their customer's nation, in the columns of posts; ``further`` ones are of the order."""
    orders = read(spark, sf_dir, "orders").join(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    none = F.array().cast("array<bigint>")
    fields = {
        "id": key,
        "date": stamp,
        "modified": cat(stamp, "+02:00"),
        "slug": F.when(priority == "5-LOW", "").otherwise(cat("order:", key)),
        "status": F.when(status == "F", "publish").when(status == "O", "draft").otherwise("private"),
        "type": F.lit("post"),
        "link": order_link(),
        "title": _rendered(cat("Order ", key, ' "', priority, '"')),
        "content": _rendered(cat("<h2>Order ", key, "</h2><p>Status <b>", status, "</b></p><p>Priority ", priority, "</p>\n")),
        "excerpt": _rendered(F.when(status == "F", cat("<p><em>", priority, "</em></p>")).otherwise("")),
        "author": F.col("o_custkey"),
        "featured_media": F.when(priority == "1-URGENT", key).otherwise(F.lit(0)).cast("bigint"),
        "categories": F.when(status == "P", none).otherwise(F.array(F.col("o_custkey") + 100001, F.lit(1).cast("bigint"))),
        "tags": F.array(F.year("o_orderdate").cast("bigint")),
    }
    return orders.select(
        store_site("c_nationkey").alias("site"), key.alias("ord"), F.lit("post").alias("content_type"), *entity_columns(POST, fields),
        *[value.alias(name) for name, value in further.items()],
    )


def store_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, market segment, customer: a tree of four levels in every store."""
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    customers = read(spark, sf_dir, "customer")
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")).cast("bigint") + 1000
    top = nations.select(
        store_site("n_nationkey").alias("site"),
        F.explode(
            F.array(
                F.struct((F.col("n_regionkey") + 1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("parent"), F.lower("r_name").alias("slug")),
                F.struct((F.col("n_nationkey") + 101).cast("bigint").alias("id"), (F.col("n_regionkey") + 1).cast("bigint").alias("parent"), F.col("n_name").alias("slug")),
            )
        ).alias("node"),
    ).select("site", "node.id", "node.parent", "node.slug")
    site = store_site("c_nationkey").alias("site")
    middle = customers.select(site, segment.alias("id"), (F.col("c_nationkey") + 101).cast("bigint").alias("parent"), F.col("c_mktsegment").alias("slug")).distinct()
    leaves = customers.select(
        site, (F.col("c_custkey") + 100001).alias("id"), segment.alias("parent"), F.replace(F.col("c_name"), F.lit("#"), F.lit(": ")).alias("slug")
    )
    nodes = top.unionByName(middle).unionByName(leaves)
    fields = {"id": F.col("id"), "parent": F.col("parent"), "slug": F.col("slug"), "name": F.col("slug"), "taxonomy": F.lit("category")}
    return nodes.select("site", F.col("id").alias("ord"), *entity_columns(CATEGORY, fields))


def store_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in which a store had orders, with their number."""
    posts = order_posts(spark, sf_dir).select("site", F.col("tags")[0].alias("id"))
    years = posts.groupBy("site", "id").count()
    fields = {"id": F.col("id"), "count": F.col("count"), "name": cat("Year ", F.col("id")), "slug": F.col("id").cast("string"), "taxonomy": F.lit("post_tag")}
    return years.select("site", F.col("id").alias("ord"), *entity_columns(TAG, fields))


def store_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    fields = {
        "id": F.col("c_custkey"),
        "name": F.col("c_name"),
        "slug": F.lower("c_name"),
        "url": cat("https://shop.example.com/u/", F.col("c_custkey")),
        "avatar_urls": F.create_map(F.lit("24"), cat("https://shop.example.com/a/", F.col("c_custkey"), ".png")),
    }
    return customers.select(store_site("c_nationkey").alias("site"), F.col("c_custkey").alias("ord"), *entity_columns(USER, fields))


def store_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier")
    fields = {
        "id": F.col("s_suppkey"),
        "slug": F.lower("s_name"),
        "title": _rendered(F.col("s_name")),
        "mime_type": F.lit("image/png"),
        "source_url": cat("https://cdn.example.com/", F.col("s_suppkey"), ".png"),
    }
    return suppliers.select(store_site("s_nationkey").alias("site"), F.col("s_suppkey").alias("ord"), *entity_columns(MEDIA, fields))


def store_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation")
    fields = {"name": F.col("n_name"), "url": cat("https://shop.example.com/", F.col("n_nationkey")), "language": F.lit("en"), "start_of_week": F.lit(1).cast("bigint")}
    return nations.select(store_site("n_nationkey").alias("site"), *entity_columns(SITE, fields))


def store_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an image each, which is media of the same store for some of them; private ones are pages."""
    image = cat('<img src="https://cdn.example.com/', F.col("author") % 97 + 1, '.png">')
    return (
        order_posts(spark, sf_dir)
        .withColumn("content", F.col("content").withField("rendered", F.concat("content.rendered", image)))
        .withColumn("content_type", F.when(F.col("status") == "private", "page").otherwise("post"))
    )


def store_content(spark: SparkSession, sf_dir: str) -> Content:
    return Content(
        sites=store_sites(spark, sf_dir),
        posts=store_posts(spark, sf_dir),
        media=store_media(spark, sf_dir),
        categories=store_categories(spark, sf_dir),
        tags=store_tags(spark, sf_dir),
        users=store_users(spark, sf_dir),
    )


def page_host() -> Column:
    return F.split_part("url", F.lit("/"), F.lit(3))


def page_slug() -> Column:
    """Text after the last slash of the path; empty where the path ends in one."""
    return F.regexp_extract("url", r"^[a-z]+://[^?#]*/([^/?#]*)", 1)


def page_posts(spark: SparkSession, sf_dir: str, content_type: str) -> DataFrame:
    """Raw web pages as posts or pages of their host, with their whole HTML as content."""
    pages = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    fields = {
        "id": F.col("page_id"),
        "date": F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss"),
        "modified": F.lit("unknown"),
        "slug": page_slug(),
        "status": F.lit("publish"),
        "type": F.lit(content_type),
        "link": F.col("url"),
        "title": _rendered(title),
        "content": _rendered(F.col("html")),
        "excerpt": _rendered(F.when(F.col("url").startswith("https:"), cat("<p>", title, "</p>")).otherwise("")),
    }
    return pages.select(
        page_host().alias("site"), F.col("page_id").alias("ord"), F.lit(content_type).alias("content_type"), *entity_columns(POST, fields)
    )


def _size(url: Column) -> Column:
    return F.struct(
        F.lit("").alias("file"),
        F.lit(None).cast("variant").alias("width"),
        F.lit(None).cast("variant").alias("height"),
        F.lit("").alias("mime_type"),
        url.alias("source_url"),
    )


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as media; those with a fragment name no file, insecure ones have no URL at all."""
    pages = read(spark, sf_dir, "pages")
    root = F.regexp_extract("url", r"^([a-z]+://[^/]*/)", 1)
    bare = F.regexp_extract("url", r"^([^?#]*[^?#/])", 1)
    url = F.when(F.col("url").endswith("#top"), root).when(F.col("url").endswith("/"), F.lit("")).otherwise(F.col("url"))
    details_type = next(f.dataType for f in struct_type(MEDIA) if f.name == "media_details")
    sizes = F.create_map(F.lit("large"), _size(cat(bare, "-1024x768.jpg")), F.lit("thumbnail"), _size(cat(bare, "-150x150.jpg?v=1")))
    details = F.struct(
        *[(sizes if f.name == "sizes" else F.lit(None)).cast(f.dataType).alias(f.name) for f in details_type]
    )
    mime = F.when(F.col("url").contains("/en/"), "image/png").when(F.col("url").contains("/fr/"), "application/pdf").otherwise("x/y")
    fields = {"id": F.col("page_id"), "source_url": url, "mime_type": mime, "media_details": details}
    return pages.select(page_host().alias("site"), F.col("page_id").alias("ord"), *entity_columns(MEDIA, fields))


def linked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages whose links are absolute, as content carries them; every third one is a page.

    Each shows the two sizes of the first medium that it links to, one of them by a relative URL, and names that medium in
    its excerpt if it has one.
    """
    posts = page_posts(spark, sf_dir, "post")
    html, home = F.col("content.rendered"), cat("https://", F.col("site"))
    first = F.regexp_extract(html, 'href="(/[^"]*)"', 1)
    absolute = F.replace(html, F.lit('href="/'), cat('href="', home, "/"))
    images = F.when(first != "", cat('<img src="', home, first, '-150x150.png"><img src="/wide', first, '.png">')).otherwise("")
    excerpt = F.col("excerpt.rendered")
    named = F.when((excerpt != "") & (first != ""), cat(excerpt, '<a href="', home, first, '">more</a>')).otherwise(excerpt)
    return posts.select(
        *[c for c in posts.columns if c not in ("content", "excerpt", "content_type")],
        F.col("content").withField("rendered", F.concat(absolute, images)).alias("content"),
        F.col("excerpt").withField("rendered", named).alias("excerpt"),
        F.when(F.col("id") % 3 == 0, "page").otherwise("post").alias("content_type"),
    )


def linked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct link targets of each host as its media, numbered by first occurrence, in two sizes.

    The last medium of a host has a third size, whose URL is what links to the first medium become.
    """
    pages = read(spark, sf_dir, "pages")
    links = pages.select(
        page_host().alias("site"), "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("pos", "href")
    )
    numbered = links.groupBy("site", "href").agg(F.min(F.col("page_id") * 1000000 + F.col("pos")).alias("id"))
    ends = numbered.groupBy("site").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min_by("href", "id").alias("first_href"))
    joined = numbered.join(ends, "site")
    url = cat("https://", F.col("site"), F.col("href"))
    own = F.create_map(F.lit("small"), _size(cat(url, "-150x150.png")), F.lit("wide"), _size(cat("/wide", F.col("href"), ".png")))
    local = cat("media/", F.col("first_id"), "_", F.translate(F.substring("first_href", 2, 1 << 20), '\\:*?"<>|', "________"))
    sizes = F.when((F.col("id") == F.col("last_id")) & (F.col("id") > F.col("first_id")), F.map_concat(own, F.create_map(F.lit("zchain"), _size(local)))).otherwise(own)
    details_type = next(f.dataType for f in struct_type(MEDIA) if f.name == "media_details")
    details = F.struct(*[(sizes if f.name == "sizes" else F.lit(None)).cast(f.dataType).alias(f.name) for f in details_type])
    fields = {"id": F.col("id"), "source_url": url, "mime_type": F.lit("image/png"), "media_details": details}
    return joined.select("site", F.col("id").alias("ord"), *entity_columns(MEDIA, fields))


def _json_page(record: Column) -> Column:
    """The records of a group as one JSON array, by id."""
    ordered = F.array_sort(F.collect_list(F.struct("id", F.to_json(record).alias("json"))))
    return cat("[", F.array_join(F.transform(ordered, lambda r: r["json"]), ","), "]")


def _with_end(pages: DataFrame) -> DataFrame:
    """Add the answer to the request after the last page."""
    ends = pages.groupBy("site", "endpoint").agg((F.max("page") + 1).alias("page"))
    return pages.unionByName(
        ends.select("site", "endpoint", "page", F.lit(400).alias("status"), F.lit('{"code":"rest_post_invalid_page_number"}').alias("body"))
    )


def page_of(record_id: Column) -> Column:
    return (F.floor(record_id / IDS_PER_PAGE) + 1).cast("int")


def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured listings; private ones are pages. A few listing pages answered with an error.

    Captures lie in storage, so they are landed: what reads them several times doesn't make them again.
    """
    posts = order_posts(spark, sf_dir, broken=(F.col("o_totalprice") > 499000) & (F.col("o_orderstatus") == "F"))
    record = F.struct("id", "date", "modified", "slug", "status", "link", "title", "content", "excerpt", "author", "featured_media", "categories", "tags")
    pages = (
        posts.groupBy("site", F.when(F.col("status") == "private", "pages").otherwise("posts").alias("endpoint"), page_of(F.col("id")).alias("page"))
        .agg(F.when(F.bool_or("broken"), 500).otherwise(200).alias("status"), _json_page(record).alias("body"))
    )
    return _with_end(landed(pages.select("site", "endpoint", "page", "status", "body")))


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as captured media listings of their host."""
    pages = read(spark, sf_dir, "pages")
    width = F.length("html")
    body = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_id", "url", width.alias("width")))),
                lambda r: cat(
                    '{"id":', r["page_id"], ',"source_url":"', r["url"], '","meta":[],"media_details":{"width":', r["width"],
                    ',"height":"', r["width"], '","sizes":{"thumb":{"width":150,"source_url":"', r["url"], '&thumb"}}}}',
                ),
            ),
            ",",
        ),
        F.lit("]"),
    )
    listed = pages.groupBy(page_host().alias("site"), F.lit("media").alias("endpoint"), (F.floor(F.col("page_id") / 100) + 1).cast("int").alias("page"))
    return _with_end(listed.agg(F.lit(200).alias("status"), body.alias("body")).select("site", "endpoint", "page", "status", "body"))


def _listing_of(rows: DataFrame, endpoint: str, record: Column) -> DataFrame:
    pages = rows.groupBy("site", F.lit(endpoint).alias("endpoint"), page_of(F.col("id")).alias("page")).agg(
        F.lit(200).alias("status"), _json_page(record).alias("body")
    )
    return _with_end(pages.select("site", "endpoint", "page", "status", "body"))


def term_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = _listing_of(
        store_categories(spark, sf_dir), "categories", F.struct("id", "name", "slug", "taxonomy", "parent")
    )
    tags = _listing_of(store_tags(spark, sf_dir), "tags", F.struct("id", "count", "name", "slug", "taxonomy"))
    return categories.unionByName(tags)


def user_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing_of(store_users(spark, sf_dir), "users", F.struct("id", "name", "slug", "url", "avatar_urls"))


def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers to listing requests: one listing per user and event type, pages in event order."""
    value = F.col("value")
    events = read(spark, sf_dir, "events")
    status = F.when(value > 190, 400).when(value > 150, 500).otherwise(200)
    record = cat('{"id":', F.col("event_id"), "}")
    body = (
        F.when(value < 1, "[]").when(value < 2, "[{").when(value < 3, cat("[", record, ",7,", record, "]"))
        .when(value < 4, cat("[", record, ",null]")).otherwise(cat("[", record, "]"))
    )
    return events.select(
        cat("user-", F.col("user_id")).alias("site"), F.col("event_type").alias("endpoint"), F.col("event_id").cast("int").alias("page"),
        status.alias("status"), body.alias("body"),
    )


def typed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as listings of posts of one user each, with fields of other types than theirs; pages in event order."""
    kind, key = F.col("event_type"), F.col("event_id")
    record = (
        F.when(kind == "click", cat('{"id":"', key, '","slug":"s"}'))
        .when(kind == "purchase", cat('{"id":', key, ',"slug":["q"],"sticky":null,"title":{"rendered":', key, "}}"))
        .when(kind == "error", cat('{"id":', key, ',"categories":[1,"', key, '"],"content":[],"author":1.5}'))
        .otherwise(cat('{"id":', key, ',"slug":"s","title":{"rendered":"t"},"categories":[1],"meta":[]}'))
    )
    events = read(spark, sf_dir, "events")
    return events.select(
        cat("user-", F.col("user_id")).alias("site"), F.lit("posts").alias("endpoint"), key.cast("int").alias("page"),
        F.lit(200).alias("status"), cat("[null,", record, "]").alias("body"),
    )


def customer_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and root answers of one site per customer."""
    customers = read(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    site = cat("c-", F.col("c_custkey"))
    settings = customers.select(
        site.alias("site"), F.lit("settings").alias("endpoint"), F.lit(1).alias("page"), F.when(balance > 5000, 200).otherwise(401).alias("status"),
        F.when(balance > 9000, "<html>").otherwise(cat('{"title":"t","url":"https://s/', F.col("c_custkey"), '","start_of_week":', F.col("c_nationkey"), ',"language":"en"}')).alias("body"),
    )
    root = customers.filter(balance > 0).select(
        site.alias("site"), F.lit("root").alias("endpoint"), F.lit(1).alias("page"), F.lit(200).alias("status"),
        F.when(balance < 1000, "{").otherwise(cat('{"name":"', F.col("c_name"), '","description":"', F.col("c_mktsegment"), '","home":"https://h/', F.col("c_custkey"), '"}')).alias("body"),
    )
    return settings.unionByName(root)


def _xml(value: Column) -> Column:
    escaped = value
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def _xml_member(name: str, kind: str, value: Column) -> Column:
    return cat(f"<member><name>{name}</name><value><{kind}>", _xml(value.cast("string")), f"</{kind}></value></member>")


def _xml_record(name: str, *members: Column) -> Column:
    return cat(f"<member><name>{name}</name><value><struct>", *members, "</struct></value></member>")


def _xml_list(name: str, *members: Column) -> Column:
    """A member that is a list of one record."""
    return cat(f"<member><name>{name}</name><value><array><data>\n<value><struct>", *members, "</struct></value>\n</data></array></value></member>")


_XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<methodResponse><params><param><value><array><data>'
_XML_TAIL = "</data></array></value></param></params></methodResponse>"


def _calls(rows: DataFrame, method: str, members: list[Column], paged: bool = False) -> DataFrame:
    """Captured calls, the records of one id range per call.

    Paged calls of a site follow each other by offset, and ten sites have one that failed; otherwise every
    range is a site of its own with a single call.
    """
    record = cat("<value><struct>", *members, "</struct></value>")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("id"), record.alias("xml"))))
    block = F.floor(F.col("id") / IDS_PER_PAGE)
    site = F.col("site") if paged else cat(F.col("site"), "-", block)
    offset = (block * 100).cast("int") if paged else F.lit(0)
    calls = rows.groupBy(site.alias("site"), F.lit(method).alias("method"), offset.alias("offset"))
    digit = F.try_element_at(F.regexp_extract_all("site", F.lit("^site-([0-9])$"), F.lit(1)), F.lit(1)).cast("int")
    failed = (offset == digit % 3 * 100) if paged else F.lit(False)
    return calls.agg(
        F.first(F.when(failed, 503).otherwise(200)).alias("status"),
        cat(_XML_HEAD, F.array_join(F.transform(ordered, lambda r: r["xml"]), ""), _XML_TAIL).alias("body"),
    )


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured XML-RPC calls for posts."""
    posts = order_posts(spark, sf_dir)
    members = [
        _xml_member("post_id", "string", F.col("id")),
        _xml_member("post_title", "string", F.col("title.rendered")),
        _xml_member("post_date", "dateTime.iso8601", F.regexp_replace("date", "-", "")),
        _xml_member("post_name", "string", F.col("slug")),
        _xml_member("post_status", "string", F.col("status")),
        _xml_member("post_author", "string", F.col("author")),
        _xml_member("link", "string", F.col("link")),
        _xml_member("post_content", "string", F.col("content.rendered")),
    ]
    return _calls(posts, "wp.getPosts", members, paged=True)


def post_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as captured XML-RPC calls: private ones as pages, the others as posts."""
    posts = order_posts(spark, sf_dir)
    stamp = F.regexp_replace("date", "-", "")
    thumbnail = _xml_record("post_thumbnail", _xml_member("attachment_id", "string", F.col("featured_media")))
    # A custom field whose value holds lists of records of lists of records.
    innermost = _xml_member("c", "string", cat(F.col("title.rendered"), " <b> & \\"))
    custom = _xml_list("custom_fields", _xml_member("id", "int", F.col("id")), _xml_member("key", "string", F.lit("deep")), _xml_record("value", _xml_list("a", _xml_list("b", innermost))))
    post_members = [
        _xml_member("post_id", "string", F.col("id")), _xml_member("post_title", "string", F.col("title.rendered")),
        _xml_member("post_date", "dateTime.iso8601", stamp), _xml_member("post_name", "string", F.col("slug")),
        _xml_member("post_status", "string", F.col("status")), _xml_member("post_author", "string", F.col("author")),
        _xml_member("link", "string", F.col("link")), _xml_member("post_content", "string", F.col("content.rendered")), thumbnail, custom,
    ]
    page_members = [
        _xml_member("page_id", "string", F.col("id")), _xml_member("title", "string", F.col("title.rendered")),
        _xml_member("dateCreated", "dateTime.iso8601", stamp), _xml_member("wp_slug", "string", F.col("slug")),
        _xml_member("page_status", "string", F.col("status")), _xml_member("wp_author_id", "string", F.col("author")),
        _xml_member("permaLink", "string", F.col("link")), _xml_member("description", "string", F.col("content.rendered")),
    ]
    private = F.col("status") == "private"
    return _calls(posts.where(~private), "wp.getPosts", post_members).unionByName(_calls(posts.where(private), "wp.getPages", page_members))


def customer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, categories and tags as captured XML-RPC calls; one call per site and method."""
    users = store_users(spark, sf_dir)
    media = store_media(spark, sf_dir)
    named = ("site", "id", "slug", "taxonomy")
    terms = store_categories(spark, sf_dir).select(*named, "parent").unionByName(
        store_tags(spark, sf_dir).select(*named, F.lit(0).cast("bigint").alias("parent"))
    )
    sites = store_sites(spark, sf_dir)
    user_calls = _calls(users, "wp.getUsers", [
        _xml_member("user_id", "string", F.col("id")), _xml_member("display_name", "string", F.col("name")),
        _xml_member("nicename", "string", F.col("slug")), _xml_member("url", "string", F.col("url")),
    ])
    media_calls = _calls(media, "wp.getMediaLibrary", [
        _xml_member("attachment_id", "string", F.col("id")), _xml_member("link", "string", F.col("source_url")),
        _xml_member("title", "string", F.col("title.rendered")), _xml_member("type", "string", F.col("mime_type")),
        _xml_record("metadata", _xml_member("width", "int", F.col("id") % 2000), _xml_member("file", "string", cat(F.col("id"), ".png")),
            _xml_record("sizes", _xml_record("thumbnail", _xml_member("file", "string", cat(F.col("id"), "-150x150.png")), _xml_member("width", "int", F.lit(150))))),
    ])
    term_calls = _calls(terms, "wp.getTerms", [
        _xml_member("term_id", "string", F.col("id")), _xml_member("slug", "string", F.col("slug")),
        _xml_member("taxonomy", "string", F.col("taxonomy")), _xml_member("parent", "string", F.col("parent")),
    ])
    option = cat("<value><struct>", _xml_member("desc", "string", F.lit("Title")), _xml_member("value", "string", F.col("name")), "</struct></value>")
    options = sites.select(
        "site", F.lit("wp.getOptions").alias("method"), F.lit(0).alias("offset"), F.lit(200).alias("status"),
        cat("<methodResponse><params><param><value><struct><member><name>blog_title</name>", option, "</member></struct></value></param></params></methodResponse>").alias("body"),
    )
    return user_calls.unionByName(media_calls).unionByName(term_calls).unionByName(options)


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers to XML-RPC calls: records, faults, junk and failed requests."""
    kind = F.col("event_type")
    record = cat("<value><struct>", _xml_member("post_id", "int", F.col("event_id")), "</struct></value>")
    fault = cat("<methodResponse><fault><value><struct>", _xml_member("faultCode", "int", F.lit(403)), "</struct></value></fault></methodResponse>")
    body = (
        F.when(kind == "error", fault)
        .when(kind == "click", F.lit("<html>busy</html>"))
        .when(kind == "signup", cat("<methodResponse><params><param><value><string>", F.col("event_id"), "</string></value></param></params></methodResponse>"))
        .otherwise(cat(_XML_HEAD, record, record, _XML_TAIL))
    )
    return read(spark, sf_dir, "events").select(
        cat("user-", F.col("user_id")).alias("site"), F.lit("wp.getPosts").alias("method"), F.col("event_id").cast("int").alias("offset"),
        F.when((kind == "purchase") & (F.col("value") > 50), 503).otherwise(200).alias("status"), body.alias("body"),
    )


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by id: orders as posts, customers as pages, documents as media."""
    orders = read(spark, sf_dir, "orders").select(
        F.lit("posts").alias("content_type"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 404).otherwise(500).alias("status"),
        cat('{"id":', F.col("o_orderkey"), ',"slug":"', F.col("o_orderpriority"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise('"}')).alias("body"),
    )
    customers = read(spark, sf_dir, "customer").select(
        F.lit("pages").alias("content_type"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, 200).otherwise(404).alias("status"),
        cat('{"id":', F.col("c_custkey"), ',"slug":"', F.col("c_mktsegment"), '"}').alias("body"),
    )
    documents = read(spark, sf_dir, "documents").select(
        F.lit("media").alias("content_type"), F.col("doc_id").alias("id"), F.lit(200).alias("status"),
        cat('{"id":', F.col("doc_id"), ',"slug":"', F.col("source"), '"}').alias("body"),
    )
    return orders.unionByName(customers).unionByName(documents).select(F.lit("store").alias("site"), "content_type", "id", "status", "body")


def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids the listings hold: ordered, active and labelled ones."""
    sources = (("lineitem", "l_orderkey", "posts"), ("events", "user_id", "pages"), ("labels", "doc_id", "media"))
    parts = [
        read(spark, sf_dir, name).select(F.lit("store").alias("site"), F.lit(kind).alias("content_type"), F.col(key).alias("id"))
        for name, key, kind in sources
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def lookup_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 1 to the largest id looked up, per content type."""
    return lookups(spark, sf_dir).groupBy("site", "content_type").agg(F.lit(1).cast("bigint").alias("first_id"), F.max("id").alias("last_id"))


def download_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as download attempts for the page their user id names; the time of day gives the attempt."""
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"),
        (F.floor(F.minute("ts") / 10) + 1).cast("int").alias("attempt"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), 200).when(F.col("event_type") == "error", 500).otherwise(404).alias("status"),
    )
    hosts = read(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id"), page_host().alias("site"))
    return events.join(hosts, "media_id").select("site", "media_id", "attempt", "status")


def present_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the pages that were not fetched securely are already there."""
    pages = read(spark, sf_dir, "pages").filter(F.col("url").startswith("http:"))
    return pages.select(page_host().alias("site"), cat(F.col("page_id"), "_", F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1)).alias("file"))
