"""Markdown documents: front matter, body, path, and which write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.markup import html_to_markdown_sql, yaml_text_sql
from sitefold.functions.names import markdown_file_name
from sitefold.functions.sqltext import column, lit, text
from sitefold.functions.times import ZERO_TIME, print_time_sql
from sitefold.operators.joins import BROADCAST_BYTES, SLICES, fits_broadcast, lookup_join, materialised
from sitefold.operators.taxonomy import with_category_folder


def _quoted(name: str, value: str) -> str:
    return f"concat({lit(name + ': ' + chr(34))}, {text(value)}, {lit(chr(34))})"


def _plain(name: str, value: str) -> str:
    return f"concat({lit(name + ': ')}, {value})"


def _positive(name: str) -> str:
    return f"CASE WHEN {name} > 0 THEN {_plain(name, name)} END"


def _id_list(name: str) -> str:
    lines = f"array_join(transform({name}, i -> concat({lit(chr(10) + '  - ')}, i)), '')"
    return f"CASE WHEN size({name}) > 0 THEN concat({lit(name + ':')}, {lines}) END"


def _front_matter_sql(content_type: str, unreadable_time: str) -> str:
    lines = [
        "'---'",
        _plain("id", "id"),
        _quoted("title", yaml_text_sql("title.rendered")),
        _quoted("slug", "slug"),
        _plain("date", print_time_sql("date", unreadable_time)),
        _plain("modified", print_time_sql("modified", unreadable_time)),
        _quoted("status", "status"),
        _quoted("type", lit(content_type)),
        _quoted("link", "link"),
        _positive("author"),
        _positive("featured_media"),
        _id_list("categories"),
        _id_list("tags"),
        "'---'",
    ]
    return f"concat_ws({lit(chr(10))}, {', '.join(lines)})"


def front_matter(content_type: str, unreadable_time: str = ZERO_TIME) -> Column:
    """The lines from rule to rule for a row of posts; optional fields only where set."""
    return column(_front_matter_sql(content_type, unreadable_time))


def document_text(content_type: str, unreadable_time: str = ZERO_TIME) -> Column:
    """Front matter, title, excerpt if there is one, and content."""
    gap = chr(10) * 2
    excerpt = (
        f"CASE WHEN {text('excerpt.rendered')} = '' THEN '' ELSE "
        f"concat({lit('## Excerpt' + gap)}, {html_to_markdown_sql('excerpt.rendered')}, {lit(gap)}) END"
    )
    parts = [
        _front_matter_sql(content_type, unreadable_time),
        lit(gap + "# "),
        text("title.rendered"),
        lit(gap),
        excerpt,
        lit("## Content" + gap),
        html_to_markdown_sql("content.rendered"),
    ]
    return column(f"concat({', '.join(parts)})")


def contested_paths(rows: DataFrame) -> DataFrame:
    """(w_site, w_path, last_ord) of the paths that several rows write, with the largest ``ord`` among them."""
    return materialised(
        rows.groupBy("site", "path")
        .agg(F.max("ord").alias("last_ord"), F.count(F.lit(1)).alias("writes"))
        .filter("writes > 1")
        .select(F.col("site").alias("w_site"), F.col("path").alias("w_path"), "last_ord")
    )


def last_writes(rows: DataFrame, bound: int = BROADCAST_BYTES, contested: DataFrame | None = None) -> DataFrame:
    """Of the rows with equal (site, path), the one with the largest ``ord``.

    Only paths written more than once leave the aggregation, and rows that lose
    are removed by an anti-join against them. Usually few paths collide; those
    are broadcast and the rows with their texts are not shuffled. Beyond the
    bound, the rows of one path are spread over slices.
    """
    contested = contested_paths(rows) if contested is None else contested
    overwritten = (
        (F.col("site") == F.col("w_site")) & (F.col("path") == F.col("w_path")) & (F.col("ord") < F.col("last_ord"))
    )
    if fits_broadcast(contested, bound):
        return rows.join(F.broadcast(contested), overwritten, "left_anti")
    repeated = contested.withColumn("w_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    same_slice = F.pmod(F.xxhash64("ord"), F.lit(SLICES)).cast("int") == F.col("w_slice")
    return rows.join(repeated, overwritten & same_slice, "left_anti")


def post_documents(posts: DataFrame, paths: DataFrame, unreadable_time: str = ZERO_TIME, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(site, path, content) of posts, in folders by category.

    Two posts can only write one path if they have one file name. Names are cheap and read no text, so they are counted
    first; only posts whose name occurs again are placed in their folders to see which paths collide. The documents are
    then made in a single pass over the posts, which lands nothing.
    """
    named = posts.filter("content_type = 'post'").withColumn("file_name", markdown_file_name("slug", "id"))
    repeated = materialised(named.groupBy("site", "file_name").count().where("count > 1").select("site", "file_name"))

    def placed(rows: DataFrame) -> DataFrame:
        folder = F.nullif(F.col("folder"), F.lit("."))
        return with_category_folder(rows, paths, bound).withColumn("path", F.concat_ws("/", F.lit("posts"), folder, "file_name"))

    rivals = lookup_join(named, repeated, ["site", "file_name"], "left_semi", ["ord"], bound)
    contested = contested_paths(placed(rivals).select("site", "path", "ord"))
    return last_writes(placed(named), bound, contested).select("site", "path", document_text("post", unreadable_time).alias("content"))


def page_documents(posts: DataFrame, unreadable_time: str = ZERO_TIME) -> DataFrame:
    """(site, path, content) of pages, all in one folder."""
    placed = posts.filter("content_type = 'page'").withColumn(
        "path", F.concat(F.lit("pages/"), markdown_file_name("slug", "id"))
    )
    return last_writes(placed).select("site", "path", document_text("page", unreadable_time).alias("content"))


def site_readmes(sites: DataFrame, exported_at: str) -> DataFrame:
    """(site, path, content) of the overview of each site."""
    facts = (
        ("Description", "description"),
        ("URL", "url"),
        ("Home URL", "home_url"),
        ("Admin Email", "admin_email"),
        ("Timezone", "timezone"),
        ("Language", "language"),
    )
    lines = [
        f"concat('# ', {text('name')})",
        "''",
        *[f"concat({lit(f'**{label}:** ')}, {text(name)}, '  ')" for label, name in facts],
        "''",
        "'---'",
        "''",
        lit(f"*Exported on {exported_at}*"),
        "''",
    ]
    content = column(f"concat_ws({lit(chr(10))}, {', '.join(lines)})")
    return sites.select("site", F.lit("README.md").alias("path"), content.alias("content"))
