"""Category hierarchies and the folder of each post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.folders import join_folders, link_folder
from sitefold.functions.names import folder_name
from sitefold.operators.joins import BROADCAST_BYTES, fits_broadcast, lookup_join, materialised

# Folder of posts without a category, and the category name that
# counts as none.
UNCATEGORIZED = "uncategorized"
GENERIC_CATEGORY = "posts"

# Depth resolved before looking for parent cycles.
TRUSTED_DEPTH = 64


def latest_categories(categories: DataFrame) -> DataFrame:
    """One row per (site, id); a later duplicate wins."""
    return (
        categories.groupBy("site", "id")
        .agg(F.max_by(F.struct("slug", "parent"), "ord").alias("latest"))
        .select("site", "id", "latest.slug", "latest.parent")
    )


def _jump(left: DataFrame, right: DataFrame, how: str, bound: int) -> DataFrame:
    """Follow ``up`` one step: join each node to the row of the ancestor it points at.

    Most nodes are leaves, at which none points. Of a large table only the rows pointed at are kept, so these are often broadcast.
    """
    ancestors = right.withColumnRenamed("id", "up")
    if not fits_broadcast(ancestors, bound):
        targets = materialised(left.select("site", "up").distinct())
        ancestors = materialised(lookup_join(ancestors, targets, ["site", "up"], "left_semi", ["up"], bound))
    return lookup_join(left, ancestors, ["site", "up"], how, ["id"], bound)


def _edges(nodes: DataFrame, bound: int) -> DataFrame:
    """Nodes with ``up`` set to the parent where the parent exists, NULL for roots."""
    children = nodes.filter("parent > 0").withColumn("up", F.col("parent"))
    known = nodes.select("site", "id", F.lit(True).alias("exists"))
    checked = _jump(children, known, "left", bound).withColumn("up", F.when(F.col("exists"), F.col("up"))).drop("exists")
    return nodes.filter("parent <= 0").withColumn("up", F.lit(None).cast("bigint")).unionByName(checked)


def _cycle_members(edges: DataFrame, bound: int) -> DataFrame:
    """(site, id) of categories that are their own ancestor.

    The number of jumps doubles each round. Once it reaches the size of the
    largest site, every pointer still alive ends on a cycle, and each cycle
    member is the end of some pointer.
    """
    largest = edges.groupBy("site").count().agg(F.max("count")).first()[0] or 0
    pointers = materialised(edges.filter("up IS NOT NULL").select("site", "id", "up"))
    jumps = 1
    while jumps < largest and not pointers.isEmpty():
        targets = pointers.select("site", "id", F.col("up").alias("next"))
        pointers = materialised(
            _jump(pointers, targets, "inner", bound).select("site", "id", F.col("next").alias("up"))
        )
        jumps *= 2
    return pointers.select("site", F.col("up").alias("id")).distinct()


def category_paths(categories: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(site, id, slug, depth, path, in_cycle), ``path`` being the folder from the root down.

    Each round joins every unresolved node to the ancestor it has reached, so
    the resolved depth doubles per round and a tree of depth d takes log2(d)
    joins. Every round is materialised. Members of a parent cycle are reported
    and start paths of their own. Tables within ``bound`` bytes are broadcast.
    """
    nodes = materialised(latest_categories(categories).withColumn("names", F.array(folder_name("slug"))))
    columns = ["site", "id", "slug", "names", "up", "in_cycle"]
    edges = materialised(_edges(nodes, bound).withColumn("in_cycle", F.lit(False)).select(*columns))
    state, depth, trusted = edges, 1, False
    while not state.filter("up IS NOT NULL").isEmpty():
        if depth >= TRUSTED_DEPTH and not trusted:
            trusted = True
            cycles = materialised(_cycle_members(edges, bound))
            if not cycles.isEmpty():
                members = cycles.withColumn("member", F.lit(True))
                flagged = edges.drop("in_cycle").join(members, ["site", "id"], "left")
                state = materialised(
                    flagged.withColumn("in_cycle", F.coalesce("member", F.lit(False)))
                    .withColumn("up", F.when(~F.col("in_cycle"), F.col("up")))
                    .select(*columns)
                )
                depth = 1
                continue
        above = state.select("site", "id", F.col("names").alias("above"), F.col("up").alias("next"))
        advanced = _jump(state.filter("up IS NOT NULL"), above, "inner", bound).select(
            "site", "id", "slug", F.concat("above", "names").alias("names"), F.col("next").alias("up"), "in_cycle"
        )
        state = materialised(state.filter("up IS NULL").unionByName(advanced))
        depth *= 2
    return state.select(
        "site",
        "id",
        "slug",
        F.size("names").alias("depth"),
        join_folders("names").alias("path"),
        "in_cycle",
    )


def first_category(categories: Column) -> Column:
    return F.try_element_at(categories, F.lit(1))


def with_category_folder(posts: DataFrame, paths: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``folder``: from the permalink, else the path of the first category.

    ``paths`` comes from ``category_paths``. While it fits ``bound``, posts are
    not shuffled. Beyond that, posts settled by their permalink get a join key of their own, so neither
    they nor posts of one popular category gather in one task.
    """
    keyed = posts.withColumn("link_folder", link_folder("link")).withColumn(
        "category_key",
        F.coalesce(
            F.when(F.col("link_folder") == "", first_category(F.col("categories"))),
            F.xxhash64("site", "ord").bitwiseOR(F.lit(-(1 << 63))),
        ),
    )
    # Ids are positive; anything else cannot name a category.
    lookup = paths.filter("id > 0").select("site", F.col("id").alias("category_key"), F.col("path").alias("category_path"))
    joined = lookup_join(keyed, lookup, ["site", "category_key"], "left", ["ord"], bound)
    path = F.nullif(F.col("category_path"), F.lit(GENERIC_CATEGORY))
    return joined.withColumn(
        "folder",
        F.coalesce(F.nullif(F.col("link_folder"), F.lit("")), path, F.lit(UNCATEGORIZED)),
    ).drop("link_folder", "category_key", "category_path")
