"""What keeps the cost of large tables in proportion to them."""

from pyspark.sql import functions as F

from sitefold.functions.folders import link_folder
from sitefold.operators import joins, rewrite
from sitefold.plans import stand_ins

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_lookup_side_beyond_the_bound_is_not_repeated(spark):
    left = spark.range(1000).selectExpr("id % 7 AS k", "id")
    right = joins.materialised(spark.range(5).selectExpr("id AS k", "id * 10 AS v"))
    joined = joins.lookup_join(left, right, ["k"], "left", ["id"], -1)
    assert "Generate" not in plan(joined) and joined.where("v IS NOT NULL").count() == sum(i % 7 < 5 for i in range(1000))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        spread = joins.lookup_join(left, right, ["k"], "left", ["id"], -1)
        assert "Generate" in plan(spread) and sorted(spread.collect()) == sorted(joined.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def test_captured_listings_are_made_once(spark):
    assert "collect_list" not in plan(stand_ins.order_listing(spark, SF))


def test_only_surroundings_of_replacements_are_searched_again(spark):
    far, near = "x" * 500 + "http://u" + "y" * 500 + "http://u" + "z" * 500, "ahttp://ubhttp://uc"
    swaps = [(("http://u", "media/1"),)]
    rows = spark.createDataFrame([(text, [s[0] for s in swaps]) for text in (far, near)], "t STRING, swaps ARRAY<STRUCT<url: STRING, local_path: STRING>>")
    parts = [r.parts for r in rows.selectExpr(f"{rewrite._formed('t', 20)} AS parts").collect()]
    assert parts[0] == ["x" * 20 + "media/1" + "y" * 20, "y" * 20 + "media/1" + "z" * 20]
    assert parts[1] == ["amedia/1bmedia/1c"]  # closer than a URL is long: one could span both


def test_posts_of_a_site_with_few_urls_are_rewritten_without_moving(spark):
    """What is broadcast is the list of a site's URLs, which doesn't grow with the number of posts."""
    copies = stand_ins.store_posts(spark, SF).crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
    posts = copies.withColumn("ord", F.expr("ord * 20 + copy")).drop("copy").cache()
    items = stand_ins.store_media(spark, SF)
    found = rewrite.occurrences(posts, rewrite.replacements(items)).count()
    bound = found * 64  # neither the replacements of posts nor their keys fit
    rows = rewrite.rewrite_media_links(posts, items, bound=bound)
    assert found > 300 and "Join LeftOuter, (site" in plan(rows) and "content_type#" not in plan(rows).split("Join LeftOuter")[1].splitlines()[0]
    texts = [sorted((r.site, r.id, r.content.rendered) for r in df.select("site", "id", "content").collect()) for df in (rows, rewrite.rewrite_media_links(posts, items, bound=-1))]
    assert texts[0] == texts[1] and any("media/" in t for *_, t in texts[0])


def test_sites_with_few_and_many_urls_are_rewritten_alike(spark, monkeypatch):
    posts, items = stand_ins.linked_posts(spark, SF).cache(), stand_ins.linked_media(spark, SF).cache()
    for exact in (False, True):
        texts = []
        for few in (16, 2, 0):  # lists for most sites, for some, for none
            monkeypatch.setattr(rewrite, "_FEW", few)
            rows = rewrite.rewrite_media_links(posts, items, exact=exact)
            texts.append(sorted((r.site, r.content_type, r.id, r.content.rendered, r.excerpt.rendered) for r in rows.select("site", "content_type", "id", "content", "excerpt").collect()))
        assert texts[0] == texts[1] == texts[2]


def test_a_lookup_side_is_hashed_while_its_shares_fit(spark):
    """The left side with its texts is then not sorted; a larger lookup side is merged as before."""
    left = spark.range(1000).selectExpr("id % 7 AS k", "id")
    right = joins.materialised(spark.range(5).selectExpr("id AS k", "id * 10 AS v"))
    size = joins.measured_bytes(right)
    for bound, hashed in ((size // 2, True), (size // 5, False)):  # four shuffle partitions
        joined = joins.lookup_join(left, right, ["k"], "left", ["id"], bound)
        assert ("ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == hashed
        assert joined.where("v IS NOT NULL").count() == sum(i % 7 < 5 for i in range(1000))


def test_folders_of_links_by_short_and_whole_checks(evaluate):
    cases = {
        "https://h.com/a-post?x=/y/z#top": "", "https://h.com//a-post//": "", "https://h.com/2024/01/02": "", "https://h.com/2024/01/02/b/c/": "",
        "https://h.com/2024/01/02x/c": "02x", "https://h.com/blog/news/a%2Fb+c/p/?q#f": "news/a/b+c", "https://h.com/a%zz/b": "", "https://h.com/x/y%41": "x",
        "https://h%41.com/x/y": "", None: "",
    }
    assert evaluate([(link,) for link in cases], "u STRING", link_folder("u")) == list(cases.values())
