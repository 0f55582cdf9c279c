import os
import random

import pytest
from pyspark.sql import functions as F

from sitefold import schemas
from sitefold.operators import discovery, documents, media, rewrite, stats, taxonomy
from sitefold.operators.joins import spread_join
from sitefold.schemas import zero_filled_fields
from sitefold.sources import rest


def table(spark, ddl, rows, extra=""):
    """Rows given as dicts, completed with zero values through the JSON decoder."""
    import json

    data = [(r.pop("site", "s"), r.pop("ord", i), r.pop("content_type", "post"), json.dumps(r)) for i, r in enumerate(map(dict, rows))]
    df = spark.createDataFrame(data, "site string, ord long, content_type string, j string").withColumn("record", F.from_json("j", ddl))
    out = df.select("site", "ord", "content_type", *zero_filled_fields("record", ddl))
    return out if ddl is schemas.POST else out.drop("content_type")


def posts_of(spark, rows):
    return table(spark, schemas.POST, rows)


def media_of(spark, rows):
    return table(spark, schemas.MEDIA, rows)


def test_spread_join_keeps_every_row(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert spread_join(left, right, ["k"], "left", ["id"]).count() == 1000
    assert spread_join(left, right, ["k"], "inner", ["id"]).count() == 667
    assert spread_join(left, right, ["k"], "left_anti", ["id"]).count() == 333
    with pytest.raises(ValueError):
        spread_join(left, right, ["k"], "full", ["id"])


def items_of(spark, rows):
    return spark.createDataFrame(
        [("s", t, i, st, '{"id": %d}' % i if st == 200 else "") for t, i, st in rows], schemas.API_ITEMS
    )


def known_of(spark, rows):
    return spark.createDataFrame([("s", t, i) for t, i in rows], "site string, content_type string, id long")


def test_discovery(spark):
    items = items_of(spark, [("posts", 5, 200), ("pages", 7, 200), ("media", 9, 200), ("posts", 1, 200), ("posts", 11, 200),
                             ("posts", 6, 404), ("posts", 8, 500), ("comments", 2, 200)])
    known = known_of(spark, [("posts", 1), ("pages", 2), ("media", 3)])
    found = discovery.discovered_items(items, known, 10)
    assert {(r.content_type, r.id) for r in found.collect()} == {("posts", 5), ("pages", 7), ("media", 9)}
    assert {(r.content_type, r.found) for r in discovery.discovery_counts(found).collect()} == {("posts", 1), ("pages", 1), ("media", 1)}
    assert discovery.discovered_items(items, known, 10, enabled=False).count() == 0
    again = discovery.discovered_items(items_of(spark, [("posts", 1, 200), ("posts", 3, 200)]), known_of(spark, [("posts", 1), ("posts", 2)]), 5)
    assert [r.id for r in again.collect()] == [3]


def test_id_ranges(spark):
    items = items_of(spark, [("posts", 10, 200), ("posts", 15, 200), ("posts", 20, 200), ("posts", 21, 200)])
    assert discovery.items_in_range(items, "posts", 10, 20).count() == 3
    assert discovery.items_in_range(items, "posts", 20, 10).count() == 0
    with pytest.raises(ValueError):
        discovery.items_in_range(items, "comments", 1, 2)


def test_gap_ids(spark):
    ranges = spark.createDataFrame([("s", "posts", 1, 150_000), ("s", "pages", 5, 4), ("t", "media", 3, 5)],
                                   "site string, content_type string, first_id long, last_id long")
    known = ranges.sparkSession.range(2, 150_000).select(F.lit("s").alias("site"), F.lit("posts").alias("content_type"), "id")
    gaps = discovery.gap_ids(ranges, known.union(known))
    assert {(r.site, r.content_type, r.id) for r in gaps.collect()} == {
        ("s", "posts", 1), ("s", "posts", 150_000), ("t", "media", 3), ("t", "media", 4), ("t", "media", 5)}
    assert discovery.candidate_ids(ranges).count() == 150_003


def test_merge_discovered(spark):
    listed = posts_of(spark, [{"id": 1}, {"id": 2}])
    found = discovery.discovered_records(items_of(spark, [("posts", 2, 200), ("pages", 4, 200)]), "posts")
    merged = discovery.merge_discovered(listed, found).orderBy("ord").collect()
    assert [r.id for r in merged] == [1, 2, 2] and merged[-1].ord == schemas.FOUND_BASE + 2


def categories_of(spark, rows):
    return table(spark, schemas.CATEGORY, [{"id": i, "parent": p, "slug": s} for i, p, s in rows])


def paths_of(spark, rows):
    return {r.id: (r.path, r.depth, r.in_cycle) for r in taxonomy.category_paths(categories_of(spark, rows)).collect()}


def test_category_paths(spark):
    assert paths_of(spark, [(1, 0, "level1"), (2, 1, "level2"), (3, 2, "level3"), (4, 99, "or phan"), (5, -1, ""), (2, 4, "later")]) == {
        1: ("level1", 1, False), 2: ("or-phan/later", 2, False), 3: ("or-phan/later/level3", 3, False),
        4: ("or-phan", 1, False), 5: ("category", 1, False)}
    assert paths_of(spark, []) == {}


def test_deep_and_cyclic_categories(spark):
    deep = [(i, i - 1, f"c{i}") for i in range(1, 101)]
    got = paths_of(spark, deep)
    assert got[100] == ("/".join(f"c{i}" for i in range(1, 101)), 100, False)
    cyclic = deep + [(201, 203, "x"), (202, 201, "y"), (203, 202, "z"), (204, 203, "below"), (300, 300, "self")]
    got = paths_of(spark, cyclic)
    assert got[100][1] == 100
    assert {i: got[i] for i in (201, 202, 203, 300)} == {
        201: ("x", 1, True), 202: ("y", 1, True), 203: ("z", 1, True), 300: ("self", 1, True)}
    assert got[204] == ("z/below", 2, False)


def test_category_folder(spark):
    rows = [(1, 0, "technology"), (2, 1, "programming"), (3, 0, "posts"), (4, 3, "posts")]
    paths = taxonomy.category_paths(categories_of(spark, rows))
    plain = "https://example.com/test-post"
    posts = posts_of(spark, [
        {"id": 1, "categories": [1], "link": plain}, {"id": 2, "categories": [2], "link": plain},
        {"id": 3, "categories": [], "link": plain}, {"id": 4, "categories": [3], "link": plain},
        {"id": 5, "categories": [1], "link": "https://example.com/category/news/test-post"},
        {"id": 6, "categories": [77, 1], "link": plain}, {"id": 7, "categories": [4], "link": plain},
        {"id": 8, "categories": [1], "link": "https://example.com/Posts-x/../posts!/a"},
    ])
    got = {r.id: r.folder for r in taxonomy.with_category_folder(posts, paths).collect()}
    assert got == {1: "technology", 2: "technology/programming", 3: "uncategorized", 4: "uncategorized", 5: "news",
                   6: "uncategorized", 7: "posts/posts", 8: "posts!"}


def test_attempts_and_manifest(spark):
    items = media_of(spark, [
        {"id": 1, "source_url": "https://e/a.jpg"}, {"id": 2, "source_url": ""}, {"id": 3, "source_url": "https://e/%zz"},
        {"id": 4, "source_url": "https://e/d.jpg"}, {"id": 5, "source_url": "https://e/e.jpg"}, {"id": 6, "source_url": "https://e/"},
    ])
    existing = spark.createDataFrame([("s", "1_a.jpg"), ("s", "1_a.jpg"), ("t", "5_e.jpg")], schemas.EXISTING_FILES)
    attempts = spark.createDataFrame(
        [("s", 4, 1, 500), ("s", 4, 4, 200), ("s", 5, 1, 500), ("s", 5, 5, 200)], schemas.ATTEMPTS)
    manifest = media.media_manifest(items, existing, attempts, "/out/media")
    got = {r.media_id: (r.status, r.downloaded, r.file, r.resolved) for r in manifest.collect()}
    assert got == {
        1: ("present", True, "1_a.jpg", True), 2: ("no_url", False, None, False), 3: ("bad_url", False, None, False),
        4: ("downloaded", True, "4_d.jpg", True), 5: ("failed", False, "5_e.jpg", False), 6: ("failed", False, "6_media_6.bin", False)}
    assert media.downloaded_counts(manifest).first().media_downloaded == 2
    assert media.media_manifest(items, existing, attempts, "/x", enabled=False).count() == 0


def test_media_dir():
    assert media.media_dir("/tmp/export/data.json", "json") == "/tmp/export/data_media"
    assert media.media_dir("/tmp/export/dir", "json") == "/tmp/export/dir/media"
    assert media.media_dir("/tmp/export/data.json", "markdown") == "/tmp/export/data.json/media"
    assert media.media_dir("out.json", "json") == os.path.join(os.getcwd(), "out_media")
    assert media.media_dir("a/../b", "markdown") == os.path.join(os.getcwd(), "b", "media")
    assert media.media_dir("s3a://bucket/x/", "json") == "s3a://bucket/x/media"


def test_rewrite_fixture(spark):
    base = "https://example.com/wp-content/uploads/2024/01/"
    items = media_of(spark, [{"id": 1, "source_url": base + "image1.jpg"}, {"id": 2, "source_url": base + "image2.png"}])
    html = f'<p>images: <img src="{base}image1.jpg" alt="1"> and <img src="{base}image2.png" alt="2"></p>'
    posts = posts_of(spark, [{"id": 1, "content": {"rendered": html}, "excerpt": {"rendered": base + "image2.png"}},
                             {"id": 2, "content_type": "page"}])
    first, second = rewrite.rewrite_media_links(posts, items).orderBy("id").collect()
    assert first.content.rendered == '<p>images: <img src="media/1_image1.jpg" alt="1"> and <img src="media/2_image2.png" alt="2"></p>'
    assert first.excerpt.rendered == "media/2_image2.png" and second.content.rendered == ""
    assert rewrite.rewrite_media_links(posts, items, enabled=False).orderBy("id").first().content.rendered == html


def test_rewrite_equals_sequential_replacement(spark):
    """Against a plain loop over media, with URLs that contain, precede and overlap each other."""
    rng = random.Random(7)
    alphabet = ["a", "b", "/", "é", "https://", "http://", "h", ".", "😀", " "]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    starts = ["https://x/", "http://x/", "/", "", "https://x/http://y/"]
    items = []
    for i in range(1, 41):
        item = {"id": i, "ord": i, "source_url": rng.choice(starts) + word(4)}
        item["media_details"] = {"sizes": {f"s{k}": {"source_url": rng.choice(starts) + word(3)} for k in range(rng.randint(0, 2))}}
        items.append(item)
    texts = ["".join(rng.choice([i["source_url"] for i in items] + [word(3)]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    media_df = media_of(spark, items)
    posts = posts_of(spark, [{"id": n, "content": {"rendered": t}} for n, t in enumerate(texts)])
    order = [(r.url, r.local_path) for r in rewrite.replacements(media_df).orderBy("rank").collect()]
    swaps = {r.ord: [(s.url, s.local_path) for s in r.swaps] for r in rewrite.rewrite_candidates(posts, rewrite.replacements(media_df)).collect()}
    for n, text in enumerate(texts):
        present = [p for p in order if p[0] in text]
        assert swaps.get(n, []) == present
    got = {r.id: r.content.rendered for r in rewrite.rewrite_media_links(posts, media_df).collect()}
    for n, text in enumerate(texts):
        for url, path in order:
            if url in texts[n]:
                text = text.replace(url, path)
        assert got[n] == text


def test_exact_rewrite_replays_every_replacement(spark):
    """URLs that only an earlier replacement forms, over several steps, are replaced as well."""
    urls = ["https://a/b", "media/1_b.jpg", "2_1_b.jpg", "media/media/3_2_1_b", "b.jp", "logo", "/x", "media/7_x.png"]
    media_df = media_of(spark, [{"id": i, "ord": i, "source_url": u} for i, u in enumerate(urls, 1)])
    texts = ["see https://a/b.jpg", "b.jp https://a/b and https://a/b.jpgb.jp", "/x.png logo/x", "nothing", "", "media/1_b.jpg" * 3]
    posts = posts_of(spark, [{"id": n, "content": {"rendered": t}, "excerpt": {"rendered": t[::-1] + t}} for n, t in enumerate(texts)])
    order = [(r.url, r.local_path) for r in rewrite.replacements(media_df).orderBy("rank").collect()]

    def replayed(text):
        for url, path in order:
            text = text.replace(url, path)
        return text

    got = {r.id: (r.content.rendered, r.excerpt.rendered) for r in rewrite.rewrite_media_links(posts, media_df, exact=True).collect()}
    assert got == {n: (replayed(t), replayed(t[::-1] + t)) for n, t in enumerate(texts)}
    plain = {r.id: r.content.rendered for r in rewrite.rewrite_media_links(posts, media_df).collect()}
    assert plain[0] != got[0][0]


def test_odd_urls_stay_on_their_site(spark):
    """Pieces are looked for by the URLs of a post's own site only."""
    urls = rewrite.replacements(media_of(spark, [{"id": 1, "ord": 1, "source_url": "https://a/b.jpg"}]))
    odd = urls.unionByName(urls.selectExpr("'other' AS site", "'logo' AS url", "local_path", "rank"))
    shapes = {r.site: r.shapes.asDict(True) for r in rewrite._url_shapes(odd).collect()}
    own = next(v for k, v in shapes.items() if k != "other")
    assert own["bare"] == [] and own["scheme"] == [{"before": 5, "n": 15, "firsts": "h", "lasts": "g"}] and shapes["other"]["scheme"] == []


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("s", "a", 1, "x"), ("s", "a", 3, "z"), ("s", "a", 2, "y"), ("s", "b", 1, "w"), ("t", "a", 0, "v")],
                                 "site string, path string, ord long, content string")
    assert {(r.site, r.path, r.content) for r in documents.last_writes(rows).collect()} == {("s", "a", "z"), ("s", "b", "w"), ("t", "a", "v")}


def test_documents(spark):
    posts = posts_of(spark, [
        {"id": 7, "slug": "hello", "date": "2024-01-15T10:30:45", "modified": "2024-01-16T10:30:45+02:00", "status": "publish",
         "link": "https://e.com/news/hello", "title": {"rendered": 'Say "hi"'}, "content": {"rendered": "<p>One</p><p>Two</p>"},
         "excerpt": {"rendered": "<p>Short</p>"}, "author": 2, "featured_media": 9, "categories": [1, 2], "tags": [3]},
        {"id": 8, "content_type": "page", "title": {"rendered": "P"}, "content": {"rendered": "<h1>x</h1>"}, "date": "bad"},
    ])
    paths = taxonomy.category_paths(categories_of(spark, []))
    doc = documents.post_documents(posts, paths).first()
    assert doc.path == "posts/news/hello.md"
    assert doc.content == (
        '---\nid: 7\ntitle: "Say \\"hi\\""\nslug: "hello"\ndate: 2024-01-15T10:30:45Z\nmodified: 2024-01-16T10:30:45+02:00\n'
        'status: "publish"\ntype: "post"\nlink: "https://e.com/news/hello"\nauthor: 2\nfeatured_media: 9\ncategories:\n  - 1\n  - 2\n'
        'tags:\n  - 3\n---\n\n# Say "hi"\n\n## Excerpt\n\nShort\n\n## Content\n\nOne\n\nTwo')
    page = documents.page_documents(posts, "2025-01-01T00:00:00Z").first()
    assert page.path == "pages/post-8.md"
    assert page.content == (
        '---\nid: 8\ntitle: "P"\nslug: ""\ndate: 2025-01-01T00:00:00Z\nmodified: 0001-01-01T00:00:00Z\nstatus: ""\ntype: "page"\nlink: ""\n---\n\n# P\n\n## Content\n\n# x')


def test_stats(spark):
    sites = spark.createDataFrame([("s",), ("empty",)], "site string")
    posts = posts_of(spark, [{"id": 1}, {"id": 2, "content_type": "page"}, {"id": 3, "ord": schemas.FOUND_BASE + 3}])
    items = media_of(spark, [{"id": 1, "source_url": "https://e/a.jpg"}])
    manifest = media.media_manifest(items, spark.createDataFrame([("s", "1_a.jpg")], schemas.EXISTING_FILES),
                                    spark.createDataFrame([], schemas.ATTEMPTS), "/m")
    cats = categories_of(spark, [(1, 0, "a")])
    got = {r.site: tuple(r)[1:] for r in stats.export_stats(sites, posts, items, cats, cats, cats, manifest).collect()}
    assert got == {"s": (2, 1, 1, 1, 1, 1, 1, 1), "empty": (0,) * 8}


def test_shuffle_paths_equal_broadcast_paths(spark):
    """With a bound of nothing, every lookup takes the spread join and gives the same rows."""
    cats = categories_of(spark, [(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 9, "d"), (5, 5, "self")])
    spread, broadcast = (taxonomy.category_paths(cats, bound) for bound in (-1, 1 << 20))
    assert sorted(spread.collect()) == sorted(broadcast.collect())
    posts = posts_of(spark, [{"id": i, "categories": [i % 6] if i % 7 else [], "link": "https://e.com/x"} for i in range(40)])
    folders = [sorted((r.id, r.folder) for r in taxonomy.with_category_folder(posts, spread, bound).collect()) for bound in (-1, 1 << 20)]
    assert folders[0] == folders[1] and len(folders[0]) == 40
    rows = spark.range(200).selectExpr("'s' AS site", "concat('p', id % 30) AS path", "id AS ord")
    assert [sorted(r.ord for r in documents.last_writes(rows, bound).collect()) for bound in (-1, 1 << 20)] == [list(range(170, 200))] * 2
    pages = [("s", "tags", p, 200, '[{"id":1}]') for p in range(1, 300)] + [("s", "tags", 300, 400, "")]
    listing = spark.createDataFrame(pages, schemas.API_PAGES)
    assert [rest.surviving_pages(listing, bound=bound).count() for bound in (-1, 1 << 20)] == [299, 299]
