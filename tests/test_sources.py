import json

import pytest
from pyspark.sql import functions as F

from sitefold import schemas
from sitefold.sources import captures, rest, rpc, site


def ids(n, start=1):
    return json.dumps([{"id": i} for i in range(start, start + n)])


def test_listing_ends_and_failures(spark):
    rows = [
        ("two-then-400", "posts", 1, 200, ids(2)), ("two-then-400", "posts", 2, 200, ids(1, 3)),
        ("two-then-400", "posts", 3, 400, "{}"), ("two-then-400", "posts", 4, 500, ""),
        ("empty-page", "posts", 1, 200, ids(1)), ("empty-page", "posts", 2, 200, "[]"), ("empty-page", "posts", 3, 200, ids(5)),
        ("null-page", "posts", 1, 200, "null"), ("server-error", "posts", 1, 200, ids(1)), ("server-error", "posts", 2, 500, ""),
        ("bad-json", "posts", 1, 200, ids(1)), ("bad-json", "posts", 2, 200, '[{"id":1'),
        ("object", "posts", 1, 200, "{}"), ("numbers", "posts", 1, 200, "[1,2]"), ("trailing", "posts", 1, 200, "[] x"),
        ("no-end", "posts", 1, 200, ids(2)),
        ("mixed", "posts", 1, 200, '[{"id":1},7,{"id":3}]'), ("mixed", "posts", 2, 200, ids(1, 4)),
        ("text-inside", "posts", 1, 200, '[{"id":1},"{}"]'), ("list-inside", "posts", 1, 200, '[{"id":1},[]]'),
        ("null-inside", "posts", 1, 200, '[{"id":1},null]'),
    ]
    pages = spark.createDataFrame(rows, schemas.API_PAGES)
    counts = {r.site: r["count"] for r in rest.scan_posts(pages).groupBy("site").count().collect()}
    assert counts == {"two-then-400": 3, "empty-page": 1, "no-end": 2, "null-inside": 2}
    failed = {r.site: r.error_page for r in rest.failed_listings(pages).collect()}
    assert failed == {"server-error": 2, "bad-json": 2, "object": 1, "numbers": 1, "trailing": 1, "mixed": 1, "text-inside": 1, "list-inside": 1}


def test_long_listing_spans_page_blocks(spark):
    rows = [("s", "tags", p, 200, ids(1, p)) for p in range(1, 200)] + [("s", "tags", 150, 400, "")]
    rows = [r for r in rows if r[:4] != ("s", "tags", 150, 200)]
    tags = rest.scan_tags(spark.createDataFrame(rows, schemas.API_PAGES))
    assert [r.id for r in tags.orderBy("ord").collect()] == list(range(1, 150))


def test_post_fields(spark):
    body = """[{"id": 5, "date": "2011-07-09T10:04:58", "guid": {"rendered": "g"}, "title": {"rendered": "T"},
      "sticky": true, "meta": [], "categories": [3, 1], "tags": [], "unknown": 1,
      "_links": {"self": [{"href": "h", "targetHints": {}}], "wp:term": [{"href": "w", "taxonomy": "t"}]}}, {}]"""
    pages = spark.createDataFrame([("s", "pages", 1, 200, body)], schemas.API_PAGES)
    first, second = rest.scan_posts(pages).orderBy("ord").collect()
    assert (first.content_type, first.id, first.guid.rendered, first.title.rendered) == ("page", 5, "g", "T")
    assert first.sticky and first.categories == [3, 1] and first["_links"]["wp:term"][0].href == "w"
    assert (second.id, second.slug, second.sticky, second.tags, second.title.rendered) == (0, "", False, [], "")
    assert first.meta.toPython() == [] and first.ord == 1 << 31 and second.ord == (1 << 31) + 1


def test_media_users_terms(spark):
    media = """[{"id": 7, "source_url": "u", "meta": {"a": 1}, "media_details": {"width": 150, "height": "100",
      "sizes": {"thumb": {"file": "f", "width": 10, "source_url": "v"}}}}]"""
    user = '[{"id": 1, "name": "N", "avatar_urls": {"24": "a"}, "meta": []}]'
    pages = spark.createDataFrame(
        [("s", "media", 1, 200, media), ("s", "users", 1, 200, user), ("s", "categories", 1, 200, '[{"id":2,"parent":1}]')],
        schemas.API_PAGES,
    )
    m = rest.scan_media(pages).first()
    assert m.media_details.width.toPython() == 150 and m.media_details.height.toPython() == "100"
    assert m.media_details.sizes["thumb"].source_url == "v"
    assert rest.scan_users(pages).first().avatar_urls == {"24": "a"}
    assert rest.scan_categories(pages).first().parent == 1


def test_item_outcomes(spark):
    rows = [("s", "posts", 1, 200, '{"id":1}'), ("s", "posts", 2, 404, ""), ("s", "posts", 3, 500, ""),
            ("s", "posts", 4, 200, "x"), ("s", "posts", 5, 200, None), ("s", "posts", 6, 200, " null\n")]
    items = spark.createDataFrame(rows, schemas.API_ITEMS)
    got = [r.o for r in items.select("id", rest.item_outcome(F.col("status"), F.col("body")).alias("o")).orderBy("id").collect()]
    assert got == ["found", "missing", "error", "error", "error", "found"]
    assert sorted(r.id for r in rest.decode_items(items, "posts").collect()) == [0, 1]
    with pytest.raises(ValueError):
        rest.decode_items(items, "comments")


def test_site_info(spark):
    rows = [
        ("a", "settings", 1, 200, '{"title":"x","url":"https://a","start_of_week":1,"language":"en"}'),
        ("b", "settings", 1, 401, "{}"), ("b", "root", 1, 200, '{"name":"B","home":"https://b/home","url":"https://b"}'),
        ("c", "settings", 1, 500, ""), ("c", "root", 1, 500, "<html>"),
    ]
    pages = spark.createDataFrame(rows, schemas.API_PAGES)
    sites = spark.createDataFrame([(s, f"https://{s}.example") for s in "abcd"], "site string, url string")
    got = {r.site: (r.name, r.url, r.home_url, r.start_of_week) for r in site.site_info(pages, sites).collect()}
    assert got == {
        "a": ("", "https://a", "", 1), "b": ("B", "https://b", "https://b/home", 0),
        "c": ("WordPress Site", "https://c.example", "", 0), "d": ("WordPress Site", "https://d.example", "", 0),
    }


def member(name, value):
    return f"<member><name>{name}</name><value>{value}</value></member>"


def record(**fields):
    return "<value><struct>" + "".join(member(k, v) for k, v in fields.items()) + "</struct></value>"


def response(records):
    return ('<?xml version="1.0" encoding="UTF-8"?>\n<methodResponse><params><param><value><array><data>'
            + "".join(records) + "</data></array></value></param></params></methodResponse>")


FAULT = ("<methodResponse><fault><value><struct>" + member("faultCode", "<int>403</int>")
         + member("faultString", "<string>no</string>") + "</struct></value></fault></methodResponse>")


def posts_xml(first, n):
    return response(record(post_id=f"<string>{i}</string>", post_title=f" T &lt;{i}&gt; ") for i in range(first, first + n))


def test_rpc_sequences(spark):
    rows = [
        ("a", "wp.getPosts", 0, 200, posts_xml(0, 100)), ("a", "wp.getPosts", 100, 200, posts_xml(100, 3)),
        ("a", "wp.getPosts", 200, 200, posts_xml(200, 5)),
        ("fault", "wp.getPosts", 0, 200, FAULT), ("status", "wp.getPosts", 0, 500, ""), ("junk", "wp.getPosts", 0, 200, "junk"),
        ("late", "wp.getPosts", 0, 200, posts_xml(0, 100)), ("late", "wp.getPosts", 100, 503, ""),
        ("empty", "wp.getPosts", 0, 200, response([])), ("none", "wp.getPosts", 0, 200, "<methodResponse><params></params></methodResponse>"),
    ]
    pages = spark.createDataFrame(rows, schemas.RPC_PAGES)
    outcome = {(r.site, r.offset): r.outcome for r in rpc.rpc_outcomes(pages).collect()}
    assert {k[0] for k, v in outcome.items() if v == "error"} == {"fault", "status", "junk", "late"}
    posts = rpc.rpc_posts(pages).orderBy("ord").collect()
    assert [(p.site, p.id) for p in posts] == [("a", i) for i in range(103)]
    assert posts[1].title.rendered == " T <1> "
    failed = {r.site for r in rpc.offset_cuts(pages).filter("failed").collect()}
    assert failed == {"fault", "status", "junk", "late"}


def test_rpc_entities(spark):
    terms = ("<array><data>" + record(term_id="<string>9</string>", taxonomy="<string>category</string>")
             + record(term_id="<string>4</string>", taxonomy="<string>post_tag</string>") + "</data></array>")
    options = ("<methodResponse><params><param><value><struct>"
               + member("blog_title", "<struct>" + member("desc", "<string>d</string>") + member("value", "<string>Blog</string>") + "</struct>")
               + "</struct></value></param></params></methodResponse>")
    rows = [
        ("a", "wp.getPosts", 0, 200, response([record(post_id="<string>1</string>", sticky="<boolean>1</boolean>", terms=terms,
            post_date="<dateTime.iso8601>20240115T10:30:45</dateTime.iso8601>")])),
        ("a", "wp.getPages", 0, 200, response([record(page_id="<int>2</int>", title="<string>P</string>", description="<string>&lt;p&gt;x&lt;/p&gt;</string>")])),
        ("a", "wp.getMediaLibrary", 0, 200, response([record(attachment_id="<string>3</string>", link="<string>https://a/i.jpg</string>")])),
        ("a", "wp.getTerms", 0, 200, response([record(term_id="<string>9</string>", slug="<string>n</string>", taxonomy="<string>category</string>", parent="<string>0</string>"),
            record(term_id="<string>4</string>", slug="<string>t</string>", taxonomy="<string>post_tag</string>")])),
        ("a", "wp.getUsers", 0, 200, response([record(user_id="<string>5</string>", username="<string>u</string>")])),
        ("a", "wp.getOptions", 0, 200, options),
    ]
    pages = spark.createDataFrame(rows, schemas.RPC_PAGES)
    post, page = rpc.rpc_posts(pages).orderBy("id").collect()
    assert (post.categories, post.tags, post.sticky, post.date) == ([9], [4], True, "2024-01-15T10:30:45")
    assert (page.id, page.content_type, page.title.rendered, page.content.rendered) == (2, "page", "P", "<p>x</p>")
    assert rpc.rpc_media(pages).first().source_url == "https://a/i.jpg"
    assert [r.slug for r in rpc.rpc_categories(pages).collect()] == ["n"]
    assert [r.slug for r in rpc.rpc_tags(pages).collect()] == ["t"]
    assert rpc.rpc_users(pages).first().name == "u"
    assert rpc.rpc_site_info(pages).first().name == "Blog"


def test_call_ends_are_joined_alike_beyond_the_broadcast_bound(spark):
    """Sequences that end, fail and go on over several blocks of offsets, by broadcast and by a spread shuffle."""
    item = "<value><struct><member><name>post_id</name><value><int>1</int></value></member></struct></value>"
    head, tail = "<methodResponse><params><param><value><array><data>", "</data></array></value></param></params></methodResponse>"
    full, short = head + item * rpc.PAGE_SIZE + tail, head + item + tail
    rows = [("long", "wp.getPosts", n * 100, 200, full) for n in range(70)] + [("long", "wp.getPosts", 7000, 200, short), ("long", "wp.getPosts", 7100, 200, short)]
    rows += [("fails", "wp.getPosts", 0, 200, full), ("fails", "wp.getPosts", 100, 500, ""), ("once", "wp.getUsers", 0, 200, full), ("early", "wp.getPages", 0, 200, short)]
    calls = spark.createDataFrame(rows, schemas.RPC_PAGES)
    both = [sorted((r.site, r.offset) for r in rpc._surviving_calls(calls, bound).collect()) for bound in (-1, 1 << 20)]
    assert rpc.rpc_posts(calls.filter("site = 'early'"), page_size=1).count() == 1  # no shorter page: it goes on to its end
    assert both[0] == both[1] == sorted([("long", n * 100) for n in range(71)] + [("once", 0), ("early", 0)])


def test_rpc_values_nest_to_any_depth(spark):
    """Lists in records in lists, texts with markup, escapes, CDATA, references by number, blanks and untyped values."""
    deep = "<string>end</string>"
    for level in range(9):
        deep = f"<array><data> <value>{deep}</value> <value><int>{level}</int></value></data></array>"
    fields = ("<array><data>" + record(id="<int>7</int>", key="<string>k</string>", value=deep)
              + record(key="<string>s</string>", value="<struct>" + member("t", "<string>&lt;b&gt; &amp;amp; &quot;q&quot; \\ &#60;i&#x3E;\n</string>")
              + member("c", "<string><![CDATA[<p>a & b</p>]]></string>") + member("u", " plain ") + member("e", "<string/>") + member("w", "<string>  </string>")
              + member("n", "<double>1.5</double>") + member("z", "<int>007</int>") + member("y", "<boolean>1</boolean>") + member("l", "<array><data/></array>")
              + member("x", "<nil/>") + "</struct>") + "</data></array>")
    sizes = "<struct>" + member("thumb", "<struct>" + member("file", "<string>i-1x1.jpg</string>") + member("width", "<int>1</int>") + "</struct>") + "</struct>"
    none = "<array><data></data></array>"
    rows = [
        ("a", "wp.getPosts", 0, 200, response([record(post_id="<int>1</int>", custom_fields=fields), record(post_id="<int>2</int>", custom_fields=none), record(post_id="<int>3</int>")])),
        ("a", "wp.getMediaLibrary", 0, 200, response([
            record(attachment_id="<string>3</string>", link="<string>https://a/u/i.jpg?x=/</string>", metadata="<struct>" + member("width", "<int>9</int>") + member("file", "<string>u/i.jpg</string>") + member("sizes", sizes) + "</struct>"),
            record(attachment_id="<string>4</string>", metadata="<struct>" + member("sizes", none) + "</struct>"), record(attachment_id="<string>5</string>", metadata="<string></string>")])),
    ]
    calls = rpc.decode_calls(spark.createDataFrame(rows, schemas.RPC_PAGES))
    one, two, three = [json.loads(m) if m else None for (m,) in rpc.rpc_posts(calls).orderBy("id").selectExpr("to_json(meta)").collect()]
    first, second = one["custom_fields"]
    value = first["value"]
    for level in reversed(range(9)):
        value, number = value
        assert number == level
    assert (first["id"], value) == (7, "end")
    assert second["value"] == {"t": '<b> &amp; "q" \\ <i>\n', "c": "<p>a & b</p>", "u": " plain ", "e": "", "w": "  ", "n": 1.5, "z": "007", "y": True, "l": [], "x": None}
    assert (two, three) == ({"custom_fields": []}, None)
    media = rpc.rpc_media(calls).orderBy("id").selectExpr("id", "media_details.file", "media_details.sizes").collect()
    assert [(m.id, m.file, {k: v.source_url for k, v in m.sizes.items()}) for m in media] == [(3, "u/i.jpg", {"thumb": "https://a/u/i-1x1.jpg"}), (4, "", {}), (5, "", {})]


def test_an_rpc_export_parses_each_call_once(spark):
    """Entities, cuts and outcomes of decoded calls read columns; none parses XML again."""
    rows = [("a", "wp.getPosts", 0, 200, posts_xml(0, 2)), ("a", "wp.getUsers", 0, 200, response([])), ("b", "wp.getPosts", 0, 500, "")]
    calls = rpc.decode_calls(spark.createDataFrame(rows, schemas.RPC_PAGES))
    for rows in (rpc.rpc_posts(calls), rpc.rpc_media(calls), rpc.rpc_categories(calls), rpc.rpc_tags(calls), rpc.rpc_users(calls), rpc.rpc_site_info(calls), rpc.offset_cuts(calls), rpc.rpc_outcomes(calls)):
        plan = rows._jdf.queryExecution().toString()
        assert "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower()
    assert "PartitionFilters: [isnotnull(method" in rpc.rpc_users(calls)._jdf.queryExecution().toString()
    assert sorted((r.site, r.failed) for r in rpc.offset_cuts(calls).collect() if r.method == "wp.getPosts") == [("a", False), ("b", True)]


def test_fields_of_another_type_are_listed(spark):
    good = {"id": 1, "slug": "s", "title": {"rendered": "t"}, "categories": [], "sticky": None, "meta": [], "unknown": 5, "excerpt": None}
    bad = {"id": "x", "slug": ["q"], "title": {"rendered": 5}, "categories": [1, "2"], "sticky": 0, "date": 3, "author": 1.5, "content": [], "_links": {"self": [{"href": 1}]}}
    picture = {"id": 2, "media_details": {"width": "7", "sizes": {"t": {"file": 1}}}}
    rows = [("a", "posts", 1, 200, json.dumps([good, bad, None])), ("a", "posts", 2, 400, ""), ("a", "posts", 3, 200, json.dumps([bad])),
            ("a", "media", 1, 200, json.dumps([picture])), ("a", "users", 1, 200, '[{"id":1,"avatar_urls":{"24":5}}]'), ("a", "tags", 1, 200, '[{"id":1,"count":12345678901234567890}]'),
            ("b", "posts", 1, 200, json.dumps([bad])), ("b", "posts", 2, 500, ""), ("c", "pages", 1, 200, "null")]
    found = rest.rejected_fields(spark.createDataFrame(rows, schemas.API_PAGES)).collect()
    got = {(r.site, r.endpoint, r.page, r.position, r.field): r.found for r in found}
    fields = ("id", "slug", "title", "categories", "sticky", "date", "author", "content", "_links")
    assert set(got) == {("a", "posts", 1, 1, f) for f in fields} | {("a", "media", 1, 0, "media_details"), ("a", "users", 1, 0, "avatar_urls"), ("a", "tags", 1, 0, "count")}
    assert (got["a", "posts", 1, 1, "id"], got["a", "posts", 1, 1, "sticky"]) == ("STRING", "BIGINT")


def test_bucketed_captures_are_pruned_and_cut_without_a_shuffle(spark, tmp_path):
    rows = [(f"s{i}", e, p, 200 if p < 3 else 400, '[{"id":%d}]' % (10 * i + p) if p < 3 else "") for i in range(20) for e in ("posts", "tags") for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, schemas.API_PAGES)
    calls = spark.createDataFrame([(f"s{i}", "wp.getPosts", 0, 200, posts_xml(i, 2)) for i in range(5)], schemas.RPC_PAGES)
    names = ["captured_pages", "captured_calls"]
    try:
        captures.write_captures(pages.where("site < 's5'"), names[0], str(tmp_path / "pages"), buckets=4)
        captures.write_captures(pages.where("site >= 's5'"), names[0], str(tmp_path / "pages"), buckets=4, mode="append")
        captures.write_captures(calls, names[1], str(tmp_path / "calls"), buckets=2)
        table = captures.read_captures(spark, names[0])
        cuts = rest.page_cuts(table.where("endpoint = 'tags'"))
        plan = cuts._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(endpoint" in plan and "Bucketed: true" in plan
        key = ["site", "endpoint"]
        assert sorted(map(tuple, rest.page_cuts(table).orderBy(*key).collect())) == sorted(map(tuple, rest.page_cuts(pages).orderBy(*key).collect()))
        assert rest.scan_tags(table).count() == 40 and rpc.rpc_posts(captures.read_captures(spark, names[1])).count() == 10
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    with pytest.raises(ValueError):
        captures.write_captures(spark.range(1), "captured_nothing")
