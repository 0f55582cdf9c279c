import json
import os
import shutil
from glob import glob

import pytest
from pyspark.sql import functions as F

from sitefold import schemas
from sitefold.operators import discovery
from sitefold.plans import export
from sitefold.plans.options import ExportOptions
from sitefold.session import shared_dir
from sitefold.sinks.markdown_export import write_tree
from sitefold.streaming.discovery import discovered_stream, read_lookups, start_discovery

RUN = "2025-01-02T03:04:05Z"
BASE = "https://a.example/wp-content/uploads"


def captures(spark):
    post = {"id": 1, "slug": "hello", "date": "2024-01-15T10:30:45.120", "status": "publish", "link": "https://a.example/hello",
            "title": {"rendered": "Hello"}, "content": {"rendered": f'<p><img src="{BASE}/x.jpg"></p>', "protected": True},
            "categories": [2], "meta": {"k": [1, "two"]}}
    page = {"id": 9, "slug": "about", "title": {"rendered": "About"}, "content": {"rendered": "<h1>About</h1>"}}
    media = {"id": 5, "source_url": f"{BASE}/x.jpg", "media_details": {"width": 10, "sizes": {"t": {"source_url": f"{BASE}/x-1.jpg"}}}}
    rows = [
        ("a", "posts", 1, 200, json.dumps([post])), ("a", "posts", 2, 400, ""), ("a", "pages", 1, 200, json.dumps([page])),
        ("a", "media", 1, 200, json.dumps([media])), ("a", "categories", 1, 200, '[{"id":1,"slug":"news"},{"id":2,"slug":"local","parent":1}]'),
        ("a", "tags", 1, 200, '[{"id":3,"slug":"t"}]'), ("a", "users", 1, 200, '[{"id":4,"name":"U"}]'),
        ("a", "settings", 1, 200, '{"name":"Site A","url":"https://a.example"}'),
        ("b", "posts", 1, 500, ""), ("b", "users", 1, 200, "[]"),
    ]
    sites = spark.createDataFrame([("a", "https://a.example"), ("b", "https://b.example")], "site string, url string")
    return spark.createDataFrame(rows, schemas.API_PAGES), sites


def items(spark):
    hidden = {"id": 7, "slug": "hidden", "link": "https://a.example/deep/hidden", "content": {"rendered": f"see {BASE}/x-1.jpg"}}
    return spark.createDataFrame(
        [("a", "posts", 7, 200, json.dumps(hidden)), ("a", "posts", 1, 200, json.dumps(hidden)), ("a", "media", 8, 404, "")], schemas.API_ITEMS)


def test_markdown_export(spark, tmp_path):
    pages, sites = captures(spark)
    content = export.land(export.content_from_api(pages, sites), str(tmp_path / "typed"))
    options = ExportOptions(output_format="markdown", run_time=RUN, discover=True)
    existing = spark.createDataFrame([("a", "5_x.jpg")], schemas.EXISTING_FILES)
    out = tmp_path / "out"
    stats = {r.site: r.asDict() for r in export.export(content, str(out), options, existing, api_items=items(spark), as_files=True).collect()}
    assert stats["a"] == {"site": "a", "total_posts": 2, "total_pages": 1, "total_media": 1, "total_categories": 2, "total_tags": 1,
                          "total_users": 1, "media_downloaded": 1, "brute_force_found": 1}
    assert stats["b"]["total_posts"] == 0
    files = sorted(os.path.relpath(f, out) for f in glob(f"{out}/**/*.md", recursive=True))
    assert files == ["a/README.md", "a/pages/about.md", "a/posts/deep/hidden.md", "a/posts/news/local/hello.md", "b/README.md"]
    text = (out / "a/posts/news/local/hello.md").read_text()
    assert text.endswith('## Content\n\n<img src="media/5_x.jpg">') and "date: 2024-01-15T10:30:45Z" in text
    assert (out / "a/posts/deep/hidden.md").read_text().endswith("see media/5_x-1.jpg")
    assert (out / "a/README.md").read_text().startswith("# Site A\n\n**Description:**   \n**URL:** https://a.example  \n")
    assert (out / "a/README.md").read_text().endswith("---\n\n*Exported on 2025-01-02 03:04:05*\n")
    metadata = document(out / "metadata", "a")
    assert list(metadata) == ["categories", "exported_at", "media", "stats", "tags", "users"]
    assert metadata["stats"]["total_posts"] == 2 and [c["slug"] for c in metadata["categories"]] == ["news", "local"]


def document(folder, site):
    parts = sorted(glob(f"{folder}/site={site}/part-*"))
    return json.loads("".join(open(p).read() for p in parts))


def test_json_export(spark, tmp_path):
    pages, sites = captures(spark)
    content = export.content_from_api(pages, sites)
    out = str(tmp_path / "data.json")
    export.export(content, out, ExportOptions(run_time=RUN))
    got = document(tmp_path / "data/export", "a")
    assert list(got) == ["site", "posts", "pages", "media", "categories", "tags", "users", "exported_at", "stats"]
    post = got["posts"][0]
    assert post["date"] == "2024-01-15T10:30:45.12Z" and post["date_gmt"] == "0001-01-01T00:00:00Z"
    assert post["content"] == {"rendered": '<p><img src="media/5_x.jpg"></p>', "protected": True}
    assert post["title"] == {"rendered": "Hello"} and post["meta"] == {"k": [1, "two"]} and post["_links"] == {}
    assert got["media"][0]["media_details"]["width"] == 10 and got["tags"][0]["meta"] is None
    assert got["exported_at"] == RUN and got["site"]["name"] == "Site A"
    empty = document(tmp_path / "data/export", "b")
    assert empty["posts"] == [] and empty["site"]["name"] == "WordPress Site"


def test_json_export_by_entity(spark, tmp_path):
    pages, sites = captures(spark)
    export.export_captures(pages, sites, str(tmp_path / "o"), ExportOptions(run_time=RUN), by_entity=True)
    lines = {}
    for path in glob(f"{tmp_path}/o/entities/entity=*/part-*"):
        with open(path) as file:
            lines.setdefault(os.path.dirname(path).rsplit("=")[-1], []).extend(json.loads(x) for x in file)
    assert sorted(lines) == ["categories", "media", "pages", "posts", "tags", "users"]
    assert [(x["site"], x["record"]["slug"]) for x in lines["posts"]] == [("a", "hello")]
    assert sorted(x["record"]["slug"] for x in lines["categories"]) == ["local", "news"]


def test_strict_option_raises_on_a_failed_listing(spark, tmp_path):
    pages, sites = captures(spark)
    with pytest.raises(export.IncompleteCapture):
        export.export_captures(pages, sites, str(tmp_path), ExportOptions(strict=True))


@pytest.mark.parametrize(("site", "path"), [("a", "../b/x.md"), ("a", "posts/../../../x.md"), ("..", "x.md"), ("a/b", "x.md")])
def test_tree_refuses_paths_outside_a_site(spark, tmp_path, site, path):
    rows = spark.createDataFrame([(site, path, "text")], "site string, path string, content string")
    with pytest.raises(Exception, match="path outside its site"):
        write_tree(rows, str(tmp_path / "out"))
    assert not glob(f"{tmp_path}/**/*.md", recursive=True)


@pytest.mark.parametrize("output", ["wasb://bucket/x", "ftp://host/x", "relative/x"])
def test_tree_refuses_storage_it_cannot_write(spark, output):
    with pytest.raises(ValueError):
        write_tree(spark.createDataFrame([], "site string, path string, content string"), output)


def test_work_folder_has_to_be_shared(monkeypatch):
    class Context:
        master, folder = "yarn", None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert shared_dir(Session()) == "/shared" and Session.sparkContext.folder == "/shared"


def test_large_document_spans_files(spark, tmp_path):
    from sitefold.sinks.json_export import EXPORT_KEYS, document_lines, write_document_lines

    pages, sites = captures(spark)
    content = export.content_from_api(pages, sites)
    records = spark.range(5000).select(F.lit("a").alias("site"), F.lit("posts").alias("entity"), F.col("id").alias("ord"),
                                       F.concat(F.lit('{"id":'), F.col("id"), F.lit("}")).alias("record"))
    stats = export.prepare(content, "/x", ExportOptions()).stats
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a large document
    try:
        write_document_lines(document_lines(content.sites, records, stats, RUN, EXPORT_KEYS), str(tmp_path / "doc"), whole_bytes=4096)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob(f"{tmp_path}/doc/site=a/part-*")) > 1
    assert [p["id"] for p in document(tmp_path / "doc", "a")["posts"]] == list(range(5000))
    # The site that fits is one valid file; the parts table says which bytes of the document every file holds.
    (small,) = glob(f"{tmp_path}/doc/site=b/part-*")
    with open(small) as file:
        assert json.load(file)["posts"] == []
    parts = spark.read.parquet(f"{tmp_path}/doc-parts").orderBy("site", "part").collect()
    names = {site: [os.path.basename(p) for p in sorted(glob(f"{tmp_path}/doc/site={site}/part-*"))] for site in ("a", "b")}
    assert {site: [r.file for r in parts if r.site == site] for site in names} == names
    end = 0
    for r in (r for r in parts if r.site == "a"):
        assert r.first_byte == end and r.bytes == os.path.getsize(f"{tmp_path}/doc/site=a/{r.file}")
        end += r.bytes


def test_options_and_strictness(spark):
    for bad in ({"output_format": "xml"}, {"max_id": 0}, {"retries": -1}):
        with pytest.raises(ValueError):
            ExportOptions(**bad)
    pages, sites = captures(spark)
    with pytest.raises(export.IncompleteCapture):
        export.content_from_api(pages, sites, strict=True)


def test_default_outputs(spark):
    cases = [("https://www.example.com", "export/example.com.2025-01-02030405"), ("https://my-site_with.special.com:80/x", "export/my-site_with.special.com.2025-01-02030405"),
             ("ht tp://invalid url", None), ("https:///x", "export/wordpress-site.2025-01-02030405")]
    sites = spark.createDataFrame(cases, "url string, site string").select(F.col("url").alias("site"), "url")
    got = {r.site: r.output for r in export.default_outputs(sites, RUN).collect()}
    assert got == dict(cases)


def test_stream_equals_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    known = spark.createDataFrame([("a", "posts", i) for i in range(0, 300, 3)], "site string, content_type string, id long")
    for start in (1, 100):  # overlapping captures: some ids arrive twice
        rows = [("a", "posts", i, 200 if i % 2 else 404, '{"id":%d}' % i) for i in range(start, start + 150)]
        spark.createDataFrame(rows, schemas.API_ITEMS).coalesce(1).write.mode("append").parquet(landing)
    found = discovered_stream(read_lookups(spark, landing, 1), known, 220)
    shared_dir(spark)
    query = start_discovery(found, str(tmp_path / "found"), f"test-{os.getpid()}")
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    assert len(batches) == 2
    assert all("rocksdb" in json.dumps(p.stateOperators[0].customMetrics).lower() for p in batches)
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")  # the session keeps its own
    streamed = sorted(r.id for r in spark.read.parquet(str(tmp_path / "found")).collect())
    batch = discovery.discovered_items(spark.read.parquet(landing), known, 220)
    assert streamed == sorted({r.id for r in batch.collect()}) and len(streamed) > 50
    # What was found is known from the stream's state alone: the output can be gone.
    kept = streamed
    for folder in glob(f"{tmp_path}/found/batch_id=[0-9]*"):
        shutil.rmtree(folder)
    later = [("a", "posts", i, 200, '{"id":%d}' % i) for i in (2, 4, 217, 219)]  # 217 was written before, 219 is listed
    spark.createDataFrame(later, schemas.API_ITEMS).coalesce(1).write.mode("append").parquet(landing)
    start_discovery(discovered_stream(read_lookups(spark, landing, 1), known, 220), str(tmp_path / "found"), f"test-{os.getpid()}").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "found")).collect()) == [2, 4] and 217 in kept


def test_rpc_content_exports(spark, tmp_path):
    body = ("<methodResponse><params><param><value><array><data><value><struct><member><name>post_id</name><value><string>3</string></value></member>"
            "<member><name>post_name</name><value><string>x</string></value></member></struct></value></data></array></value></param></params></methodResponse>")
    calls = spark.createDataFrame([("r", "wp.getPosts", 0, 200, body), ("r", "wp.getOptions", 0, 200,
        "<methodResponse><params><param><value><struct></struct></value></param></params></methodResponse>")], schemas.RPC_PAGES)
    content = export.content_from_rpc(calls, strict=True)
    export.export(content, str(tmp_path), ExportOptions(output_format="markdown", run_time=RUN), as_files=False)
    docs = {r.path for r in spark.read.parquet(f"{tmp_path}/documents").collect()}
    assert docs == {"README.md", "posts/uncategorized/x.md"}


def test_metadata_rewrites_nothing_and_a_rewrite_shuffles_no_text(spark, monkeypatch):
    pages, sites = captures(spark)
    content = export.content_from_api(pages, sites)
    calls = []
    own = export.rewrite.rewrite_media_links
    monkeypatch.setattr(export.rewrite, "rewrite_media_links", lambda *a, **k: calls.append(1) or own(*a, **k))
    prepared = export.prepare(content, "/x", ExportOptions(output_format="markdown"))
    export.metadata_lines(prepared, ExportOptions()).collect()
    assert not calls
    assert prepared.content is prepared.content and len(calls) == 1
    posts = spark.createDataFrame(content.posts.collect(), content.posts.schema)
    plan = own(posts, content.media)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    texts = []
    for bound in (1 << 20, 60, -1):  # replacements fit; only their keys may; nothing does
        rows = own(posts, content.media, bound=bound).collect()
        texts.append(sorted((r.site, r.id, r.content.rendered) for r in rows))
    assert texts[0] == texts[1] == texts[2] and any("media/5_x.jpg" in t for *_, t in texts[0])


def test_a_failed_tree_leaves_what_was_there_and_a_new_one_replaces_it(spark, tmp_path):
    columns = "site string, path string, content string"
    out = str(tmp_path / "out")
    write_tree(spark.createDataFrame([("a", "old.md", "1"), ("a", "x/y.md", "1"), ("b", "z.md", "1")], columns), out)
    rows = spark.createDataFrame([("a", f"{i}.md", "2") for i in range(200)] + [("a", "../b.md", "2")], columns).repartition(4)
    with pytest.raises(Exception, match="path outside its site"):
        write_tree(rows, out)
    files = lambda: sorted(os.path.relpath(f, out) for f in glob(f"{out}/**/*", recursive=True, include_hidden=True) if os.path.isfile(f))
    assert files() == ["a/old.md", "a/x/y.md", "b/z.md"]
    write_tree(spark.createDataFrame([("a", "x/y.md", "3")], columns), f"file://{out}")
    assert files() == ["a/x/y.md", "b/z.md"] and (tmp_path / "out/a/x/y.md").read_text() == "3"


def test_files_of_an_earlier_export_as_a_table(spark, tmp_path):
    from sitefold.operators.media import media_manifest
    from sitefold.sources.files import existing_files

    pages, sites = captures(spark)
    media = export.content_from_api(pages, sites).media
    (tmp_path / "media/a").mkdir(parents=True)
    (tmp_path / "media/a/5_x.jpg").write_bytes(b"12345")
    (tmp_path / "media/a/odd name é+%41.jpg").write_bytes(b"")
    (tmp_path / "media/loose.txt").write_bytes(b"1")
    files = existing_files(spark, str(tmp_path / "media"))
    assert sorted(map(tuple, files.collect())) == [("a", "5_x.jpg", 5), ("a", "odd name é+%41.jpg", 0)]
    one = existing_files(spark, str(tmp_path / "media/a"), site="only")
    assert {r.site for r in one.collect()} == {"only"} and one.count() == 2
    assert existing_files(spark, str(tmp_path / "none")).count() == 0
    attempts = spark.createDataFrame([], schemas.ATTEMPTS)
    by_hand = spark.createDataFrame([("a", "5_x.jpg")], schemas.EXISTING_FILES)
    manifests = [sorted(map(str, media_manifest(media, f, attempts, "/m").collect())) for f in (files.drop("bytes"), by_hand)]
    assert manifests[0] == manifests[1]


def test_strict_rpc_export_raises(spark, tmp_path):
    calls = spark.createDataFrame([("r", "wp.getPosts", 0, 500, "")], schemas.RPC_PAGES)
    before = set(glob(f"{shared_dir(spark)}/landed-*"))
    with pytest.raises(export.IncompleteCapture):
        export.export_rpc_captures(calls, str(tmp_path), ExportOptions(strict=True))
    assert export.export_rpc_captures(calls, str(tmp_path / "o"), ExportOptions()).count() == 0
    assert set(glob(f"{shared_dir(spark)}/landed-*")) == before


@pytest.mark.parametrize("output_format", ["json", "markdown"])
def test_an_export_leaves_no_work_folder_behind(spark, tmp_path, output_format):
    pages, sites = captures(spark)
    content = export.land(export.content_from_api(pages, sites), str(tmp_path / "typed"))
    work = lambda: set(glob(f"{shared_dir(spark)}/landed-*"))
    before = work()
    stats = export.export(content, str(tmp_path / "out"), ExportOptions(output_format=output_format, run_time=RUN))
    assert work() == before and stats.count() == 2
