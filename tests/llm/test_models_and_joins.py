"""URL rules, components, embeddings, pieces and the classifier chain; the registered queries and the pipeline."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F
from test_text_operators import plain_components, plain_fingerprint, plain_matches

import corpus_pipeline
from sitefold.llm import components, embedding_dedup, license_scan, pieces, queries, toxicity, url_filter

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
needs_model = pytest.mark.skipif(not os.path.isfile(pieces.MODEL_PATH), reason="the tokenizer is not here")
PAGES = "page_id long, url string, html string, host int, path int, copies int, rule int, labels int"


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and url and "://" in url]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_url_filter_equals_brute_force(spark):
    rules = [*url_filter.RULES, ("a.b", "", "block"), ("a.b", "/xy", "allow"), ("b", "/x", "allow")]
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.Example.COM", "x.net", "net", "notexample.com", "a.b", "q.a.b", "aa.b", "b", "", "com:80", "u@com", "..com", "é.com"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/x", "/fr/?q", "?/en/", "#/es/", "/x", "/xyz", "//", "/EN/"]
    urls = [rng.choice(["http://", "https://", "x://", "", "HTTP://a://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)]
    urls += [None, "", "://", "http://", "http://com/" + "p" * 20_000, urls[0], urls[0]]
    rows = [(i if i % 50 else None, u, None, 1, 2, 3, 4, 5) for i, u in enumerate(urls)] + [(7, urls[7], "", 0, 0, 0, 0, 0)]
    rule_rows = rules + [(None, "/", "block"), ("com", None, "block"), ("com", "/", "allow")]
    table = spark.createDataFrame(rule_rows, "host string, path string, verdict string")
    found = url_filter.filter_urls(spark.createDataFrame(rows, PAGES), table).collect()
    wanted = [(r[0], *plain_verdict(r[1], rules)) for r in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_url_filter_empty_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://net/es/"), (2, None)], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()] == ["allow", "allow"]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(40)] + [(300 + (i * 37) % 60, 300 + ((i + 1) * 37) % 60) for i in range(59)]
    top = {v: v for e in edges for v in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    table = spark.createDataFrame([*edges, (None, 3), (5, None)], "x int, y int")
    found = {r.vertex: r.component for r in components.components(table, "x", "y").collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert found == {v: top[v] for v in linked}
    assert components.components(table.limit(0), "x", "y").count() == 0


def vectors_of(spark, rows):
    kinds = "vec_id long, embedding array<float>, label int, cell string, home int, links int, copies string"
    return spark.createDataFrame([(*r, "c", 1, 2, "d") for r in rows], kinds)


def test_embedding_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(320):
        own = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.02, 0.08, 0.15])
        rows.append((i, own.astype(np.float32).tolist(), [0, 1, None][rng.choice(3, p=[0.6, 0.35, 0.05])]))
    rows += [(400 + i, rows[0][1], rows[0][2]) for i in range(20)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 8, 0), (503, [math.nan] * 8, 0), (504, [1.0, None], 0), (505, [math.inf] * 8, 1), (506, [1.0] * 4, 0), (507, [2.0] * 4, 0), (508, [-0.0, 1.0], 0), (509, [0.0, 1.0], 0)]
    wanted = embedding_dedup.near_duplicates_by_brute_force(rows)
    for per_pivot, block in ((1_000, 8_192), (10, 8_192), (10, 20)):
        monkeypatch.setattr(embedding_dedup, "PER_PIVOT", per_pivot)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = embedding_dedup.near_duplicates(vectors_of(spark, rows))
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert sum(r[1] > 0 for r in wanted) > 100


def test_dense_cell_stays_within_memory():
    """A few thousand near copies of one vector: millions of links, but only counts and joining edges come out."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 3_000
    rows = np.ones(64) + rng.normal(size=(n, 64)) * 0.01
    cell = pa.table({"class": [f"{i:05d}" for i in range(n)], "vector": [r.tobytes() for r in rows], "copies": np.ones(n, np.int64), "home": [True] * n,
                     "distance": np.linalg.norm(rows / np.linalg.norm(rows, axis=1, keepdims=True) - 0.125, axis=1), "part": np.zeros(n, np.int32), "low": np.zeros(n, np.int32), "high": np.zeros(n, np.int32)})
    tracemalloc.start()
    found = embedding_dedup.cell_links(cell)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert found.column("b").null_count == n and found.num_rows == 2 * n - 1
    assert set(found.column("links").to_pylist()[:n]) == {n - 1}


def test_embedding_dedup_defined_cases(spark):
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (None, None, 1), (9, [1.0, 0.0], 2)]
    found = sorted(embedding_dedup.near_duplicates(vectors_of(spark, rows)).collect(), key=str)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == [("4", 2, "4"), ("4", 2, "4"), ("9", 0, "9"), ("None", 0, "None"), ("None", 2, "4")]


def plain_segmentation(vocabulary, text):
    """The best segmentation of the whole text, marker before it, by a plain dictionary."""
    scores = vocabulary["scores"]
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [(0.0, 0, None)] + [(-math.inf, 0, None)] * len(marked)
    for start in range(len(marked)):
        for end in range(start + 1, min(len(marked), start + 50) + 1):
            piece = marked[start:end]
            if piece in scores or end == start + 1:
                score = best[start][0] + (scores[piece][0] if piece in scores else vocabulary["unknown"])
                if score > best[end][0]:
                    best[end] = (score, start, scores[piece][1] if piece in scores else None)
    ids, at = [], len(marked)
    while at:
        _, start, piece = best[at]
        ids = ([piece] if piece is not None else [vocabulary["bytes"][b] for b in marked[start:at].encode()]) + ids
        at = start
    return ids


@pytest.fixture(scope="module")
def model():
    if not os.path.isfile(pieces.MODEL_PATH):
        pytest.skip("the tokenizer is not here")
    read = pieces.read_pieces(pieces.MODEL_PATH)
    normal = {p.decode(): (s, i) for i, (p, s, kind) in enumerate(read) if kind in (1, 4)}
    plain = {"scores": normal, "unknown": min(s for s, _ in normal.values()) - 10, "bytes": {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(read) if kind == 6}}
    return pieces.load(), plain


def test_pieces_equal_plain_viterbi_and_come_back(model):
    vocabulary, plain = model
    rng = random.Random(1)
    texts = ["", None, " ", "  a", "a  b ", "x\n\ny", "日本語テキスト", "😀 ok\x00", "a▁b", "   ", "é" * 30, "The quick brown fox", "x" * 400]
    texts += ["".join(rng.choice("abtheing  \nÀß漢😀▁.") for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    ids, counts = pieces.Encoder(vocabulary, memory=50).encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [plain_segmentation(plain, t or "") for t in texts]
    assert vocabulary.decode(ids, counts) == [(t or "").replace("▁", " ") for t in texts]


def test_pieces_score_as_well_as_the_library(model):
    import sentencepiece

    with open(pieces.MODEL_PATH, "rb") as file:
        data = file.read()
    kind = data.index(b"\x12\x06tok_v0\x18\x02") + 9  # the kind of the model: 2 merges pairs, 1 is the unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:kind] + b"\x01" + data[kind + 1 :])
    vocabulary, _ = model
    texts = ["the", "with a view", "of the people", "antidisestablishment", "Hello world", "ich bin hier", "por la tarde"]
    ids, counts = pieces.Encoder(vocabulary).encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert [library.id_to_piece(i) for i in own.tolist()] == library.nbest_encode_as_pieces(text, 2)[0]


def test_double_array_finds_its_keys():
    rng = random.Random(3)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6))) for _ in range(800)} | {b"\x00", b"\xff", b"a", b"ab"})
    base, check, values = pieces.double_array(keys)

    def find(key):
        state = 0
        for b in key:
            following = base[state] + b
            if check[following] != state:
                return -1
            state = following
        return values[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(k + b"?") == (keys.index(k + b"?") if k + b"?" in keys else -1) for k in keys)


def test_models_with_inner_markers_are_refused():
    with pytest.raises(ValueError, match="marker"):
        pieces.Vocabulary([("a▁b".encode(), -1.0, 1)])


@needs_model
def test_encode_and_decode_tables(spark):
    rows = [(1, "a b", "en", "t", 3), (None, None, None, None, None), (2, "", "en", "t", 0), (2, "w " * 30_000, "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, token_ids string, n_tokens long")
    coded = pieces.encode(docs, decoded="back")
    assert coded.columns == ["doc_id", "text", "lang", "token_ids", "n_tokens", "round_trip", "back"]
    found = coded.collect()
    assert all(r.round_trip and r.back == (r.text or "") and r.n_tokens == len(r.token_ids) for r in found)
    again = pieces.decode(coded.select("doc_id", "token_ids"))
    assert sorted(r.decoded for r in again.collect()) == sorted(r.back for r in found)
    assert pieces.encode(docs.limit(0)).count() == 0


def chain_tables(spark, n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(5, 80))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["vile", "nasty", "awful"])
        docs.append((i, " ".join(own).upper() + "!!" if bad else " ".join(own), "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, fold string, words int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_chain_on_held_out_documents(spark):
    docs, labels, rows = chain_tables(spark, 1200)
    known = toxicity.chain_labels(labels.where("doc_id < 800"))
    found = {r.doc_id: r for r in toxicity.score(docs, known).collect()}
    held = [(found[i], quality, toxic) for i, quality, toxic in rows if i >= 800]
    assert len(found) == 1200
    assert sum(r.toxic == bool(t) for r, _, t in held) >= 0.97 * len(held)
    assert sum((r.p_low_quality >= 0.5) != bool(q) for r, q, _ in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.toxic}


def test_later_models_learn_from_unseen_predictions(spark):
    """Without any signal, a forerunner judged on its own training rows would seem to know the answer."""
    rng = np.random.default_rng(1)
    n = 300
    own = [np.unique(rng.integers(0, 40, 12)).astype(np.uint64) for _ in range(n)]
    noise = rng.integers(0, 2, n)
    rows = {"fold": np.arange(n) % 3, "first": noise, "second": noise, "words": pa.array([x.tobytes() for x in own], pa.binary()), "style": [[0.0] * toxicity.STYLES] * n}
    parts = toxicity.train(pa.table(rows), ("first", "second")).column("model")[0].as_py()
    chain = toxicity.Chain(parts, 2)
    assert chain.models[1][1][-1] < 0.5  # the weight of the forerunner's log odds


def test_toxicity_defined_cases(spark):
    docs, labels, _ = chain_tables(spark, 60)
    known = toxicity.chain_labels(labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 30_000)], "doc_id long, text string")
    assert all(0 <= r.p_toxic <= 1 for r in toxicity.score(odd.unionByName(docs.select("doc_id", "text")), known).collect())
    assert [(r.p_toxic, r.toxic) for r in toxicity.score(odd, known.limit(0)).collect()] == [(0.0, False)] * 3
    assert toxicity.drop_toxic(odd, known.limit(0)).count() == 3
    assert toxicity.score(docs.limit(0), known).count() == 0
    nulls = known.selectExpr("doc_id", "CAST(NULL AS int) AS low_quality", "toxic")
    assert not any(r.toxic for r in toxicity.score(odd, nulls).collect())
    clean = known.selectExpr("doc_id", "0 AS low_quality", "0 AS toxic").union(known.selectExpr("doc_id", "0", "NULL"))
    assert not any(r.toxic for r in toxicity.score(docs, clean).collect())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    problem, rows = differences(spark, connect(SF_DIR), name, SF_DIR)
    assert problem is None and rows > 0


@needs_tables
def test_queries_without_an_oracle_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in corpus_pipeline.table(spark, SF_DIR, "documents").collect()]
    licences = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op3_license_scan(spark, SF_DIR).collect()}
    assert licences == dict(zip([d for d, _ in docs], license_scan.scan_by_brute_force([t for _, t in docs])))
    prints = [plain_fingerprint(t) for _, t in docs]
    components_of = {d: (f"{p:016x}", docs[c][0]) for (d, _), p, c in zip(docs, prints, plain_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF_DIR).collect()} == components_of
    shards = queries.op8_sharding(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in shards) == sorted((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs)
    assert sorted(r.slot * 16 + r.shard for r in shards) == list(range(len(docs))) and {r.law for r in shards} == {"rows"}
    items = [(r.item_id, r.text) for r in corpus_pipeline.table(spark, SF_DIR, "benchmark").collect()]
    wanted = plain_matches(docs, items)
    found = {(r.doc_id, r.item_id): (r.first_word, r.distance) for r in queries.op10_decontamination(spark, SF_DIR).collect()}
    assert set(found) <= set(wanted) and len(found) >= 0.97 * len(wanted)


@needs_tables
@needs_model
def test_every_document_comes_back_from_its_pieces(spark):
    rows = queries.op6_sentencepiece(spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in corpus_pipeline.table(spark, SF_DIR, "documents").collect()}
    assert len(rows) == len(texts) and all(r.round_trip and len(r.token_ids) == r.n_tokens for r in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_toxicity_query_on_documents_it_was_not_trained_on(spark, tmp_path):
    """Labels of a third of the labelled documents are withheld and compared."""
    for name in ("documents", "labels"):
        os.symlink(f"/root/testdata/sf0.1/{name}.parquet", tmp_path / f"all_{name}.parquet")
    labels = spark.read.parquet(str(tmp_path / "all_labels.parquet"))
    labels.where("doc_id % 3 <> 0").write.parquet(str(tmp_path / "labels.parquet"))
    os.symlink("/root/testdata/sf0.1/documents.parquet", tmp_path / "documents.parquet")
    found = queries.op2_toxicity(spark, str(tmp_path)).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    counts = {(bool(r.truth), r.toxic): r["count"] for r in found.groupBy("truth", "toxic").count().collect()}
    assert counts.get((True, True), 0) >= 0.8 * (counts.get((True, True), 0) + counts.get((True, False), 0)) > 50
    assert counts.get((False, True), 0) <= 0.02 * counts[False, False]


@needs_tables
@needs_model
def test_pipeline_stages_take_effect(spark):
    """Each stage against its operator's own verdicts on that stage's input."""
    docs = corpus_pipeline.table(spark, SF_DIR, "documents")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    clean = by_name["toxicity"](spark, docs, SF_DIR)
    verdicts = {r.doc_id for r in queries.op2_toxicity(spark, SF_DIR).where("toxic").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == verdicts and clean.columns == columns
    lines = by_name["line_dedup"](spark, docs, SF_DIR)
    texts = {r.doc_id: r.text for r in queries.op9_line_dedup(spark, SF_DIR).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == texts and lines.columns == columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    single = by_name["simhash_near_dedup"](spark, docs, SF_DIR)
    heads = {r.component_id for r in queries.op4_simhash(spark, SF_DIR).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(heads) and single.columns == columns
    free = by_name["benchmark_decontamination"](spark, docs, SF_DIR)
    holders = {r.doc_id for r in queries.op10_decontamination(spark, SF_DIR).collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in free.collect()} == holders and free.columns == columns
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = {r.doc_id for r in whole}
    assert len(ids) == len(whole) and not ids & verdicts and all(r.round_trip for r in whole)
