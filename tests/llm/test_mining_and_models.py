"""Phrases, quality, alignment, licence templates and the SQL of line dedup: brute force and defined cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitefold.llm import alignment, collocations, decontamination, license_scan, line_dedup, pieces, quality, queries, sharding, simhash, toxicity
from sitefold.operators import joins

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, pair int, own string, score string"


def docs_of(spark, texts, ids=None, langs=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], "s" if sources is None else sources[i], 0, "k", 1, 2, "o", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Phrases


def plain_phrases(rows, least, top):
    lower = {i: i + 32 for i in range(65, 91)}
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(zip(*(words[i:] for i in range(size))))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = {}
        for p, a in found.items():
            for inner in (p[:2], p[1:]) if len(p) == 3 else ():
                around[inner] = max(a, around.get(inner, 0))
        ranked = []
        for p, a in found.items():
            if 100 * around.get(p, 0) < 50 * a:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "\x01", "\x00x", "日本", *(f"w{i}" for i in range(12))]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(n)] + [None, "", " . , ", "x " * 3000, "new york"]


@pytest.mark.parametrize("limits", [{}, {"run_entries": 300, "partition_bytes": 500, "merge_entries": 150, "fanout": 3}])
def test_phrases_equal_brute_force(spark, monkeypatch, limits):
    """Also with containers that burst, runs that spill and partitions that are cut again and again."""
    if limits:
        monkeypatch.setattr(collocations, "BURST", 40)
        monkeypatch.setattr(collocations, "STRETCH", 200)
        monkeypatch.setattr(collocations, "PAGE_ENTRIES", 64)
    texts = phrase_texts(len(limits))
    rng = random.Random(5)
    langs = [rng.choice(["en", "de", None, ""]) for _ in texts]
    docs = docs_of(spark, texts + texts[:9], langs=langs + langs[:9], ids=[None] * (len(texts) + 9)).repartition(3)
    for least, top in ((2, 50), (10, 2000)):
        found = sorted(map(tuple, collocations.collocations(docs, least=least, top=top, **limits).collect()))
        assert found == plain_phrases(list(zip(langs, texts)) + list(zip(langs, texts))[:9], least, top) and found


def test_phrases_of_many_languages_and_none(spark):
    texts = ["a b c a b c"] * 150
    langs = [f"l{i % 75}" for i in range(150)]
    found = sorted(map(tuple, collocations.collocations(docs_of(spark, texts, langs=langs), least=2, run_entries=50).collect()))
    assert found == plain_phrases(list(zip(langs, texts)), 2, 2000)
    assert collocations.collocations(docs_of(spark, [])).count() == 0 and collocations.collocations(docs_of(spark, [None, ""])).count() == 0
    with pytest.raises(ValueError):
        collocations.ngram_counts(docs_of(spark, []), longest=4)


def test_containers_burst_and_spill_whole():
    keys = np.array([(i % 97) << 42 | (i % 89) << 21 | i % 83 for i in range(200_000)], np.int64)
    trie = collocations.Trie()
    trie.root.add(keys)
    assert trie.root.children is not None and trie.root.entries == len(set(keys.tolist()))
    got = collections.Counter()
    for share in (0.5, 0.3, 1):
        own, counts = trie.spill(share)
        got.update(dict(zip(own.tolist(), counts.tolist())))
    assert got == collections.Counter(keys.tolist()) and trie.root.entries == 0


# Alignment


@pytest.fixture(scope="module")
def libraries():
    encoder = Tokenizer.from_file(alignment.BYTE_BPE)
    encoder.encode_special_tokens = True
    return encoder, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def plain_alignment(rows, libraries):
    encoder, pieces = libraries
    letters = alignment._byte_letters()
    vocabulary = {i: bytes(letters.get(c, 0) for c in p) for p, i in encoder.get_vocab().items()}
    count, out = collections.Counter(), []
    for key, text in rows:
        a = encoder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        spoken_a = [vocabulary[i] for i in a]
        spoken_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(spoken_a) == b"".join(spoken_b) == (" " + text).encode():
            out.append((key, 0, 0, [], []))
            continue
        owner_a, owner_b = ([i for i, t in enumerate(spoken) for _ in t] for spoken in (spoken_a, spoken_b))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        ends = [set(np.cumsum([len(t) for t in spoken]).tolist()) for spoken in (spoken_a, spoken_b)]
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            left, right = [], []
            while at_a < end:
                left.append(a[i])
                at_a += len(spoken_a[i])
                i += 1
            while at_b < end:
                right.append(b[j])
                at_b += len(spoken_b[j])
                j += 1
            groups.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
        count.update(links)
        out.append((key, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (key, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), ";".join(groups))
        for key, n_a, n_b, groups, links in out
    ]


ODD = [None, "", " ", "  two", "a\tb\n\nc ", "<|endoftext|> <s> </s> <unk> <0x41>", "marker ▁ inside", "\x00nul", "😀🏽 é日本 ﬁ K", "x" * 3000, "don't  we'll 12 345", "long words " * 4000]


@pytest.mark.parametrize("limits", [{}, {"table_pairs": 0, "task_pairs": 500}])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, limits):
    """By broadcast counts and by a join; also with a memory that starts afresh all the time."""
    if limits:
        monkeypatch.setattr(alignment, "MEMORY_LINKS", 300)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["the", "Of", "naïve", "tokenization", "x1", "…", "—"]) for _ in range(rng.randrange(80))) for _ in range(40)]
    texts += texts[-5:]
    ids = [None if i % 11 == 5 else i for i in range(len(texts))]
    docs = docs_of(spark, texts, ids=ids).repartition(3)
    found = sorted(map(tuple, alignment.alignments(docs, **limits).collect()), key=str)
    assert found == sorted(plain_alignment(list(zip(ids, texts)), libraries), key=str)
    assert alignment.alignments(docs_of(spark, [])).count() == 0


def test_alignment_query_equals_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    wanted = sorted((*row, hashlib.sha256(groups.encode()).hexdigest() if groups else "") for *row, groups in plain_alignment(docs, libraries))
    found = queries.op13_alignment(spark, SF_DIR)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == wanted


def test_both_libraries_of_byte_pairs_agree(libraries):
    """On every character that isn't a surrogate, between letters, digits, marks and blanks."""
    coder, _ = alignment.tokenizers()
    assert coder.ranked
    points = [i for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    texts = ["\n".join(f" a{chr(i)}b {chr(i)}{chr(i)}1{chr(i)} {chr(i)} 7{chr(i)}!" for i in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert coder.encode(texts) == [e.ids for e in libraries[0].encode_batch_fast(texts, add_special_tokens=False)]


def test_a_file_without_merge_ranks_is_read_by_the_plain_library(libraries):
    import json

    with open(alignment.BYTE_BPE, encoding="utf-8") as file:
        known = json.load(file)
    known["model"]["merges"] = known["model"]["merges"][:-3]
    coder = alignment.ByteTokenizer(json.dumps(known))
    assert not coder.ranked and coder.encode([" plain text"]) == [libraries[0].encode(" plain text").ids]


# Quality


def quality_tables(spark, n=400):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "t", "le", "rus", "gem")]
    texts, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        good = rng.random() < 0.7
        if not good:
            body = [rng.choice(body[:3])] * len(body) if i % 2 else [w.upper() + "$$" for w in body]
        texts.append(" ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(body)))
        labels.append((i, int(good), 0))
    return texts, labels


def test_quality_on_held_out_documents(spark):
    texts, labels = quality_tables(spark)
    known = spark.createDataFrame(labels + [(0, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs_of(spark, texts), known).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.predicted == good[r.doc_id] for r in held) >= 0.95 * len(held)
    # Labels of held-out documents change nothing, nor do those of bad ones that are learnt from.
    other = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels if q or not zlib.crc32(str(i).encode()) % 5]
    again = quality.score(docs_of(spark, texts), spark.createDataFrame(other, "doc_id long, quality int, toxic int")).collect()
    assert [r.doc_id for r in sorted(again)] == [r.doc_id for r in sorted(rows)]
    assert max(abs(a.score - b.score) for a, b in zip(sorted(rows), sorted(again), strict=True)) < 1e-9


def test_prior_is_near_the_share_of_good_text(spark):
    texts, labels = quality_tables(spark, 1500)
    rows = quality.measured(docs_of(spark, texts), "doc_id", "text")
    own = quality.trusted(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "quality", 20_000)
    share = sum(q for _, q, _ in labels) / len(labels)
    assert share - 0.2 <= quality.prior_of(rows, own, quality.Scale(own)) <= share + 0.02


def test_measures_equal_plain_ones():
    from sitefold.llm.words import text_bytes

    import pyarrow as pa

    texts = ["", "A b\n\nA b", "x", "é É 12 $$ wow!!", "one two one two one\nlast.", "  \n ", "W " * 5]
    found = quality.measures(*text_bytes(pa.array(texts)))
    assert found.shape == (len(texts), quality.MEASURES) and np.isfinite(found).all()
    for text, row in zip(texts, found, strict=True):
        words, lines = text.encode().split(), [x for x in text.split("\n") if x]
        pairs = list(zip(words, words[1:]))
        size = max(1, len(text.encode()))
        plain = {
            0: np.log1p(len(text.encode())), 3: sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / size, 4: sum(c in "0123456789" for c in text) / size,
            12: len(set(words)) / max(1, len(words)), 13: len(set(pairs)) / max(1, len(pairs)), 14: sum(a == b for a, b in pairs) / max(1, len(pairs)),
            15: len(set(lines)) / max(1, len(lines)), 16: np.log1p(len(words) / max(1, len(lines))),
        }
        assert {k: round(v, 9) for k, v in plain.items()} == {k: round(float(row[k]), 9) for k in plain}, text


def test_quality_defined_cases(spark):
    schema = "doc_id long, quality int, toxic int"
    texts = [None, "", "some text", "some text", "word " * 20_000]
    docs = docs_of(spark, texts, ids=[1, 2, None, None, 5])
    none = quality.score(docs, spark.createDataFrame([(1, 0, 0)], schema)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.0} and all(r.held_out for r in none if r.doc_id is None)
    one = quality.score(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], schema)).collect()
    assert len(one) == 5 and len({r.score for r in one if r.doc_id in (1, 2)}) == 1 and all(0 <= r.score <= 1 for r in one)
    assert quality.score(docs_of(spark, []), spark.createDataFrame([], schema)).count() == 0
    assert quality.score(docs_of(spark, []), spark.createDataFrame([(1, 1, 0)], schema)).count() == 0


def test_quality_query_on_held_out_documents(spark):
    rows = queries.op12_quality(spark, "/root/testdata/sf0.01")
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.97 and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


# Licence templates


def license_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "no words of it", "LICENSE license mit"]
    for label, words, _ in license_scan.TEMPLATES:
        own = words.split()
        texts.append(" ".join(own))
        for _ in range(4):
            some = list(own)
            for _ in range(rng.randrange(1 + len(some) // 5)):
                some[rng.randrange(len(some))] = rng.choice(["x", "license", "software", "the"])
            cut = rng.randrange(3)
            some = ["before"] * rng.randrange(4) + some[cut:] + ["after", "the", "license"] * rng.randrange(3)
            texts.append(rng.choice([" ", "\n", ", "]).join(some).upper())
    texts += [" ".join(rng.sample([t for t in texts if t], 6)) for _ in range(10)] + ["mit license " * 400]
    return texts


def test_license_templates_equal_brute_force(spark):
    texts = license_texts(4)
    found = sorted(license_scan.scan(docs_of(spark, texts)).collect())
    base = [b for *_, b in license_scan.scan_by_brute_force(texts)]
    wanted = [(",".join(sorted({*filter(None, labels.split(",")), *filter(None, b.split(","))})), score) for (labels, score), b in zip(license_scan.templates_by_brute_force(texts), base)]
    assert [r.labels for r in found] == [w for w, _ in wanted]
    assert max(abs(r.score - s) for r, (_, s) in zip(found, wanted)) < 1e-9 and sum(r.score >= 0.8 for r in found) > 40


def test_license_templates_cost_what_they_share_with_a_file(spark):
    """As many templates again, of other words, are candidates nowhere."""
    more = [(f"own-{n}", " ".join(f"{w}q{n}" for w in words.split()), [" ".join(f"{w}q{n}" for w in p.split()) for p in phrases]) for n in range(3) for _, words, phrases in license_scan.TEMPLATES]
    texts = license_texts(6) + [" ".join(f"w{i % 700}" for i in range(400))] * 3000
    docs = docs_of(spark, texts)
    seconds = []
    for templates in (license_scan.TEMPLATES, license_scan.TEMPLATES + more):
        rows = license_scan.scan(docs, templates=templates)
        best = []
        for _ in range(2):
            start = time.perf_counter()
            rows.write.mode("overwrite").format("noop").save()
            best.append(time.perf_counter() - start)
        seconds.append(min(best))
    assert seconds[1] < 2 * seconds[0]  # four times the templates
    with pytest.raises(ValueError):
        license_scan.mandatory(("x", "a b c", ["b d"]))


# Line dedup


def test_line_dedup_equals_its_sql_on_pages_of_boilerplate_alone(spark, tmp_path):
    texts = [f"menu\nfooter\nbody {i}" for i in range(12)] + ["menu\nfooter", "same\nlines"] + ["same\nlines"] * 3 + [None, "", "menu\n\nfooter"]
    sources = ["s"] * 12 + ["s"] * 5 + ["s", None, "s"] + [None] * 3
    docs = docs_of(spark, texts + ["menu"] * 3, sources=sources)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, source, text, n_lines, n_dropped, exempt"
    wanted = con.sql(f"SELECT {columns} FROM ({queries.ORACLES['op9_line_dedup']})").fetchall()
    found = [tuple(r) for r in queries.op9_line_dedup(spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(found) == sorted(wanted) and any(r[-1] for r in found) and any(r[2] == "" and r[4] for r in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_of_the_query_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["menu", " menu\r", "", "foot", f"u{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 4))) for _ in range(120)] + [None, "", "menu", "menu"]
    hosts = [rng.choice(["a", None]) for _ in texts]
    totals, pages = collections.Counter(hosts), collections.Counter()
    strip = lambda x: x.strip(" \t\r")
    for host, text in zip(hosts, texts):
        pages.update((host, line) for line in {strip(x) for x in (text or "").split("\n")} - {""})
    bad = {k for k, n in pages.items() if n >= 3 and n / totals[k[0]] > 0.1}
    kept = [[x for x in (t or "").split("\n") if (h, strip(x)) not in bad] for h, t in zip(hosts, texts)]
    loses = [t is not None and len(k) < len(t.split("\n")) for k, t in zip(kept, texts)]
    alone = [out and not any(map(strip, k)) for out, k in zip(loses, kept)]
    copies = collections.Counter((h, t) for h, t, a in zip(hosts, texts, alone) if a)
    wanted = []
    for h, t, k, out, a in zip(hosts, texts, kept, loses, alone):
        exempt = a and copies[h, t] > 1
        change = out and not exempt
        wanted.append(("\n".join(k) if change else t, 0 if t is None else len(t.split("\n")), len(t.split("\n")) - len(k) if change else 0, exempt))
    rows = line_dedup.drop_boilerplate(docs_of(spark, texts, sources=hosts), copies_only=True).orderBy("doc_id")
    assert [tuple(r) for r in rows.select("text", "n_lines", "n_dropped", F.col("exempt")).collect()] == wanted and any(w[-1] for w in wanted)


# Decontamination


def test_short_benchmark_items_are_found_as_they_are(spark):
    items = spark.createDataFrame([(1, "Four words, in all!"), (2, "lone"), (3, "two words"), (4, "two words"), (5, "..."), (6, None), (7, "a five word item here")], "item_id long, text string")
    texts = ["x four WORDS in all y", "four words in", "the lone one", "lonely two words", "two", "words", None, "", "and two words two words", "in all four words", "say a five word item here"]
    found = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.distance) for r in decontamination.find_items(docs_of(spark, texts), items, stretches=True).collect())
    assert found == [(0, 1, 1, 4, 0), (2, 2, 1, 1, 0), (3, 3, 1, 2, 0), (3, 4, 1, 2, 0), (8, 3, 1, 2, 0), (8, 4, 1, 2, 0), (10, 7, 1, 5, 0)]
    kept = decontamination.drop_contaminated(docs_of(spark, texts), items, stretches=True)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 9]


@pytest.mark.parametrize("most", [2048, 0])
def test_edited_items_are_found_whatever_the_edits(spark, monkeypatch, most):
    """The share found of copies with as many edits as allowed, per kind of edit; all of them where windows meet every item."""
    monkeypatch.setattr(decontamination, "MOST_REPETITIONS", most)
    rng = random.Random(2)
    items = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 7, 15, 38, 59]))) for _ in range(40)]
    texts, kinds = [], []
    for item in items:
        for kind in ("replace", "leave out", "put in"):
            for _ in range(5):
                own = item.split()
                for _ in range(len(own) // 5):
                    at = rng.randrange(len(own))
                    own[at : at + (kind != "put in")] = [] if kind == "leave out" else [f"n{rng.randrange(10**6)}"]
                texts.append(" ".join(f"x{rng.randrange(10**6)}" for _ in range(30)) + " " + " ".join(own) + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(30)))
                kinds.append(kind)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_items(docs_of(spark, texts), table, stretches=True).collect()}
    for kind in set(kinds):
        own = [(i, i // 15) in found for i, k in enumerate(kinds) if k == kind]
        assert np.mean(own) >= (0.98 if most else 1), kind


# Sharding, SimHash, toxicity and pieces: hot groups and ties


def test_shards_of_very_many_equal_rows(spark, monkeypatch):
    """A third of all rows alike is written out in blocks; buckets are summed up in groups."""
    plain = sorted(map(tuple, sharding.shard(docs_of(spark, ["same"] * 700 + [f"t{i}" for i in range(1400)], ids=[None] * 700 + list(range(1400)))).collect()), key=str)
    monkeypatch.setattr(sharding, "COPY_BLOCK", 64)
    monkeypatch.setattr(sharding, "GROUP_BUCKETS", 100)
    monkeypatch.setattr(sharding, "lookup_join", lambda *a: joins.lookup_join(*a, bound=-1))
    found = sharding.shard(docs_of(spark, ["same"] * 700 + [f"t{i}" for i in range(1400)], ids=[None] * 700 + list(range(1400)))).collect()
    assert sorted(map(tuple, found), key=str) == plain
    assert sorted(r.row_number for r in found) == list(range(2100))


def test_the_smallest_id_stays_among_negative_ones(spark):
    kept = simhash.keep_one(docs_of(spark, ["one two three four five six"] * 4, ids=[-12, 5, -17, 30]))
    assert [r.doc_id for r in kept.collect()] == [-17]


def test_toxicity_of_repeated_ids_is_repeatable(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["fine", "good", "vile", "scum", "tree"]) for _ in range(20)) for _ in range(300)]
    ids = [i % 100 for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(100)], "doc_id long, low_quality int, toxic int")
    first, second = (
        sorted(map(tuple, toxicity.score(docs_of(spark, t, ids=k), labels).collect())) for t, k in ((texts, ids), (texts[::-1], ids[::-1]))
    )
    assert first == second


def test_pieces_remember_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 1000)
    encoder, plain = pieces.Encoder(pieces.load()), pieces.Encoder(pieces.load())
    for k in range(6):
        text = ["x" * 700 + str(k), f"some words {k}"]
        assert [x.tolist() for x in encoder.encode(text)] == [x.tolist() for x in plain.encode(text)]
        assert encoder.bytes < 2500


# Pipeline


def test_pipeline_defined_cases(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "good words " * 30, "en", "a", 330), (3, "good words " * 30, "en", "a", 330), (None, "other words here " * 9, None, None, 5),
            (None, "other words here " * 9, None, None, 5), (-4, "long text of numbered words " + " ".join(f"w{i}" for i in range(20_000)), "en", "b", 9)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    labels, benchmark = ([(i, 1, i % 2) for i in range(6)], [(1, "an item that nobody holds at all")])
    for name, docs in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    single = simhash.keep_one(spark.read.parquet(f"{tmp_path}/some/documents.parquet")).collect()
    assert sorted(map(str, (r.doc_id for r in single))) == ["-4", "1", "3", "None"]
    found = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()]
    assert {*found} <= {1, 3, None, -4} and len(found) == len({*found})
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("most", [20_000, 30])
def test_a_family_of_near_copies_is_entered_under_longer_keys(spark, most):
    """A third of all fingerprints within few bits of one; groups are divided in Spark up to three times."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 700:
        near = centre
        for _ in range(rng.randrange(1, 8)):
            near ^= 1 << rng.randrange(64)
        prints.add(near)
    prints |= {rng.getrandbits(64) for _ in range(1400)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    edges = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fingerprint_bits long"), most_prints=most).collect()
    parent = {p: p for p in signed}

    def root(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    mask = (1 << 64) - 1
    for low, high in edges:
        assert bin((low ^ high) & mask).count("1") <= 3
        parent[root(low)] = root(high)
    found = {p: root(p) for p in signed}
    values = np.array(sorted(prints), np.uint64)
    for p in sorted(prints):
        near = values[np.bitwise_count(values ^ np.uint64(p)) <= 3]
        assert len({found[int(q) - (1 << 64) if q >= 1 << 63 else int(q)] for q in near}) == 1


def test_smallest_hashes_are_those_of_a_plain_order(spark):
    from sitefold.llm.common import smallest_hashes

    rows = spark.range(20_000).withColumnRenamed("id", "key")
    plain = [r.key for r in rows.orderBy(F.xxhash64("key"), "key").limit(500).collect()]
    assert [r.key for r in smallest_hashes(rows, "key", 500).collect()] == plain
    assert smallest_hashes(rows.limit(3), "key", 500).count() == 3
