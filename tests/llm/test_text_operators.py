"""Text operators against brute force, and their defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sitefold.llm import decontamination, license_scan, line_dedup, sharding, simhash, substring_dedup, words
from sitefold.operators import joins as operators_joins

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = DOCS + ", bucket string, chunk string, copies int, place int, host int, fingerprint_bits string, component int, words int, low int"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs_of(spark, texts, ids=None, sources=None, clashing=False):
    rows = [
        (i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], 0, *(["x", "y", 1, 2, 3, "z", 4, 5, 6] if clashing else []))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, CLASHING if clashing else DOCS)


def some_texts(seed, n=60):
    """Texts of few words, so that windows, shingles and near copies repeat."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab cd ef gh ij kl Mn".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(120))) for _ in range(n // 2)]
    texts = list(base)
    for _ in range(n - len(base)):
        own = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            if own:
                own[rng.randrange(len(own))] = "new" + str(rng.randrange(9))
        texts.append(rng.choice([" ", "\t", "\n "]).join(own))
    return texts + [None, "", "   ", "one", "one two", "é ü x", base[0], base[0]]


def test_word_spans_equal_split():
    texts = ["", "a", " a ", None, "b\tc\x0bd", " x y", "zz"]
    data, offsets = words.text_bytes(pa.array(texts))
    starts, ends, first = words.word_spans(data, offsets, words.NOT_BLANK)
    found = [[bytes(data[a:b]) for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert found == [(t or "").encode().split() for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    data, offsets = words.text_bytes(pa.array(["abcdefghij x abcdefghij", "x", "abcdefghik"]))
    starts, ends, _ = words.word_spans(data, offsets, words.NOT_BLANK)
    h = words.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_rolling_hashes_of_equal_windows():
    h = np.array([1, 2, 3, 9, 1, 2, 3], np.uint64)
    found = words.rolling_hashes(h, 3, substring_dedup.BASES[0])
    assert found[0] == found[4] and len(set(found.tolist())) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    texts = some_texts(seed)
    ids = [7 * i % 101 for i in range(len(texts) - 2)] + [5, 5]
    found = substring_dedup.remove_repeats(docs_of(spark, texts, ids, clashing=True), width=6, chunk_bytes=500).collect()
    mine = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found)
    assert mine == sorted(substring_dedup.removed_by_brute_force(list(zip(ids, texts)), 6))
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_substring_dedup_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [passage, passage, "x " + passage + " y", LONG, LONG, None, ""]
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(spark, texts, [3, None, 9, 20, 21, 30, 31])).collect()}
    assert [found[i].n_removed for i in (3, None, 9, 20, 21)] == [0, 50, 50, 0, 30_000]
    assert found[9].kept_text == "x y" and found[9].removed[0].start == 1
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = [w.decode() for w in lowered.encode().split()]
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or ([" ".join(own)] if own else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most=3):
    top = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= most:
                    top[i] = top[j] = min(top[i], top[j])
    return top


def test_simhash_equals_brute_force(spark):
    texts = some_texts(3, 50)
    found = sorted(simhash.near_duplicates(docs_of(spark, texts, clashing=True)).collect())
    prints = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in found] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in found] == plain_components(prints)


def test_simhash_links_of_close_fingerprints(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(30):
        own = rng.getrandbits(64)
        for _ in range(4):
            prints.append(own)
            for _ in range(rng.randrange(1, 5)):
                own ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint_bits long")
    edges = [(r.low % (1 << 64), r.high % (1 << 64)) for r in simhash.fingerprint_links(rows).collect()]
    assert edges and all((a ^ b).bit_count() <= 3 for a, b in edges)
    place = {p: i for i, p in enumerate(prints)}
    top = list(range(len(prints)))
    for _ in prints:
        for a, b in edges:
            top[place[a]] = top[place[b]] = min(top[place[a]], top[place[b]])
    assert top == plain_components(prints)


def test_dense_group_is_divided():
    rng = np.random.default_rng(5)
    values = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 6), replace=False)) for _ in range(900)], dtype=np.uint64))
    edges = simhash.joining_edges(values, list(range(20)), 1, direct=16)
    assert len(edges) < len(values) and all((int(values[i]) ^ int(values[j])).bit_count() <= 1 for i, j in edges)
    whole = simhash.joining_edges(values, list(range(20)), 1, direct=10**6)  # all pairs compared
    assert len(whole) == len(edges)


def test_simhash_defined_cases(spark):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, [None, "", LONG, LONG + " z"], [4, 2, 8, 7])).collect()}
    assert found[4].fingerprint == "0" * 16 and found[4].component_id == 2 and found[8].component_id == 7
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    null_ids = simhash.near_duplicates(docs_of(spark, ["a b c d", "a b c d", "q"], [None, 3, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in null_ids) == [("3", "3"), ("None", "3"), ("None", "None")]


def test_keep_one_of_each_group(spark):
    texts = ["a b c d e", "A b  c d e", "x y z w v u", "a b c d e", None, ""]
    docs = docs_of(spark, texts, [12, 3, 5, 12, 40, None], clashing=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 40]
    assert simhash.keep_one(docs_of(spark, ["q r s"] * 3, [1, 1, 1])).count() == 1
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def test_license_places_equal_brute_force(spark):
    texts = [
        "Released under the MIT License.", "mit-license MIT\tLICENSE apache license", "mit licenses, permit license", None, "", "GNU General Public License license",
        "The General  Public\nLicense; mit x license", "É mit license Kelvin license", LONG + " apache license", "mit license " * 200, "MITLICENSE", "Ümit license",
    ]
    found = sorted(license_scan.scan(docs_of(spark, texts, clashing=True)).collect())
    wanted = license_scan.scan_by_brute_force(texts)
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in found] == wanted
    assert found[8].n_words == 30_002 and found[3].n_words == 0 and all(0 <= r.score <= 1 for r in found)


def test_license_templates_need_their_phrases_in_place(spark):
    texts = [words_ for _, words_, _ in license_scan.TEMPLATES]
    texts += ["licensed under the license apache version 2 0", "Text before. Licensed under the Apache License, Version 2.0. After.", "licensed cc by nc 4 0", "nothing here"]
    found = sorted(license_scan.scan(docs_of(spark, texts)).collect())
    for row, (label, _, _) in zip(found, license_scan.TEMPLATES):
        assert label in row.labels.split(",") and row.score == pytest.approx(1)
    assert found[-4].labels == "" and found[-3].labels == "apache,apache-2.0" and found[-1].score == 0
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def test_sharding_law(spark):
    texts = some_texts(6, 70)
    ids = [None, *range(len(texts) - 3), 4, 4]
    docs = docs_of(spark, texts, ids, clashing=True)
    found = sharding.shard(docs).collect()
    n = len(texts)
    sizes = [sum(r.shard == s for r in found) for s in range(16)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    wanted = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == wanted
    again = sharding.shard(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    back = spark.createDataFrame(found).select("row_number", sharding.row_number_at("shard", "slot", n).alias("back")).collect()
    assert all(r.row_number == r.back for r in back) and sorted(r.row_number for r in found) == list(range(n))
    assert sharding.shard(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_permutation(spark, n):
    found = spark.range(n).selectExpr(f"{sharding.permuted('id', n)} AS p").selectExpr("p", f"{sharding.permuted('p', n, inverse=True)} AS q").collect()
    assert sorted(r.p for r in found) == list(range(n)) and sorted(r.q for r in found) == list(range(n))
    assert n < 100 or [r.p for r in found] != list(range(n))


def plain_line_dedup(rows, max_ratio, min_pages):
    pages, totals = {}, {}
    for host, text in rows:
        totals[host] = totals.get(host, 0) + 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
    out = []
    for host, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not x.strip(" \t\r") or not (pages[host, x.strip(" \t\r")] >= min_pages and pages[host, x.strip(" \t\r")] / totals[host] > max_ratio)]
        changes = len(kept) < len(lines) and any(x.strip(" \t\r") for x in kept)
        out.append((text if not changes else "\n".join(kept), 0 if text is None else len(lines), len(lines) - len(kept) if changes else 0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["menu", " menu\r", "", f"l{rng.randrange(30)}", f"u{rng.random()}"]) for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    texts += [None, "", "\n\n", "menu"]
    sources = [rng.choice(["a", "b", None]) for _ in texts]
    docs = docs_of(spark, texts, sources=sources, clashing=True)
    found = sorted(line_dedup.drop_boilerplate(docs, max_ratio=0.2).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert [tuple(r)[1:] for r in found] == plain_line_dedup(list(zip(sources, texts)), 0.2, 3)
    assert line_dedup.drop_boilerplate(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_line_dedup_keeps_whole_copies(spark):
    docs = docs_of(spark, ["menu\nown one", "menu\nown two", "menu\nown three", "same\nlines"] + ["same\nlines"] * 3)
    found = [r.text for r in line_dedup.drop_boilerplate(docs).orderBy("doc_id").collect()]
    assert found == ["own one", "own two", "own three"] + ["same\nlines"] * 4
    assert line_dedup.drop_boilerplate(docs_of(spark, [])).count() == 0


def test_line_dedup_exempts_only_proven_copies(spark, monkeypatch):
    texts = ["menu\nfoot\nown one", "menu\nfoot\nown two", "menu\nfoot\nown three", "menu\nfoot", "foot\n\n menu", "same\nlines"] + ["same\nlines"] * 3 + [None, ""]
    wanted = ["own one", "own two", "own three", "", "", *["same\nlines"] * 4, None, ""]
    docs = docs_of(spark, texts + texts[:4], sources=["s"] * len(texts) + [None] * 4, clashing=True)
    for bound in (operators_joins.BROADCAST_BYTES, 0):
        monkeypatch.setattr(line_dedup, "lookup_join", lambda *a, bound=bound: operators_joins.lookup_join(*a, bound=bound))
        rows = sorted(line_dedup.drop_boilerplate(docs, copies_only=True).select("doc_id", "text", "n_dropped", "exempt").collect())
        assert [None if r.text is None else r.text.strip("\n") for r in rows] == wanted + ["own one", "own two", "own three", ""]
        assert [r.n_dropped for r in rows] == [2] * 5 + [0] * 6 + [2] * 4
        assert [r.doc_id for r in rows if r.exempt] == [5, 6, 7, 8]
    assert line_dedup.drop_boilerplate(docs, copies_only=True).columns == [*docs.columns, "n_lines", "n_dropped", "exempt"]
    assert line_dedup.drop_boilerplate(docs_of(spark, []), copies_only=True).count() == 0


def plain_matches(docs, items):
    found = {}
    for d, text in docs:
        h, _ = decontamination.words_of(pa.array([text], pa.large_string()))
        for i, item in items:
            own, _ = decontamination.words_of(pa.array([item], pa.large_string()))
            m = len(own)
            if m >= decontamination.LEAST_WORDS and len(h) >= m:
                windows = np.lib.stride_tricks.sliding_window_view(h, m)
                distance = decontamination.edit_distances(windows, np.repeat(own[None], len(windows), 0))
                best = int(distance.argmin())
                if distance[best] <= m // 5:
                    found[d, i] = (best, int(distance[best]))
    return found


def edited(rng, own, n):
    own = list(own)
    for _ in range(n):
        at = rng.randrange(len(own))
        own[at : at + rng.randrange(2)] = [f"e{rng.randrange(99)}"] * rng.randrange(2)
    return own


def test_edit_distances():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            old, row = row, [i + 1] + [0] * len(b)
            for j, y in enumerate(b):
                row[j + 1] = min(row[j] + 1, old[j + 1] + 1, old[j] + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (40, 9)).astype(np.uint64), rng.integers(0, 4, (40, 9)).astype(np.uint64)
    assert decontamination.edit_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_decontamination_recall_and_exactness(spark):
    rng = random.Random(8)
    items = [(100 + i, [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(12, 50))]) for i in range(40)]
    docs = []
    for d in range(160):
        own = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(200))]
        if d % 2:
            passage = rng.choice(items)[1]
            at = rng.randrange(len(own) + 1)
            own[at:at] = edited(rng, passage, rng.randrange(len(passage) // 5 + 2))
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(own).upper()))
    docs += [(500, None), (501, "")]
    item_rows = [(i, " ".join(own)) for i, own in items] + [(900, None), (901, ""), (902, "two words")]
    bench = spark.createDataFrame(item_rows, "item_id long, text string")
    table = docs_of(spark, [t for _, t in docs], [d for d, _ in docs], clashing=True)
    wanted = plain_matches(docs, item_rows)
    for block_bytes in (1 << 20, 2_000):
        found = {(r.doc_id, r.item_id): (r.first_word, r.distance) for r in decontamination.find_items(table, bench, block_bytes=block_bytes).collect()}
        assert set(found) <= set(wanted) and len(found) >= 0.97 * len(wanted) > 40
        assert sum(found[k] == wanted[k] for k in found) >= 0.97 * len(found)
    clean = decontamination.drop_contaminated(table, bench, block_bytes=2_000)
    assert clean.columns == table.columns
    kept = {r.doc_id for r in clean.collect()}
    assert not kept & {d for d, _ in found} and kept | {d for d, _ in found} == {d for d, _ in docs}


def test_decontamination_defined_cases(spark):
    item = "one two three four five six seven"
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    docs = docs_of(spark, [item, "x " + item.upper() + "!", None, LONG + " " + item, item], [None, 1, 2, 3, 1])
    found = sorted((str(r.doc_id), r.item_id, r.first_word, r.distance) for r in decontamination.find_items(docs, bench).collect())
    assert found == sorted([("None", 1, 0, 0), ("None", 2, 0, 0), ("1", 1, 1, 0), ("1", 2, 1, 0), ("1", 1, 0, 0), ("1", 2, 0, 0), ("3", 1, 30_000, 0), ("3", 2, 30_000, 0)])
    assert decontamination.find_items(docs_of(spark, []), bench).count() == 0
    assert decontamination.find_items(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 5


def plain_stretches(docs, items):
    """(document, item): least distance over all stretches of the document, of whatever length."""
    found = {}
    for d, text in docs:
        h = decontamination.words_of(pa.array([text], pa.large_string()))[0].tolist()
        for i, item in items:
            own = decontamination.words_of(pa.array([item], pa.large_string()))[0].tolist()
            row = [0] * (len(h) + 1)
            for n, word in enumerate(own):
                old, row = row, [n + 1]
                for j, x in enumerate(h):
                    row.append(min(row[j] + 1, old[j + 1] + 1, old[j] + (x != word)))
            if len(own) >= decontamination.LEAST_WORDS and min(row) <= len(own) // 5:
                found[d, i] = min(row)
    return found


def test_best_stretches():
    def hashed(text):
        return decontamination.words_of(pa.array([text], pa.large_string()))[0]

    item = "a b c d e f g h i j"
    texts = ["x y a b c d e f g h i j z", "q a b c e f g h i j k l", "a b c d p e f g h i j", "b c d e f g h i j"]
    sizes = np.array([len(t.split()) for t in texts])
    rows = np.array([np.pad(hashed(t), (0, 13 - n)) for t, n in zip(texts, sizes)])
    found = decontamination.best_stretches(rows, sizes, np.repeat(hashed(item)[None], 4, 0))
    assert [x.tolist() for x in found] == [[0, 1, 1, 1], [2, 1, 0, 0], [10, 9, 11, 9]]


def test_decontamination_finds_stretches_of_other_lengths(spark):
    rng = random.Random(9)
    items = [(i, [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(15, 60))]) for i in range(30)]
    docs = []
    for d in range(180):
        own, passage = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80))] for _ in range(2)], list(items[d % 30][1])
        for _ in range(len(passage) // 5):
            at = rng.randrange(len(passage))
            passage[at : at + (d % 3 != 1)] = [] if d % 3 == 0 else [f"e{rng.randrange(99)}"]  # left out, put in, replaced
        docs.append((d, " ".join(own[0] + passage + own[1])))
    docs += [(1000 + i, " ".join(own[1:])) for i, own in items]  # whole documents shorter than the item
    docs += [(2000 + i, "front " + " ".join(own[: len(own) - len(own) // 5])) for i, own in items]  # stretches at the end
    item_rows = [(i, " ".join(own)) for i, own in items]
    bench = spark.createDataFrame(item_rows, "item_id long, text string")
    table = docs_of(spark, [t for _, t in docs], [d for d, _ in docs])
    wanted = plain_stretches(docs, item_rows)
    rows = decontamination.find_items(table, bench, stretches=True).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert len(rows) == len(found) and set(found) <= set(wanted) and len(found) >= 0.97 * len(wanted) >= 0.97 * 240
    assert sum(found[k] == wanted[k] for k in found) >= 0.97 * len(found)
    texts, words_in = dict(docs), dict(items)
    for r in rows:
        assert r.similarity == pytest.approx(1 - r.distance / len(words_in[r.item_id])) and abs(r.n_words - len(words_in[r.item_id])) <= r.distance
        assert r.first_word + r.n_words <= len(texts[r.doc_id].split())
    assert sum(k[0] < 180 and k[0] % 3 == 0 for k in found) >= 57 and sum(1000 <= k[0] < 2000 for k in found) == 30 and sum(k[0] >= 2000 for k in found) >= 29
    clean = {r.doc_id for r in decontamination.drop_contaminated(table, bench, stretches=True).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}
