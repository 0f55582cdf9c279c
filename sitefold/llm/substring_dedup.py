"""Exact repeated passages: Rabin-Karp hashes of all word windows, counted in Spark, merged into removal intervals.

A window is ``WINDOW`` consecutive words of one document. A word is removed if a window that covers it also starts in a
document with a smaller id; all windows are judged on the input.

1. Documents are dealt to chunks of some 8 MB of text by a hash of their id and text. Each chunk computes the rolling hash of
   every window, drops repeats within the chunk (their smallest id stays) and deals the rest to buckets by a second
   rolling hash, eight bytes a window. A passage that a third of all documents share thus travels once per chunk.
2. Each bucket counts its windows over all chunks and answers to every chunk but that of the smallest id.
3. Each chunk, cogrouped with its answers, marks the words its repeated windows cover, merges them into maximal
   intervals and writes the words that are left. The chunking exchange of step 1 is the same and is reused.

The numbers of chunks and of buckets follow the size of the table, so neither grows itself, but the rows between them are as many as
their product: on 1 TB such a row holds some 16 windows, from about 10 TB on one or two, and both sizes should then be
set larger, as far as a task's memory allows. Two different windows count as equal only if 64 bits
of one hash and the bucket of the other agree: buckets double with the table, and the chance of one false pair stays
below one in 10,000 for up to 10**9 windows and falls with the buckets' number beyond.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null text has no words. A null id ranks after all others.
Documents with equal ids do not rob each other of words. Repeated rows give repeated rows. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import scale_of
from sitefold.llm.words import NOT_BLANK, packed, rolling_hashes, slices, text_bytes, unpacked, window_mask, word_hashes, word_spans

WINDOW = 50
CHUNK_BYTES = 8 << 20
#: Text whose windows share a bucket: about two million windows.
BUCKET_BYTES = 12 << 20
#: Odd bases of the two rolling hashes.
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_LAST = np.iinfo(np.int64).max


def _windows(texts: pa.ChunkedArray, width: int, n_buckets: int | None):
    """For slices of the texts: first document, words per document, starts of windows, documents, hashes, buckets."""
    data, offsets = text_bytes(texts)
    for first, last in slices(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, first_word = word_spans(part, offsets[first : last + 1] - offsets[first], NOT_BLANK)
        hashes = word_hashes(part, starts, ends)
        at = np.flatnonzero(window_mask(first_word, len(starts), width))
        document = first + np.searchsorted(first_word, at, side="right") - 1
        one = rolling_hashes(hashes, width, BASES[0])[at] if len(at) else np.zeros(0, np.uint64)
        two = None
        if n_buckets and len(at):
            two = (rolling_hashes(hashes, width, BASES[1])[at] % np.uint64(n_buckets)).astype(np.int64)
        yield first, first_word, at, document, one, np.zeros(0, np.int64) if two is None else two


def _ids(chunk: pa.Table) -> np.ndarray:
    return chunk.column("id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)


def _first_of_chunk(documents: np.ndarray, ids: np.ndarray, hashes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Index of one entry per window content: that of the smallest id."""
    order = np.lexsort((ids[documents], hashes, buckets))
    h, b = hashes[order], buckets[order]
    return order[np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])]]


def _offers(chunk: pa.Table, width: int, n_buckets: int) -> pa.Table:
    """A row per bucket: distinct windows of the chunk, in the order of ids, and how many each id has."""
    ids = _ids(chunk)
    documents, hashes, buckets = [], [], []
    for _, _, _, document, one, two in _windows(chunk.column("text"), width, n_buckets):
        documents.append(document.astype(np.int32))
        hashes.append(one)
        buckets.append(two.astype(np.int32))
    rows = {"bucket": [], "chunk": [], "ids": [], "counts": [], "hashes": []}
    document = np.concatenate(documents) if documents else np.zeros(0, np.int32)
    if len(document):
        h, b = np.concatenate(hashes), np.concatenate(buckets)
        once = _first_of_chunk(document, ids, h, b)
        once = once[np.lexsort((ids[document[once]], b[once]))]
        h, b, i = h[once], b[once], ids[document[once]]
        cuts = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            own, counts = np.unique(i[first:last], return_counts=True)
            gaps = np.diff(own, prepend=own[:1]).astype(np.uint64)
            rows["bucket"].append(int(b[first]))
            rows["chunk"].append(chunk.column("chunk")[0].as_py())
            rows["ids"].append(int(own[0]).to_bytes(8, "little", signed=True) + packed(gaps))
            rows["counts"].append(packed(counts.astype(np.uint64)))
            rows["hashes"].append(h[first:last].tobytes())
    kinds = [("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]
    return pa.table(rows, schema=pa.schema(kinds))


def _answers(bucket: pa.Table) -> pa.Table:
    """Per chunk the windows of this bucket that a smaller id of another chunk holds."""
    chunks = bucket.column("chunk").to_numpy()
    ids, hashes, counts = [], [], []
    for own, n, h in zip(*(bucket.column(c).to_pylist() for c in ("ids", "counts", "hashes")), strict=True):
        first = int.from_bytes(own[:8], "little", signed=True)
        ids.append(np.repeat(first + np.cumsum(unpacked(own[8:]).astype(np.int64)), unpacked(n).astype(np.int64)))
        hashes.append(np.frombuffer(h, np.uint64))
        counts.append(len(hashes[-1]))
    i, h = np.concatenate(ids), np.concatenate(hashes)
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    order = np.lexsort((i, h))
    h, i, row = h[order], i[order], row[order]
    new = np.r_[True, h[1:] != h[:-1]]
    smallest = i[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.flatnonzero(i > smallest)
    late = late[np.argsort(row[late], kind="stable")]
    told, at = np.unique(row[late], return_index=True)
    parts = np.split(h[late], at[1:]) if len(told) else []
    found = {"chunk": chunks[told], "hashes": [p.tobytes() for p in parts]}
    return pa.table(found, schema=pa.schema([("chunk", pa.int64()), ("hashes", pa.binary())]))


def _removed(covered: np.ndarray, first_word: np.ndarray, d: int) -> np.ndarray:
    return covered[first_word[d] : first_word[d + 1]]


def _cleaned(chunk: pa.Table, answers: pa.Table, width: int) -> pa.Table:
    """Words, removed words, intervals and the text that is left of every document of a chunk."""
    ids = _ids(chunk)
    told = [np.frombuffer(x, np.uint64) for x in answers.column("hashes").to_pylist()]
    elsewhere = np.unique(np.concatenate(told)) if told else np.zeros(0, np.uint64)
    texts = chunk.column("text").to_pylist()
    parts = list(_windows(chunk.column("text"), width, None))
    h = np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, np.uint64)
    document = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
    late = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((ids[document], h))
        sorted_h, sorted_i = h[order], ids[document[order]]
        new = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
        smallest = sorted_i[np.flatnonzero(new)][np.cumsum(new) - 1]
        late[order] = sorted_i > smallest
        if len(elsewhere):
            at = np.minimum(np.searchsorted(elsewhere, h), len(elsewhere) - 1)
            late |= elsewhere[at] == h
    n_words, n_removed, kept, spans, seen = [], [], [], [], 0
    for first, first_word, at, _, one, _ in parts:
        hit = at[late[seen : seen + len(one)]]
        seen += len(one)
        edges = np.zeros(int(first_word[-1]) + width + 1, np.int32)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + width, -1)
        covered = np.cumsum(edges)[: int(first_word[-1])] > 0
        for d in range(len(first_word) - 1):
            words = (texts[first + d] or "").encode().split()
            gone = _removed(covered, first_word, d)
            count = int(gone.sum())
            if count:
                turns = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
                words = list(compress(words, (~gone).tolist()))
            else:
                spans.append([])
            n_words.append(len(gone))
            n_removed.append(count)
            kept.append(b" ".join(words).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [chunk.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
    return pa.table(columns, names=["id", "n_words", "n_removed", "removed", "kept_text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Key, n_words, n_removed, removed (word intervals, end excluded) and kept_text of every document."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0]
    n_chunks, n_buckets = scale_of(total, chunk_bytes), scale_of(total, BUCKET_BYTES, 12)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chunked = plain.select(F.expr(f"pmod(xxhash64(id, text), {n_chunks})").alias("chunk"), "id", "text")
    offers = chunked.groupBy("chunk").applyInArrow(
        lambda chunk: _offers(chunk, width, n_buckets), "bucket int, chunk bigint, ids binary, counts binary, hashes binary"
    )
    answers = offers.groupBy("bucket").applyInArrow(_answers, "chunk bigint, hashes binary")
    cleaned = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda chunk, told: _cleaned(chunk, told, width),
        "id bigint, n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string",
    )
    return cleaned.withColumnRenamed("id", key)


def removed_by_brute_force(rows: list[tuple[int | None, str | None]], width: int = WINDOW) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) by comparing word tuples; for tests on small tables."""
    split = [(_LAST if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for rank, _, words in split:
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            first[window] = min(rank, first.get(window, rank))
    found = []
    for rank, i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < rank:
                gone[k : k + width] = [True] * width
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        found.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return found
