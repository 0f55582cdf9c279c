"""Cross-tokenizer alignment by whitespace-token anchors, with a memory of aligned windows.

Every text is encoded by two tokenizers: A, byte-level BPE (of a blank and the text), and B, a SentencePiece model (which puts
its own marker before the text). Tokens are compared as bytes.

1. Full tokenisation of whole texts. A text whose tokens don't give a blank and the text in both is left out.
2. Anchors. Byte offsets where tokens of both end, before a token with a leading blank on either side, and the text's
   end, cut a text into windows of token ids.
3. Windows are aligned once: token ends in common cut a window into groups, tokens with bytes in common are linked. The
   result is remembered under the tuple of A's ids and the tuple of B's; the memory starts afresh beyond ``MEMORY_LINKS``.
4. Links are counted per id pair, within a task first and then over the corpus; each document's pairs are landed as a
   sorted, packed list beside its digest. The counts are measured: up to ``TABLE_PAIRS`` pairs they travel to the documents by
   broadcast, beyond that the pairs of documents meet them in a join that spreads each pair over several tasks.

Tokenizers are read on the driver from the paths given and travel by broadcast; both have the size of their vocabulary.

Defined cases: null and empty texts, and those left out in 1, have no tokens, zeros and no groups. Tokens that hold the
special tokens' strings are plain text. Repeated rows are documents of their own, null keys are carried. Very long texts are encoded
whole. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import landed, short_batches
from sitefold.llm.words import packed, ranges, unpacked
from sitefold.operators.joins import spread_join
from sitefold.session import landed as landed_table

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
MARKER = "▁"
#: Fixed value: the cut into words that byte-level BPE files with ``use_regex`` mean.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links that a task remembers, pairs that it counts before it passes them on, and pairs that are broadcast.
MEMORY_LINKS, TASK_PAIRS, TABLE_PAIRS = 2 << 20, 1 << 20, 4 << 20

_LANDED = "row bigint, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary, counted boolean"


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and numbers the others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Byte-level BPE from a tokenizer file, without its special tokens."""

    def __init__(self, description: str):
        self.description = description
        known, letters = json.loads(description), _byte_letters()
        special = {t["content"] for t in known["added_tokens"]}
        vocabulary = {piece: i for piece, i in known["model"]["vocab"].items() if piece not in special}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in known["added_tokens"])]))
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece)
        # Where ids follow the order of merges, they are the ranks that the faster library goes by.
        merges = [m.split(" ") if isinstance(m, str) else m for m in known["model"]["merges"]]
        cut = known["pre_tokenizer"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] and known["normalizer"] is None
        self.ranked = plain and all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        self._encoder = None

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._encoder is None and self.ranked:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self._encoder = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        elif self._encoder is None:
            from tokenizers import Tokenizer

            self._encoder = Tokenizer.from_str(self.description)
            self._encoder.encode_special_tokens = True
        if self.ranked:
            return [self._encoder.encode_ordinary(text) for text in texts]
        return [self._encoder.encode(text, add_special_tokens=False).ids for text in texts]


class PieceTokenizer:
    """A SentencePiece model."""

    def __init__(self, model: bytes):
        self.model, self._encoder = model, None
        encoder, self.bytes = self._own(), []
        for i in range(encoder.get_piece_size()):
            piece = encoder.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:-1], 16)]) if encoder.is_byte(i) else piece.replace(MARKER, " ").encode())

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    def _own(self):
        if self._encoder is None:
            import sentencepiece

            self._encoder = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._encoder

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own().encode(texts, num_threads=1)


def tokenizers(byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> tuple[ByteTokenizer, PieceTokenizer]:
    with open(byte_bpe, encoding="utf-8") as description, open(piece_bpe, "rb") as model:
        return ByteTokenizer(description.read()), PieceTokenizer(model.read())


def _token_counts(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of token ends before each of the places ``at``."""
    return np.cumsum(mark)[at] - mark[at]


class Aligner:
    """Aligns batches of encoded texts and remembers windows by their id tuples."""

    def __init__(self, tokens_a: list[bytes], tokens_b: list[bytes]):
        self.tokens_a, self.tokens_b = tokens_a, tokens_b
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in tokens], np.int64) for tokens in (tokens_a, tokens_b))
        self.marked_a, self.marked_b = (np.array([t[:1] == b" " for t in tokens]) for tokens in (tokens_a, tokens_b))
        # An id's text with what may follow it: an id of its side, the other side, another group, nothing.
        names_a, names_b = ([str(i) for i in range(len(tokens))] for tokens in (tokens_a, tokens_b))
        self.texts_a = np.array([[n + "," for n in names_a], [n + "|" for n in names_a]], object)
        self.texts_b = np.array([[n + "," for n in names_b], [n + ";" for n in names_b], names_b], object)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.groups, self.n_groups, self.starts, self.pairs = [], array("q"), array("q", [0]), array("q")

    def _learn(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Align new windows, laid end to end, all at once; ``n_a`` and ``n_b`` are their numbers of tokens.

        Token ends of both sides cut a window into stretches; each lies in one token of A and one of B, and links them.
        """
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        mark_a, mark_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_b[-1] + 1, bool)
        mark_a[ends_a] = mark_b[ends_b] = True
        stretch, shared = np.flatnonzero(mark_a | mark_b), np.flatnonzero(mark_a & mark_b)
        links = a[_token_counts(mark_a, stretch)].astype(np.int64) * len(self.tokens_b) + b[_token_counts(mark_b, stretch)]
        window_ends = ends_a[np.cumsum(n_a) - 1]
        self.starts.extend((len(self.pairs) + np.searchsorted(stretch, window_ends, side="right")).tolist())
        self.pairs.frombytes(links.tobytes())
        groups = np.searchsorted(shared, window_ends, side="right")
        self.n_groups.extend(np.diff(groups, prepend=0).tolist())
        # Texts in the order of groups, A's ids before B's in each.
        upto_a, upto_b = np.searchsorted(ends_a, shared, side="right"), np.searchsorted(ends_b, shared, side="right")
        sizes_a, sizes_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        last_b[np.cumsum(n_b) - 1] = 2
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + np.repeat(np.r_[0, upto_b[:-1]], sizes_a)] = self.texts_a[last_a, a]
        texts[np.arange(len(b)) + np.repeat(upto_a, sizes_b)] = self.texts_b[last_b, b]
        texts, first = texts.tolist(), 0
        for end in np.cumsum(n_a + n_b).tolist():
            self.groups.append("".join(texts[first:end]))
            first = end

    def fits(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = b" " + text.encode()
        return b"".join(map(self.tokens_a.__getitem__, a)) == whole == b"".join(map(self.tokens_b.__getitem__, b))

    def windows(self, a: np.ndarray, b: np.ndarray, bytes_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One past the last token of every window in A and in B, and its end, for texts laid end to end (``bytes_of``: their ends)."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        last = np.full(size + 1, -1, np.int64)
        last[ends_a] = np.arange(len(a))
        shared = np.flatnonzero(last[ends_b] >= 0)
        in_a = last[ends_b[shared]]
        marked_a, marked_b = (np.r_[m[ids], True][1:] for m, ids in ((self.marked_a, a), (self.marked_b, b)))
        border = np.zeros(size + 1, bool)
        border[bytes_of] = True
        anchor = (marked_a[in_a] & marked_b[shared]) | border[ends_b[shared]]
        return in_a[anchor] + 1, shared[anchor] + 1, ends_b[shared[anchor]]

    def batch(self, texts: list[str], encoded_a: list[list[int]], encoded_b: list[list[int]]):
        """Per text n_groups, n_links, groups, and its sorted distinct id pairs with their number of links."""
        if len(self.pairs) > MEMORY_LINKS:
            self._forget()
        a, b = (np.concatenate([np.array(ids, np.int32) for ids in encoded]) for encoded in (encoded_a, encoded_b))
        text_ends = np.cumsum([1 + len(text.encode()) for text in texts])
        ends_a, ends_b, ends = self.windows(a, b, text_ends, int(text_ends[-1]))
        bytes_a, bytes_b = a.tobytes(), b.tobytes()
        numbers, fresh, low_a, low_b, learnt = [], [], 0, 0, len(self.groups)
        for high_a, high_b in zip((4 * ends_a).tolist(), (4 * ends_b).tolist(), strict=True):
            key = (bytes_a[low_a:high_a], bytes_b[low_b:high_b])
            number = self.known.get(key)
            if number is None:
                self.known[key] = number = learnt + len(fresh)
                fresh.append(len(numbers))
            numbers.append(number)
            low_a, low_b = high_a, high_b
        if fresh:
            n_a, n_b = np.diff(ends_a, prepend=0)[fresh], np.diff(ends_b, prepend=0)[fresh]
            new_a = np.repeat(ends_a[fresh] - n_a, n_a) + ranges(n_a)
            new_b = np.repeat(ends_b[fresh] - n_b, n_b) + ranges(n_b)
            self._learn(a[new_a], b[new_b], n_a, n_b)
        cuts = np.searchsorted(ends, text_ends, side="right")
        window = np.array(numbers, np.int64)
        starts, pairs, n_groups = np.array(self.starts), np.array(self.pairs), np.array(self.n_groups)
        sizes = starts[window + 1] - starts[window]
        links = pairs[np.repeat(starts[window], sizes) + ranges(sizes)]
        link_ends = np.r_[0, np.cumsum(sizes)]
        first = 0
        for end in cuts.tolist():
            distinct, times = np.unique(links[link_ends[first] : link_ends[end]], return_counts=True)
            groups = ";".join(map(self.groups.__getitem__, numbers[first:end]))
            yield int(n_groups[window[first:end]].sum()), int(times.sum()), groups, distinct, times
            first = end


def _gaps(distinct: np.ndarray) -> bytes:
    return packed(np.diff(distinct, prepend=0).astype(np.uint64))


def _ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).astype(np.int64))


class Tally:
    """Numbers of links per pair that a task hasn't passed on yet."""

    def __init__(self):
        self.pairs = self.times = np.zeros(0, np.int64)

    def add(self, pairs: list[np.ndarray], times: list[np.ndarray]) -> None:
        keys, weights = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.pairs, self.times = keys[begins], np.add.reduceat(weights, begins) if len(keys) else weights


def _record(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
    names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times", "counted"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def aligned(docs: DataFrame, key: str, text: str, coders: tuple[ByteTokenizer, PieceTokenizer], digest: bool, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """A row per document with its alignment and packed pairs, and rows (``counted``) with the pairs that a task has counted."""
    shared = docs.sparkSession.sparkContext.broadcast(coders)

    def run(batches) -> Iterator[pa.RecordBatch]:
        coder_a, coder_b = shared.value
        aligner, tally = Aligner(coder_a.bytes, coder_b.bytes), Tally()
        row, key_type = TaskContext.get().partitionId() << 40, pa.int64()
        for batch in batches:
            key_type, keys = batch.column(0).type, batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            given = [k for k, t in enumerate(texts) if t]
            encoded_a, encoded_b = coder_a.encode([" " + texts[k] for k in given]), coder_b.encode([texts[k] for k in given])
            fitting = [n for n, k in enumerate(given) if aligner.fits(texts[k], encoded_a[n], encoded_b[n])]
            found = {}
            if fitting:
                one, two = [encoded_a[n] for n in fitting], [encoded_b[n] for n in fitting]
                for n, result in zip(fitting, aligner.batch([texts[given[n]] for n in fitting], one, two), strict=True):
                    found[given[n]] = (len(encoded_a[n]), len(encoded_b[n]), *result)
                tally.add([f[5] for f in found.values()], [f[6] for f in found.values()])
            rows = []
            for k, name in enumerate(keys):
                n_a, n_b, n_groups, n_links, groups, distinct, times = found.get(k, (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((row, name, n_a, n_b, n_groups, n_links, groups, _gaps(distinct), packed(times), False))
                row += 1
            yield _record(rows, key_type)
            if len(tally.pairs) > task_pairs:
                yield _record([(None, None, None, None, None, None, None, _gaps(tally.pairs), packed(tally.times), True)], key_type)
                tally = Tally()
        if len(tally.pairs):
            yield _record([(None, None, None, None, None, None, None, _gaps(tally.pairs), packed(tally.times), True)], key_type)

    kind = docs.schema[key].dataType.simpleString()
    return short_batches(docs).select(key, text).mapInArrow(run, _LANDED.format(kind=kind))


def _opened(rows: DataFrame) -> DataFrame:
    """A row per packed pair: row, pair and its number of links there."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = _ascending(pairs)
                columns = [pa.array([row] * len(found), pa.int64()), pa.array(found), pa.array(unpacked(times).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "pair", "times"])

    return rows.select("row", "pairs", "times").mapInArrow(run, "row bigint, pair bigint, times bigint")


def pair_counts(landed_rows: DataFrame, n_pieces: int) -> DataFrame:
    """pair (A's id times ``n_pieces`` plus B's), its links in the corpus, and whether B's id has no pair with more."""
    counts = landed(_opened(landed_rows.where("counted")).groupBy("pair").agg(F.sum("times").alias("links")))
    highest = counts.groupBy((F.col("pair") % n_pieces).alias("piece")).agg(F.max("links").alias("most"))
    # At most a row per piece of the vocabulary.
    marked = counts.withColumn("piece", F.col("pair") % n_pieces).join(F.broadcast(highest), "piece")
    return landed(marked.select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def alignments(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
    digest: bool = False,
    table_pairs: int = TABLE_PAIRS,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """Key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``digest``: their SHA-256) of every document."""
    coders = tokenizers(byte_bpe, piece_bpe)
    rows = landed_table(aligned(docs, key, text, coders, digest, task_pairs))
    counts = pair_counts(rows, len(coders[1].bytes))
    own, shown = rows.where("NOT counted"), ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if counts.count() > table_pairs:
        met = spread_join(_opened(own), counts, ["pair"], "inner", ["row"])
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
        joined = own.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
        return joined.select(F.col("key").alias(key), *shown)
    table = counts.toArrow().sort_by("pair")
    known = tuple(table.column(c).to_numpy() for c in ("pair", "links", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        pair, links, best = shared.value
        for batch in batches:
            packs = [batch.column(k).to_pylist() for k in (6, 7)]
            sums = []
            for pairs, times in zip(*packs, strict=True):
                at, n = np.searchsorted(pair, _ascending(pairs)), unpacked(times).astype(np.int64)
                sums.append((int(n[best[at]].sum()), int((n * links[at]).sum())))
            n_best, count_sum = (pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1))
            columns = [*(batch.column(k) for k in range(5)), n_best, count_sum, batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *shown])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    summed = own.select("key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times").mapInArrow(run, schema)
    return summed.withColumnRenamed("key", key)
