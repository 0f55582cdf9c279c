"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items become words (letters and digits, A-Z lower-cased). With ``stretches``, as the queries search, an item of
m words is found in a document if some stretch of it, of any length from ``m - m // 5`` to ``m + m // 5`` words, is within
``m // 5`` word edits of the item (a similarity of 0.8 or more); a stretch may be the whole of a document shorter than the
item. Without ``stretches`` only windows of exactly m words within a document count, which misses copies from which over
m / 10 words were left out or to which as many were added.

1. Windows. A window within k edits of an item shares at least m - 1 - 2k of its word pairs with it, because an edit
   touches two pairs at most. Windows with fewer pairs known from any item are left out; this loses nothing. The same
   holds for the window of m words that begins with a stretch: an added word costs one pair and pushes one out at most.
   With ``stretches`` the window at a document's end is filled up with zeros.
2. Embedding. The CGK walk copies the word under a pointer, step by step, and moves the pointer on by a random bit that
   depends on step and word; after 3m steps an edit distance has become a Hamming distance. (After some 2m the text is used
   up; places beyond agree always, which the number of repetitions below takes into account.) Windows and items of one
   length take the same walk.
3. Sampling. ``SAMPLES`` places of an embedding make a key; windows meet the items with an equal key. Walks and samples
   are repeated until pairs at the largest allowed distance meet with ``TARGET_RECALL``: the number is set by embedding
   edited copies of the items (a bounded number of them) in many walks, and the hardest of them has to reach it; exact copies
   always meet. With ``stretches`` copies with words only replaced, only left out and only put in have to reach it as well.
   Where that would take more than ``MOST_REPETITIONS``, windows meet every item of their length instead.
4. Verification. Each pair that has met is compared by its exact word edit distance; with ``stretches`` the item is
   compared with all stretches that begin near the window (semi-global distance).

Items of fewer than ``LEAST_WORDS`` words allow no edit; they are looked up as they are, by a hash of their words.

The benchmark is measured and travels to the tasks in blocks of at most ``BLOCK_BYTES``; further blocks are further
passes, so no benchmark is too large. Documents are not shuffled.

Defined cases: null and empty texts hold no item; items without words are found nowhere. Repeated
items are reported each; repeated documents too. Null ids are carried. Of several windows for one item the closest, then
the first is reported; of equally close stretches with one first word that whose length is nearest the item's. Extra columns are not read (``drop_contaminated`` passes them on). Empty tables give no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import scale_of, short_batches
from sitefold.llm.words import ALPHANUMERIC, mixed, ranges, slices, text_bytes, word_hashes, word_spans

EDIT_SHARE = 5
LEAST_WORDS = 5
SAMPLES = 2
TARGET_RECALL = 0.98
SEED = 7_919
WALK_STEPS = 3
#: Samples taken from each walk.
PER_WALK = 4
#: Items whose edited copies set the number of repetitions, at most, and walks that each is tried with. Where more than
#: ``MOST_REPETITIONS`` would be needed, every window is compared with every item of its length instead.
TRIALS, TRIAL_WALKS, MOST_REPETITIONS = 64, 64, 2048
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts and the index of each text's first word."""
    data, offsets = texts if isinstance(texts, tuple) else text_bytes(texts)
    data = _LOWER[data]
    starts, ends, first_word = word_spans(data, offsets, ALPHANUMERIC)
    return word_hashes(data, starts, ends), first_word


def allowed_edits(words: int) -> int:
    return words // EDIT_SHARE


def word_pairs(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])


def sequence_keys(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m words that begin at every word; none at the last m - 1."""
    n = max(0, len(hashes) - m + 1)
    keys = np.full(n, m, np.uint64)
    for step in range(m):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + hashes[step : n + step])
    return keys


def walks(symbols: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CGK embeddings of rows of word hashes, zero past a row's end: (steps, rows, seeds).

    The coin of a word at a step is one of the 64 bits of its hash, chosen by step and seed. The pointer stays past the end
    once it has left the row, where the words are zero.
    """
    n, widest = symbols.shape
    padded = np.zeros((n, widest + 1), np.uint64)
    padded[:, :widest] = symbols
    flat, coins = padded.ravel(), mixed(padded).ravel()
    first, last = np.arange(n)[:, None] * (widest + 1), np.arange(n)[:, None] * (widest + 1) + widest
    at = np.repeat(first, len(seeds), axis=1)
    out = np.empty((WALK_STEPS * widest, n, len(seeds)), np.uint64)
    for step in range(WALK_STEPS * widest):
        out[step] = flat[at]
        bits = mixed(seeds + np.uint64(step)) >> np.uint64(58)
        at = np.minimum(at + ((coins[at] >> bits) & np.uint64(1)).astype(np.int64), last)
    return out


class Sampler:
    """The walks and sampled places of all repetitions."""

    def __init__(self, repetitions: int):
        random = np.random.default_rng(SEED)
        self.seeds = random.integers(1, 1 << 62, -(-repetitions // PER_WALK)).astype(np.uint64)
        self.places = random.random((len(self.seeds), PER_WALK, SAMPLES))

    def keys(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A key of every row for every repetition: its words at sampled places of its own 3m steps."""
        embedded, rows = walks(symbols, self.seeds), np.arange(len(symbols))
        found = []
        for walk, repetitions in enumerate(self.places):
            for places in repetitions:
                key = lengths.astype(np.uint64)
                for share in places:
                    step = (share * WALK_STEPS * lengths).astype(np.int64)
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + embedded[step, rows, walk])
                found.append(key)
        return np.array(found)


def edit_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of two word matrices of equal width."""
    n, m = left.shape
    steps = np.arange(m + 1)
    row = np.broadcast_to(steps, (n, m + 1)).astype(np.int32)
    for j in range(m):
        fresh = np.empty_like(row)
        fresh[:, 0] = j + 1
        fresh[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (right != left[:, j : j + 1]))
        row = np.minimum.accumulate(fresh - steps, axis=1) + steps  # insertions
    return row[:, m]


def best_stretches(texts: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least distance of each row of ``items`` to a stretch of its text's first ``sizes`` words; the stretch's start and length.

    Of equally close stretches the first, then the one nearest the item's length.
    """
    (n, widest), m = texts.shape, items.shape[1]
    one = np.int64(1 << 32)  # an edit; the lower bits hold where the stretch begins
    steps = np.arange(widest + 1)
    row = np.broadcast_to(steps, (n, widest + 1)).astype(np.int64)
    for i in range(m):
        fresh = row + one
        fresh[:, 1:] = np.minimum(fresh[:, 1:], row[:, :-1] + one * (texts != items[:, i : i + 1]))
        row = np.minimum.accumulate(fresh - steps * one, axis=1) + steps * one
    row[steps > sizes[:, None]] = np.iinfo(np.int64).max
    least = row.min(axis=1)
    start = least & (one - 1)
    off = np.where(row == least[:, None], np.abs(steps - start[:, None] - m), np.iinfo(np.int64).max)
    return least >> 32, start, off.argmin(axis=1) - start


def repetitions_for(items: list[np.ndarray], target: float = TARGET_RECALL, edits: tuple[int, ...] = (0, 1, 2)) -> int:
    """Repetitions with which copies of the items at the largest allowed distance meet them as often as wanted.

    ``edits``: words are replaced (0), left out (1) or put in (2), in turn.
    """
    random = np.random.default_rng(SEED)
    seeds = np.arange(SEED, SEED + TRIAL_WALKS, dtype=np.uint64)
    hardest = 0.0  # chance of a pair not to meet in a walk
    for words in items[:TRIALS]:
        edited = list(words)
        for k in range(allowed_edits(len(words))):
            at = int(random.integers(len(edited)))
            strange = np.uint64(random.integers(1, 1 << 62))
            edit = edits[k % len(edits)]
            edited[at : at + (edit != 2)] = [] if edit == 1 else [strange]
        edited = (edited + [np.uint64(random.integers(1, 1 << 62)) for _ in words])[: len(words)]
        both = walks(np.array([words, edited], dtype=np.uint64), seeds)
        same = (both[:, 0] == both[:, 1]).mean(axis=0)
        hardest = max(hardest, float(((1 - same**SAMPLES) ** PER_WALK).mean()))
    return PER_WALK * max(1, math.ceil(math.log(1 - target) / math.log(min(max(hardest, 1e-9), 1 - 1e-6))))


class Index:
    """Items of one block: their words, sampled keys and word pairs."""

    def __init__(self, ids: list, texts: list[str | None], stretches: bool = False):
        self.stretches = stretches
        hashes, first_word = words_of(pa.array(texts, pa.large_string()))
        sizes = np.diff(first_word)
        own = np.flatnonzero(sizes >= LEAST_WORDS)
        self.ids, self.lengths = [ids[i] for i in own], sizes[own]
        self.words = padded_rows(hashes, first_word[:-1][own], self.lengths)
        rows = [row[:m] for row, m in zip(self.words, self.lengths, strict=True)]
        trials = rows[:: max(1, len(rows) // TRIALS)]
        edits = [(0, 1, 2), (0,), (1,), (2,)] if stretches else [(0, 1, 2)]
        repetitions = max(repetitions_for(trials, edits=kinds) for kinds in edits)
        self.exhaustive = repetitions > MOST_REPETITIONS
        self.sampler = Sampler(0 if self.exhaustive else repetitions)
        self.by_length = np.argsort(self.lengths, kind="stable")
        self.short = {}
        for m in range(1, LEAST_WORDS):
            some = np.flatnonzero(sizes == m)
            if len(some):
                keys = sequence_keys(padded_rows(hashes, first_word[:-1][some], sizes[some]).ravel(), m)[::m]
                order = np.argsort(keys, kind="stable")
                self.short[m] = keys[order], [ids[i] for i in some[order]]
        keys = self.sampler.keys(self.words, self.lengths) if not self.exhaustive else np.zeros((0, len(own)), np.uint64)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        # Each word pair with the lengths of the items that hold it.
        kinds, kind = np.unique(self.lengths, return_inverse=True)
        pairs = np.concatenate([word_pairs(row) for row in rows]) if rows else np.zeros(0, np.uint64)
        both = np.unique(np.array([pairs, np.repeat(kind, self.lengths - 1).astype(np.uint64)]), axis=1)
        self.kinds, self.kind_of = kinds, both[1].astype(np.int64)
        self.pairs, self.first = np.unique(both[0], return_index=True)
        self.first = np.r_[self.first, both.shape[1]]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.pairs >> np.uint64(44)).astype(np.int64)] = True

    def windows(self, hashes: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of every item-sized window that holds enough word pairs of items of its length.

        With ``stretches`` a window may reach over its document's end.
        """
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(hashes) < 2 or not len(self.pairs):
            return nothing
        pairs = word_pairs(hashes)
        at = np.flatnonzero(self.flags[(pairs >> np.uint64(44)).astype(np.int64)])
        entry = np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)
        at, entry = at[self.pairs[entry] == pairs[at]], entry[self.pairs[entry] == pairs[at]]
        counts = self.first[entry + 1] - self.first[entry]
        kind = self.kind_of[np.repeat(self.first[entry], counts) + ranges(counts)]
        at = np.repeat(at, counts)
        order = np.lexsort((at, kind))
        at, kind = at[order], kind[order]
        needed = np.maximum(1, self.kinds - 1 - 2 * (self.kinds // EDIT_SHARE))
        # The window has to reach from one pair to the one that completes the number needed.
        last = np.arange(len(at)) + needed[kind] - 1
        fits = np.flatnonzero(last < len(at))
        last = last[fits]
        m = self.kinds[kind[fits]]
        near = (kind[last] == kind[fits]) & (at[last] - at[fits] <= m - 2)
        begin, end, m = at[fits][near], at[last][near], m[near]
        document = np.searchsorted(first_word, begin, side="right") - 1
        low = np.maximum(end - (m - 2), first_word[document])
        high = begin if self.stretches else np.minimum(begin, first_word[document + 1] - m)
        sizes = np.maximum(0, high - low + 1)
        found = np.unique(np.repeat(m, sizes) * len(hashes) + np.repeat(low, sizes) + ranges(sizes))
        return found % len(hashes), found // len(hashes)

    def matches(self, texts) -> Iterator[tuple[int, object, int, int, int, float]]:
        """(document, item id, first word, words, distance, similarity) of every document and item that match."""
        hashes, first_word = words_of(texts)
        yield from self._short_matches(hashes, first_word)
        starts, lengths = self.windows(hashes, first_word)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for first in range(0, len(starts), 1024):
            start, m = starts[first : first + 1024], lengths[first : first + 1024]
            document = np.searchsorted(first_word, start, side="right") - 1
            windows = padded_rows(hashes, start, np.minimum(m, first_word[document + 1] - start), int(m.max()))
            window, item = self._met(windows, m)
            if self.stretches:
                for d, i, *found in self._near(hashes, first_word, start[window], document[window], item):
                    best[d, i] = min(tuple(found), best.get((d, i), tuple(found)))
                continue
            for size in np.unique(m[window]):
                own = np.flatnonzero(m[window] == size)
                for k in range(0, len(own), 8192):
                    w, i = window[own[k : k + 8192]], item[own[k : k + 8192]]
                    distance = edit_distances(windows[w, :size], self.words[i, :size])
                    for hit in np.flatnonzero(distance <= allowed_edits(int(size))):
                        d = int(document[w[hit]])
                        found = (int(distance[hit]), int(start[w[hit]] - first_word[d]), int(size))
                        best[d, int(i[hit])] = min(found, best.get((d, int(i[hit])), found))
        for (d, i), (distance, start, size) in best.items():
            yield d, self.ids[i], start, size, distance, 1 - distance / int(self.lengths[i])

    def _short_matches(self, hashes: np.ndarray, first_word: np.ndarray) -> Iterator[tuple[int, object, int, int, int, float]]:
        """First place of every short item in every document."""
        for m, (known, ids) in self.short.items():
            keys = sequence_keys(hashes, m)
            low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
            at = np.flatnonzero(high > low)
            document = np.searchsorted(first_word, at, side="right") - 1
            at, document = (x[at + m <= first_word[document + 1]] for x in (at, document))
            _, first = np.unique(np.array([document, low[at]]), axis=1, return_index=True)
            for k in first:
                for item in ids[low[at[k]] : high[at[k]]]:
                    yield int(document[k]), item, int(at[k] - first_word[document[k]]), m, 0, 1.0

    def _near(self, hashes, first_word, start, document, item) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item number, distance, first word, words) of the best stretch about each window that has met an item.

        Windows of a quarter of the item's words are taken together: the text about all of them is compared once.
        """
        most, n = len(hashes) + 1, max(1, len(self.ids))
        cell = (start - first_word[document]) // np.maximum(1, self.lengths[item] // 4)
        cells = np.unique((document * n + item) * most + cell)
        document, item = cells // most // n, cells // most % n
        m = self.lengths[item]
        edits, step = m // EDIT_SHARE, np.maximum(1, m // 4)
        begin = first_word[document] + cells % most * step
        low = np.maximum(begin - edits, first_word[document])
        sizes = np.minimum(begin + step + m + edits, first_word[document + 1]) - low
        for size in np.unique(m):
            own = np.flatnonzero(m == size)
            rows = max(1, (1 << 19) // (2 * int(size)))
            for k in range(0, len(own), rows):
                some = own[k : k + rows]
                distance, first, words = best_stretches(padded_rows(hashes, low[some], sizes[some]), sizes[some], self.words[item[some], :size])
                for hit in np.flatnonzero(distance <= allowed_edits(int(size))):
                    one = some[hit]
                    place = int(low[one] - first_word[document[one]] + first[hit])
                    yield int(document[one]), int(item[one]), int(distance[hit]), place, int(words[hit])

    def _met(self, windows: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and item numbers of the distinct pairs that have a key in common."""
        n, met = len(self.ids), []
        if self.exhaustive:
            ordered = self.lengths[self.by_length]
            low = np.searchsorted(ordered, m)
            sizes = np.searchsorted(ordered, m, side="right") - low
            return np.repeat(np.arange(len(m)), sizes), self.by_length[np.repeat(low, sizes) + ranges(sizes)]
        for known, order, key in zip(self.keys, self.order, self.sampler.keys(windows, m), strict=True):
            low = np.searchsorted(known, key)
            sizes = np.searchsorted(known, key, side="right") - low
            if sizes.any():
                met.append(np.repeat(np.arange(len(key)), sizes) * n + order[np.repeat(low, sizes) + ranges(sizes)])
                if sum(map(len, met)) > 1 << 20:
                    met = [np.unique(np.concatenate(met))]
        pairs = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        window, item = pairs // max(n, 1), pairs % max(n, 1)
        same = m[window] == self.lengths[item]
        return window[same], item[same]


def padded_rows(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = 0) -> np.ndarray:
    """A row of word hashes for every window, zero past its length; rows are ``least`` wide at least."""
    widest = max(least, int(lengths.max()) if len(lengths) else 0)
    steps = np.arange(widest)
    inside = steps < lengths[:, None]
    return np.where(inside, hashes[np.where(inside, starts[:, None] + steps, 0)], np.uint64(0)) if len(hashes) else np.zeros((len(starts), widest), np.uint64)


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks whose texts are bounded; each item is read once."""
    total = items.agg(F.sum(F.octet_length(text))).first()[0]
    n = scale_of(total, block_bytes)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64(text), F.lit(n)) == block).select(key, text).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    stretches: bool = False,
) -> DataFrame:
    """Document and item of every match, with first_word, n_words, distance and similarity.

    ``stretches``: stretches of other lengths than the item's count as well.
    """
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}"
    schema = f"{kinds}, first_word bigint, n_words bigint, distance int, similarity double"
    arrow_item = pa.int64() if items.schema[item_key].dataType.simpleString() in ("bigint", "int") else None
    found = None
    for ids, texts in _blocks(items, item_key, item_text, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, stretches))

        def run(batches, index=index):
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                rows = []
                for first, last in slices(offsets):
                    own = (data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    rows += [(first + d, *rest) for d, *rest in index.value.matches(own)]
                if rows:
                    document, item, start, m, distance, similarity = zip(*rows, strict=True)
                    columns = [
                        batch.column(0).take(pa.array(document)),
                        pa.array(item, arrow_item),
                        pa.array(start, pa.int64()),
                        pa.array(m, pa.int64()),
                        pa.array(distance, pa.int32()),
                        pa.array(similarity, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, item_key, "first_word", "n_words", "distance", "similarity"])

        part = short_batches(docs).select(key, text).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", block_bytes: int = BLOCK_BYTES, stretches: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept; each row is judged where it is read."""
    at = docs.columns.index(text)
    numbered = items.select(F.lit(0).alias("number"), F.col(item_text).alias("text"))
    for ids, texts in _blocks(numbered, "number", "text", block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, stretches))

        def run(batches, index=index):
            for batch in batches:
                data, offsets = text_bytes(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for first, last in slices(offsets):
                    own = (data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    clean[[first + found[0] for found in index.value.matches(own)]] = False
                yield batch.filter(pa.array(clean))

        docs = short_batches(docs).mapInArrow(run, docs.schema)
    return docs
