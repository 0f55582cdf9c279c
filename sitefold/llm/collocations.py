"""Phrase collocations: n-grams counted in a HAT-trie that spills sorted runs, merged per prefix partition; then scored.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and the pieces into words at blanks and tabs. Every
language (null: ``und``) is counted on its own.

1. Counting. A task gives the words of its texts ids of its own and packs the ids of an n-gram into one number. A shallow
   trie over the digits of the first and second word's id leads to hash containers, which burst into 64 children once they
   hold ``BURST`` n-grams. Beyond ``RUN_ENTRIES`` n-grams the largest subtrees are written out as one sorted run, cut into
   pages by prefix partition. An n-gram's partition is a hash of its first word. Memory doesn't grow with the table.
2. Splitting. A partition that holds more than ``MERGE_ENTRIES`` entries, be it because the table is large or because one
   prefix is hot, is combined in parts and cut into ``FANOUT`` finer ones by a hash of all its words, again and again.
3. Merging. All pages of a partition meet in one task, where the runs are merged and n-grams that occur ``least`` times
   or more stay. What is below never leaves its task.
4. Scoring, in SQL functions. A candidate of two or more words with a occurrences is cut after each of its first words:
   floor(1,000,000 a a / (l r)), with l and r occurrences of both parts, in exact decimals. The lowest cut counts, then the
   smallest. Candidates inside a longer one with half their occurrences or more go. The first ``top`` of a language stay.

Parts of a candidate occur at least as often as it does, so what stays in 3 is all that 4 needs.

Defined cases: null and empty texts and pieces have no words; a language without candidates has no rows. Equal texts are
counted each time. Ties in score and occurrences go by the phrase's bytes. Very long texts are counted in stretches.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitefold.llm.common import landed, scale_of, short_batches
from sitefold.llm.words import mixed, packed, unpacked, word_hashes
from sitefold.operators.joins import lookup_join

LEAST, TOP, LONGEST = 10, 2000, 3
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
ABSORBED = 50
#: Bits of a word id; three ids make a key.
ID_BITS = 21
#: N-grams of a container before it bursts, of a trie before it spills, and words that are counted at once.
BURST, RUN_ENTRIES, STRETCH = 1 << 15, 1 << 20, 1 << 19
#: Entries of a page, and of a partition that is merged in one task.
PAGE_ENTRIES, MERGE_ENTRIES = 1 << 14, 1 << 21
#: Bytes of text for each of the first partitions, the most of them, and the number into which a large one is cut.
PARTITION_BYTES, MOST_PARTITIONS, FANOUT = 8 << 20, 4096, 64

_PAGES = "lang string, part bigint, entries bigint, page binary"
_COUNTS = "lang string, phrase string, size int, n bigint"
#: Digits of a key that lead to a container: the low ones of the first word's id come first.
_DIGITS, _FAN = (2 * ID_BITS, 2 * ID_BITS + 6, 2 * ID_BITS + 12, ID_BITS, ID_BITS + 6), 64
_ABSENT, _BREAK = 0, b"."


def _letters() -> bytes:
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    table[9] = 32
    for byte in b".,;:!?\n\x0b\x0c\r":
        table[byte] = _BREAK[0]
    return bytes(table)


_LETTERS = _letters()


class Words(dict):
    """Ids of words in the order of their first occurrence; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: _ABSENT})
        self.known = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.known)
        self.known.append(word)
        return number


class Container:
    """N-grams with a common prefix of id digits: a hash table, or 64 children once it has burst."""

    __slots__ = ("children", "counts", "depth", "entries")

    def __init__(self, depth: int):
        self.depth, self.entries, self.counts, self.children = depth, 0, Counter(), None

    def add(self, keys: np.ndarray) -> None:
        if self.children is None:
            self.counts.update(keys.tolist())
            self.entries = len(self.counts)
            if self.entries > BURST and self.depth < len(_DIGITS):
                counts, self.counts = self.counts, None
                self.children = [Container(self.depth + 1) for _ in range(_FAN)]
                for key, n in counts.items():
                    self.children[key >> _DIGITS[self.depth] & _FAN - 1].counts[key] = n
                for child in self.children:
                    child.entries = len(child.counts)
            return
        digits = (keys >> _DIGITS[self.depth] & _FAN - 1).astype(np.uint8)
        keys = keys[np.argsort(digits, kind="stable")]
        ends = np.cumsum(np.bincount(digits, minlength=_FAN))
        for child, first, end in zip(self.children, np.r_[0, ends], ends):
            if first < end:
                child.add(keys[first:end])
        self.entries = sum(child.entries for child in self.children)

    def tables(self) -> Iterator[Counter]:
        if self.children is None:
            yield self.counts
        else:
            for child in self.children:
                yield from child.tables()


class Trie:
    """The n-grams of one language that a task has counted and not yet written."""

    def __init__(self):
        self.words, self.root = Words(), Container(0)
        self._hashes = np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        """Hashes of all words, those of new ones added to what is known."""
        known = self.words.known
        self._hashes = np.r_[self._hashes, hashes_of(known[len(self._hashes) :])]
        return self._hashes

    def forget(self) -> None:
        self.words, self._hashes = Words(), np.zeros(0, np.uint64)

    def add(self, tokens: list[bytes], longest: int, own: int) -> None:
        """Count the n-grams that begin in the first ``own`` tokens."""
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        ids = np.r_[ids, np.zeros(longest, np.int64)]
        keys, alive = np.zeros(own, np.int64), np.ones(own, bool)
        for step in range(longest):
            following = ids[step : own + step]
            alive = alive & (following > 0)
            keys = keys | following << (2 - step) * ID_BITS
            self.root.add(keys[alive])

    def spill(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the largest subtrees, which hold ``share`` of all entries; they start anew."""
        whole = share >= 1 or self.root.children is None
        subtrees = [self.root] if whole else sorted(self.root.children, key=lambda c: -c.entries)
        wanted, keys, counts = share * self.root.entries, [], []
        for subtree in subtrees:
            if wanted <= 0:
                break
            wanted -= subtree.entries
            for table in subtree.tables():
                keys.append(np.fromiter(table.keys(), np.int64, len(table)))
                counts.append(np.fromiter(table.values(), np.int64, len(table)))
            self.root.entries -= 0 if whole else subtree.entries
            subtree.entries, subtree.counts, subtree.children = 0, Counter(), None
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(counts)


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Hashes of words, alike in all tasks; that of no word is zero."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]], ends) if words else np.zeros(0, np.uint64)
    hashes[: 1 if words and not words[0] else 0] = 0
    return hashes


def pages(lang: str, words: list[bytes], grams: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
    """Sorted pages of a run: n-grams (three rows of indexes into ``words``, 0: none) and counts, cut by partition."""
    seen = np.zeros(len(words), bool)
    seen[0] = seen[grams] = True
    used = np.flatnonzero(seen)
    names = [words[i] for i in used.tolist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[used[order]] = np.arange(len(order))
    names, ranks, bits = np.array(names, object)[order], rank[grams], len(names).bit_length()
    if 3 * bits <= 63:
        by = np.argsort(ranks[0] << 2 * bits | ranks[1] << bits | ranks[2])
    else:
        by = np.lexsort(ranks[::-1])
    by = by[np.argsort(part[by].astype(np.uint16 if len(part) and part.max() < 1 << 16 else np.int64), kind="stable")]
    ranks, counts, part = ranks[:, by], counts[by], part[by]
    borders = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(0, np.int64)
    for first, end in zip(borders[:-1], borders[1:], strict=True):
        for low in range(first, end, PAGE_ENTRIES):
            high = min(end, low + PAGE_ENTRIES)
            local, numbers = np.unique(np.r_[0, ranks[:, low:high].ravel()], return_inverse=True)
            one, two, three = numbers[1:].reshape(3, -1)
            # Sorted, so first words and second words of one first word are written as steps.
            step = np.diff(one, prepend=0)
            two = np.where(step > 0, two, np.diff(two, prepend=0))
            columns = [b" ".join(names[local].tolist()), *map(packed, (step, two, three, counts[low:high]))]
            sizes = np.array([len(c) for c in columns], "<i8").tobytes()
            blob = sizes + b"".join(columns)
            page = len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)
            yield lang, int(part[low]), high - low, page


def combined(some: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The runs of several pages merged into one: sorted words, distinct n-grams and their summed counts."""
    opened = []
    for page in some:
        blob = pa.decompress(page[8:], int.from_bytes(page[:8], "little"), codec="zstd", asbytes=True)
        ends = 40 + np.r_[0, np.cumsum(np.frombuffer(blob, "<i8", 5))]
        words, *columns = (blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        step, two, three, counts = (unpacked(c).astype(np.int64) for c in columns)
        sums, begins = np.cumsum(two), np.flatnonzero(step)
        two = sums - np.repeat(sums[begins] - two[begins], np.diff(np.r_[begins, len(step)]))
        opened.append((words.split(b" "), np.cumsum(step), two, three, counts))
    names = sorted(set().union(*(words for words, *_ in opened)))
    number = {word: i for i, word in enumerate(names)}
    places = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words, *_ in opened]
    first, second, third = (np.concatenate([at[page[k]] for at, page in zip(places, opened, strict=True)]) for k in (1, 2, 3))
    counts = np.concatenate([page[4] for page in opened])
    bits = len(names).bit_length()
    front = first << bits | second
    if 3 * bits > 63:  # number the pairs first, so that a key fits
        pairs, front = np.unique(front, return_inverse=True)
    keys = front << bits | third
    order = np.argsort(keys, kind="stable")  # merges what is sorted already
    keys = keys[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    at = order[begins]
    return names, np.array([first[at], second[at], third[at]]), np.add.reduceat(counts[order], begins)


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, part, entries, page = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [pa.array(lang, pa.string()), pa.array(part, pa.int64()), pa.array(entries, pa.int64()), pa.array(page, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "part", "entries", "page"])


def _batched(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > most:
            yield _page_batch(held)
            held, size = [], 0
    if held:
        yield _page_batch(held)


def _runs(docs: DataFrame, lang: str, text: str, longest: int, partitions: int, run_entries: int) -> DataFrame:
    """Pages of sorted runs; ``docs`` are read once and not shuffled."""

    def written(name: str, trie: Trie, share: float) -> Iterator[tuple]:
        keys, counts = trie.spill(share)
        mask = (1 << ID_BITS) - 1
        grams = np.array([keys >> 2 * ID_BITS, keys >> ID_BITS & mask, keys & mask])
        prefix = mixed(trie.hashes() * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(partitions)
        yield from pages(name, trie.words.known, grams, counts, prefix.astype(np.int64)[grams[0]])
        if share >= 1:
            trie.forget()

    def counted(batches) -> Iterator[tuple]:
        tries: dict[str, Trie] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.setdefault("und" if name is None else name, []).append(body or b"")
            for name, bodies in texts.items():
                trie = tries.setdefault(name, Trie())
                tokens = b" . ".join(bodies).translate(_LETTERS).replace(_BREAK, b" . ").split()
                for first in range(0, len(tokens), STRETCH):
                    if len(trie.words.known) + STRETCH + longest >= 1 << ID_BITS:
                        yield from written(name, trie, 1)
                    own = min(STRETCH, len(tokens) - first)
                    trie.add(tokens[first : first + own + longest - 1], longest, own)
                    if sum(t.root.entries + len(t.words) for t in tries.values()) > run_entries:
                        largest = max(tries, key=lambda t: tries[t].root.entries)
                        yield from written(largest, tries[largest], 0.5 if len(tries[largest].words) < run_entries // 4 else 1)
                        if len(tries) > 64:  # many languages: none keeps a trie for long
                            for other in tries:
                                yield from written(other, tries[other], 1)
                            tries = {name: trie}
        for name, trie in tries.items():
            yield from written(name, trie, 1)

    columns = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return short_batches(columns).mapInArrow(lambda batches: _batched(counted(batches)), _PAGES)


def _grouped(batches, most: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """Pages of each (language, partition), given side by side, up to ``most`` entries at a time."""
    group, held, entries = None, [], 0
    for batch in batches:
        for lang, part, n, page in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held and ((lang, part) != group or entries + n > most):
                yield group, held
                held, entries = [], 0
            group = (lang, part)
            held.append(page)
            entries += n
    if held:
        yield group, held


def _finer(pages_of_large: DataFrame, level: int, fanout: int, most: int) -> DataFrame:
    """Large partitions cut into ``fanout`` finer ones each; tasks take parts of them, so a hot one is spread."""

    def cut(batches) -> Iterator[tuple]:
        for (lang, part), some in _grouped(batches, most):
            names, grams, counts = combined(some)
            hashes = hashes_of(names)
            whole = mixed(mixed(hashes[grams[0]] + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[grams[1]]) + (hashes[grams[2]] << np.uint64(1)))
            digit = (mixed(whole) % np.uint64(fanout)).astype(np.int64)
            yield from pages(lang, names, grams, counts, MOST_PARTITIONS + part * fanout + digit)

    slice_of = F.pmod(F.xxhash64("page"), F.ceil(F.col("total") / F.lit(most)))
    dealt = pages_of_large.withColumn("slice", slice_of).repartition("lang", "part", "slice").sortWithinPartitions("lang", "part", "slice")
    return dealt.select("lang", "part", "entries", "page").mapInArrow(lambda batches: _batched(cut(batches)), _PAGES)


def ngram_counts(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    partition_bytes: int = PARTITION_BYTES,
    merge_entries: int = MERGE_ENTRIES,
    fanout: int = FANOUT,
    run_entries: int = RUN_ENTRIES,
) -> DataFrame:
    """lang, phrase, size and n of every n-gram of up to ``longest`` words with ``least`` occurrences or more.

    Rows of size 0 give shares of the number of words of a language.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases of 1 to {LONGEST} words are counted")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0]
    partitions = min(MOST_PARTITIONS, scale_of(total, partition_bytes))
    open_pages, done, level = landed(_runs(docs, lang, text, longest, partitions, run_entries)), None, 0
    while True:
        sizes = landed(open_pages.groupBy("lang", "part").agg(F.sum("entries").alias("total")))
        large = sizes.where((F.col("total") > merge_entries) & (F.lit(level) < 8)).select("lang", "part", "total")
        n_large = large.count()
        small = lookup_join(open_pages, large, ["lang", "part"], "left_anti", ["page"]) if n_large else open_pages
        done = small if done is None else done.unionByName(small)
        if not n_large:
            break
        level += 1
        open_pages = landed(_finer(lookup_join(open_pages, large, ["lang", "part"], "inner", ["page"]), level, fanout, merge_entries))

    def merged(batches) -> Iterator[pa.RecordBatch]:
        for (lang_of, _), some in _grouped(batches, 1 << 62):
            names, grams, counts = combined(some)
            sizes = (grams > 0).sum(axis=0)
            own = np.flatnonzero(counts >= least)
            phrases = [b" ".join(names[i] for i in gram if i).decode() for gram in grams[:, own].T.tolist()]
            words = int(counts[sizes == 1].sum())
            columns = [
                pa.array([lang_of] * (len(own) + 1), pa.string()),
                pa.array([*phrases, None], pa.string()),
                pa.array(np.r_[sizes[own], 0].astype(np.int32)),
                pa.array(np.r_[counts[own], words].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])

    return done.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(merged, _COUNTS)


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    **counting: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of every language."""
    counts = landed(ngram_counts(docs, lang, text, longest, least, **counting))
    totals = counts.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    grams = counts.where("size > 0").select("lang", "phrase", F.col("n").alias("f"))
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    # The parts of a candidate of m words that begin at word i and have j words.
    part = "array_join(slice(split(phrase, ' '), {0}, {1}), ' ')"
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"left": F.expr(part.format("1", "k")), "right": F.expr(part.format("k + 1", "size - k"))})
    for side, count in (("left", "l"), ("right", "r")):
        known = grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        # Both sides are distinct phrases; a word that begins very many of them is split by adaptive execution.
        cuts = cuts.join(known, ["lang", side])
    score = F.expr("(cast(1000000 AS decimal(7,0)) * (cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = f"explode(flatten(transform(sequence(2, size - 1), j -> transform(sequence(1, size - j + 1), i -> {part.format('i', 'j')}))))"
    longer = found.where("size > 2").select("lang", F.expr(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {int(absorbed)} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # First within slices of a language, so that none is sorted whole by one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    for keys in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    named = lookup_join(sliced, landed(totals), ["lang"], "inner", ["phrase"])
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
