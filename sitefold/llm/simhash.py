"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits agree in at least three
blocks, so each is entered under all 20 choices of three blocks (31 to 33 bits of key); equal keys meet in one
partition, sorted, and are verified by their Hamming distance there. Documents with one fingerprint are one vertex, so
copies cost nothing beyond an aggregation. Keys are counted: one shared by more than ``GROUP_PRINTS`` different fingerprints,
such as those of a large family of near copies, is entered again in Spark under four longer keys, by the same principle over
the bits that are left, up to three times; what then shares a key differs in 14 bits at most, so no task holds an
unbounded group. Within a task only the edges that join a group's parts are kept, so no group emits its pairs.

Defined cases: a text without words, null included, has the fingerprint zero and links like any other. Null ids are
kept and have no influence on the ids of components; a component of null ids only has a null id. Repeated rows give
repeated rows. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sitefold.llm.common import landed, short_batches
from sitefold.llm.components import components
from sitefold.operators.joins import lookup_join

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
BLOCKS = 6
#: Fingerprints that may share a key before it is entered again under longer ones, and how often that is done.
GROUP_PRINTS, DEEPEST = 20_000, 3
#: Groups up to this size are compared directly; larger ones are divided again by the bits that are left.
DIRECT = 512

_BORDERS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def _lanes() -> np.ndarray:
    """For each byte value its eight bits in eight byte lanes of a 64-bit number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8")[:, 0]


def fingerprint(hashes: np.ndarray, lanes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, len(octets), 255):  # a lane counts to 255
        summed = np.add.reduce(lanes[octets[first : first + 255]], axis=0)
        counts += summed.astype("<u8").view(np.uint8)
    set_bits = counts * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()  # bytes: blanks and letter case of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        spans = [(0, None)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        spans = zip([0, *ends], [e - 1 for e in ends[width - 1 :]], strict=False)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """Key and 64-bit fingerprint (as a signed long) of every document."""

    def run(batches):
        lanes = _lanes()
        for batch in batches:
            found = []
            for body in batch.column(1):
                hashes = shingle_hashes(body.as_py(), width, HASH_SEED)
                found.append(fingerprint(hashes, lanes) if len(hashes) else 0)
            values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "fingerprint_bits"])

    kind = docs.schema[key].dataType.simpleString()
    return short_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint_bits bigint")


def joining_edges(values: np.ndarray, bits: list[int], most: int, direct: int = DIRECT) -> list[tuple[int, int]]:
    """Edges that join all ``values`` linked by chains of pairs at ``most`` or fewer differing bits.

    ``bits``: the bit places in which the values may still differ.
    """
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((i, j))

    def within(members: np.ndarray, places: list[int]) -> None:
        if len(members) < 2:
            return
        if len(members) <= direct or len(places) <= most:
            for k in range(0, len(members) - 1):
                rest = members[k + 1 :]
                for j in rest[np.bitwise_count(values[rest] ^ values[members[k]]) <= most]:
                    join(int(members[k]), int(j))
            return
        step = -(-len(places) // (most + 1))
        for first in range(0, len(places), step):
            block = places[first : first + step]
            mask = np.uint64(sum(1 << b for b in block))
            part = values[members] & mask
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            left = [b for b in places if b not in block]
            for group in np.split(members[order], cuts):
                within(group, left)

    within(np.arange(len(values)), bits)
    return edges


def _links_of_run(prints: np.ndarray, groups: np.ndarray, tags: np.ndarray, left_bits: list[list[int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within equal groups of a sorted run of fingerprints."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    left, right = [], []
    small = np.repeat(sizes <= 8, sizes)
    index = np.arange(len(groups))
    for gap in range(1, 8):  # pairs of small groups, all groups at once
        a, b = index[:-gap], index[gap:]
        near = (groups[a] == groups[b]) & small[a]
        a, b = a[near], b[near]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= most
        left.append(prints[a[near]])
        right.append(prints[b[near]])
    for g in np.flatnonzero(sizes > 8):
        members = prints[starts[g] : starts[g] + sizes[g]]
        edges = joining_edges(members, left_bits[tags[starts[g]]], most)
        left.append(members[[i for i, _ in edges]])
        right.append(members[[j for _, j in edges]])
    return np.concatenate(left), np.concatenate(right)


def _fixed_mask(left: list[int]) -> int:
    """The bits that are not left, as a signed number."""
    mask = (1 << 64) - 1 - sum(1 << b for b in left)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _entered(distinct: DataFrame, column: str, left_bits: list[list[int]], most: int) -> DataFrame:
    """(print, tag, block): every fingerprint under each of its keys; ``left_bits[tag]`` are the places where those who share one may differ."""
    spark = distinct.sparkSession
    masks = [_fixed_mask(left) for left in left_bits]
    entries = distinct.select(
        F.col(column).alias("print"), F.posexplode(F.array(*[F.lit(m).bitwiseAND(F.col(column)) for m in masks])).alias("tag", "block")
    )
    done = None
    for _ in range(DEEPEST):
        large = landed(entries.groupBy("tag", "block").count().where(F.col("count") > most).select("tag", "block"))
        tags = sorted(r.tag for r in large.select("tag").distinct().collect())  # at most a row per choice and division
        if not tags:
            break
        small = lookup_join(entries, large, ["tag", "block"], "left_anti", ["print"])
        done = small if done is None else done.unionByName(small)
        longer = []
        for tag in tags:
            left = left_bits[tag]
            step = -(-len(left) // (MAX_BITS + 1))
            for first in range(0, len(left), step):
                left_bits.append(left[:first] + left[first + step :])
                longer.append((tag, len(left_bits) - 1, _fixed_mask(left_bits[-1])))
        keys = F.broadcast(spark.createDataFrame(longer, "tag int, longer int, mask long"))
        again = lookup_join(entries, large, ["tag", "block"], "inner", ["print"]).join(keys, "tag")
        entries = landed(again.select("print", F.col("longer").alias("tag"), F.col("print").bitwiseAND(F.col("mask")).alias("block")))
    return entries if done is None else done.unionByName(entries)


def fingerprint_links(distinct: DataFrame, column: str = "fingerprint_bits", most_prints: int = GROUP_PRINTS) -> DataFrame:
    """Edges (low, high) between distinct fingerprints that join all within ``MAX_BITS``."""
    choices = combinations(range(BLOCKS), BLOCKS - MAX_BITS)
    left_bits = [[b for k in range(BLOCKS) if k not in fixed for b in range(_BORDERS[k], _BORDERS[k + 1])] for fixed in choices]
    entries = _entered(distinct, column, left_bits, most_prints)
    dealt = entries.withColumn("place", F.xxhash64("tag", "block"))
    # Equal (tag, block) meet in a partition, next to each other.
    met = dealt.repartition("place").sortWithinPartitions("place", "tag", "block", "print")

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            rows = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            same = np.r_[False, (rows[1][1:] == rows[1][:-1]) & (rows[2][1:] == rows[2][:-1])]
            groups = np.cumsum(~same)
            last = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
            held = [x[last:] for x in rows]
            if last:
                yield from emitted([x[:last] for x in rows], groups[:last])
        if held is not None:
            yield from emitted(held, np.zeros(len(held[0]), np.int64))

    def emitted(rows, groups):
        prints = rows[0].view(np.uint64)
        low, high = _links_of_run(prints, groups, rows[1], left_bits, MAX_BITS)
        if len(low):
            a, b = low.view(np.int64), high.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["low", "high"])

    columns = met.select("print", F.col("tag").cast("int").alias("tag"), "block", "place")
    # Four numbers a row, so batches may be long; the edges are landed at once, then texts get short ones again.
    conf, name = columns.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "20000")
    try:
        return landed(columns.mapInArrow(run, "low bigint, high bigint"))
    finally:
        conf.set(name, before)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, fingerprint (16 hex digits) and component_id of every document."""
    prints = landed(with_fingerprints(docs, key, text))
    distinct = landed(prints.groupBy("fingerprint_bits").agg(F.min(key).alias("first_id")))
    edges = fingerprint_links(distinct)
    found = components(edges, "low", "high")
    labelled = distinct.join(found.withColumnRenamed("vertex", "fingerprint_bits"), "fingerprint_bits", "left")
    classes = landed(labelled.withColumn("class", F.coalesce("component", "fingerprint_bits")))
    smallest = landed(classes.groupBy("class").agg(F.min("first_id").alias("component_id")))
    # A component of very many fingerprints is not gathered to learn its smallest id.
    members = lookup_join(classes.select("fingerprint_bits", "class"), smallest, ["class"], "inner", ["fingerprint_bits"]).drop("class")
    hexed = F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint")
    # A fingerprint of very many documents is spread, should the lookup not fit a broadcast.
    placed = lookup_join(prints, landed(members), ["fingerprint_bits"], "left", [key])
    return placed.select(key, hexed, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key, all columns kept; of repeated rows one stays.

    Only keys move: those of rows to drop are measured and broadcast, or joined by a spread shuffle beyond the bound.
    """
    number = F.col(key).cast("string")
    if isinstance(docs.schema[key].dataType, IntegralType):  # texts sort like the numbers, negative ones first
        number = F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    number = F.coalesce(number, F.lit("~"))
    keyed = docs.withColumn("__sh_key", F.concat_ws("/", number, F.md5(F.coalesce(text, F.lit("")))))
    found = landed(near_duplicates(keyed, "__sh_key", text).select("__sh_key", "component_id"))
    dropped = landed(found.where("__sh_key <> component_id").select("__sh_key").distinct())
    kept = lookup_join(keyed, dropped, ["__sh_key"], "left_anti", [text])
    repeated = landed(found.where("__sh_key = component_id").groupBy("__sh_key").count().where("count > 1").select("__sh_key"))
    if not repeated.isEmpty():
        once = lookup_join(kept, repeated, ["__sh_key"], "left_semi", [text]).dropDuplicates(["__sh_key"])
        kept = lookup_join(kept, repeated, ["__sh_key"], "left_anti", [text]).unionByName(once)
    return kept.drop("__sh_key")
