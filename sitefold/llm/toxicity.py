"""Toxicity by a classifier chain of sparse linear models.

The categories of ``labels`` are predicted one after the other; each later model also sees the log odds that the earlier
ones give. In training these come from ``FOLDS``-fold models that have not seen the document, so a later model does not
trust its forerunners more than it can at prediction time. Every model is a logistic regression with an elastic net
over the presence of words (A-Z lower-cased, letters and digits), the presence of their beginnings, and a few measures
of style. A document is toxic from the probability on at which the unseen predictions of the sample have the best F1.

Training takes a bounded sample: the ``SAMPLE`` labelled documents with the smallest hash of their id. Their words reach
one task as 64-bit hashes; the vocabulary is made of the words of ``LEAST_DOCUMENTS`` sampled documents or more, up to
``MOST_WORDS`` of the most frequent ones. The model is a few hundred kilobytes, and all documents are scored against it
without a shuffle.

Defined cases: null and empty texts have no words and get the probability their style measures give. A label row with a
null is ignored; of several label rows for one document the larger value counts, of several texts with one id the one of the smallest digest. Documents without a label are scored
like others. Without labelled documents every probability is 0; with one class only, it is that class's. Repeated rows
give repeated rows, null ids are kept. Extra columns are not read (``drop_toxic`` passes them on). An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import short_batches, smallest_hashes
from sitefold.llm.words import ALPHANUMERIC, byte_class, slices, text_bytes, word_hashes, word_spans

CATEGORIES = ("low_quality", "toxic")
SAMPLE = 8_000
FOLDS = 3
MOST_WORDS, LEAST_DOCUMENTS = 20_000, 5
#: Bytes of a word's beginning, which counts as a feature of its own: languages build words by endings.
BEGINNING = 5
ITERATIONS = 200
L1, L2 = 1e-3, 1e-5
#: Log odds are kept within this range where they enter a later model.
ODDS = 8.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_CASE = ~byte_class("".join(map(chr, range(65, 91))))
_DIGIT = ~byte_class("0123456789")
_MARK = ~byte_class("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
STYLES = 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of words and beginnings, their document numbers, and the style measures of every document."""
    starts, ends, first_word = word_spans(data, offsets, ALPHANUMERIC)
    lowered, n_words = _LOWER[data], np.diff(first_word)
    long = np.flatnonzero(ends - starts > BEGINNING)
    beginnings = ~word_hashes(lowered, starts[long], starts[long] + BEGINNING)  # not those of whole words
    hashes = np.r_[word_hashes(lowered, starts, ends), beginnings]
    document = np.repeat(np.arange(len(n_words)), n_words)
    document = np.r_[document, document[long]]
    order = np.lexsort((hashes, document))
    h, d = hashes[order], document[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    h, d = h[new], d[new]

    def share(member: np.ndarray) -> np.ndarray:
        counts = np.r_[0, np.cumsum(member[data])]
        return (counts[offsets[1:]] - counts[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

    distinct = np.bincount(d, minlength=len(n_words))
    style = np.stack(
        [np.log1p(n_words), distinct / np.maximum(1, n_words), share(_UPPER_CASE), share(_DIGIT), share(_MARK), np.diff(offsets) / np.maximum(1, n_words)],
        axis=1,
    )
    style[:, 5] = np.log1p(style[:, 5])
    return h, d, style


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Sparse presence rows with weights per column, and dense columns beside them."""

    def __init__(self, row: np.ndarray, column: np.ndarray, scale: np.ndarray, dense: np.ndarray):
        self.row, self.column, self.scale, self.dense = row, column, scale, dense

    def take(self, chosen: np.ndarray) -> Rows:
        number = np.full(len(self.dense), -1)
        number[chosen] = np.arange(len(chosen))
        inside = number[self.row] >= 0
        return Rows(number[self.row[inside]], self.column[inside], self.scale, self.dense[chosen])

    def times(self, sparse: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, (sparse * self.scale)[self.column], len(self.dense)) + self.dense @ dense

    def back(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.column, residual[self.row], len(self.scale)) * self.scale, self.dense.T @ residual


def fit(rows: Rows, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by accelerated proximal gradient steps; the dense weights carry no L1 penalty."""
    n = max(1, len(target))
    sparse, dense = np.zeros(len(rows.scale)), np.zeros(rows.dense.shape[1])
    if not len(target) or target.min() == target.max():
        dense[0] = 0.0 if not len(target) else (20.0 if target[0] else -20.0)
        return sparse, dense
    u, v = np.ones_like(sparse), np.ones_like(dense)
    for _ in range(12):  # the largest eigenvalue, for the step size
        norm = max(1e-12, float(np.sqrt(u @ u + v @ v)))
        u, v = rows.back(rows.times(u / norm, v / norm))
    step = 1 / (0.25 * 1.1 * max(1e-9, float(np.sqrt(u @ u + v @ v))) / n + L2)
    a, b, momentum = sparse, dense, 1.0
    for _ in range(ITERATIONS):
        residual = (_sigmoid(rows.times(a, b)) - target) / n
        down, dense_down = rows.back(residual)
        fresh = a - step * (down + L2 * a)
        fresh = np.sign(fresh) * np.maximum(0, np.abs(fresh) - step * L1)
        dense_fresh = b - step * dense_down
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (momentum - 1) / following
        a, b = fresh + ahead * (fresh - sparse), dense_fresh + ahead * (dense_fresh - dense)
        sparse, dense, momentum = fresh, dense_fresh, following
    return sparse, dense


def train(sample: pa.Table, categories: tuple[str, ...]) -> pa.Table:
    """The chain from the sampled documents: vocabulary, style scaling and weights, as one row of bytes."""
    n = sample.num_rows
    own = [np.frombuffer(x, np.uint64) for x in sample.column("words").to_pylist()]
    style = np.array(sample.column("style").to_pylist(), dtype=float).reshape(n, STYLES)
    targets = np.array([sample.column(c).to_numpy() for c in categories], dtype=float).reshape(len(categories), n)
    fold = sample.column("fold").to_numpy()
    hashes = np.concatenate(own) if own else np.zeros(0, np.uint64)
    words, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    frequent = np.flatnonzero(counts >= LEAST_DOCUMENTS)
    frequent = np.sort(frequent[np.lexsort((words[frequent], -counts[frequent]))][:MOST_WORDS])
    number = np.full(len(words), -1)
    number[frequent] = np.arange(len(frequent))
    column = number[inverse]
    row = np.repeat(np.arange(n), [len(x) for x in own])[column >= 0]
    scale = np.log((n + 1) / (counts[frequent] + 1)) + 0.1
    mean, spread = (style.mean(axis=0), style.std(axis=0) + 1e-9) if n else (np.zeros(STYLES), np.ones(STYLES))
    dense = np.c_[np.ones(n), (style - mean) / spread]
    weights, extra = [], np.zeros((n, 0))
    for target in targets:
        rows = Rows(row, column[column >= 0], scale, np.c_[dense, extra])
        unseen = np.zeros(n)
        for k in range(FOLDS):
            out, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            unseen[out] = rows.take(out).times(*fit(rows.take(rest), target[rest]))
        sparse, whole = fit(rows, target)
        weights.append((sparse * scale, whole))
        extra = np.c_[extra, np.clip(unseen, -ODDS, ODDS)]
    limit = best_threshold(_sigmoid(extra[:, -1]), targets[-1])
    parts = [words[frequent].tobytes(), mean.tobytes() + spread.tobytes(), np.float64(limit).tobytes()]
    parts += [x.astype(float).tobytes() for pair in weights for x in pair]
    return pa.table({"model": pa.array([parts], pa.list_(pa.binary()))})


def best_threshold(p: np.ndarray, target: np.ndarray) -> float:
    """The probability from which on calling a row positive gives the best F1; 0.5 where nothing is positive."""
    if not len(p) or not target.any() or target.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + target.sum())
    best = int(np.argmax(f1))
    following = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(min(0.5, (p[order[best]] + following) / 2))


class Chain:
    """A trained chain; scores batches of texts."""

    def __init__(self, parts: list[bytes], categories: int):
        self.words = np.frombuffer(parts[0], np.uint64)
        self.mean, self.spread = np.frombuffer(parts[1]).reshape(2, STYLES)
        self.threshold = float(np.frombuffer(parts[2])[0])
        rest = [np.frombuffer(x) for x in parts[3:]]
        self.models = [(rest[2 * k], rest[2 * k + 1]) for k in range(categories)]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, document, style = features(data, offsets)
        n = len(offsets) - 1
        at = np.flatnonzero(self.flags[(hashes >> np.uint64(44)).astype(np.int64)])
        column = np.minimum(np.searchsorted(self.words, hashes[at]), max(0, len(self.words) - 1))
        known = self.words[column] == hashes[at] if len(self.words) else np.zeros(len(at), bool)
        document, column = document[at[known]], column[known]
        dense = np.c_[np.ones(n), (style - self.mean) / self.spread]
        odds = np.zeros((n, 0))
        for sparse, whole in self.models:
            z = np.bincount(document, sparse[column], n) + np.c_[dense, odds] @ whole
            odds = np.c_[odds, np.clip(z, -ODDS, ODDS)]
        return _sigmoid(odds) if len(self.models) else odds


def trained_chain(docs: DataFrame, labels: DataFrame, key: str, text: str, categories: tuple[str, ...], sample: int = SAMPLE) -> list[bytes] | None:
    """Train on the sampled labelled documents; None without any. ``labels``: key and a 0/1 column per category."""
    known = labels.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *categories))))
    # The bound of the broadcast below.
    chosen = smallest_hashes(known.groupBy(key).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]), key, sample)
    sampled = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(chosen), key)
    # Of several texts with one id the one of the smallest digest, so that the model is repeatable.
    smallest = F.min(F.struct(F.md5(F.coalesce("__text", F.lit(""))).alias("digest"), "__text")).alias("first")
    picked = sampled.groupBy(key, *categories).agg(smallest).select(key, *categories, "first.__text")
    kinds = ", ".join(f"`{c}` int" for c in categories)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            words, styles = [], []
            for first, last in slices(offsets):
                h, d, style = features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                cuts = np.searchsorted(d, np.arange(last - first + 1))
                words += [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                styles += style.tolist()
            columns = [batch.column(c) for c in ("fold", *categories)]
            columns += [pa.array(words, pa.binary()), pa.array(styles, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", *categories, "words", "style"])

    folded = picked.select(F.expr(f"cast(pmod(xxhash64(`{key}`, 'fold'), {FOLDS}) AS int) AS fold"), *categories, "__text")
    measured = short_batches(folded).mapInArrow(run, f"fold int, {kinds}, words binary, style array<double>")
    # One task: at most SAMPLE rows of word hashes.
    whole = measured.withColumn("chain", F.lit(1)).groupBy("chain")
    models = whole.applyInArrow(lambda rows: train(rows, categories), "model array<binary>").collect()
    return [bytes(x) for x in models[0][0]] if models else None


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Key, the probability ``p_<category>`` of every category and ``toxic``: the last one reaches the threshold."""
    parts = trained_chain(docs, labels, key, text, categories)
    model = docs.sparkSession.sparkContext.broadcast(Chain(parts, len(categories)) if parts else None)
    names = [f"p_{c}" for c in categories]

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = [np.zeros((0, len(names)))]
            for first, last in slices(offsets):
                own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                found.append(model.value.probabilities(*own) if model.value else np.zeros((last - first, len(names))))
            p, limit = np.concatenate(found), model.value.threshold if model.value else 1.0
            columns = [batch.column(0), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names, "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *[f"{n} double" for n in names], "toxic boolean"])
    return short_batches(docs).select(key, text).mapInArrow(run, schema)


def chain_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels table as the chain's categories: quality turned into low_quality, and toxic."""
    return labels.select(key, (1 - F.col("quality")).alias("low_quality"), "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` not found toxic, all columns kept; rows with equal keys are judged by their own texts."""
    parts = trained_chain(docs, labels, key, text, CATEGORIES)
    if parts is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(Chain(parts, len(CATEGORIES)))
    columns = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(columns.index(text)))
            keep = [np.zeros(0, bool)]
            for first, last in slices(offsets):
                own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                keep.append(model.value.probabilities(*own)[:, -1] < model.value.threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return short_batches(docs).mapInArrow(run, docs.schema)
