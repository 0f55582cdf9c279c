"""Quality by positive-unlabelled learning: the non-negative risk of a linear model over measures of style.

Trusted positives are documents labelled as good; what is labelled otherwise is never looked at. Unlabelled text is the whole
documents table.

1. Measures. Every text is read once for ``MEASURES`` numbers: length, words, upper case, digits, marks, repetition of words,
   word pairs and lines, and the like. They are landed, 4 bytes each, with their table; all later passes read only them.
   They enter the model in units of the positives' spread, plain and squared, since good text is alike in them and bad
   text is far off on either side.
2. Class prior. A model that tells positives from unlabelled text is fitted on half of the positives. Where it scores highest there is
   next to nothing bad, so the share of unlabelled text there over the share of the other half of the positives is the prior; the
   least such ratio with a margin for chance is taken (best bin), less the margin: too small a prior costs a little certainty,
   too large a one makes the risk of bad text negative.
3. Risk. With prior p and logistic loss l the risk of g is p E_pos[l(g)] + max(0, E_all[l(-g)] - p E_pos[l(-g)]). It is
   minimised by Newton steps; each adds up risk, gradient and curvature over all documents in Spark. A step that raises the risk,
   or that takes the second part, the risk of bad text, below zero, is shortened; the fit ends where none is left.
4. Scores are the model's probabilities, from the landed measures.

Positives are a bounded sample: the ``POSITIVES`` ones with the smallest hash of their id (their measures, 68 bytes each, reach the
driver). Sums over all documents are a few thousand numbers, combined before they are shuffled.

Defined cases: null and empty texts have measures of zero and a score like others. Of several label rows for one document
the smallest counts; nulls are ignored. Labels of held-out documents (``crc32`` of the id as text divisible by ``FOLDS``; a
null id is held out) are not read. Without positives every score is 0. Repeated rows give repeated rows, null ids are kept.
Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import short_batches, smallest_hashes
from sitefold.llm.words import NOT_BLANK, byte_class, mixed, slices, text_bytes, word_hashes, word_spans
from sitefold.session import landed

POSITIVES = 20_000
FOLDS = 5
THRESHOLD = 0.3
MEASURES = 17
#: Measures enter within this many spreads of the positives' mean.
REACH = 8.0
L2, STEPS, ENOUGH = 1e-3, 15, 1e-5
#: Shares of a Newton step that are tried, and steps of the model that only the prior is taken from.
SHARES, PRIOR_STEPS = (1.0, 0.25, 0.0625), 6
#: Chance of error of the prior's margin.
DOUBT = 0.1

_CLASSES = {
    "upper": ~byte_class("".join(map(chr, range(65, 91)))),
    "digit": ~byte_class("0123456789"),
    "sentence": ~byte_class(".,;:!?'\"-()"),
    "mark": ~byte_class("#$%&*+/<=>@[\\]^_`{|}~"),
    "shout": ~byte_class("!?"),
    "foreign": np.arange(256) >= 128,
}
_LINE = byte_class("\n")


def _distinct(document: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of every document."""
    order = np.lexsort((hashes, document))
    h, d = hashes[order], document[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(d[new], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of measures for every text."""
    n, n_bytes = len(offsets) - 1, np.diff(offsets)
    starts, ends, first_word = word_spans(data, offsets, NOT_BLANK)
    n_words = np.diff(first_word)
    document, hashes, lengths = np.repeat(np.arange(n), n_words), word_hashes(data, starts, ends), ends - starts

    def share(member: np.ndarray, of: np.ndarray = n_bytes) -> np.ndarray:
        counts = np.r_[0, np.cumsum(member[data])]
        return (counts[offsets[1:]] - counts[offsets[:-1]]) / np.maximum(1, of)

    def words(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(document[chosen], minlength=n) / np.maximum(1, n_words)

    following = np.flatnonzero(document[1:] == document[:-1])
    pairs = mixed(hashes[following] * np.uint64(0x9E3779B97F4A7C15) + hashes[following + 1])
    n_pairs = np.bincount(document[following], minlength=n)
    line_starts, line_ends, first_line = word_spans(data, offsets, _LINE)
    n_lines = np.diff(first_line)
    line_document = np.repeat(np.arange(n), n_lines)
    mean = n_bytes / np.maximum(1, n_words)
    spread = np.bincount(document, (lengths - mean[document]) ** 2, minlength=n) / np.maximum(1, n_words)
    marked = _CLASSES["sentence"] | _CLASSES["mark"]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(n_bytes),
        np.log1p(mean),
        np.log1p(spread),
        share(_CLASSES["upper"]),
        share(_CLASSES["digit"]),
        share(_CLASSES["sentence"]),
        share(_CLASSES["mark"]),
        share(_CLASSES["shout"], n_words),
        share(_CLASSES["foreign"]),
        words(marked[last]),
        words(_CLASSES["upper"][first]),
        words(_CLASSES["upper"][first] & _CLASSES["upper"][last]),
        _distinct(document, hashes, n) / np.maximum(1, n_words),
        _distinct(document[following], pairs, n) / np.maximum(1, n_pairs),
        np.bincount(document[following[hashes[following] == hashes[following + 1]]], minlength=n) / np.maximum(1, n_pairs),
        _distinct(line_document, word_hashes(data, line_starts, line_ends), n) / np.maximum(1, n_lines),
        np.log1p(n_words / np.maximum(1, n_lines)),
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, held_out and the measures (packed) of every document, landed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = [np.zeros((0, MEASURES))]
            for first, last in slices(offsets):
                rows.append(measures(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
            own = np.concatenate(rows).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in own], pa.binary())], names=["key", "own"])

    kind = docs.schema[key].dataType.simpleString()
    rows = short_batches(docs).select(key, text).mapInArrow(run, f"key {kind}, own binary")
    return landed(rows.withColumn("held_out", F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % FOLDS == 0))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), MEASURES).astype(float)


class Scale:
    """Measures in spreads of the positives, plain and squared, with a constant."""

    def __init__(self, positives: np.ndarray):
        self.mean, self.spread = positives.mean(axis=0), np.maximum(positives.std(axis=0), 1e-3)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -REACH, REACH)
        return np.concatenate([np.ones((len(z), 1)), z, z * z / REACH], axis=1)


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of`` (a vector per batch of measures) over all documents, combined before the shuffle."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(_matrix(batch.column(0)))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = rows.select("own").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "part"))
    found = sorted(parts.groupBy("at").agg(F.sum("part")).collect())
    return np.array([value for _, value in found])


def _curve(scale: Scale, weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Number of rows, loss as bad text, gradient and curvature at ``weights``."""

    def of(rows: np.ndarray) -> np.ndarray:
        x = scale(rows)
        g = x @ weights
        chance = _chance(g)
        curvature = x.T @ (x * (chance * (1 - chance))[:, None])
        return np.concatenate([[len(x), _loss(-g).sum()], chance @ x, curvature.ravel()])

    return of


def fit(rows: DataFrame, positives: np.ndarray, scale: Scale, prior: float | None, steps: int = STEPS) -> np.ndarray:
    """Weights of the least non-negative risk; without ``prior`` those that tell positives from all text."""
    x = scale(positives)
    width = x.shape[1]
    ridge = L2 * np.r_[0, np.ones(width - 1)]
    weights, step, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(steps):
        # A full step and shorter ones are tried in one pass.
        tried = [weights + step * share for share in SHARES]
        sums = _summed(rows, lambda own, tried=tried: np.concatenate([_curve(scale, w)(own) for w in tried])).reshape(len(tried), -1)
        for w, (n, bad, *rest) in zip(tried, sums, strict=True):
            g, rest = x @ w, np.array(rest) / n
            curvature, decay, bad = rest[width:].reshape(width, width), 0.5 * float(ridge @ (w * w)), bad / n
            if prior is None:
                risk, allowed = _loss(g).mean() + bad + decay, True
                down = rest[:width] - (1 - _chance(g)) @ x / len(x)
                curvature = curvature + x.T @ (x * (_chance(g) * _chance(-g))[:, None]) / len(x)
            else:
                bad -= prior * _loss(-g).mean()
                risk, allowed = prior * _loss(g).mean() + bad + decay, bad >= 0
                down = rest[:width] - prior * x.mean(axis=0)
            if allowed and risk < least:
                break
        else:
            break
        gain, weights, least = least - risk, w, risk
        if gain < ENOUGH:
            break
        step = -np.linalg.solve(curvature + np.diag(ridge + 1e-9), down + ridge * w)
    return weights


def prior_of(rows: DataFrame, positives: np.ndarray, scale: Scale) -> float:
    """Share of good text among all, by the best bin of a model fitted on half of the positives."""
    half = np.arange(len(positives)) % 2 == 0
    if half.all():
        return 0.5
    weights = fit(rows, positives[half], scale, None, PRIOR_STEPS)
    scores = scale(positives[~half]) @ weights
    bins = np.unique(np.quantile(scores, np.linspace(0, 0.95, 200)))

    def above(own: np.ndarray) -> np.ndarray:
        g = np.sort(scale(own) @ weights)
        return np.r_[len(g), len(g) - np.searchsorted(g, bins)].astype(float)

    n, *counts = _summed(rows, above)
    of_all = np.array(counts) / n
    of_positives = (len(scores) - np.searchsorted(np.sort(scores), bins)) / len(scores)
    margin = sum(np.sqrt(np.log(4 / DOUBT) / (2 * k)) for k in (n, len(scores)))
    best = np.argmin((of_all + 2 * margin) / of_positives)
    return float(np.clip((of_all[best] - margin) / of_positives[best], 0.01, 0.99))


def trusted(rows: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> np.ndarray:
    """Measures of the sampled positives."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("least"))
    good = rows.where("NOT held_out").join(known.where("least = 1"), "key", "left_semi")
    # One row per id: of several texts the one whose measures are smallest as bytes.
    some = smallest_hashes(good.groupBy("key").agg(F.min("own").alias("own")), "key", most).select("own").collect()
    return np.frombuffer(b"".join(bytes(r[0]) for r in some), "<f4").reshape(len(some), MEASURES).astype(float)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES) -> DataFrame:
    """Key, held_out, score and predicted of every document."""
    rows = measured(docs, key, text)
    own = trusted(rows, labels, key, label, positives)
    model = None
    if len(own):
        scale = Scale(own)
        prior = prior_of(rows, own, scale)
        model = scale, fit(rows, own, scale, prior)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = np.zeros(batch.num_rows) if model is None else _chance(model[0](_matrix(batch.column(2))) @ model[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chances)], names=[key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.select("key", "held_out", "own").mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
