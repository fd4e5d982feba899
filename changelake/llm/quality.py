"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document or abstain: one votes good, the others bad. How often
each combination of votes occurs is counted over all documents (at most 2^labellers combinations, so the
table is bounded), and expectation-maximisation on these counts estimates how often each labeller votes in
either class (independently given the class) and with them the posterior of every combination. The posteriors then serve as
soft labels for a linear scorer on hashed features of the text (word shapes, pairs of shapes, immediate
repetitions, rough sizes), which also judges texts that the labellers have nothing or contradictions on.

The scorer is fitted on a bounded sample, the ``TRAIN_ROWS`` documents (about) with the least hash; counts,
posteriors and scores cover all documents. No human label is used.

Defined results. Texts without words (null, empty, blank) score 0 and are rejected. Rows are independent;
repeated rows and null or repeated ids give one result row each. If no combination with a bad vote occurs,
everything that has words is kept. Other columns are not read (``score``) or pass through (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.store import materialise
from changelake.llm.text import Words, mix, span_hash, tidy, words

FEATURES = 1 << 12
TRAIN_ROWS = 20_000
STEPS = 300
RIDGE = 1e-4
LABELLERS = ["prose", "symbols", "capitals", "repetition", "variety", "sentences", "separators", "word_length"]

_bytes = np.arange(256)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_LETTER = _UPPER | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_DIGIT = (_bytes >= 48) & (_bytes <= 57)
_PLAIN = np.isin(_bytes, np.frombuffer(b".,;:'\"-()?!/", np.uint8))
_SYMBOL = ~(_LETTER | _DIGIT | _PLAIN) & (_bytes > 32)
_STOP = np.isin(_bytes, np.frombuffer(b".?!", np.uint8))
# bytes of one kind look alike in a word's shape; punctuation and symbols stand for themselves
_SHAPE = np.where(_UPPER, 65, np.where(_LETTER, 97, np.where(_DIGIT, 48, _bytes)))


def _by_doc(w: Words, of_word: np.ndarray) -> np.ndarray:
    """Sum of a per-word figure for each document."""
    total = np.concatenate([[0], np.cumsum(of_word)])
    return total[w.bounds[1:]] - total[w.bounds[:-1]]


def _by_word(w: Words, of_byte: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(of_byte)])
    return total[w.end] - total[w.start]


def _distinct(w: Words) -> np.ndarray:
    order = np.lexsort((w.hash, doc := w.doc_of_word()))
    h, d = w.hash[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[fresh], minlength=w.rows)


def _again(w: Words) -> np.ndarray:
    """Words equal to the word before them in their document."""
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    heads = w.bounds[:-1][np.diff(w.bounds) > 0]
    same[heads] = False
    return same


def votes(w: Words) -> np.ndarray:
    """(documents, labellers): whether each votes; the first votes good, the others bad."""
    n = np.diff(w.bounds)
    some, data = np.maximum(n, 1), w.data
    size = w.end - w.start
    symbols = _by_doc(w, _by_word(w, _SYMBOL[data]) > 0) / some
    letters = np.maximum(_by_doc(w, _by_word(w, _LETTER[data])), 1)
    capitals = _by_doc(w, _by_word(w, _UPPER[data])) / letters
    repeated = _by_doc(w, _again(w)) / some
    variety = _distinct(w) / some
    stops = _by_doc(w, _STOP[data[w.end - 1]] if len(w.end) else w.end) / some
    bars = _by_doc(w, (size == 1) & _SYMBOL[data[w.start]] if len(w.end) else w.end) / some
    length = _by_doc(w, size) / some

    long = n >= 30
    prose = (symbols < 0.05) & (capitals < 0.2) & (repeated < 0.05) & (bars == 0) & ((stops < 0.5) | (n < 10))
    return (n > 0)[:, None] & np.stack([
        prose, symbols > 0.2, (capitals > 0.3) & (n >= 5), (repeated > 0.2) & (n >= 5), long & (variety < 0.2),
        long & ((stops < 0.005) | (stops > 0.7)), bars > 0.1, long & (length > 25)], axis=1)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, weight) triples: shares of hashed features among the document's words."""
    n = np.diff(w.bounds)
    doc = w.doc_of_word()
    inside = np.zeros(len(w.data), bool)
    if len(w.start):
        edge = np.zeros(len(w.data) + 1, np.int64)
        edge[w.start] += 1
        np.subtract.at(edge, w.end, 1)
        inside = np.cumsum(edge)[:-1] > 0
    shape = _SHAPE[w.data]
    run = inside.copy()
    run[1:] &= (shape[1:] != shape[:-1]) | ~inside[:-1]
    run[w.start] = True
    rank = np.concatenate([[0], np.cumsum(run)])
    kept = mix(shape[run].astype(np.uint64) + np.uint64(1))
    value = span_hash(kept, rank[w.start], rank[w.end])
    before = np.zeros(len(value), np.uint64)
    before[1:] = value[:-1]
    before[w.bounds[:-1][n > 0]] = 0
    pair = mix(value ^ (before * np.uint64(0x9E3779B97F4A7C15)))
    again = np.flatnonzero(_again(w))
    some = np.flatnonzero(n)
    sizes = [np.log2(n[some] + 1), 10 * _distinct(w)[some] / n[some], _by_doc(w, w.end - w.start)[some] / n[some]]
    whole = [mix((np.floor(x) + 1000 * (i + 1)).astype(np.uint64)) for i, x in enumerate(sizes)]
    at = np.concatenate([doc, doc, doc[again], *[some] * len(whole)])
    hashed = np.concatenate([value, pair, np.full(len(again), mix(np.array([7], np.uint64))[0]), *whole])
    weight = np.concatenate([1 / n[doc], 1 / n[doc], 1 / n[doc[again]], *[np.full(len(some), 0.2)] * len(whole)])
    return at, (hashed >> np.uint64(52)).astype(np.int64) % FEATURES, weight


def combinations(docs: DataFrame, text: str = "text") -> DataFrame:
    """(votes, n): how often each combination of votes occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), "space", False):
                code, n = np.unique(_code(votes(w)[np.diff(w.bounds) > 0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["votes", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(tidy(run), "votes long, n long").groupBy("votes").agg(
        F.sum("n").alias("n"))


def _code(v: np.ndarray) -> np.ndarray:
    return v @ 2 ** np.arange(len(LABELLERS))


def _decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] >> np.arange(len(LABELLERS)) & 1


def estimate(code: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of 'good' per combination, chance of a vote [class, labeller], share of good) by
    expectation-maximisation. It starts from labellers that are right more often than wrong."""
    v = _decode(code)
    table = np.array([[0.1] + [0.35] * (v.shape[1] - 1), [0.9] + [0.005] * (v.shape[1] - 1)])
    good, posterior = 0.8, np.ones(len(v))
    if not v[:, 1:].any():
        return posterior, table, 1.0
    for _ in range(rounds):
        score = [(v * np.log(table[c]) + (1 - v) * np.log1p(-table[c])).sum(axis=1) for c in (0, 1)]
        odds = np.log(good) - np.log1p(-good) + score[1] - score[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for c, weight in ((0, (1 - posterior) * n), (1, posterior * n)):
            table[c] = ((v * weight[:, None]).sum(axis=0) + 0.5) / (weight.sum() + 1)
        good = float(np.clip((posterior * n).sum() / n.sum(), 1e-4, 1 - 1e-4))
    return posterior, table, good


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float64), float(bias)

    def scores(self, w: Words) -> np.ndarray:
        at, feature, weight = features(w)
        total = np.bincount(at, weights=self.weights[feature] * weight, minlength=w.rows)
        score = 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))
        return np.where(np.diff(w.bounds) > 0, score, 0.0)

    def score(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """Per row: the key, score, keep."""
        held = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in words(batch.column(1), "space", False):
                    score = held.value.scores(w)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(w.first_row, w.rows), pa.array(score), pa.array(score >= 0.5)],
                        names=["doc_id", "score", "keep"])

        kind = docs.schema[key].dataType.simpleString()
        return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, score double, keep boolean").withColumnRenamed("doc_id", key)

    def keep_good(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The rows that are not rejected, with all their columns."""
        held, at = docs.sparkSession.sparkContext.broadcast(self), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in words(batch.column(at), "space", False):
                    yield batch.slice(w.first_row, w.rows).filter(pa.array(held.value.scores(w) >= 0.5))

        return docs.mapInArrow(tidy(run), docs.schema)


def train(docs: DataFrame, text: str = "text") -> QualityModel:
    """A scorer for these documents, from their own votes."""
    counted = combinations(docs, text).toPandas().sort_values("votes")
    total = int(counted["n"].sum())
    if not total:
        return QualityModel(np.zeros(FEATURES), 1.0)
    posterior, _, good = estimate(counted["votes"].to_numpy(), counted["n"].to_numpy())
    label = dict(zip(counted["votes"].tolist(), posterior.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), "space", False):
                at, feature, weight = features(w)
                y = np.array([label[c] for c in _code(votes(w)).tolist()] if w.rows else [], float)
                cell, back = np.unique(at * FEATURES + feature, return_inverse=True)
                share = np.bincount(back, weights=weight)
                doc = cell // FEATURES
                cuts = np.searchsorted(doc, np.arange(w.rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cell % FEATURES, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(share, pa.float32()))],
                    names=["y", "feature", "share"])

    # rows below a hash bound: about TRAIN_ROWS of them, whatever the size of the corpus
    bound = min(1.0, TRAIN_ROWS / total)
    sample = docs.where(F.col(text).isNotNull() & F.trim(F.col(text)).rlike(r"\S")).select(text).where(
        F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(bound * (1 << 30)))
    rows = sample.limit(2 * TRAIN_ROWS).mapInArrow(tidy(run), "y double, feature array<int>, share array<float>")
    got = materialise(rows, "quality-sample").toArrow().combine_chunks()
    return _fit(got.column("y").to_numpy(), got.column("feature"), got.column("share"), good)


def _fit(y: np.ndarray, feature, share, good: float) -> QualityModel:
    """Logistic regression on soft labels by full-batch steps of adaptive size."""
    good = min(max(good, 1e-3), 1 - 1e-3)
    w, b = np.zeros(FEATURES), float(np.log(good / (1 - good)))
    if not len(y) or y.min() >= 0.5:
        return QualityModel(w, abs(b) + 0.1)
    count = np.array([len(x) for x in feature.to_pylist()])
    row = np.repeat(np.arange(len(y)), count)
    col = np.concatenate([np.asarray(x, np.int64) for x in feature.to_pylist()])
    val = np.concatenate([np.asarray(x, np.float64) for x in share.to_pylist()])
    seen, seen_b = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col] * val, minlength=len(y)) + b, -30, 30)))
        error = (p - y) / len(y)
        gradient = np.bincount(col, weights=error[row] * val, minlength=FEATURES) + RIDGE * w
        seen += gradient ** 2
        seen_b += error.sum() ** 2
        w -= 0.5 * gradient / np.sqrt(seen)
        b -= 0.5 * error.sum() / np.sqrt(seen_b)
    return QualityModel(w, b)
