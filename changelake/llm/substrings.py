"""Removal of word passages that repeat across documents, by level-wise doubling.

A window is ``length`` (50) consecutive words. A word goes if a window that covers it also starts in a
document with a smaller doc_id; windows are judged on the input.

Level length/2. Equal windows of the full length hold the same half-length window at the same place, so
it is enough to look at one of them: the one with the least hash (leftmost among equals). Each document
sends these *anchors*, about one for 13 words, with the run of full windows that each stands for. Anchors
that occur in one document only end here, with all their windows.

Level length. Repeated anchors are extended. First each anchor with its whole run of windows, as one
hash: where the same stretch is in a smaller document, all its windows go. The smallest document of an
anchor has nothing to lose. Only what is still open, and what it may have to be compared with, is
expanded into single windows of the full length, and these are matched. (An occurrence whose whole
stretch is in a smaller document need not be expanded: that document has the same windows.)

Scale. Anchors are aggregated before they are joined, so a passage that a third of all documents hold
sends one row a task to the aggregate, and adaptive execution may split the join back. Text is shuffled
only for documents that hold open anchors or lose words; which documents those are is broadcast up to a
counted bound. Windows are compared as 64-bit hashes.

Defined results. Words are runs of [^\\x20\\x09-\\x0D], unchanged; null text has none, and documents with
fewer than ``length`` words lose nothing. The kept text is the kept words joined by one space. Rows
without doc_id take no part and lose nothing. Rows that share a doc_id count as one document as often as
they are written: they do not repeat each other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.store import materialise, only_ids
from changelake.llm.text import ragged, slices, span_hash, starts_of_windows, tidy, window_hash, words

LENGTH = 50


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:])


def anchors(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per anchor: h (its hash), doc_id, first (first window of its run), n (windows), span (hash
    of all words of these windows)."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), "space", False):
                start = starts_of_windows(w.bounds, length)
                if not len(start):
                    continue
                h = window_hash(w.hash, half)
                low = np.uint64((1 << max(24, len(h).bit_length())) - 1)
                placed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
                anchor = (sliding_min(placed, length - half + 1)[start] & low).astype(np.int64)
                doc = np.searchsorted(w.bounds, start, "right") - 1
                fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
                at = np.flatnonzero(fresh)
                n = np.diff(np.append(at, len(start)))
                first, doc = start[at], doc[at]
                span = span_hash(w.hash, first, first + n - 1 + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[anchor[at]].view(np.int64)),
                     batch.column(0).slice(w.first_row, w.rows).take(pa.array(doc)),
                     pa.array(first - w.bounds[doc], pa.int32()), pa.array(n, pa.int32()),
                     pa.array(span.view(np.int64))], names=["h", "doc_id", "first", "n", "span"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"h long, doc_id {kind}, first int, n int, span long")


def expand(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, first) of single windows; ``docs`` holds doc_id, text, runs (first, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2).to_pylist()
            for w in words(batch.column(1), "space", False):
                doc = np.repeat(np.arange(w.rows), [len(r) for r in runs[w.first_row:w.first_row + w.rows]])
                mine = [x for r in runs[w.first_row:w.first_row + w.rows] for x in r]
                count = np.array([x["n"] for x in mine], np.int64)
                at = ragged(np.array([x["first"] for x in mine], np.int64), count)
                doc = np.repeat(doc, count)
                begin = w.bounds[doc] + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span_hash(w.hash, begin, begin + length).view(np.int64)),
                     batch.column(0).slice(w.first_row, w.rows).take(pa.array(doc, pa.int64())),
                     pa.array(at, pa.int32())], names=["h", "doc_id", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "runs").mapInArrow(tidy(run), f"h long, doc_id {kind}, first int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, first, last): word ranges, last excluded, that windows of smaller documents cover. They
    may overlap."""
    base = materialise(anchors(docs, length, text, key), "anchors")
    twice = base.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    repeated = materialise(base.join(twice, "h"), "repeated-anchors")
    stretch = repeated.groupBy("h", "span", "n").agg(F.min("doc_id").alias("stretch_lo"))
    judged = materialise(repeated.join(stretch, ["h", "span", "n"]).select(
        "h", "doc_id", "first", "n", F.when(F.col("stretch_lo") < F.col("doc_id"), "whole").when(
            F.col("lo") == F.col("doc_id"), "smallest").otherwise("open").alias("state")), "judged-anchors")
    whole = judged.where("state = 'whole'").select(
        "doc_id", "first", (F.col("first") + F.col("n") + (length - 1)).alias("last"))

    unsettled = judged.where("state = 'open'").select("h").distinct()
    runs = materialise(judged.where("state <> 'whole'").join(unsettled, "h", "left_semi").groupBy("doc_id").agg(
        F.collect_list(F.struct("first", "n")).alias("runs")), "open-runs")
    body = only_ids(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")),
                    "doc_id", runs.select("doc_id"))
    windows = materialise(expand(body.join(runs, "doc_id"), length), "windows")
    least = windows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    single = windows.join(least, "h").where("doc_id > lo").select(
        "doc_id", "first", (F.col("first") + length).alias("last"))
    return whole.union(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_words, n_removed, kept (the text without repeated windows)."""
    spans = materialise(repeated_spans(docs, length, text, key).groupBy("doc_id").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    body = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()
    hit = only_ids(body, "doc_id", spans.select("doc_id")).join(spans, "doc_id")
    rest = only_ids(body, "doc_id", spans.select("doc_id"), "left_anti").withColumn(
        "spans", F.lit(None).cast(spans.schema["spans"].dataType))
    made = hit.select("doc_id", "text", "spans").union(rest).mapInArrow(tidy(_cut), f"doc_id {kind}, n_words long, n_removed long, kept string")
    return made.withColumnRenamed("doc_id", key)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, offsets in slices(batch.column(1)):
            part = batch.slice(first, len(offsets) - 1)
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                body = (text or "").encode().split()     # bytes.split() parts at \x20 and \x09-\x0D alone
                n_words.append(len(body))
                if spans:
                    edge = np.zeros(len(body) + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["last"] for s in spans], -1)
                    body = [body[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(body))
                kept.append(b" ".join(body).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
