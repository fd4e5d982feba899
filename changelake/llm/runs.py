"""Periodic runs of words, by recursive frequency splitting and a lag scan of what is left.

A run is a stretch of consecutive words that repeats with its smallest period q (words q apart are equal),
is at least max(12, 2q) words long and cannot be extended to either side with that period.

1. Splitting. Each word of a run has an equal word q places before or after it, inside the run, and the run
   is at least 2q long. So a word that has no equal word within half the length of its segment is in no run
   of the segment: it splits it. The parts are judged anew by the words that *they* hold, until nothing
   splits; parts of fewer than 12 words are dropped. All segments of a slice are split at the same time.
2. Lag scan of the surviving segments. Lags below 8 are compared word by word. A run with a lag of K to
   2K - 1 (K = 8, 16, ...) matches itself over at least K words, so it holds a place i that is a multiple
   of K/2 where the K/2 words from i on equal those from i + q on. One look at each such i against the lags
   of its level finds every run; the match is then extended to both sides by bisection. A level costs two
   comparisons a word, whatever the text.
3. Of stretches with the same ends the least lag is the period: other lags are its multiples.

Spans of words are compared by sums modulo two primes (62 bits), words by 64-bit hashes.

Nothing is shuffled: a document is judged by itself, slices of bounded bytes at a time. A longer document
is a slice of its own.

Defined results. Words are runs of [^\\x20\\x09-\\x0D], unchanged. Null and empty texts have no words and no
runs. Rows are independent, so repeated rows and null or repeated ids give one result row each. Runs are
ordered by start, then period. A word goes if some run holds it after that run's first q words; the kept text
is the other words joined by one space. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm.text import mix, ragged, tidy, words

LEAST = 12                     # words of a run
SHORT = 8                      # lags below are compared word by word
PRIMES = (2147483647, 2147483629)

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def surviving(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the segments that no word splits further; ``bounds`` of the documents in ``ids``."""
    first, end = bounds[:-1], bounds[1:]
    done_first, done_end = [], []
    while True:
        size = end - first
        first, end = first[size >= least], end[size >= least]
        if not len(first):
            break
        size = end - first
        at = ragged(first, size)
        segment = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((at, ids[at], segment))       # equal words of a segment side by side, in order
        place, word, part = at[order], ids[at][order], segment[order]
        near = (word[1:] == word[:-1]) & (part[1:] == part[:-1]) & (2 * (place[1:] - place[:-1]) <= size[part[1:]])
        alone = np.ones(len(at), bool)
        alone[1:] &= ~near
        alone[:-1] &= ~near
        cut = np.sort(place[alone])
        whole = np.ones(len(first), bool)
        whole[part[alone]] = False
        done_first.append(first[whole])
        done_end.append(end[whole])
        if not len(cut):
            break
        # the pieces of split segments between their cuts
        lo = np.sort(np.concatenate([first[~whole], cut + 1]))
        hi = np.sort(np.concatenate([cut, end[~whole]]))
        first, end = lo[hi > lo], hi[hi > lo]
    if not done_first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_first), np.concatenate(done_end)


@lru_cache(maxsize=4)
def _powers(n: int, prime: int) -> np.ndarray:
    out, base = np.ones(n, np.uint64), np.uint64(1_000_003)
    done, step = 1, base
    while done < n:                                      # out[done:2 * done] = out[:done] * base ** done
        out[done:2 * done] = out[:n - done][:done] * step % np.uint64(prime)
        step = step * step % np.uint64(prime)
        done *= 2
    return out


class Spans:
    """Equality of spans of one array of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        room = 1 << max(16, n.bit_length())
        self.parts = []
        for k, prime in enumerate(PRIMES):
            p, power = np.uint64(prime), _powers(room, prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(values + np.uint64(k)) % p * power[:n] % p, out=sums[1:])
            self.parts.append((p, power, sums % p))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether values[a:a+size] equal values[b:b+size]; a <= b."""
        same = np.ones(len(a), bool)
        for p, power, sums in self.parts:
            x, y = (sums[a + size] + p - sums[a]) % p, (sums[b + size] + p - sums[b]) % p
            same &= x * power[b - a] % p == y
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest size, at most ``most``, of equal spans that begin (end, if ``back``) at a and b."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def least_lags(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, least lag) of the distinct stretches."""
    lo, hi, lag = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((lag, hi, lo))
    lo, hi, lag = lo[order], hi[order], lag[order]
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[fresh], hi[fresh], lag[fresh]


def lag_scan(ids: np.ndarray, first: np.ndarray, end: np.ndarray, least: int = LEAST):
    """(first, length, period) of all runs within the segments, in no order."""
    order = np.argsort(first - end, kind="stable")       # longest first: a level works on the longer ones
    first, end = first[order], end[order]
    size = end - first
    stop = np.cumsum(size)
    begin = stop - size
    x = ids[ragged(first, size)]
    home = np.repeat(np.arange(len(first)), size)
    found = []
    for lag in range(1, SHORT):
        n = stop[np.searchsorted(-size, -max(least, 2 * lag), "right") - 1] if size[:1].sum() >= max(least, 2 * lag) else 0
        if n <= lag:
            break
        same = np.zeros(n + 1, bool)
        same[:n - lag] = (x[:n - lag] == x[lag:n]) & (home[:n - lag] == home[lag:n])
        edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0))
        a, b = edge[::2], edge[1::2]
        keep = b - a + lag >= max(least, 2 * lag)
        found.append((a[keep], b[keep] + lag, np.full(keep.sum(), lag)))
    spans = Spans(x) if len(size) and size[0] >= 2 * SHORT else None
    known_end, known_lag = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)   # of a long run at each place
    level = SHORT
    while len(size) and size[0] >= 2 * level:
        n = stop[np.searchsorted(-size, -2 * level, "right") - 1]
        half = level // 2
        found = [least_lags(found)]
        lo, hi, lag = (c[found[0][1] - found[0][0] >= 2 * level] for c in found[0])
        order = np.argsort(hi - lo)                      # the longest run of a place is written last
        lo, hi, lag = lo[order], hi[order], lag[order]
        place = ragged(lo, hi - lo)
        known_end[place], known_lag[place] = np.repeat(hi, hi - lo), np.repeat(lag, hi - lo)
        at = np.arange(0, n - level, half)
        for some in np.array_split(at, -(-len(at) * level // (1 << 21))) if len(at) else []:
            # one word decides for most lags; what passes is compared over half a level
            other = some[:, None] + np.arange(level, 2 * level)
            inside = other + half <= stop[home[some]][:, None]
            row, col = np.nonzero(inside & (x[np.minimum(other, n - 1)] == x[some][:, None]))
            i, j = some[row], other[row, col]
            # within a known run whose period divides the lag, the match would have the run's own ends
            new = (j + half > known_end[i]) | ((j - i) % known_lag[i] != 0)
            i, j = i[new], j[new]
            same = spans.equal(i, j, half)
            i, j = i[same], j[same]
            if not len(i):
                continue
            lo = i - spans.reach(i, j, i - begin[home[i]], back=True)
            hi = j + spans.reach(i, j, stop[home[i]] - j)
            keep = hi - lo >= 2 * (j - i)
            found.append((lo[keep], hi[keep], (j - i)[keep]))
        level *= 2
    lo, hi, lag = least_lags(found)
    return first[home[lo]] + lo - begin[home[lo]], hi - lo, lag


def find(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, period) of all runs of the documents, by first word, then period."""
    first, length, period = lag_scan(ids, *surviving(ids, bounds))
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_words, runs (start, length, period: in words), n_dropped, collapsed (the text with
    each run cut to its first period)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), "space", False):
                first, length, period = find(w.hash, w.bounds)
                doc = np.searchsorted(w.bounds, first, "right") - 1
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, first + period, 1)
                np.add.at(edge, first + length, -1)
                kept = np.cumsum(edge)[:-1] == 0
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(w.rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (first - w.bounds[doc], length, period)],
                                               ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first_row, w.rows), pa.array(np.diff(w.bounds), pa.int64()), runs,
                     pa.array(np.diff(np.append(0, np.cumsum(~kept))[w.bounds]), pa.int64()), joined(w, kept)],
                    names=[key, "n_words", "runs", "n_dropped", "collapsed"])

    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS),
                           T.StructField("n_dropped", T.LongType()), T.StructField("collapsed", T.StringType())])
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), schema)


def joined(w, kept: np.ndarray) -> pa.Array:
    """Each document's kept words, joined by one space."""
    which = np.flatnonzero(kept)
    size = w.end[which] - w.start[which]
    doc = np.searchsorted(w.bounds, which, "right") - 1
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    room = size + ~last                                  # a space after each word but a document's last
    out = np.full(int(room.sum()), 0x20, np.uint8)
    begin = np.cumsum(room) - room
    out[ragged(begin, size)] = w.data[ragged(w.start[which], size)]
    offsets = np.zeros(w.rows + 1, np.int64)
    offsets[1:] = np.cumsum(np.bincount(doc, room, w.rows)) if len(doc) else 0
    return pa.LargeStringArray.from_buffers(w.rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
