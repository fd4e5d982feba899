"""Benchmark decontamination with an FM-index per training shard.

The benchmark's phrases (windows of ``size`` consecutive words; an item of fewer is one phrase) are
searched in every training document. A task cuts its documents into shards of bounded bytes and maps
words to symbols: words of the benchmark keep one each, runs of other words become one separator (no
phrase holds them). It builds the shard's FM-index, searches all phrases backwards by wavelet ranks,
locates the occurrences by sampled suffix positions and merges the spans to remove. Documents are
never shuffled.

The phrases go to the tasks in blocks of at most ``BLOCK_WORDS`` words, so what a task holds is bounded
however large the benchmark is; each block is one pass over the documents, and the passes' results are
united per row. Words are compared as 64-bit hashes.

Defined results. Null or empty texts (either side) have no words and no phrases. Rows are independent:
repeated rows and null or repeated doc_ids give one result row each. Repeated items count once per
item_id; null item_ids are searched and count as hits but are not listed. An empty benchmark leaves
everything clean. Other columns pass through unless they have the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm.fmindex import FMIndex
from changelake.llm.text import Words, ragged, tidy, words
from changelake.session import shared_dir

PHRASE = 10
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 1 << 20
RESULT = ("n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first:int,last:int>>, "
          "cleaned string")
_RESULT = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("cleaned", pa.string())])


class Phrases:
    """A block of phrases as symbol rows, with the items that hold them."""

    def __init__(self, ids: list, hashes: list[np.ndarray], size: int):
        self.words = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        rows, lengths, items = [], [], []
        for item, h in zip(ids, hashes):
            symbols = np.searchsorted(self.words, h) + 1
            k = min(size, len(h))
            for i in range(len(h) - k + 1):
                rows.append(np.pad(symbols[i:i + k], (0, size - k)))
                lengths.append(k)
                items.append(item)
        matrix = np.array(rows, np.int64).reshape(-1, size)
        self.rows, back = np.unique(matrix, axis=0, return_inverse=True) if rows else (matrix, np.zeros(0, int))
        self.lengths = (self.rows > 0).sum(axis=1)
        holder = pd.DataFrame({"phrase": np.ravel(back), "item": pd.array(items, dtype="string")}).drop_duplicates()
        holder = holder.sort_values("phrase", kind="stable")
        self.items = holder["item"].to_numpy(dtype=object, na_value=None)
        self.bounds = np.searchsorted(holder["phrase"].to_numpy(), np.arange(len(self.rows) + 1))

    @property
    def symbols(self) -> int:
        return len(self.words) + 1


def phrase_blocks(benchmark: DataFrame, size: int, text: str, key: str) -> Iterator[Phrases]:
    """The benchmark, streamed to the driver partition by partition and cut into bounded blocks."""
    ids, hashes, held = [], [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(
        F.col(key).cast("string"), F.col(text).cast("string"))
    for item, body in rows.toLocalIterator():
        for w in words(pa.array([body]), "alnum", True):
            if len(w.hash):
                # items longer than a block are cut so that every window is in one piece
                step = max(1, BLOCK_WORDS - size)
                for at in range(0, max(1, len(w.hash) - size + 1), step):
                    piece = w.hash[at:at + step + size - 1]
                    ids.append(item)
                    hashes.append(piece)
                    held += len(piece)
                    if held >= BLOCK_WORDS:
                        yield Phrases(ids, hashes, size)
                        ids, hashes, held = [], [], 0
    if ids:
        yield Phrases(ids, hashes, size)


def shard_symbols(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each symbol): benchmark words, and one separator for each run of others and
    at the start of every document."""
    place = np.searchsorted(phrases.words, w.hash)
    known = phrases.words[np.minimum(place, len(phrases.words) - 1)] == w.hash
    symbol = np.where(known, place + 1, 0)
    fresh = np.zeros(len(symbol), bool)
    fresh[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    keep = known.copy()
    keep[1:] |= ~known[1:] & known[:-1]
    # a document that starts with a known word gets a separator of its own before it
    head = np.flatnonzero(fresh & known)
    word = np.flatnonzero(keep)
    symbol = symbol[word]
    where = np.searchsorted(word, head)
    return np.insert(symbol, where, 0), np.insert(word, where, -1)


def find(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE, text: str = "text",
         item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with n_words, n_hit (words inside a phrase), n_items, items (their ids, sorted as
    strings), spans (merged word ranges, last included) and cleaned (the text without those spans)."""
    names = [c for c in docs.columns if c not in {"n_words", "n_hit", "n_items", "items", "spans", "cleaned"}]
    result = T.StructType.fromDDL(RESULT)
    schema = T.StructType([*[docs.schema[c] for c in names], *result.fields])
    found = docs.select(*[F.col(f"`{c}`") for c in names])
    any_block = False
    for phrases in phrase_blocks(benchmark, size, item_text, item):
        if any_block:
            # next block: the words that are already hit travel along as spans
            folder = shared_dir(docs.sparkSession, "phrases")
            found.write.parquet(folder)
            found = docs.sparkSession.read.schema(found.schema).parquet(folder)
        found = found.mapInArrow(tidy(_search(phrases, text, len(names), any_block)), schema)
        any_block = True
    if not any_block:
        found = found.mapInArrow(_search(Phrases([], [], size), text, len(names), False), schema)
    return found


def _search(phrases: Phrases, text: str, n_names: int, seen_before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            earlier_items = batch.column(n_names + 3).to_pylist() if seen_before else None
            earlier_spans = batch.column(n_names + 4).to_pylist() if seen_before else None
            for w in words(column.cast(pa.large_string()), "alnum", True, SHARD_BYTES):
                hit, doc_items = search_shard(w, phrases)
                out = []
                for d in range(w.rows):
                    row, mine = hit[w.bounds[d]:w.bounds[d + 1]], set(doc_items.get(d, ()))
                    if seen_before:
                        mine |= set(earlier_items[w.first_row + d])
                        for s in earlier_spans[w.first_row + d]:
                            row[s["first"]:s["last"] + 1] = True
                    out.append(_row(w, d, row, mine, column[w.first_row + d].is_valid))
                result = pa.RecordBatch.from_pylist(out, _RESULT)
                kept = batch.slice(w.first_row, w.rows)
                yield pa.RecordBatch.from_arrays([*kept.columns[:n_names], *result.columns],
                                                 names=[*batch.schema.names[:n_names], *result.schema.names])
    return run


def search_shard(w: Words, phrases: Phrases) -> tuple[np.ndarray, dict[int, list]]:
    """(which words are hit, items found per document) of one shard."""
    hit = np.zeros(len(w.hash) + 1, np.int64)
    if not len(w.hash) or not len(phrases.rows):
        return hit[:-1].astype(bool), {}
    symbols, word = shard_symbols(w, phrases)
    index = FMIndex(symbols, phrases.symbols)
    lo, hi = index.count(phrases.rows, phrases.lengths)
    phrase, position = index.locate(lo, hi)
    first = word[position]
    np.add.at(hit, first, 1)
    np.add.at(hit, first + phrases.lengths[phrase], -1)
    doc = np.searchsorted(w.bounds, first, "right") - 1
    found: dict[int, list] = {}
    pairs = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.zeros((2, 0), int)
    for d, p in pairs.T:
        found.setdefault(int(d), []).extend(
            x for x in phrases.items[phrases.bounds[p]:phrases.bounds[p + 1]] if x is not None)
    return np.cumsum(hit)[:-1] > 0, found


def _row(w: Words, d: int, hit: np.ndarray, items: set, valid: bool) -> dict:
    begin, end = w.offsets[d], w.offsets[d + 1]
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    body = w.data[begin:end].tobytes()
    if len(first):
        a = w.start[w.bounds[d] + first] - begin
        b = w.end[w.bounds[d] + last] - begin
        cuts = [0, *np.stack([a, b], 1).ravel().tolist(), len(body)]
        body = b"".join(body[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2))
    return {"n_words": len(hit), "n_hit": int(hit.sum()), "n_items": len(items), "items": sorted(items),
            "spans": [{"first": int(x), "last": int(y)} for x, y in zip(first, last)],
            "cleaned": body.decode() if valid else None}
