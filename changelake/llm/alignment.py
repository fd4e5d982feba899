"""Cross-tokenizer alignment on anchors at white space.

Vocabulary A is a byte-level BPE (tokenizers file), B a sentencepiece BPE model. Both encode a space and the
text.

1. Tokens. Where a space follows another character that is no white space, neither vocabulary has a token
   across: A's pattern starts a pre-token there, and no piece of B has a space after another character (which
   is checked). What lies between two such places is encoded once a slice, by both.
2. Anchors. The joined bytes of each such stretch are compared with its text on both sides. If they are equal,
   tokens of A and B end together before a token that begins with a space in A and is marked with one in B: a
   verified shared end. Anchors cut a document into windows of token ids.
3. Windows are aligned once and remembered by their two id tuples. The ends of both sides on one axis give
   the links (each stretch between neighbouring ends lies in one token of A and one of B) and the groups
   (shared ends). A worker remembers a bounded number of windows; results do not depend on it.
4. Counts. A task sums up the documents that hold a linked pair over a block of documents (an Arrow batch of bounded bytes), so a
   pair that all documents hold sends one row a block to the count. The counts come back to the blocks in
   the same way, and a document finds its pairs by number within its block: documents are sent once, with
   small numbers, and never joined by a pair.

Defined results. Null and empty texts, and texts whose joined bytes of A or B differ from a space and the text
(those with U+2581, which B takes for a space), have no tokens: zeros and the digest ''. Rows are
independent documents, so repeated rows and null or repeated ids count as often as they are written. Special
tokens' strings inside texts are plain text. Other columns are not read. A document longer than a slice is a
slice of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm import bpe
from changelake.llm.pretoken import split_texts, sums
from changelake.llm.store import materialise
from changelake.llm.text import ragged, slices, tidy

# A space and what follows up to the next space that has no white space before it.
CHUNK = re.compile(r" +[^ ]*+(?:(?<=\s) +[^ ]*+)*+")
BLOCK_BYTES = 4 << 20
PIECE_CHARS = 1 << 20
MEMO = 100_000                 # windows of a generation; two are held
SHIFT = 32                     # a pair is id of A << SHIFT | id of B


def chunks_of(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, distinct chunks, chunks a text) of texts that begin with a space; codes number the chunks."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    parts = [np.fromiter(map(number.__getitem__, CHUNK.findall(t)), np.int64) for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64), [c.encode() for c in number],
            np.fromiter(map(len, parts), np.int64, len(parts)))


def flat_table(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first byte, bytes) of the entries of a vocabulary."""
    size = np.array(list(map(len, table)), np.int64)
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)


class ByteTokens:
    """Vocabulary A."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        self.merges, _ = bpe.load_merges(path)
        self.size, self.begin, self.data = flat_table(bpe.load_token_bytes(path))

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of chunks."""
        codes, unique, count, _ = split_texts([c.decode() for c in chunks], self.pattern, piece_chars=PIECE_CHARS)
        ids, bounds = self.merges.encode(unique)
        size = np.diff(bounds)[codes]
        return ids[ragged(bounds[codes], size)], np.append(0, np.cumsum(sums(size, count)))


class PieceTokens:
    """Vocabulary B."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the vocabulary has pieces across spaces")
        table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in enumerate(pieces)]
        self.size, self.begin, self.data = flat_table(table)
        self.space = self.model.piece_to_id("▁")

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the model puts the first space of a chunk there by itself, but for an empty text
        ids = [x or [self.space] for x in self.model.encode([c[1:].decode() for c in chunks], num_threads=1)]
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(bounds[-1])), bounds


@lru_cache(maxsize=2)
def _sides(path_a: str, pattern: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(path_a, pattern), PieceTokens(path_b)


def faithful(vocabulary, chunks: list[bytes], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which chunks are the joined bytes of their tokens."""
    n_bytes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    n_ids, size = np.diff(bounds), vocabulary.size
    same = sums(size[ids], n_ids) == n_bytes
    ids = ids[np.repeat(same, n_ids)]
    joined = vocabulary.data[ragged(vocabulary.begin[ids], size[ids])]
    own = np.frombuffer(b"".join(chunks), np.uint8)[np.repeat(same, n_bytes)]
    same[same] = sums(joined != own, n_bytes[same]) == 0
    return same


def align(a: np.ndarray, bounds_a: np.ndarray, b: np.ndarray, bounds_b: np.ndarray,
          size_a: np.ndarray, size_b: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
    """Per window: the groups as text, their number, the linked pairs in order."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.union1d(end_a, end_b)
    in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    pairs = a[in_a] << SHIFT | b[in_b]
    shared = np.flatnonzero((end_a[in_a] == ends) & (end_b[in_b] == ends))
    last_a, last_b = in_a[shared] + 1, in_b[shared] + 1          # end of each group on both sides
    group_of = np.searchsorted(last_a, bounds_a, "right")         # windows end with a shared end
    link_of = np.searchsorted(in_a, bounds_a)
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups = [text_a[j - 1] + "|" + text_b[m - 1] if j - i == 1 == m - k else
              ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in zip(
        [0, *last_a[:-1].tolist()], last_a.tolist(), [0, *last_b[:-1].tolist()], last_b.tolist())]
    raw = pairs.astype(np.int64).tobytes()
    return [(";".join(groups[g:h]), h - g, raw[8 * i:8 * j]) for g, h, i, j in zip(
        group_of[:-1].tolist(), group_of[1:].tolist(), link_of[:-1].tolist(), link_of[1:].tolist())]


Aligned = tuple[str, int, bytes]
Key = tuple[bytes, bytes]


class Recent:
    """A bounded memory of two generations of at most MEMO entries each: what is asked for again moves to the
    younger one, and the older one is dropped when that is full."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def find(self, keys: list) -> list:
        """What is remembered under each key, else None."""
        young, old = self.young, self.old
        return [young.get(k) or old.get(k) for k in keys]

    def keep(self, keys: list, values: list) -> None:
        for k, x in zip(keys, values):
            if k not in self.young:
                if len(self.young) >= MEMO:
                    self.young, self.old = {}, self.young
                self.young[k] = x


_ALIGNED = Recent()            # id tuples of a window -> its alignment
_TOKENS = Recent()             # text of a chunk -> its id tuples


def tokens_of(chunks: list[bytes], vocabulary_a: ByteTokens, vocabulary_b: PieceTokens) -> list[Key]:
    """The id tuples of each chunk in both vocabularies; empty ones if its joined tokens are not its text."""
    known = _TOKENS.find(chunks)
    new = [i for i, x in enumerate(known) if x is None]
    if new:
        fresh = [chunks[i] for i in new]
        sides, good = [], np.ones(len(new), bool)
        for vocabulary in (vocabulary_a, vocabulary_b):
            ids, bounds = vocabulary.encode(fresh)
            good &= faithful(vocabulary, fresh, ids, bounds)
            raw, cut = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            sides.append([raw[i:j] for i, j in zip(cut, cut[1:])])
        for i, key, ok in zip(new, zip(*sides), good.tolist()):
            known[i] = key if ok else (b"", b"")
    _TOKENS.keep(chunks, known)
    return known


def aligned_windows(keys: list[Key], size_a: np.ndarray, size_b: np.ndarray) -> list[Aligned]:
    """The alignment of each window; windows that are not remembered are aligned together."""
    known = _ALIGNED.find(keys)
    new = [i for i, x in enumerate(known) if x is None]
    if new:
        sides = []
        for side in (0, 1):
            parts = [keys[i][side] for i in new]
            sides += [np.frombuffer(b"".join(parts), "<u4").astype(np.int64),
                      np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))]
        for i, x in zip(new, align(*sides, size_a, size_b)):
            known[i] = x
    _ALIGNED.keep(keys, known)
    return known


_ROWS = pa.schema([("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("n_links", pa.int64()), ("groups", pa.string()), ("numbers", pa.list_(pa.int32())),
                   ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32()))])


def aligned_block(texts: list, vocabulary_a: ByteTokens, vocabulary_b: PieceTokens, digest: bool) -> tuple[dict, dict]:
    """Columns of the documents, and of the block: its pairs and the number of documents that hold each."""
    n = len(texts)
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    codes, chunks, per_doc = chunks_of([" " + texts[i] for i in some])
    keys = tokens_of(chunks, vocabulary_a, vocabulary_b)
    odd = np.fromiter((not k[0] for k in keys), bool, len(keys))
    good = sums(odd[codes], per_doc) == 0
    codes, some, per_doc = codes[np.repeat(good, per_doc)], some[good], per_doc[good]
    columns = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    texts_out, numbers, times, bounds = [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    pairs, n_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(some):
        used, which = np.unique(codes, return_inverse=True)       # windows of documents that have tokens
        keys = [keys[i] for i in used.tolist()]
        known = aligned_windows(keys, vocabulary_a.size, vocabulary_b.size)
        names, groups, raw = zip(*known)
        length = lambda parts, width: np.fromiter(map(len, parts), np.int64, len(known)) // width
        n_pairs = length(raw, 8)
        pairs, flat = np.unique(np.frombuffer(b"".join(raw), np.int64), return_inverse=True)
        first = np.cumsum(n_pairs) - n_pairs
        for column, values in (("n_a", length([k[0] for k in keys], 4)), ("n_b", length([k[1] for k in keys], 4)),
                               ("n_groups", np.array(groups, np.int64)), ("n_links", n_pairs)):
            columns[column][some] = sums(values[which], per_doc)
        held = flat[ragged(first[which], n_pairs[which])] + len(pairs) * np.repeat(np.repeat(some, per_doc), n_pairs[which])
        held, times = np.unique(held, return_counts=True)
        doc, numbers = held // len(pairs), held % len(pairs)
        bounds = np.searchsorted(doc, np.arange(n + 1))
        n_docs = np.bincount(numbers, minlength=len(pairs))
        ends = np.cumsum(per_doc).tolist()
        for i, lo, hi in zip(some.tolist(), [0, *ends[:-1]], ends):
            text = ";".join([names[k] for k in which[lo:hi].tolist()])
            texts_out[i] = hashlib.sha256(text.encode()).hexdigest() if digest else text
    return columns | {"groups": texts_out, "numbers": (bounds, numbers), "times": (bounds, times)}, {
        "pairs": pairs, "n_docs": n_docs}


def _to_blocks(key: str, vocabulary_a: str, pattern: str, vocabulary_b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = _sides(vocabulary_a, pattern, vocabulary_b)
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for first, _, offsets in slices(column, BLOCK_BYTES):
                n = len(offsets) - 1
                block = task << 32 | number
                number += 1
                docs, pairs = aligned_block(column.slice(first, n).to_pylist(), side_a, side_b, digest)
                key_type = batch.schema.field(0).type

                def ints(pair):
                    return pa.ListArray.from_arrays(pa.array(pair[0], pa.int32()), pa.array(pair[1], pa.int32()))

                rows = [batch.column(0).slice(first, n), pa.array(np.full(n, block)),
                        *[pa.array(docs[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(docs["groups"], pa.string()),
                        ints(docs["numbers"]), ints(docs["times"]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(rows, names=[key, *_ROWS.names])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, key_type), pa.array([block], pa.int64()), *[pa.nulls(1, t) for t in _ROWS.types[1:-2]],
                     pa.array([pairs["pairs"]], pa.list_(pa.int64())), pa.array([pairs["n_docs"]], pa.list_(pa.int32()))],
                    names=[key, *_ROWS.names])
    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each linked pair; whether no pair of its id of A has more."""
    n = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.n_docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", SHIFT))        # at most the size of vocabulary B
    return n.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _judge(key: str):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        place = counts["number"].to_numpy()
        n[place], best[place] = counts["n"].to_numpy(), counts["best"].to_numpy()

        def flat(name: str) -> np.ndarray:
            return docs[name].combine_chunks().flatten().to_numpy().astype(np.int64)

        size = pc.list_value_length(docs["numbers"]).to_numpy()
        number, times = flat("numbers"), flat("times")
        return pa.table({key: docs[key], "n_a": docs["n_a"], "n_b": docs["n_b"], "n_groups": docs["n_groups"],
                         "n_links": docs["n_links"], "n_best": sums(best[number] * times, size),
                         "count_sum": sums(n[number] * times, size), "groups": docs["groups"]})
    return run


def align_documents(docs: DataFrame, vocabulary_a: str, pattern: str, vocabulary_b: str, digest: bool = False,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups ("a1,a2|b1;a3|b2,b3", or
    its SHA-256 if ``digest``: the text is several times as long as the document's). Vocabularies are read by
    path on the executors."""
    columns = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in (
        "block", "n_a", "n_b", "n_groups", "n_links")], T.StructField("groups", T.StringType()),
        T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("n_docs", T.ArrayType(T.IntegerType()))])
    made = materialise(docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(
        tidy(_to_blocks(key, vocabulary_a, pattern, vocabulary_b, digest)), columns), "aligned-blocks")
    blocks = made.where("pairs IS NOT NULL").select("block", "pairs", "n_docs")
    rows = made.where("pairs IS NULL").drop("pairs", "n_docs")
    known = materialise(pair_counts(blocks), "pair-counts")
    back = blocks.select(F.col("block").alias("asked_by"), F.posexplode("pairs").alias("number", "pair")).join(known, "pair").select(
        "asked_by", "number", "n", "best")
    schema = T.StructType([columns[key], *[T.StructField(c, T.LongType()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups", T.StringType())])
    return rows.groupBy("block").cogroup(back.groupBy("asked_by")).applyInArrow(_judge(key), schema)
