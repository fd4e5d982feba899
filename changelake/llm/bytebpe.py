"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

1. Documents are cut into blocks of bounded bytes. A block's pre-tokens are numbered by frequency; the
   positions of a document are its sequence of these numbers. A block sends each *distinct* pre-token
   once, grouped by hash bucket, and keeps its number sequences in one packed row.
2. A bucket gets every block's words of that hash, encodes each distinct word once, and sends the ids
   back to the blocks that asked.
3. A block joins the ids to its numbers and puts every document together again by position.
Decoding joins ids to the token-byte table (the vocabulary, whose size is fixed by its file).

The blocks are written to the shared folder once, as a table bucketed by block: the words' way to their
hash and back is the only shuffle, the numbers stay where they were written. A lost executor makes Spark
recompute tasks from that table and never renumber a block. Words are distinct
within a block before they are shuffled, so a word that every document has costs one entry a block.

Defined results. Null text is empty: no ids, zero tokens, empty bytes. Rows are independent; repeated
rows and null or repeated ids give one result row each. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm import bpe
from changelake.llm.pretoken import split_texts, sums
from changelake.llm.text import ragged, slices, tidy
from changelake.session import estimated_bytes, shared_dir

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^32, byte plane by byte plane, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u4").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    size = np.array(list(map(len, words)), np.int64)
    head = pack(size)
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unpack(blob[4:cut])).tolist()
    data = zstandard.ZstdDecompressor().decompress(blob[cut:])
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


_BLOCKS = ("block long, bucket int, rows binary, n_rows int, words_per_row binary, codes binary, "
           "bucket_of_code binary, words binary")
_IDS = "block long, bucket int, count binary, ids binary"


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _to_blocks(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, BLOCK_BYTES):
            column = pc.fill_null(batch.column(1), "")
            for first, _, offsets in slices(column, BLOCK_BYTES):
                n = len(offsets) - 1
                block = (task << 32) | number
                number += 1
                codes, unique, count, _ = split_texts(column.slice(first, n).to_pylist(), pattern)
                # the most frequent word gets number 0: small numbers pack well
                order = np.argsort(-np.bincount(codes, minlength=len(unique)), kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                ranked = [unique[i] for i in order]
                home = np.fromiter((zlib.crc32(w) % buckets for w in ranked), np.int64, len(ranked))
                keys = pa.RecordBatch.from_arrays([batch.column(0).slice(first, n)], ["key"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, keys.schema) as out:
                    out.write_batch(keys)
                rows = [(block, -1, sink.getvalue().to_pybytes(), n, pack(count), pack(place[codes]),
                         pack(home), None)]
                by_home = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[by_home])) + 1
                for group in np.split(by_home, cuts) if len(by_home) else []:
                    rows.append((block, int(home[group[0]]), None, None, None, None, None,
                                 pack_words([ranked[i] for i in group])))
                schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("rows", pa.binary()),
                                    ("n_rows", pa.int32()), ("words_per_row", pa.binary()),
                                    ("codes", pa.binary()), ("bucket_of_code", pa.binary()),
                                    ("words", pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return run


def _encode_bucket(vocabulary: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        merges, _ = bpe.load_ranks(vocabulary)
        lists = [unpack_words(w) for w in pdf["words"]]
        codes, unique = pd.factorize(np.array([w for ws in lists for w in ws], dtype=object))
        ids, bounds = merges.encode(list(unique))
        out, done = [], 0
        for block, bucket, ws in zip(pdf["block"], pdf["bucket"], lists):
            mine = codes[done:done + len(ws)]
            done += len(ws)
            n = bounds[mine + 1] - bounds[mine]
            out.append((block, bucket, pack(n), pack(ids[ragged(bounds[mine], n)])))
        return pd.DataFrame(out, columns=["block", "bucket", "count", "ids"])
    return run


def _assemble(key: str):
    def run(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for b in blocks.itertuples():
            home = unpack(b.bucket_of_code)
            count, first, pieces, at = np.zeros(len(home), np.int64), np.zeros(len(home), np.int64), [], 0
            for w in words.itertuples():
                mine, n, ids = np.flatnonzero(home == w.bucket), unpack(w.count), unpack(w.ids)
                count[mine], first[mine] = n, at + np.cumsum(n) - n
                pieces.append(ids)
                at += len(ids)
            table = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
            codes = unpack(b.codes)
            n_words = unpack(b.words_per_row)[:b.n_rows]
            ids = table[ragged(first[codes], count[codes])].astype("<u4")
            per_row = sums(count[codes], n_words)
            ends = np.cumsum(per_row)
            keys = pa.ipc.open_stream(b.rows).read_all().column(0).to_pandas()
            parts.append(pd.DataFrame({key: keys, "n_tokens": per_row, "ids": [
                ids[e - n:e].tobytes() for e, n in zip(ends, per_row)]}))
        if not parts:
            return pd.DataFrame({key: [], "n_tokens": [], "ids": []})
        return pd.concat(parts, ignore_index=True)
    return run


def materialise_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The frame as a table in the shared folder that is bucketed by ``key``: later groupings by the key
    need no shuffle of it."""
    name = f"bpe_{uuid.uuid4().hex}"
    folder = shared_dir(df.sparkSession, "bpe-blocks")
    df.write.bucketBy(buckets, key).format("parquet").option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_tokens, ids (little-endian unsigned 32-bit integers). ``vocabulary``: a rank
    file, readable at that path on every executor."""
    spark = docs.sparkSession
    size = estimated_bytes(docs)
    buckets = -(-size // BUCKET_BYTES) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(65536, max(12, buckets))       # of unknown size: as many as the session shuffles to
    made = materialise_by(docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(
        tidy(_to_blocks(pattern, int(buckets))), _BLOCKS), "block", int(buckets))
    blocks = made.where("bucket < 0").drop("words", "bucket")
    words = made.where("bucket >= 0").select("block", "bucket", "words")
    ids = words.groupBy("bucket").applyInPandas(_encode_bucket(vocabulary), _IDS)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(_assemble(key), schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the bytes that its ids stand for; null ids give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = bpe.load_ranks(vocabulary)
        size = np.array(list(map(len, table)), np.int64)
        begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            made = []
            for blob in batch.column(batch.schema.get_field_index(ids)).to_pylist():
                if blob is None:
                    made.append(None)
                    continue
                x = np.frombuffer(blob, "<u4")
                made.append(b"".join(
                    data[ragged(begin[y], size[y])].tobytes()
                    for y in (x[i:i + 262144] for i in range(0, len(x), 262144))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())],
                                             names=[*batch.schema.names, out])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))
