"""SimHash near-duplicates: fingerprints compared exactly, tile by tile, with XOR and bit counts.

1. One pass over the documents gives each a 64-bit fingerprint: a bit is set if more than half of the
   hashes of its three-word shingles (repeats included) have it.
2. Equal fingerprints are one class, named by its smallest doc_id; only classes are compared.
3. A class lies in the tile of its PARTS population counts, those of 16 bits each. Fingerprints within the
   radius have counts that differ by no more than the radius in sum, so tile pairs beyond it are skipped:
   of the 17^4 tiles a class visits the 21 that are near and not before its own (of two tiles, one visits the
   other). About one pair of classes in 60 is compared.
4. A tile of more than BLOCK classes is cut into blocks by hash, and its visitors go to each block. A block
   and its visitors meet in one task, a batch of visitors at a time: XOR of all pairs, bit counts, links.
5. Links leave a task as a forest: a visitor's links to one connected part of a block are one edge.
   Connected components of these edges are those of all links.

Scale. Tiles number at most 83,521, so their table of sizes may be broadcast. The work grows with the square
of the number of distinct fingerprints, as each pair of near tiles is compared exactly, divided by some
100 and spread over tiles and blocks; the shuffle is 21 small rows a class and block visited. A hot text is one
class, a group of near copies is at most as many edges as visits.

Defined results. Words are lower-cased (A-Z) runs of [^\\x20\\x09-\\x0D]; a text with fewer than three is one
shingle; null and empty texts have the fingerprint zero, which is linked like any other. Rows without doc_id
take no part: their component is null. Rows that share a doc_id are one document with several fingerprints,
whose links it has all. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm.graph import connected_components
from changelake.llm.store import materialise
from changelake.llm.text import Words, ragged, starts_of_windows, tidy, words

SHINGLE = 3
SEED = 42
RADIUS = 2
PARTS = 4
BLOCK = 8192
PAIRS = 1 << 20                # compared at once within a task


def flat_words(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The slice's words, lower-cased, with one space after each; first byte and end of each word."""
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    data = w.data | np.where((w.data >= 65) & (w.data <= 90), 32, 0).astype(np.uint8)
    out[ragged(start, size)] = data[ragged(w.start, size)]
    return out.tobytes(), start, end


# the bits of a byte in eight lanes of a byte each
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()


def majority(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each run values[bounds[i]:bounds[i+1]] the bits that over half of its values have; 0 if it is empty."""
    count = np.diff(bounds)
    parts = -(-count // 255)                             # a lane of eight bits holds 255 values
    owner = np.repeat(np.arange(len(count)), parts)
    out = np.zeros(len(count), np.uint64)
    if not len(owner):
        return out
    begin = bounds[:-1][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    some = np.flatnonzero(count)
    edge = np.searchsorted(owner, some)
    for byte in range(8):
        lanes = _LANES[(values >> np.uint64(8 * byte)).astype(np.uint8)]
        total = np.add.reduceat(lanes, begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(total, edge, axis=0)
        bits = (2 * total > count[some][:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint(w: Words) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    data, start, end = flat_words(w)
    n = np.diff(w.bounds)
    at = starts_of_windows(w.bounds, SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    first = np.concatenate([at, w.bounds[short]])
    order = np.argsort(first, kind="stable")
    last = np.concatenate([at + SHINGLE, w.bounds[short + 1]])[order] - 1
    first = first[order]
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())),
                         np.uint64, len(first))
    return majority(values, np.searchsorted(first, w.bounds))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and the fingerprint (a long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), "space", False, hashed=False):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first_row, w.rows), pa.array(fingerprint(w).view(np.int64))],
                    names=["doc_id", "fingerprint"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), schema)


# ---- tiles ------------------------------------------------------------------------------------

def steps(radius: int) -> list[tuple[int, ...]]:
    """The differences of population counts within the radius of which the first that is not 0 is positive, and
    the one without any: of two tiles, one visits the other."""
    near = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return [s for s in near if s >= (0,) * PARTS]


def counts(fp: Column) -> list[Column]:
    """Population counts of the parts of a fingerprint."""
    width = 64 // PARTS
    return [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(PARTS)]


def tile_of(parts: list[Column]) -> Column:
    """One number for a tile. Counts are shifted by the radius: a step never leaves its digit."""
    base = 64 // PARTS + 2 * RADIUS + 1
    return sum((p + RADIUS) * base ** k for k, p in enumerate(parts)).cast("int")


def visits(classes: DataFrame) -> DataFrame:
    """(tile, block, home, doc_id, fingerprint): each class once at home, and with each block that it visits."""
    at_home = classes.select("doc_id", "fingerprint", tile_of(counts(F.col("fingerprint"))).alias("tile"))
    blocks = materialise(at_home.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "tiles")
    base = 64 // PARTS + 2 * RADIUS + 1
    offsets = [sum(s * base ** k for k, s in enumerate(step)) for step in steps(RADIUS)]
    near = at_home.select("doc_id", "fingerprint", F.explode(F.array(*map(F.lit, offsets))).alias("step"), "tile").select(
        "doc_id", "fingerprint", (F.col("tile") + F.col("step")).alias("tile"))
    size = F.broadcast(blocks)                           # at most 17^4 rows
    visitors = near.join(size, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("home"),
        "doc_id", "fingerprint")
    residents = at_home.join(size, "tile").select(
        "tile", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("home"),
        "doc_id", "fingerprint")
    return residents.union(visitors)


def block_links(home_id: list, home: np.ndarray, label: np.ndarray, guest_id: list, guest: np.ndarray, radius: int):
    """Edges (a, b) of a spanning forest of the links between guests and residents. ``label``: the connected
    part of each resident so far, changed in place."""
    step = max(1, PAIRS // max(1, len(home)))
    for lo in range(0, len(guest), step):
        row, col = np.nonzero(np.bitwise_count(guest[lo:lo + step, None] ^ home[None, :]) <= radius)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for g, mine in zip(row[np.append(0, cuts)] if len(row) else (), np.split(col, cuts)):
            own, part = guest_id[lo + g], np.unique(label[mine])
            for p in part.tolist():
                if own != home_id[p]:
                    yield own, home_id[p]
            if len(part) > 1:
                label[np.isin(label, part[1:])] = part[0]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the classes (doc_id, fingerprint) exactly as all links do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home_id, home, label = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            tile, block, at_home, ids, fp = batch.columns
            place = tile.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | block.to_numpy(zero_copy_only=False)
            at_home = at_home.to_numpy(zero_copy_only=False)
            fp, ids = fp.to_numpy(zero_copy_only=False).view(np.uint64), ids.to_pylist()
            edges: list[tuple] = []
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if place[lo] != now:
                    now, home_id, home = place[lo], [], np.zeros(0, np.uint64)
                cut = lo + int(at_home[lo:hi].sum())     # residents come first
                if cut > lo:
                    home_id, home = home_id + ids[lo:cut], np.append(home, fp[lo:cut])
                    label = np.arange(len(home))
                if len(home) and cut < hi:
                    edges += block_links(home_id, home, label, ids[cut:hi], fp[cut:hi], radius)
            if edges:
                a, b = zip(*edges)
                kind = batch.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    placed = visits(classes)
    kind = classes.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return placed.repartition("tile", "block").sortWithinPartitions("tile", "block", F.desc("home")).mapInArrow(
        tidy(run), schema)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, fingerprint (a long), class_id (smallest doc_id with this fingerprint), component_id
    (smallest doc_id reachable)."""
    seen = materialise(fingerprints(docs, text, key), "fingerprints")
    known = seen.where(F.col("doc_id").isNotNull())
    classes = materialise(known.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "fingerprint-classes")
    # a doc_id with several rows connects the classes of its fingerprints
    several = known.groupBy("doc_id").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).where("lo < hi")
    shared = known.join(several.select("doc_id"), "doc_id").join(
        classes.withColumnRenamed("doc_id", "class_id"), "fingerprint").select(
        F.col("class_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    edges = materialise(links(classes).union(shared), "fingerprint-links")
    component = materialise(connected_components(edges), "fingerprint-components")
    placed = classes.join(component, classes["doc_id"] == component["node"], "left").select(
        F.col("fingerprint").alias("_fp"), F.col("doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"))
    out = seen.join(placed, seen["fingerprint"] == placed["_fp"], "left")
    held = F.col("doc_id").isNotNull()
    return out.select(F.col("doc_id").alias(key), "fingerprint", F.when(held, F.col("class_id")).alias("class_id"),
                      F.when(held, F.col("component_id")).alias("component_id"))
