"""MinHash near-duplicates with odd sketches.

1. One pass over the documents gives each the size of its shingle set, a 128-bit fingerprint of the set,
   MinHash samples of which BANDS x ROWS are folded into band hashes, and an odd sketch: a bitmap in which
   each sample flips one bit. The pass's result is the only table that all later steps read; text is not shuffled.
2. Documents with equal sets are one class and go on as its smallest doc_id.
3. Classes that share a band hash are candidates. They are compared in rounds: the smallest member of
   each band group (the hub) with those that are not yet in its component; after HUB_ROUNDS rounds the
   rest, which is small, with all members of other components. A group of near copies is connected by
   its first hub, so its pairs are never listed.
4. A pair is dropped if its set sizes forbid the similarity, or if the population count of the XOR of
   the sketches puts it more than 0.11 below the threshold (a chance of 1.4e-7 to lose a pair at 0.75); the
   others are confirmed on full shingle sets, which are computed for these documents alone.
5. Components of the confirmed links.

A pair at similarity 0.75 exactly shares no band with probability (1 - 0.75^6)^50 = 5.6e-5, at 0.8 with
probability 2.6e-7. Shingles and words are compared as 64-bit hashes.

Defined results. Words are lower-cased (A-Z) runs of [^\\x20\\x09-\\x0D]; a text with fewer than five words
is one shingle; null and empty texts have no shingle, are linked with nothing and are kept. Rows without
doc_id take no part: their component is null and they are kept. Rows that share a doc_id count as one
document as often as they are written. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.llm.graph import connected_components
from changelake.llm.store import materialise, only_ids
from changelake.llm.text import Words, mix, span_hash, starts_of_windows, tidy, window_hash, words

SHINGLE = 5
BANDS, ROWS = 50, 6
SAMPLES = 600
SKETCH_BITS = 2048
THRESHOLD = 75                # per cent
SLACK = 0.11
HUB_ROUNDS = 2


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, document by document and sorted; bounds per document)."""
    at = starts_of_windows(w.bounds, k)
    whole = np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < k))
    value = np.concatenate([window_hash(w.hash, k)[at] if len(at) else np.zeros(0, np.uint64),
                            span_hash(w.hash, w.bounds[whole], w.bounds[whole + 1])])
    doc = np.concatenate([np.searchsorted(w.bounds, at, "right") - 1, whole])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(w.rows + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, odd sketches) of documents with at least one shingle."""
    begin, n = bounds[:-1], len(bounds) - 1
    # multiply-add permutations of the upper half of each hash; the multipliers are odd
    rng = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
    times, plus = (rng[:SAMPLES] | np.uint64(1)).astype(np.uint32), rng[SAMPLES:].astype(np.uint32)
    x = (value >> np.uint64(32)).astype(np.uint32)
    least = np.empty((SAMPLES, n), np.uint32)
    with np.errstate(over="ignore"):
        buffer = np.empty_like(x)
        for i in range(SAMPLES):
            np.multiply(x, times[i], out=buffer)
            buffer += plus[i]
            least[i] = np.minimum.reduceat(buffer, begin)
        wide = mix(least.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[:, None])
        bands = mix(wide[:BANDS * ROWS].reshape(BANDS, ROWS, n).sum(axis=1, dtype=np.uint64)
                    + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    row = np.arange(n)
    for sample in wide:
        bits[row, (sample >> np.uint64(40)) % np.uint64(SKETCH_BITS)] ^= 1
    return np.ascontiguousarray(bands.T), np.packbits(bits, axis=1).view(np.uint64)


def _lists(values: np.ndarray) -> pa.Array:
    """A list array from a matrix."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()),
                                    pa.array(values.reshape(-1).view(np.int64)))


def describe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, s1, s2 (fingerprint of the set), bands, sketch; the last two are null for
    documents without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), "space", True):
                value, bounds = shingles(w)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                edge = np.append(bounds[some], len(value))
                s1, s2 = np.zeros(w.rows, np.uint64), np.zeros(w.rows, np.uint64)
                bands, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.uint64)
                if len(some):
                    s1[some] = np.add.reduceat(value, edge[:-1])
                    s2[some] = np.bitwise_xor.reduceat(mix(value), edge[:-1])
                    bands, sketch = signatures(value, edge)
                take = pa.array(np.cumsum(n > 0) - 1, pa.int64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first_row, w.rows), pa.array(n, pa.int64()),
                     pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     _lists(bands).take(take), _lists(sketch).take(take)],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the distinct shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), "space", True):
                value, bounds = shingles(w)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first_row, w.rows),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64)))],
                    names=["doc_id", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, shingles array<long>")


def sketches_near(x: Column, y: Column) -> Column:
    """Whether two odd sketches put the similarity, 1 + n / 4k * ln(1 - 2z / n) for z differing bits, at
    the threshold less SLACK or above. Written out word by word, it stays in generated code."""
    n, k = SKETCH_BITS, SAMPLES
    most = n / 2 * (1 - math.exp(4 * k / n * (THRESHOLD / 100 - SLACK - 1)))
    differing = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(n // 64)]
    return reduce(lambda p, q: p + q, differing) <= int(most)


def may_be_near(a: str, b: str) -> Column:
    """False for pairs that set sizes or sketches put well below the threshold."""
    x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (F.least(x, y) * 100 >= F.greatest(x, y) * THRESHOLD) & sketches_near(
        F.col(f"sketch_{a}"), F.col(f"sketch_{b}"))


def enough(a: str, b: str) -> Column:
    """Whether the full sets are similar enough."""
    shared = F.size(F.array_intersect(f"set_{a}", f"set_{b}"))
    return shared * 100 >= (F.col(f"n_{a}") + F.col(f"n_{b}") - shared) * THRESHOLD


def sets_of(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, shingles) of these documents, once each."""
    ids = materialise(ids.distinct(), "near-ids")
    sets = shingle_sets(only_ids(docs.select(key, text), key, ids), text, key)
    return materialise(sets.dropDuplicates(["doc_id"]), "shingle-sets")


def links_left(placed: DataFrame, known: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Links (a, b) between band partners in different components, each found in the first band that both
    share. All is decided inside the join, cheapest test first, so that only links come out of it."""
    sets = sets_of(docs, placed.select("doc_id"), text, key)
    wide = placed.select("band", "nth", "doc_id", "component").join(known.join(sets, "doc_id"), "doc_id")
    x, y = (wide.select("band", "nth", *[F.col(c).alias(f"{n}_{s}") for c, n in (
        ("component", "component"), ("n_shingles", "n"), ("sketch", "sketch"), ("bands", "bands"), ("shingles", "set"))],
        F.col("doc_id").alias(s)) for s in ("a", "b"))
    first = F.coalesce(*[F.when(F.get("bands_a", F.lit(i)) == F.get("bands_b", F.lit(i)), i) for i in range(BANDS)])
    return x.join(y.withColumnRenamed("band", "band_b").drop("nth"), (F.col("band") == F.col("band_b"))
                  & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
                  & may_be_near("a", "b") & (first == F.col("nth")) & enough("a", "b")).select("a", "b")


def confirm(pairs: DataFrame, known: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def side(name: str) -> DataFrame:
        return known.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                            F.col("sketch").alias(f"sketch_{name}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(may_be_near("a", "b"))
    near = materialise(near.select("a", "b", "n_a", "n_b"), "near-pairs")
    sets = sets_of(docs, near.select("a").union(near.select("b")), text, key)
    return near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").where(
        enough("a", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, n_links
    (confirmed links of the class), kept."""
    seen = materialise(describe(docs, text, key), "signatures")
    some = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets have equal bands and sketches, so any row of a class can stand for it
    classes = materialise(some.groupBy("s1", "s2", "n_shingles").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    of_doc = some.select(F.col("doc_id").alias("_id"), "s1", "s2", "n_shingles").distinct().join(
        classes.select("s1", "s2", "n_shingles", F.col("doc_id").alias("class_id")), ["s1", "s2", "n_shingles"]).select(
        F.col("_id").alias("doc_id"), "class_id")
    heads = classes.select("doc_id", "n_shingles", "bands", "sketch")
    banded = heads.select("doc_id", F.posexplode("bands").alias("nth", "band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = materialise(banded.join(shared, "band"), "band-members")
    known = materialise(heads.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "n_shingles", "bands", "sketch"), "sketches")

    links, component, active = None, None, members
    for turn in range(HUB_ROUNDS + 1):
        placed = active.withColumn("component", F.col("doc_id")) if component is None else active.join(
            component, active["doc_id"] == component["node"], "left").select(
            "band", "nth", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                           F.min(F.struct("doc_id", "component")).alias("hub")).where("lo < hi")
        placed = materialise(placed.join(split.select("band", "hub"), "band"), "band-members")
        if placed.isEmpty():
            if links is not None and turn < HUB_ROUNDS:
                component = materialise(connected_components(links), "components")
            break
        if turn < HUB_ROUNDS:
            pairs = placed.where("component <> hub.component").select(
                F.least("hub.doc_id", "doc_id").alias("a"), F.greatest("hub.doc_id", "doc_id").alias("b"))
            found = confirm(pairs.distinct(), known, docs, text, key)
        else:
            found = links_left(placed, known, docs, text, key)
        found = materialise(found, "links")
        links = found if links is None else links.union(found)
        # one step to the smallest linked document is enough to spare most comparisons with a second hub;
        # before all that is left is compared, and at the end, components are exact
        component = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")) if (
            turn < HUB_ROUNDS - 1) else connected_components(links)
        component = materialise(component, "components")
        active = placed.where("doc_id <> hub.doc_id").select("band", "nth", "doc_id")

    if links is None:
        links = of_doc.where("false").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
        component = of_doc.where("false").select(F.col("class_id").alias("node"), F.col("class_id").alias("component"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"))
    of_class = component.join(degree, "node", "left")
    placed = of_doc.join(of_class, of_doc["class_id"] == of_class["node"], "left").select(
        F.col("doc_id").alias("_id"), "class_id", F.coalesce("component", "class_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = seen.select("doc_id", "n_shingles").join(placed, F.col("doc_id") == F.col("_id"), "left")
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
