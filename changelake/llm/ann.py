"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook, so that K + K centroids make K * K
cells. A query walks the cells by the sum of its nearness to the two half centroids, best first, with a
heap over the two sorted centroid lists, until the cells hold ``reach`` vectors; these are reranked by the
exact inner product in double precision.

``reach`` is not guessed: for a bounded sample of queries the exact neighbours are found by brute force in
Spark, each is looked up in that query's walk, and ``reach`` is set where ``RECALL`` of them are passed. On
clustered vectors that is a small share of the table; on vectors without structure it is a large one, and
no index does much better there.

Scale. Equal vectors are one entry with its k + 1 smallest ids (no more can be asked for), so a vector that
a third of the rows hold is one candidate. Entries are dealt by the first half's centroid, large groups in
blocks of at most ENTRY_BLOCK, and a query goes once to each group that it visits, with the list of second
centroids; groups with many queries are dealt in blocks of QUERY_BLOCK. Codebooks, cell counts and sample
queries are bounded and held by every task.

Defined results. Vectors that are null, zero or hold null or non-finite components take no part, nor do
those of another length than most, or rows without id. Of rows with the same id and different vectors the
nearest counts. A query without any candidate has no rows. Equal scores go to the smaller id. Other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.llm.store import materialise
from changelake.llm.text import tidy

NEIGHBOURS = 20
RECALL = 0.96
FIT_ROWS = 20_000
FIT_ROUNDS = 12
TUNE_QUERIES = 256
CELL_ROWS = 200               # vectors a cell that K aims at
ENTRY_BLOCK, QUERY_BLOCK = 20_000, 20_000
SALTS = 32


def entries(table: DataFrame, k: int, vector: str, key: str) -> DataFrame:
    """(v array<float>, ids): distinct usable vectors and their k + 1 smallest ids."""
    usable = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = usable.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "size").first()
    usable = usable.where(F.size("v") == (sizes["size"] if sizes else 0))

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))

    # equal vectors meet in salted groups first; a hot one is many small lists of k + 1 ids by then
    salted = usable.select("v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), F.array("id").alias("ids"))
    return least(least(salted, "v", "salt"), "v")


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows; empty centroids keep their place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class MultiIndex:
    """Codebooks of the two halves and how many entries each cell holds."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.k = first, second, len(first)
        self.count = np.zeros((self.k, self.k), np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return tuple(np.argmin((c ** 2).sum(1) - 2 * part @ c.T, axis=1)
                     for c, part in ((self.first, x[:, :half]), (self.second, x[:, half:])))

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells by falling sum of inner products with the two centroids: a heap over two sorted lists."""
        half = self.first.shape[1]
        a, b = self.first @ q[:half], self.second @ q[half:]
        rows, columns = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[rows].tolist(), b[columns].tolist()
        rows, columns = rows.tolist(), columns.tolist()
        heap = [(-a[0] - b[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i], columns[j]
            # each cell has one parent: its left neighbour, or the one above in the first column
            if j + 1 < self.k:
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))

    def visited(self, q: np.ndarray, reach: int) -> dict[int, list[int]]:
        """Second centroids per first centroid of the cells that hold the first ``reach`` entries."""
        found: dict[int, list[int]] = {}
        got = 0
        for i, j in self.walk(q):
            if self.count[i, j]:
                found.setdefault(i, []).append(j)
                got += self.count[i, j]
                if got >= reach:
                    break
        return found

    def depth(self, q: np.ndarray, cells: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
        """Entries passed when each of the cells has been visited."""
        out, got = {}, 0
        for cell in self.walk(q):
            got += int(self.count[cell])
            if cell in cells:
                out[cell] = got
                if len(out) == len(cells):
                    break
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column.values
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the k best (score, id) of each query, reduced in salted groups first."""
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best")
    cand = rows.select("query_id", F.array(F.struct((-F.col("score")).alias("minus"), F.col("id"))).alias("best"),
                       F.pmod(F.xxhash64("id"), F.lit(4)).alias("salt"))
    return cand.groupBy("query_id", "salt").agg(best).groupBy("query_id").agg(best)


def search(table: DataFrame, queries: Column, k: int = NEIGHBOURS, recall: float = RECALL,
           vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, score): the k nearest found for the rows of ``table`` where ``queries`` holds,
    among all rows but the query's own."""
    spark = table.sparkSession
    held = materialise(entries(table, k, vector, key), "vectors")
    total = held.count()
    id_type = table.schema[key].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, {key} {id_type}, score double"
    if not total:
        return spark.createDataFrame([], schema)
    keep = min(1.0, FIT_ROWS / total)
    chosen = held.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(keep * (1 << 30)))
    sample = np.array([r.v for r in chosen.select("v").limit(2 * FIT_ROWS).toLocalIterator()] or held.first().v, float)
    sample = sample.reshape(-1, len(held.first().v))
    sample = sample[np.lexsort(sample.T[::-1])]
    width = sample.shape[1]
    n = int(np.clip(round((total / CELL_ROWS) ** 0.5), 16, 1024))
    n, half = min(n, len(sample)), max(1, width // 2)
    second = sample[:, half:] if width > 1 else np.zeros((len(sample), 1))
    index = MultiIndex(kmeans(sample[:, :half], n), kmeans(second, n)[:, :max(0, width - half)])
    book = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = book.value.cells(_matrix(batch.column(0), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))],
                                                 names=["v", "ids", "i", "j"])

    placed = materialise(held.mapInArrow(tidy(place), f"v array<double>, ids array<{id_type}>, i int, j int"), "cells")
    for r in placed.groupBy("i", "j").count().collect():      # at most K * K rows
        index.count[r.i, r.j] = r["count"]
    book = spark.sparkContext.broadcast(index)

    asked = table.where(queries).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(
        F.col("query_id").isNotNull() & (F.size("q") == width)
        & ~F.exists("q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("q", lambda x: x != 0)).distinct()
    asked = materialise(asked, "queries")
    reach = _tune(placed, asked, index, width, k, recall)

    blocks = {int(i): max(1, -(-int(c) // ENTRY_BLOCK)) for i, c in enumerate(index.count.sum(axis=1))}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell, block, second = [], [], [], []
            for row, q in enumerate(_matrix(batch.column(1), width)):
                for i, js in book.value.visited(q, reach).items():
                    for b in range(blocks[i]):
                        at.append(row)
                        cell.append(i)
                        block.append(b)
                        second.append(js)
            chosen = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns, pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(second, pa.list_(pa.int32()))],
                names=["query_id", "q", "i", "block", "js"])

    routed = asked.mapInArrow(tidy(route), f"query_id {id_type}, q array<double>, i int, block int, js array<int>")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    routed = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    counts = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("v"), F.element_at(counts, F.col("i"))).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def rerank(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(wanted):
            x, q = np.stack(found["v"].to_numpy()), np.stack(wanted["q"].to_numpy())
            ids = found["ids"].to_numpy()
            by_cell = {j: at for j, at in found.groupby("j").indices.items()}
            for row, (own, js) in enumerate(zip(wanted["query_id"], wanted["js"])):
                at = np.concatenate([by_cell[j] for j in js if j in by_cell] or [np.zeros(0, int)])
                score = x[at] @ q[row]
                if len(at) > k + 1:
                    # all that tie with the last one go on, ids decide later
                    at, score = at[(ok := score >= np.partition(score, -k - 1)[-k - 1])], score[ok]
                pairs = sorted((-s, i) for s, a in zip(score.tolist(), at) for i in ids[a] if i != own)
                out += [(own, i, -s) for s, i in pairs[:k]]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    near = dealt.groupBy("i", "block", "part").cogroup(routed.groupBy("i", "block", "part")).applyInPandas(
        rerank, f"query_id {id_type}, id {id_type}, score double")
    ranked = nearest(near, k).select("query_id", F.posexplode("best").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(key),
                         (-F.col("x.minus")).alias("score"))


def _tune(placed: DataFrame, asked: DataFrame, index: MultiIndex, width: int, k: int, recall: float) -> int:
    """The number of entries to visit so that ``recall`` of the sample's exact neighbours are reached."""
    few = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNE_QUERIES).collect()
    if not few:
        return 1
    matrix = np.array([r.q for r in few], float)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = matrix @ _matrix(batch.column(0), width).T
                top = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
                row = np.repeat(np.arange(len(matrix)), top.shape[1])
                at = top.ravel()
                cell = (batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * index.k
                        + batch.column(3).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cell[at]), pa.array(score[row, at])],
                                                 names=["query_id", "id", "score"])

    # an entry is known by its cell and score; the query's own vector is the best one and counts too
    best = nearest(placed.mapInArrow(tidy(exact), "query_id long, id long, score double"), k + 1).collect()
    depths: list[int] = []
    for r in best:
        cells = [divmod(x.id, index.k) for x in r.best]
        at = index.depth(matrix[r.query_id], set(cells))
        depths += [at[c] for c in cells]
    return int(np.quantile(depths, recall, method="higher"))
