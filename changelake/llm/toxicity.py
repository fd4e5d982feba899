"""Toxicity by class-conditional Kneser-Ney models over all bytes of a text.

A text is the sequence of its words' bytes (A-Z lower-cased, see ``text.word_table``), each word followed by
a byte 0. Every byte is predicted from the ``ORDER`` - 1 bytes before it, across words, with zeros before the
first; so words of any length and what stands between two words are judged, in any script. Training counts
every such n-gram of all labelled documents per class, so what is gathered grows with the labelled corpus.
An n-gram is its own key: six bytes in a long, the history is the key without its last byte. There are three
levels; the classes have their own counts at the first two and share the third:

    P_class(w | h)  = (max(c(hw) - D, 0) + sum_v min(c(hv), D) * P_word(w | h')) / c(h)
    P_word(w | h')  = (max(c(h'w) - D, 0) + sum_v min(c(h'v), D) * P_shared(w | h')) / c(h')
    P_shared(w | h') = (max(n(h'w) - d, 0) + d * types(h') * P_cont(w | last byte of h')) / n(h')

h' is h without what lies before the word, so the first level is left out where h lies within a word;
n are the counts of both classes together, P_cont Kneser-Ney continuation counts (in how many distinct
histories a byte pair occurs). A rare expression therefore has nearly the shared probability in both
classes and says little; one that a class uses often says much.

A text's two log-likelihoods are compared byte by byte and normalised by its length: ``ratio`` is the plain
difference, ``evidence`` counts the bytes at which the toxic model is ahead by more than ``MARGIN`` nats.
Long ordinary texts pile up small differences of chance, so the score is a logistic curve of ``evidence``.
The curve's two parameters are fitted on up to ``FIT_ROWS`` labelled rows with counts that leave these rows'
eighth of the corpus out; the final model counts all.

The log-likelihood ratios per n-gram are computed in Spark and stay a table there. Tasks hold its most
frequent histories, ``HOT`` n-grams at most, each history with all that follows it. If there are more, the
n-grams of other histories leave the tasks as counts per document and are joined with the table, so every
n-gram counts with its own value whatever the size of the model.

Defined results. Null and empty texts have no evidence and get the curve's value there. Rows are
independent; repeated rows and null or repeated doc_ids give one row each. Labels with null doc_id or label
are not used; several labels of one document count once each. Labels of one class alone give a curve
without slope, slightly below 0.5. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.store import materialise
from changelake.llm.text import Words, mix, ragged, tidy, words

ORDER = 6
CLASS_DISCOUNT = 1.5
SHARED_DISCOUNT = 0.75
MARGIN = 1.0
COUNT_ROWS = 3_000_000        # n-grams that a task adds up before it sends counts
HOT = 1 << 22                 # n-grams that tasks hold
FIT_ROWS = 20_000
BROADCAST_LABELS = 2_000_000  # labels up to this number are broadcast, beyond it the join shuffles
WITHIN = 1 << 56              # marks keys of the second level
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends there, document) of each byte of the words and of each word's end."""
    size, doc = w.end - w.start, w.doc_of_word()
    count = np.diff(w.bounds)
    # zeros before each document's first word, so that no history reaches into the document before
    base = np.cumsum(size + 1) - (size + 1) + (ORDER - 1) * np.cumsum(count > 0)[doc]
    line = np.zeros(int(base[-1] + size[-1] + 1) if len(base) else 0, np.uint64)
    line[ragged(base, size)] = _LOWER[w.data[ragged(w.start, size)]]
    key = line.copy()
    for back in range(1, ORDER):
        key[back:] |= line[:-back] << np.uint64(8 * back)
    return key[ragged(base, size + 1)], np.repeat(doc, size + 1)


def within(key: np.ndarray) -> np.ndarray:
    """The n-grams without what lies before their last byte's word."""
    out = key.copy()
    for back in range(ORDER - 1, 0, -1):
        zero = key & np.uint64(0xFF << 8 * back) == 0
        out[zero] = key[zero] & np.uint64((1 << 8 * back) - 1)
    return out


def within_column(key: Column) -> Column:
    """The same in Spark."""
    out = key
    for back in range(ORDER - 1, 0, -1):
        out = F.when(key.bitwiseAND(F.lit(0xFF << 8 * back)) == 0, key.bitwiseAND(F.lit((1 << 8 * back) - 1))).otherwise(out)
    return out


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(key, tox_0, ord_0, tox_1, ord_1), counts by part, from rows (text, toxic, part): tasks add up first."""
    names = ["ord_0", "tox_0", "ord_1", "tox_1"]

    def add_up(held: list) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        return code[first], np.add.reduceat(n, first) if len(first) else n

    def rows(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, at = np.unique(code >> np.uint64(2), return_inverse=True)
        table = np.zeros((4, len(key)), np.int64)
        table[(code & np.uint64(3)).astype(np.int64), at] = n
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i:i + 100_000].view(np.int64)), *[pa.array(c[i:i + 100_000]) for c in table]],
                names=["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            kind = np.array(batch.column(2).to_pylist(), np.uint64) * np.uint64(2) + np.array(
                batch.column(1).to_pylist(), np.uint64)
            for w in words(batch.column(0), "alnum", True, hashed=False):
                key, doc = ngrams(w)
                held.append(np.unique(key << np.uint64(2) | kind[doc + w.first_row], return_counts=True))
                size += len(held[-1][0])
                if size > COUNT_ROWS:
                    held = [add_up(held)]
                    size = len(held[0][0])
                    if size > COUNT_ROWS // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*add_up(held))

    return labelled.select("text", "toxic", "part").mapInArrow(
        tidy(run), "key long, " + ", ".join(f"{c} long" for c in names)).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in names])


def compile_model(counts: DataFrame) -> DataFrame:
    """(key, ratio, rest, weight) from rows (key, tox, ord), for both levels: log P_toxic - log P_ordinary of
    the n-gram's last byte; what a byte that neither class has after its history adds to the next level's
    value; how often the history occurs."""
    low, high, d = F.lit(0.0), CLASS_DISCOUNT, SHARED_DISCOUNT
    history = Window.partitionBy(F.shiftright("key", 8))                      # 256 rows at most
    both = F.col("tox") + F.col("ord")

    def spread(c: str) -> Column:
        return F.sum(F.least(F.col(c).cast("double"), F.lit(high))).over(history)

    def sums(level: DataFrame) -> DataFrame:
        return level.withColumns({
            "sum_tox": F.sum("tox").over(history), "sum_ord": F.sum("ord").over(history), "rest_tox": spread("tox"),
            "rest_ord": spread("ord"), "sum": F.sum(both).over(history), "types": F.count(F.lit(1)).over(history)})

    def own(c: str, shorter: str) -> Column:
        p = (F.greatest(F.col(c) - high, low) + F.col(f"rest_{c}") * F.col(shorter)) / F.col(f"sum_{c}")
        return F.when(F.col(f"sum_{c}") > 0, p).otherwise(F.col(shorter))

    def left(c: str) -> Column:
        return F.when(F.col(f"sum_{c}") > 0, F.col(f"rest_{c}") / F.col(f"sum_{c}")).otherwise(F.lit(1.0))

    def ratios(level: DataFrame, tox: Column, ord: Column, *more: str) -> DataFrame:
        return level.select("key", F.log(tox / ord).cast("float").alias("ratio"),
                            F.log(left("tox") / left("ord")).cast("float").alias("rest"), F.col("sum").alias("weight"), *more)

    counts = counts.withColumn("word", within_column(F.col("key")))
    words_only = materialise(counts.groupBy(F.col("word").bitwiseOR(F.lit(WITHIN)).alias("key")).agg(
        F.sum("tox").alias("tox"), F.sum("ord").alias("ord")), "word-counts").withColumn(
        "pair", F.col("key").bitwiseAND(F.lit(0xFFFF)).cast("int"))
    pairs = words_only.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))      # 65,536 rows at most
    before = pairs.groupBy(F.shiftright("pair", 8).alias("v")).agg(
        F.sum("n").alias("n_v"), F.count(F.lit(1)).alias("types_v"))
    cont = pairs.join(F.broadcast(before), F.shiftright("pair", 8) == F.col("v")).select(
        "pair", ((F.greatest(F.col("n") - d, low) + F.col("types_v") * d / 256) / F.col("n_v")).alias("p_cont"))
    second = sums(words_only.join(F.broadcast(cont), "pair")).withColumn(
        "p", (F.greatest(both - d, low) + F.col("types") * d * F.col("p_cont")) / F.col("sum")).withColumns(
        {"p_tox": own("tox", "p"), "p_ord": own("ord", "p")})
    second = materialise(ratios(second, F.col("p_tox"), F.col("p_ord"), "p_tox", "p_ord"), "word-level")
    first = sums(counts.where("key <> word")).join(
        second.select(F.col("key").bitwiseAND(F.lit(WITHIN - 1)).alias("word"), "p_tox", "p_ord"), "word")
    return ratios(first, own("tox", "p_tox"), own("ord", "p_ord")).union(second.drop("p_tox", "p_ord"))


class Index:
    """Finds numbers in an array of distinct ones."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys)
        self.order = np.argsort(mixed).astype(np.int32)
        self.mixed = mixed[self.order]
        bits = max(int(len(keys)).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.mixed >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each, or -1."""
        out = np.full(len(keys), -1, np.int64)
        mixed = mix(keys)
        cell = (mixed >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        on = np.flatnonzero(at < end)
        while len(on):
            hit = self.mixed[at[on]] == mixed[on]
            out[on[hit]] = self.order[at[on[hit]]]
            on = on[~hit]
            at[on] += 1
            on = on[at[on] < end[on]]
        return out


class Tables:
    """The compiled model's most frequent histories as arrays; ``cold`` is the whole table if that is not all."""

    def __init__(self, model: DataFrame):
        model = materialise(model, "toxicity-model")
        level = F.floor(F.log2("weight") * 4).cast("int")
        taken, self.lowest, self.cold = 0, None, None
        for r in model.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 256 rows at most
            taken += r["count"]
            if taken > HOT:
                self.cold = model
                break
            self.lowest = r.level
        got = (model.where("false") if self.lowest is None else model.where(level >= self.lowest)).select(
            "key", "ratio", "rest").toArrow()
        key = got.column("key").to_numpy().astype(np.uint64)
        history, first = np.unique(key >> np.uint64(8), return_index=True)
        self.held = Held(Index(key), got.column("ratio").to_numpy(), Index(history),
                         got.column("rest").to_numpy()[first], self.cold is not None)


class Held:
    """What tasks get of the model."""

    def __init__(self, key: Index, ratio: np.ndarray, history: Index, rest: np.ndarray, more: bool):
        self.key, self.ratio, self.history, self.rest, self.more = key, ratio, history, rest, more

    def compare(self, w: Words) -> list[pa.Array]:
        """total, ahead, length of each text, and its distinct n-grams that need other histories, with their counts."""
        key, doc = ngrams(w)
        word = within(key)
        mark = word | np.uint64(WITHIN)
        at = self.key.find(mark)
        known, value = at >= 0, np.zeros(len(key))
        value[known] = self.ratio[at[known]]
        on = np.flatnonzero(~known)
        before = self.history.find(mark[on] >> np.uint64(8))
        value[on[before >= 0]] = self.rest[before[before >= 0]]
        known[on[before >= 0]] = True
        on = np.flatnonzero(word != key)
        at = self.key.find(key[on])
        value[on[at >= 0]] = self.ratio[at[at >= 0]]
        known[on[at >= 0]] = True
        on = on[at < 0]
        before = self.history.find(key[on] >> np.uint64(8))
        value[on[before >= 0]] += self.rest[before[before >= 0]]
        known[on[before < 0]] = False
        cold = np.flatnonzero(~known) if self.more else on[:0]
        value[cold] = 0
        cold = cold[np.lexsort((key[cold], doc[cold]))]
        k, d = key[cold], doc[cold]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else cold
        cuts = pa.array(np.searchsorted(d[first], np.arange(w.rows + 1)), pa.int32())
        return [pa.array(np.bincount(doc, weights=value, minlength=w.rows)),
                pa.array(np.bincount(doc, weights=np.where(value > MARGIN, value, 0), minlength=w.rows)),
                pa.array(np.bincount(doc, minlength=w.rows), pa.int64()),
                pa.ListArray.from_arrays(cuts, pa.array(k[first].view(np.int64))),
                pa.ListArray.from_arrays(cuts, pa.array(np.diff(np.append(first, len(k))), pa.int64()))]


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps, with a little ridge."""
    if not len(x) or y.all() or not y.any():
        return 0.0, -0.01
    scale = x.std() or 1.0
    design, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-3 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


class ToxicityModel:
    def __init__(self, tables: Tables, slope: float, intercept: float):
        self.tables, self.slope, self.intercept = tables, slope, intercept

    def score(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """Per row: the key, ratio, evidence, score, predicted."""
        held = docs.sparkSession.sparkContext.broadcast(self.tables.held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w in words(batch.column(1), "alnum", True, hashed=False):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(w.first_row, w.rows), *held.value.compare(w)],
                        names=["doc_id", "total", "ahead", "length", "cold", "times"])

        kind = docs.schema[key].dataType.simpleString()
        rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, total double, ahead double, length long, cold array<long>, times array<long>")
        if self.tables.cold is not None:
            rows = self._with_cold(rows)
        size = F.greatest("length", F.lit(1))
        odds = F.col("evidence") * self.slope + self.intercept
        return rows.select("doc_id", (F.col("total") / size).alias("ratio"), (F.col("ahead") / size).alias("evidence")).withColumn(
            "score", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))).withColumn(
            "predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("doc_id", key)

    def _with_cold(self, rows: DataFrame) -> DataFrame:
        """The rows with the n-grams added that tasks could not judge."""
        rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "toxicity-rows")
        asked = materialise(rows.select("_row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select(
            "_row", F.col("x.cold").alias("key"), F.col("x.times").alias("times")), "toxicity-asked")
        model = self.tables.cold
        rests = model.select(F.shiftright("key", 8).alias("_h"), "rest").distinct()
        found = asked.select("key").distinct().withColumn("word", within_column(F.col("key")))
        for name, at in (("first", F.when(F.col("key") != F.col("word"), F.col("key"))),
                         ("second", F.col("word").bitwiseOR(F.lit(WITHIN)))):
            found = found.withColumn("_at", at)
            found = found.join(model.select(F.col("key").alias("_key"), F.col("ratio").alias(f"ratio_{name}")),
                               F.col("_at") == F.col("_key"), "left").join(
                rests.withColumnRenamed("rest", f"rest_{name}"), F.shiftright("_at", 8) == F.col("_h"), "left").drop(
                "_at", "_key", "_h")
        none = F.lit(0.0)
        found = found.select("key", F.coalesce(F.col("ratio_first").cast("double"), F.coalesce("rest_first", none) + F.coalesce(
            "ratio_second", "rest_second", none)).alias("value"))
        more = asked.join(found, "key").groupBy("_row").agg(
            F.sum(F.col("value") * F.col("times")).alias("more"),
            F.sum(F.when(F.col("value") > MARGIN, F.col("value") * F.col("times")).otherwise(0.0)).alias("more_ahead"))
        return rows.join(more, "_row", "left").select(
            "doc_id", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("ahead") + F.coalesce("more_ahead", F.lit(0.0))).alias("ahead"), "length")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """(doc_id, text, toxic) of labelled documents; labels are broadcast if they were counted as few."""
    side = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("_labelled"), (F.col(label) != 0).alias("toxic"))
    if side.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        side = F.broadcast(side)
    return docs.join(side, docs[key] == F.col("_labelled")).select(
        F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), "toxic")


def train(labelled: DataFrame) -> ToxicityModel:
    """A model from rows (doc_id, text, toxic). All rows are counted."""
    parted = labelled.withColumn("part", (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).cast("int"))
    counts = materialise(count_ngrams(parted), "ngram-counts")
    most = counts.select("key", F.col("tox_0").alias("tox"), F.col("ord_0").alias("ord")).where("tox + ord > 0")
    fitted = ToxicityModel(Tables(compile_model(most)), 1.0, 0.0)
    aside = parted.where("part = 1").select("text", F.col("toxic").cast("int").alias("toxic"))
    rows = fitted.score(aside, key="toxic").select("toxic", "evidence").limit(FIT_ROWS).toArrow()
    slope, intercept = fit_curve(rows.column("evidence").to_numpy(), rows.column("toxic").to_numpy().astype(float))
    whole = counts.select("key", (F.col("tox_0") + F.col("tox_1")).alias("tox"), (F.col("ord_0") + F.col("ord_1")).alias("ord"))
    return ToxicityModel(Tables(compile_model(whole)), slope, intercept)
