"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Each document's lines (split at \\n) are hashed; every run of ``width`` consecutive non-blank lines
is a window. A window occurrence is *later* if the same lines occur at a smaller (doc_id, position).
All lines covered by a later occurrence are removed; overlapping occurrences merge by position.

Defined results. Null text stays null. Documents with fewer non-blank lines than ``width`` have no
window and stay as they are; blank lines are never compared and are never removed. Rows without
doc_id take no part and stay as they are. Rows that share a doc_id count as one document written
twice: equal (doc_id, position) is no later occurrence, so neither row loses to the other. Further
columns pass through unchanged; the internal names start with ``_ln_`` (clashes raise nothing: the
operator works on a renamed projection).

Scale. Only (96-bit hash, doc_id, position) is shuffled to find repeats, pre-aggregated on the map
side; a window that a third of all documents hold sends one row per task to the aggregate, and the
join back to its occurrences is a plain equi-join that adaptive execution splits. Text is shuffled
once, by doc_id, when the positions are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def window_rows(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per window: doc_id, at (rank among the document's non-blank lines), h1, h2."""
    hashed = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("doc_id"),
        F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != ""),
                    lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))).alias("_h"))
    windows = hashed.select("doc_id", F.posexplode(F.expr(
        f"if(size(_h) < {width}, array(), transform(sequence(0, size(_h) - {width}), "
        f"i -> struct(xxhash64(slice(_h, i + 1, {width})) as h1, hash(slice(_h, i + 1, {width})) as h2)))"
    )).alias("at", "_w"))
    return windows.select("doc_id", "at", "_w.h1", "_w.h2")


def later_windows(windows: DataFrame) -> DataFrame:
    """Occurrences (doc_id, at) of windows that also occur at a smaller (doc_id, at)."""
    first = windows.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > 1).drop("n")
    return windows.join(first, ["h1", "h2"]).where(
        F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at")


def covered_lines(later: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document the merged, sorted ranks of non-blank lines that later occurrences cover."""
    at = later.groupBy("doc_id").agg(F.collect_set("at").alias("_at"))
    return at.select("doc_id", F.array_sort(F.array_distinct(F.flatten(F.transform(
        "_at", lambda x: F.sequence(x, x + F.lit(width - 1)))))).alias("_covered"))


def dedup_lines(docs: DataFrame, width: int = WIDTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with repeated windows taken out, plus n_lines and n_lines_removed."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_ln_{i}") for i, c in enumerate(names)])
    t, k = f"_ln_{names.index(text)}", f"_ln_{names.index(key)}"
    spans = covered_lines(later_windows(window_rows(docs, width, text, key)), width)
    spans = spans.withColumnRenamed("doc_id", "_ln_doc")
    # arrays that lambdas index are built below the join: above it, they would be built per reference
    lines = inner.withColumn("_ln_lines", F.split(F.col(t), "\n")).drop(t)
    lines = lines.withColumn("_ln_solid", F.array_compact(F.transform(
        "_ln_lines", lambda x, i: F.when(F.trim(x) != "", i))))
    joined = lines.join(spans, lines[k] == spans["_ln_doc"], "left")
    doomed = F.transform("_covered", lambda r: F.get(F.col("_ln_solid"), r))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ln_lines") - 1), doomed)
    kept = F.when(F.col("_covered").isNotNull(), F.transform(left, lambda i: F.get(F.col("_ln_lines"), i)))
    text_out = F.array_join(F.coalesce(kept, F.col("_ln_lines")), "\n")
    columns: list[Column] = [
        (text_out if c == text else F.col(f"_ln_{i}")).alias(c) for i, c in enumerate(names)]
    return joined.select(
        *columns, F.coalesce(F.size("_ln_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_lines_removed"))

