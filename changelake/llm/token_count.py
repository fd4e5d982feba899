"""Token counts by rank-synchronous merging (see ``bpe``), with no shuffle.

Each Arrow batch is cut into slices of bounded bytes; a slice's distinct pre-tokens are merged
together, every round applying the lowest-rank pair of each, and a document's count is the sum of the
surviving symbols of its pre-tokens plus one for each special token that its text spells out.

Defined results. Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows
and null or repeated ids give one result row each. Other columns are not read. A document longer than
the slice bound is a slice of its own; a pre-token of any length is merged in n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm import bpe
from changelake.llm.pretoken import split_texts, sums
from changelake.llm.text import slices, tidy

TOKEN_LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = TOKEN_LIMIT,
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, n_bytes, n_tokens, over_limit. ``vocabulary``: a tokenizers file with a
    byte-level BPE model, readable at that path on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, special = bpe.load_merges(vocabulary)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n_bytes, n_tokens = [], []
            for first, _, offsets in slices(column):
                texts = column.slice(first, len(offsets) - 1).to_pylist()
                codes, unique, count, marks = split_texts(texts, pattern, list(special))
                _, bounds = merges.encode(unique)
                n_tokens.append(sums(np.diff(bounds)[codes], count) + marks)
                n_bytes.append(np.diff(offsets))
            size = np.concatenate(n_bytes) if n_bytes else np.zeros(0, np.int64)
            tokens = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(tokens > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), schema)
