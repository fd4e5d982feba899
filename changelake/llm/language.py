"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text is cut into chunks of at most
``CHUNK`` bytes at spaces, every chunk is compressed with every dictionary, and the language with the
smallest total wins. The whole text is compressed: chunks keep the dictionary in reach of each part of a
long text. The score is the margin to the second language, as a share of that language's size; narrow
margins are marked as rejected. Where the margin is below ``NARROW``, whole bytes are too coarse, so the
text is also compressed with other match lengths and the sizes are added up.

The dictionaries are fitted on a bounded sample: up to ``SAMPLE_BYTES`` of text a language, of the
documents with the least hash. A task needs ``len(languages)`` dictionaries of that size.

Defined results. Null texts and texts without a letter are ``und`` with score 0. Rows are independent;
repeated rows and null or repeated ids give one result row each. Equal sizes go to the language with the
largest number of training texts, then by name, with score 0. Training rows with null text or label are
not used; without any, all texts are ``und``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.text import slices, tidy

SAMPLE_BYTES = 512 << 10
SAMPLE_PIECE = 2 << 10        # characters of one document, so that a dictionary holds many
CHUNK = 2 << 10
LEVEL = 12
NARROW = 0.1
FINER = [(12, 3), (12, 4), (12, 5), (3, 4)]     # (level, least match)
MIN_MARGIN = 0.02
_LETTER = regex.compile(r"\p{L}")


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language from (text, label) rows."""
    # one short piece per language and hash bucket: a bounded number, however many documents there are
    buckets = 3 * SAMPLE_BYTES // SAMPLE_PIECE
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(text)
    middle = F.greatest(F.length(text) / 2 - SAMPLE_PIECE // 2, F.lit(1)).cast("int")   # texts often begin alike
    rows = usable.select(
        F.col(label).cast("string").alias("lang"), F.pmod(order, F.lit(buckets)).alias("bucket"), order.alias("order"),
        F.substring(F.col(text), middle, F.lit(SAMPLE_PIECE)).alias("piece")
    ).groupBy("lang", "bucket").agg(F.min_by("piece", "order").alias("piece"), F.count(F.lit(1)).alias("n")).collect()
    content: dict[str, bytes] = {}
    number: dict[str, int] = {}
    for lang, _, piece, n in sorted(rows):
        number[lang] = number.get(lang, 0) + n
        if len(content.get(lang, b"")) < SAMPLE_BYTES:
            content[lang] = content.get(lang, b"") + piece.lower().encode() + b"\n"
    # of equal sizes the first counts, so the most frequent language stands first
    return {lang: content[lang][-SAMPLE_BYTES:] for lang in sorted(content, key=lambda x: (-number[x], x))}


def chunks(body: bytes) -> Iterator[bytes]:
    """Runs of at most CHUNK bytes, cut after a space where there is one."""
    at = 0
    while at < len(body):
        end = at + CHUNK
        if end < len(body):
            end = max(body.rfind(b" ", at + 1, end) + 1, 0) or end
        yield body[at:end]
        at = end


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.usual = self._compressors(dictionaries, LEVEL)
        self.finer = [self._compressors(dictionaries, level, min_match=least) for level, least in FINER]

    @staticmethod
    def _compressors(dictionaries: dict[str, bytes], level: int, **more: int) -> list[zstandard.ZstdCompressor]:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        out = []
        for content in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=parameters)
            out.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters))
        return out

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0
        # letter case says little about the language and hides matches
        pieces = list(chunks(text.lower().encode()))
        size = np.array([sum(len(c.compress(x)) for x in pieces) for c in self.usual], np.int64)
        if len(size) > 1 and 1 - size.min() / np.partition(size, 1)[1] < NARROW:
            for each in self.finer:
                size += [sum(len(c.compress(x)) for x in pieces) for c in each]
        order = np.argsort(size, kind="stable")
        best = int(order[0])
        return self.names[best], float(1 - size[best] / size[order[min(1, len(order) - 1)]])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, lang_pred, score (0 to 1), rejected."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(held.value)
        for batch in batches:
            for first, _, offsets in slices(batch.column(1)):
                part = batch.slice(first, len(offsets) - 1)
                made = [compressors.classify(t) for t in part.column(1).to_pylist()]
                score = np.array([m[1] for m in made], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(score),
                     pa.array(score < MIN_MARGIN)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("doc_id", key)
