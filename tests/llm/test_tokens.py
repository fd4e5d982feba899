"""Token counts, encoding and decoding against the libraries that the vocabularies belong to."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
from changelake.llm import bpe, bytebpe
from changelake.llm.token_count import count_tokens
from tests.conftest import SF

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hug():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def odd_texts():
    rnd = random.Random(7)
    alphabet = "abcXYZ012'  \n\t \u0085\x1c　éñß漢字🙂‍́!?.-s t"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    anywhere = ["".join(chr(c) for c in rnd.sample(range(0x20000), 300) if not 0xD800 <= c < 0xE000) for _ in range(20)]
    return [None, "", " ", "\n\n\n", "x" * 30000, "ab" * 9000, " " * 5000, "it's we've 'sno ''s", "a <|endoftext|> b",
            "<|endoftext|><|endoftext|>", "<|endoftext", " ", "\0", " \0\1", "a\0b", "a\0c", "a", *made, *anywhere]


def test_words_merge_as_the_libraries_do(tik):
    merges, table = bpe.load_ranks(RANKS)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abéx ") for _ in range(rnd.randint(1, 200))).encode() for _ in range(500)] + [b""]
    ids, bounds = merges.encode(words)
    for i, w in enumerate(words):
        mine = ids[bounds[i]:bounds[i + 1]].tolist()
        assert mine == (tik._core_bpe.encode_single_piece(w) if w else [])
        assert b"".join(table[t] for t in mine) == w


def test_counts_on_odd_texts(spark, hug):
    texts = odd_texts()
    rows = [(None if i % 50 == 3 else i, t, "x") for i, t in enumerate(texts)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"),
                       P.path("byte_bpe_50k.json"), P.PATTERN, limit=100).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()),
                   len(hug.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_round_trip_on_odd_texts(spark, tik):
    texts = odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = bytebpe.decode(bytebpe.encode(frame, RANKS, P.PATTERN), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens * 4 == len(r.ids)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert bytebpe.decode(bytebpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0


def test_queries(spark, tik, hug):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = {d.doc_id: d.text or "" for d in docs}
    got = entry.queries()["op5_token_counts"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(hug.encode(text[r.doc_id], add_special_tokens=False).ids) for r in got)
    got = entry.queries()["op9_byte_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tik.encode_ordinary(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
