"""Operators 11 to 13 against brute force and the tokenizers' own libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changelake.llm import alignment, runs, simhash
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, fingerprint string, tile string, block string, n_words string, runs string, pairs string, label string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", None, "y", "z", None, "q", "r") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


EDGES = [None, "", " \n\t ", "one", "One two", "one  TWO\tthree", "one two three", "x" * 30000, "a " * 4000, "a b " * 30,
         "café Ünï 日本語 text ▁ mark", "<|endoftext|> </s> <s> x", "\x00\x01 ctrl", "tail  ", "   head", "\n\n new\n  lines \n"]


# ---- 11 ----

def brute_print(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(ids, prints, radius=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= radius:
                a, b = find(ids[x]), find(ids[y])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    docs = documents(spark)
    want = [brute_print(t) for _, t in docs]
    groups = brute_groups([i for i, _ in docs], want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op11_simhash"](spark, SF).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for (i, _), p in zip(docs, want)}


def test_simhash_edges(spark):
    ids = [*range(40, 40 + len(EDGES)), 3, 3, None]
    texts = [*EDGES, "one", "another text of its own", ""]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r.component_id for r in got}
    assert by[None] is None and by[40] == by[41] == by[42] == 40      # empty texts are linked with one another
    assert by[43] == by[3] == 3
    assert not simhash.near_duplicates(frame(spark, [])).collect()


def test_simhash_links_in_few_tiles(spark, monkeypatch):
    """Chains of fingerprints two bits apart, most of them in one tile of many blocks, small steps of work."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rnd, prints = random.Random(2), [0, (1 << 64) - 1]
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(30):
            prints.append(x)
            x ^= 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64) if rnd.random() < 0.8 else 0)
    for _ in range(150):                                             # the same population counts in every part
        x = 0
        for part in range(4):
            x |= sum(1 << k for k in rnd.sample(range(16), 3)) << 16 * part
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    rnd.shuffle(prints)
    classes = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    edges = simhash.links(classes).collect()
    want = brute_groups(range(len(prints)), prints)
    root = {i: i for i in range(len(prints))}
    for _ in range(len(prints)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert root == want
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 or want[a] == want[b] for a, b in edges)


def test_simhash_edges_are_a_forest():
    n = 3000
    prints = np.arange(4, dtype=np.uint64)[np.arange(n) % 4]
    edges = list(simhash.block_links(list(range(n)), prints, np.arange(n), list(range(n)), prints, 2))
    assert len(edges) < 2 * n


# ---- 12 ----

def brute_runs(w):
    """Every lag word by word; of stretches with the same ends the least lag."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def digests(found, w):
    gone = set()
    for start, length, q in found:
        gone |= set(range(start + q, start + length))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark):
    got = {r.doc_id: r[1:] for r in entry.queries()["op12_periodic_runs"](spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    docs = documents(spark)
    assert len(got) == len(docs)
    seen = 0
    for i, text in docs:
        w = planted(i, words_of(text))
        if len(w) < 4000:
            assert tuple(got[i]) == digests(brute_runs(w), w), i
            seen += got[i][0]
    assert seen > 10


def test_periodic_runs_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            k, n = rnd.choice([1, 2, 3, 5, 20, 200]), rnd.choice([0, 1, 11, 12, 13, 30, 100, 250])
            d = [rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3)):
                if n > 20:
                    a, p = rnd.randrange(n), rnd.randint(1, n // 4)
                    for i in range(a + p, min(n, a + rnd.randint(2 * p, 4 * p))):
                        d[i] = d[i - p]
            docs.append(d)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        found = runs.find(np.array([x for d in docs for x in d], np.uint64), bounds)
        want = [(a + bounds[i], n, q) for i, d in enumerate(docs) for a, n, q in brute_runs(d)]
        assert list(zip(*map(np.ndarray.tolist, found))) == sorted(want, key=lambda r: (r[0], r[2]))


def test_periodic_runs_of_structured_words():
    """Fibonacci and Thue-Morse words: many runs, and none of exponent above two."""
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    morse = [bin(i).count("1") % 2 for i in range(512)]
    for w in (b, morse, [7] * 700, [i % 9 for i in range(700)]):
        found = runs.find(np.array(w, np.uint64), np.array([0, len(w)]))
        assert list(zip(*map(np.ndarray.tolist, found))) == sorted(brute_runs(w), key=lambda r: (r[0], r[2]))


def test_periodic_runs_edges(spark):
    ids = [*range(len(EDGES)), 9, None]
    texts = [*EDGES, EDGES[9], "a b " * 10]
    got = runs.periodic_runs(frame(spark, texts, ids)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words_of(texts[r.doc_id] if r.doc_id is not None else "a b " * 10)
        found = brute_runs(w)
        assert [tuple(x) for x in r.runs] == sorted(found, key=lambda x: (x[0], x[2])) and r.n_words == len(w)
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == digests(found, w)[-1]
    assert not runs.periodic_runs(frame(spark, [])).collect()


def test_splitting_keeps_only_what_may_repeat():
    ids = np.array([*range(100), *[1, 2, 3] * 5, *range(200, 260)], np.uint64)
    first, end = runs.surviving(ids, np.array([0, len(ids)]))
    assert [(int(a), int(b)) for a, b in zip(first, end)] == [(100, 115)]


# ---- 13 ----

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    side_a = tokenizers.Tokenizer.from_file(A)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for c, b in alignment.bpe.byte_symbols().items()}
    docs = []
    for t in texts:
        ids_a = side_a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = side_b.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in side_a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(side_b.id_to_piece(i)[3:5], 16)]) if side_b.is_byte(i)
                   else side_b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append(None)
            continue
        spans_a, spans_b = ([(sum(map(len, x[:k])), k) for k in range(len(x) + 1)] if len(x) < 400 else list(zip(
            np.append(0, np.cumsum(list(map(len, x)))).tolist(), range(len(x) + 1))) for x in (bytes_a, bytes_b))
        at_a, at_b = dict(spans_a), dict(spans_b)
        cuts = sorted(set(at_a) & set(at_b))
        groups = ";".join(",".join(map(str, ids_a[at_a[p]:at_a[q]])) + "|" + ",".join(map(str, ids_b[at_b[p]:at_b[q]]))
                          for p, q in zip(cuts, cuts[1:]))
        links, i, j = [], 0, 0
        while i < len(ids_a) and j < len(ids_b):
            links.append((ids_a[i], ids_b[j]))
            x, y = spans_a[i + 1][0], spans_b[j + 1][0]
            i, j = i + (x <= y), j + (y <= x)
        docs.append((len(ids_a), len(ids_b), len(cuts) - 1, links, groups))
    count = Counter(p for d in docs if d for p in set(d[3]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (
        d[0], d[1], d[2], len(d[3]), sum(count[p] == top[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_alignment_query(spark):
    docs = documents(spark)
    want = brute_alignment([t for _, t in docs])
    got = {r.doc_id: r for r in entry.queries()["op13_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, _), w in zip(docs, want):
        assert tuple(got[i][c] for c in NAMES) == w[:-1], i
        assert got[i].groups_sha256 == (hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else ""), i


@pytest.mark.parametrize("memo", [100_000, 1, 7])
def test_alignment_edges(spark, memo, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", memo)
    rnd = random.Random(4)
    alphabet = ["a", "Word", " ", "  ", "\n", "é", "日本", ".", "'s", "12", "\t", "▁", "🙂", "́", "ﬁ", "-", " ", "\x85"]
    mixed = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts = [*EDGES, *mixed, *mixed[:5]]
    got = alignment.align_documents(frame(spark, texts, [*range(len(texts) - 1), None]), A, public_tokenizers.PATTERN, B).collect()
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    for r in got:
        w = want[-1 if r.doc_id is None else r.doc_id]
        assert tuple(r[c] for c in [*NAMES, "groups"]) == w, (texts[r.doc_id or -1])
    assert not alignment.align_documents(frame(spark, []), A, public_tokenizers.PATTERN, B).collect()
    only = alignment.align_documents(frame(spark, [None, ""]), A, public_tokenizers.PATTERN, B).collect()
    assert [tuple(r[c] for c in NAMES) for r in only] == [(0,) * 6] * 2
