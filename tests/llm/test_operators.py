"""Operators on small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from changelake.llm import ann, decontaminate, fmindex, graph, language, lines, neardup, quality, substrings, toxicity
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, h string, band string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t), "x", None, "y") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rnd, n, words=40):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(0, 200), 3000) for _ in range(40)]
    passage = prose(rnd, 120, 3000)
    texts = [None, "", "   \n\t ", "one", "one two three", "x" * 20000, "one", *base]
    for t in base[:15]:
        words = t.split()
        if words:
            words[rnd.randrange(len(words))] = "CHANGED"
        texts += [t, " ".join(words), t + " tail", t.upper()]
    for t in base[:12]:
        words = t.split()
        at, lo, hi = rnd.randrange(len(words) + 1), rnd.randrange(40), rnd.randrange(60, 121)
        texts.append(" ".join(words[:at]) + " " + " ".join(passage.split()[lo:hi]) + "\n" + " ".join(words[at:]))
    return texts + [" ".join(["same"] * 130), " ".join(["same"] * 90), prose(rnd, 60000)]


def words_of(text, lower=False):
    text = text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text) if w]


def brute_repeats(texts, length=50):
    first = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s:s + length]), i)
    out = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        gone = {j for s in range(len(w) - length + 1) if first[tuple(w[s:s + length])] < i for j in range(s, s + length)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = words_of(t, True)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_substrings_equal_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, corpus)).collect()}
    assert got == brute_repeats(corpus)


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, corpus)).collect()}
    assert got == brute_components(corpus)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rnd = random.Random(2)
    base = prose(rnd, 150, 5000).split()
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(len(w))] = f"n{i}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"a{i}" for i in range(80))
    docs = frame(spark, [long, long, long, long], [None, 7, 7, 9])
    near = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near) == [
        (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    cut = substrings.remove_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in cut) == [(-1, 0), (7, 0), (7, 0), (9, 80)]
    kept = lines.dedup_lines(frame(spark, ["a\nb\nc"] * 4, [None, 7, 7, 9])).collect()
    assert sorted((r.doc_id or -1, r.n_lines_removed, r.text) for r in kept) == [
        (-1, 0, "a\nb\nc"), (7, 0, "a\nb\nc"), (7, 0, "a\nb\nc"), (9, 3, "")]


def test_empty_tables(spark):
    empty = frame(spark, ["x"]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substrings.remove_repeats(empty).count() == neardup.near_duplicates(empty).count() == 0
    assert lines.dedup_lines(empty).count() == decontaminate.find(empty, bench).count() == 0
    assert quality.train(empty).score(empty).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_texts(empty, labels))
    docs = frame(spark, [None, "", "some words"])
    assert [r.predicted for r in model.score(docs).collect()] == [0, 0, 0]
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, F.col("vec_id") % 2 == 0).count() == 0


def test_lines(spark):
    texts = ["a\nb\nc\nd", "x\na\n\nb\nc\ny", None, "", "a\nb", "q\nq\nq\nq\nq", "c\nd\ne", "a\nb\nc\nd\ne"]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: ("a\nb\nc\nd", 0), 1: ("x\n\ny", 3), 2: (None, 0), 3: ("", 0), 4: ("a\nb", 0), 5: ("q", 4),
                   6: ("c\nd\ne", 0), 7: ("", 5)}


def test_line_dedup_is_native(spark):
    plan = lines.dedup_lines(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_index_finds_all(spark):
    rng = np.random.default_rng(1)
    for _ in range(60):
        symbols = int(rng.integers(2, 7))
        text = np.tile(rng.integers(0, symbols, rng.integers(1, 120)), int(rng.integers(1, 4)))
        index = fmindex.FMIndex(text, symbols)
        patterns = [p for p in (text[i:i + k] for i, k in zip(rng.integers(0, len(text), 20), rng.integers(1, 7, 20))) if (p > 0).all()]
        if not patterns:
            continue
        lengths = np.array([len(p) for p in patterns])
        rows = np.array([np.pad(p, (0, 6 - len(p))) for p in patterns])
        found = set(zip(*(x.tolist() for x in index.locate(*index.count(rows, lengths)))))
        assert found == {(i, j) for i, p in enumerate(patterns) for j in range(len(text) - len(p) + 1)
                         if (text[j:j + len(p)] == p).all()}


def brute_hits(texts, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for item, t in items:
        w = split(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            phrases.setdefault(tuple(w[i:i + k]), set()).add(item)
    sizes, out = {len(p) for p in phrases}, {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (p := tuple(w[i:i + k])) in phrases:
                    hit |= set(range(i, i + k))
                    found |= phrases[p]
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 40])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(4)
    items = [(i, prose(rnd, rnd.randint(8, 40), 12)) for i in range(6)] + [
        (6, None), (7, "..."), (8, "Short item"), (9, "short ITEM"), (None, "nobody knows"), (10, prose(rnd, 30, 12))]
    texts = [None, "", "?!", "a short, item here; nobody-knows", "SHORT-ITEM", "short item"]
    for _ in range(25):
        w = prose(rnd, rnd.randint(0, 150), 12).split()
        at = rnd.randrange(len(w) + 1)
        texts.append(" ".join(w[:at]) + " é " + str(rnd.choice(items)[1]).upper() + ", " + " ".join(w[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find(frame(spark, texts), bench).collect()}
    want = brute_hits(texts, items)
    assert {d: (r.n_words, r.n_hit, r.items) for d, r in got.items()} == want
    assert got[4].cleaned == "" and got[5].cleaned == "" and got[0].cleaned is None
    assert got[3].cleaned == "a  here; "


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(40)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[300:500] = x[300]                                      # a hot vector
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0, None] * 8, "x"), (None, [1.0] * 16, "x"),
             (904, [1.0, 2.0], "x"), (20, x[20].tolist(), "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 800, 20)) and len(got) == 40 * 20
    wide, hits = x.astype(np.float64), 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        score = wide @ wide[q]
        assert np.allclose([score[r.vec_id] for r in found], [r.score for r in found], rtol=0, atol=1e-12)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(found, found[1:]))
        others = [i for i in range(800) if i != q]
        hits += len({r.vec_id for r in found} & set(sorted(others, key=lambda i: (-score[i], i))[:20]))
    assert hits >= 0.9 * 800


def held_out(i, modulus, at):
    return zlib.crc32(str(i).encode()) % modulus == at


def auc(label, score):
    order = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_language_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op3_language"](spark, SF).collect()
    assert len(got) == len(lang) and all(r.held_out == held_out(r.doc_id, 3, 1) for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = language.identify(frame(spark, [None, "", "12 345 !", "é"]), {"en": b"the and of " * 50, "fr": b"\xc3\xa9 le la de " * 50}).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in odd)[:3] == [(0, "und"), (1, "und"), (2, "und")]


def test_quality_against_labels(spark):
    folder = SF.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = entry.queries()["op1_quality"](spark, folder).collect()
    mine = [(label[r.doc_id], r.score) for r in got if r.doc_id in label]
    assert auc(np.array([m[0] for m in mine]), np.array([m[1] for m in mine])) > 0.97
    docs = frame(spark, [None, "", "Some ordinary words in a sentence."])
    model = quality.train(docs)
    assert [r.doc_id for r in model.keep_good(docs).collect()] == [2]


def test_toxicity_on_held_out_rows(spark):
    folder = SF.replace("0.001", "0.1")
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = entry.queries()["op8_toxicity"](spark, folder).collect()
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.5) for r in got)
    test = [(label[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in label]
    assert auc(np.array([t[0] for t in test]), np.array([t[1] for t in test])) > 0.9


def trained(spark, toxic, ordinary):
    """A model from these texts, each ten times."""
    texts = [*toxic, *ordinary] * 10
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(t in toxic)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    return toxicity.train(toxicity.labelled_texts(docs, labels))


def test_toxicity_reads_whole_texts(spark):
    toxic = ["internationalscum", "black dog", "white cat", "\u043f\u0440\u0435\u0434\u0430\u0442\u0435\u043b\u044c"]
    ordinary = ["internationalpeace", "black cat", "white dog", "\u043f\u0440\u0435\u0434\u043b\u043e\u0433"]
    texts = [*toxic, *ordinary]
    got = {r.doc_id: r for r in trained(spark, toxic, ordinary).score(frame(spark, texts)).collect()}
    for i in range(4):
        assert got[i].ratio > 0 > got[i + 4].ratio and got[i].evidence > got[i + 4].evidence == 0, texts[i]


def test_toxicity_keeps_every_ngram(spark, monkeypatch):
    rnd = random.Random(3)
    toxic = [prose(rnd, 30, 900).replace("w", "t") for _ in range(10)]
    ordinary = [prose(rnd, 30, 900) for _ in range(10)]
    texts = [*toxic, *ordinary, None, "", "w1 t2", "unseen", " ".join([toxic[0]] * 50)]
    want = trained(spark, toxic, ordinary).score(frame(spark, texts)).orderBy("doc_id").collect()
    for hot in (300, 0):
        monkeypatch.setattr(toxicity, "HOT", hot)
        model = trained(spark, toxic, ordinary)
        assert model.tables.cold is not None and len(model.tables.held.ratio) <= hot
        got = model.score(frame(spark, texts)).orderBy("doc_id").collect()
        assert [r.doc_id for r in got] == [r.doc_id for r in want]
        for column in ("ratio", "evidence", "score"):
            assert np.allclose([r[column] for r in got], [r[column] for r in want]), (hot, column)


def test_sketches_lose_far_less_than_bands():
    n, k, s = neardup.SKETCH_BITS, neardup.SAMPLES, neardup.THRESHOLD / 100
    most = int(n / 2 * (1 - math.exp(4 * k / n * (s - neardup.SLACK - 1))))
    odd, z, lost = np.eye(1, n + 1)[0], np.arange(n + 1), 0.0
    for differ in range(k + 1):           # samples that differ; each flips two bits of the XOR
        chance = math.exp(math.lgamma(k + 1) - math.lgamma(differ + 1) - math.lgamma(k - differ + 1)
                          + differ * math.log(1 - s) + (k - differ) * math.log(s))
        lost += chance * odd[most + 1:].sum()
        for _ in range(2):
            odd = np.append(0, odd[:-1] * (n - z[:-1]) / n) + np.append(odd[1:] * z[1:] / n, 0)
    assert lost < 0.01 * (1 - s ** neardup.ROWS) ** neardup.BANDS


def test_pipeline_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    result = corpus_pipeline.run(spark, SF).collect()
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, now, SF)
    assert good.columns == columns
    good = {r.doc_id: r.text for r in good.collect()}
    assert set(good) <= set(docs) and all(docs[i].text == t for i, t in good.items())
    deduped = stages["line_dedup"](spark, frame(spark, list(good.values()), list(good)), SF).select("doc_id", "text").collect()
    order = sorted(good)
    near = stages["near_dedup"](spark, frame(spark, [r.text for r in deduped], [r.doc_id for r in deduped]), SF)
    text = {r.doc_id: r.text for r in deduped}
    brute = brute_components([text[i] for i in order])
    kept = {order[i] for i, (_, root) in brute.items() if root == i}
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == kept
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(left)
    hits = brute_hits([left[i] for i in ids], items)
    clean = {r.doc_id: r.text for r in stages["decontamination"](spark, frame(spark, [left[i] for i in ids], ids), SF).collect()}
    for n, i in enumerate(ids):
        assert (clean[i] == left[i]) == (hits[n][1] == 0)
    assert {r.doc_id: r.decoded_sha256 for r in result} == {
        i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in clean.items()}


SQL_CHECKED = ["op2_decontaminate", "op6_substring_dedup", "op7_near_duplicates", "op10_line_dedup"]


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in columns) for r in res.fetchall())
    assert sorted(names) == columns and sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
