"""Registered queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm.store import small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{folder}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    import corpus_pipeline
    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    import corpus_pipeline
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


# ---- 10. Line dedup -------------------------------------------------------------------------

@query("op10_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
solid AS (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS nth
          FROM lines WHERE trim(line, ' ') <> ''),
windows AS (SELECT a.doc_id, a.nth, a.line AS l1, b.line AS l2, c.line AS l3 FROM solid a
            JOIN solid b ON a.doc_id = b.doc_id AND b.nth = a.nth + 1
            JOIN solid c ON a.doc_id = c.doc_id AND c.nth = a.nth + 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, nth) AS k FROM windows),
covered AS (SELECT DISTINCT doc_id, nth + d AS nth FROM ranked, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
gone AS (SELECT s.doc_id, s.pos FROM solid s JOIN covered c ON s.doc_id = c.doc_id AND s.nth = c.nth),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines
         ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(c.n, 0)::BIGINT AS n_lines_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id""")
def _lines(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.lines import dedup_lines
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# ---- 5. Token counts ------------------------------------------------------------------------

@query("op5_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers
    from changelake.llm.token_count import count_tokens
    return count_tokens(table(spark, folder, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


# ---- 9. Byte-level BPE encoding and decoding --------------------------------------------------

@query("op9_byte_bpe")
def _byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers
    from changelake.llm import bytebpe
    ranks = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, folder, "documents"), ranks, tokenizers.PATTERN)
    return bytebpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- 2. Benchmark decontamination -------------------------------------------------------------

@query("op2_decontaminate", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
              unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS p
            FROM b WHERE len(w) > 0),
windows AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i,
              unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p
            FROM d, (SELECT DISTINCT k FROM phrases) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, w.k, item_id FROM windows w JOIN phrases USING (k, p)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (
                SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
            SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""")
def _decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm import decontaminate
    found = decontaminate.find(table(spark, folder, "documents").select("doc_id", "text"),
                               table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


# ---- 7. MinHash near-duplicates ---------------------------------------------------------------

@query("op7_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
           FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * i >= 75 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id""")
def _near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.neardup import near_duplicates
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


# ---- 6. Substring dedup -----------------------------------------------------------------------

@query("op6_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
              unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i + 49], ' '))) AS t
            FROM w WHERE len(w) >= 50),
first AS (SELECT t, min(doc_id) AS lo FROM windows GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN first USING (t) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN counts c ON w.doc_id = c.doc_id""")
def _substrings(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.substrings import remove_repeats
    return remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# ---- 8. Toxicity ------------------------------------------------------------------------------

def fold(modulus: int, key: str = "doc_id"):
    """The remainder that splits training from held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


@query("op8_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm import toxicity
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold(5) != 0)
    model = toxicity.train(toxicity.labelled_texts(docs, labels))
    return model.score(docs).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "ratio", "evidence")


# ---- 3. Language identification ---------------------------------------------------------------

@query("op3_language")
def _language(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm import language
    docs = table(spark, folder, "documents")
    dictionaries = language.train(docs.where(fold(3) != 1).select("text", "lang"))
    return language.identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


# ---- 1. Quality classifier --------------------------------------------------------------------

@query("op1_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm import quality
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.train(docs).score(docs)


# ---- 4. Approximate nearest neighbours --------------------------------------------------------

@query("op4_nearest_neighbours")
def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.ann import search
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


# ---- 11. SimHash near-duplicates --------------------------------------------------------------

@query("op11_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.simhash import near_duplicates
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---- 12. Periodic runs ------------------------------------------------------------------------

def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten gets a periodic end, as the contract of op12 sets out."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    w = w.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        "a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    end = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("w", F.col("a") + i % F.col("p")))
    planted = F.array_join(F.concat(F.slice("w", 1, "a"), end), " ")
    return w.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def _periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from changelake.llm.runs import periodic_runs
    found = periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# ---- 13. Cross-tokenizer alignment ------------------------------------------------------------

@query("op13_alignment")
def _alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers
    from changelake.llm.alignment import align_documents
    found = align_documents(table(spark, folder, "documents"), tokenizers.path("byte_bpe_50k.json"),
                            tokenizers.PATTERN, tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
