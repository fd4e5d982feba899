"""Source-of-truth tables: Parquet folders, JDBC, CSV samples and JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(12,2)"
# Column types of the captured tables where they differ from the input files.
CASTS = {
    "region": {"r_regionkey": "int"},
    "nation": {"n_nationkey": "int", "n_regionkey": "int"},
    "customer": {"c_nationkey": "int", "c_acctbal": MONEY},
    "orders": {"o_totalprice": MONEY},
}
PRIMARY_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"],
                "region": ["r_regionkey"], "cdc_probe": ["probe_id"]}

Tables = Callable[[str], DataFrame]


def load_projection(df: DataFrame, table: str) -> DataFrame:
    """A source table with the column types the lake expects."""
    casts = CASTS.get(table, {})
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c)
                       for c in df.columns])


def parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """Access to ``<folder>/<table>.parquet`` with the load projections applied."""
    return lambda name: load_projection(spark.read.parquet(f"{folder}/{name}.parquet"), name)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
               partitions: int, **properties: str) -> DataFrame:
    """A table read over JDBC by parallel ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def key_quantiles(spark: SparkSession, url: str, table: str, key: str, partitions: int, **properties: str) -> list[int]:
    """Key values that cut a table into parts of about equal numbers of rows. Only the key column is read, in
    parallel by even ranges; minimum, maximum and count are answered by the database."""
    whole = (spark.read.format("jdbc").options(url=url, dbtable=table, pushDownAggregate="true", **properties).load()
             .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first())
    if not whole.n or partitions < 2 or whole.lo == whole.hi:
        return []
    keys = jdbc_table(spark, url, table, key, int(whole.lo), int(whole.hi) + 1, partitions, **properties).select(key)
    cuts = keys.agg(F.percentile_approx(key, [i / partitions for i in range(1, partitions)])).first()[0]
    return sorted({int(c) for c in cuts if c > whole.lo})


def jdbc_by_quantiles(spark: SparkSession, url: str, table: str, key: str, partitions: int, **properties: str) -> DataFrame:
    """A table read over JDBC in parts of about equal size, wherever its keys lie (even ranges of a key with gaps
    give one part most rows). Filters and columns of the query reach the database; rows without key come
    with the first part."""
    whole = spark.read.jdbc(url, table, properties=properties)
    name = next(c for c in whole.columns if c.lower() == key.lower())     # databases differ in the case of names
    cuts = key_quantiles(spark, url, table, name, partitions, **properties)
    if not cuts:
        return whole
    at = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)
    parts = [f"{at} < {cuts[0]} OR {at} IS NULL", *[f"{at} >= {a} AND {at} < {b}" for a, b in zip(cuts, cuts[1:])],
             f"{at} >= {cuts[-1]}"]
    return spark.read.jdbc(url, table, predicates=parts, properties=properties)


def jdbc_tables(spark: SparkSession, url: str, schema: str, partitions: int = 8,
                keys: dict[str, list[str]] = PRIMARY_KEYS, **properties: str) -> Tables:
    """Access to the tables of a database schema by name, with the load projections applied. Tables are cut by the
    first column of their primary key; those without a known one are read as a whole."""
    def read(name: str) -> DataFrame:
        full = f"{schema}.{name}"
        if name in keys:
            df = jdbc_by_quantiles(spark, url, full, keys[name][0], partitions, **properties)
        else:
            df = spark.read.jdbc(url, full, properties=properties)
        return load_projection(df.select(*[F.col(c).alias(c.lower()) for c in df.columns]), name)
    return read


def csv_sample(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')


def load_state(existing: DataFrame, expected: DataFrame) -> str:
    """``load`` an empty table, ``skip`` a loaded one; a partial one is an error."""
    have = existing.count()
    if not have:
        return "load"
    want = expected.count()
    if have < want:
        raise ValueError(f"has {have} of {want} rows from an interrupted load")
    return "skip"


REPORT_SCHEMA = ("started_at string, finished_at string, tables map<string, struct<"
                 "before: map<string,string>, after: map<string,string>, "
                 "steps: map<string, map<string,string>>>>")


def maintenance_reports(spark: SparkSession, folder: str, newer_than: str | None = None) -> DataFrame:
    """Step timings of maintenance report files: report, table, step, seconds, details."""
    reports = (spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").json(folder)
               .withColumn("file", F.col("_metadata.file_path"))
               .withColumn("modified", F.col("_metadata.file_modification_time")))
    if newer_than:
        reports = reports.where(F.col("modified") >= F.lit(newer_than).cast("timestamp"))
    return (reports.select("file", F.explode("tables").alias("table_name", "entry"))
            .select("file", "table_name", F.explode("entry.steps").alias("step", "details"))
            .withColumn("seconds", F.try_element_at("details", F.lit("seconds")).try_cast("double")))
