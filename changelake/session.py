"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest side, in bytes of the optimizer's estimate, that a plan may treat as small.
SMALL_SIDE_BYTES = 32 * 1024 * 1024

_LOCAL_SHARED: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "changelake", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on. Cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Epoch values of the change events only round-trip when the session runs in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder (own one only in local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        root = _LOCAL_SHARED.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{root.rstrip('/')}/changelake/{purpose}-{uuid.uuid4().hex[:12]}"


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan (for file scans: from the file sizes)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = SMALL_SIDE_BYTES) -> bool:
    """True when the estimate proves that the frame fits a broadcast."""
    return estimated_bytes(df) <= limit
