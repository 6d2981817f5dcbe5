"""Session defaults for profiling jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Timestamps compare with other engines in UTC; AQE coalesces small shuffles
# and splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call-site capture per Column call doubles the time to build wide reports
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "crivo", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; the cluster's own settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """``shared_dir``; a local session without ``spark.checkpoint.dir``, as in tests, gets a temporary folder, any other is refused."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="crivo-"))
    return shared_dir(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back, so that a lost executor repeats nothing before it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """New folder name for intermediate tables, under the cluster's shared folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; without
    it there is none that all executors are known to share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share, or pass work_dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
