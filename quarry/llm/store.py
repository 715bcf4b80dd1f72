"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Only a single-process
    session (``local`` master, tests) may leave it unset; it then gets a
    private folder. On a cluster an unset folder is an error: executors could
    not read each other's files."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not context.getCheckpointDir():  # the setting itself is fixed once a session runs
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-llm-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quarry-llm/{what}-{uuid.uuid4().hex}"


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage ends here, and a
    lost executor costs a re-read instead of a recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def release(*kept: DataFrame) -> None:
    """Remove tables of ``keep`` that no later step reads."""
    for df in kept:
        spark, path = df.sparkSession, df.kept_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
