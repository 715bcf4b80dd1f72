"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "quarry",
              shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the extraction jobs.

    On a cluster the builder picks up the existing session and its settings;
    the values here only fill in what is unset. AQE stays on so shuffle
    partition counts and skewed (project, rule) groups are re-planned at
    run time.
    """
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    builder = (
        SparkSession.builder
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    if master:  # else as spark-submit or the running session has it
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Only a single-process session (local tests) may leave it unset; it gets a
    private folder. On a cluster executors could not read each other's files
    there, so it is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting itself is fixed once a session runs; the context keeps the folder
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-ckpt-"))
        return spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df, what: str = "table"):
    """Write ``df`` once to the shared folder and read it back: the lineage
    ends here, a lost executor costs a re-read, and Spark knows the table's size."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/quarry/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
