"""Session settings shared by the bench, the tests and the driver contract."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that decide results (time zone) or let Spark re-plan at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir`` (a file or a directory, in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session takes a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"/tmp/marlstone-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the shared folder: a lost executor costs no recomputation. Spark removes the files once the result is no longer referenced."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
