"""Strict sources and sinks: exact CSV headers, no ragged or blank rows, create-only writes that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, escape: str = "\\") -> DataFrame:
    """CSV files whose headers, each file's own, must be the schema's names in order; blank and malformed rows fail the read, empty strings are null. A byte order mark is let pass in a single file."""
    options = {"nullValue": "", "escape": escape}
    first = spark.read.text(path).where("value <> ''").first()
    names = [] if first is None else list(spark.read.options(**options).csv(spark.sparkContext.parallelize([first["value"].lstrip("\ufeff").strip("\r")])).first())
    if names != schema.fieldNames():
        raise ValueError(f"header {names}, expected {schema.fieldNames()}")
    lines = spark.read.text(path)
    if lines.where(F.regexp_replace("value", "[,\\s]", "") == "").limit(1).count():
        raise ValueError("a blank row")
    # (the reader itself holds each file's header against the schema, but for a mark before the first name)
    marked = first["value"].startswith("\ufeff")
    if marked and len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError("a byte order mark in one of several files")
    return spark.read.schema(schema).options(header=True, enforceSchema=marked, mode="FAILFAST", **options).csv(path)


def write_csv_verified(df: DataFrame, path: str) -> None:
    """Writes to a path that must not exist, reads it back and fails where a row differs."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    back = df.sparkSession.read.schema(df.schema).options(header=True, nullValue="").csv(path)
    if df.exceptAll(back).limit(1).count() or back.exceptAll(df).limit(1).count():
        raise ValueError(f"{path} differs from what was written")


def manifest_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a folder against (name, sha256): rows (name, problem) that are missing, undeclared or changed."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    joined = files.join(manifest, "name", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "undeclared").when(F.col("found") != F.col("sha256"), "changed")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def read_registry(spark: SparkSession, path: str, schema: T.StructType, sha256: str, expected: DataFrame, order: str, texts: list[str]) -> DataFrame:
    """A small table in one CSV file that must have the given SHA-256, the schema's header, exactly the rows of ``expected`` (some of its columns) and no blank text in ``texts``; texts are trimmed and rows sorted by ``order``."""
    found = [r["h"] for r in spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).take(2)]
    if found != [sha256]:
        raise ValueError(f"{path} has another SHA-256 than the one named")
    rows = read_csv(spark, path, schema)
    named = rows.select(*expected.columns)
    if named.exceptAll(expected).limit(1).count() or expected.exceptAll(named).limit(1).count():
        raise ValueError(f"{path} has other rows than expected")
    blank = F.lit(False)
    for name in texts:
        blank = blank | F.coalesce(F.trim(name) == "", F.lit(True))
    if rows.where(blank).limit(1).count():
        raise ValueError(f"{path} has a blank text")
    return rows.withColumns({name: F.trim(name) for name in texts}).orderBy(order)
