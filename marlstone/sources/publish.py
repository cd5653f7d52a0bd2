"""Publishing a folder as a whole: a lock, a staging folder, the manifest of hashes last, one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

MANIFEST = "manifest.json"


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, bytes) of the data files below a folder, hashed where they are read; names are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index(F.col("path"), f"{folder.rstrip('/').split('/')[-1]}/", -1)
    return files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def publish(spark: SparkSession, target: str, parts: dict[str, DataFrame], about: dict | None = None) -> dict:
    """Writes each of ``parts`` as a Parquet folder of that name below ``target``, which must not exist, and a manifest of all files' hashes; returns the manifest.

    Readers see either nothing or the whole folder. A second writer that comes while the first is at work fails on the lock, one that comes later on the folder.
    """
    parent, name = target.rstrip("/").rsplit("/", 1)
    store = Store(spark, parent)
    lock = f".{name}.lock"
    if not store.create(lock, ""):
        raise FileExistsError(f"{target} is being published by another writer")
    staging = f".{name}.{uuid.uuid4().hex}"
    try:
        if store.exists(name):
            raise FileExistsError(f"{target} is published already")
        for part, df in parts.items():
            df.write.parquet(f"{parent}/{staging}/{part}")
        files = {r["name"]: {"sha256": r["sha256"], "bytes": r["bytes"]} for r in _hashes(spark, f"{parent}/{staging}").collect()}  # (a row a file)
        manifest = {"files": files, "schemas": {p: df.schema.jsonValue() for p, df in parts.items()}} | (about or {})
        if not store.create(f"{staging}/{MANIFEST}", json.dumps(manifest, sort_keys=True)) or not store.rename(staging, name):
            raise FileExistsError(f"{target} is published already")
        return manifest
    finally:
        store.delete(staging)
        store.delete(lock)


def problems(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of a published folder against its manifest: files missing, undeclared or changed."""
    declared = json.loads(Store(spark, folder).read(MANIFEST))["files"]
    known = spark.createDataFrame([(n, f["sha256"]) for n, f in declared.items()], "name string, declared string")
    found = _hashes(spark, folder).where(F.col("name") != MANIFEST).select("name", "sha256")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("sha256") != F.col("declared"), "changed")
    return found.join(known, "name", "full").select("name", problem.alias("problem")).where("problem is not null")


def read_published(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """A part of a published folder, after all of its files were held against the manifest."""
    wrong = problems(spark, folder).limit(3).collect()
    if wrong:
        raise ValueError(f"{folder}: {[tuple(r) for r in wrong]}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{part}")
