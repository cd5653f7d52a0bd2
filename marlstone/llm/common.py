"""Helpers that several operators share: lineage cuts and paths in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_dir

__all__ = ["cut", "dropped", "fresh_path", "map_pandas", "shared_dir", "written"]


def map_pandas(df: DataFrame, of: Callable, types: str, *ids: str) -> DataFrame:
    """``df.mapInPandas`` in which the columns ``ids`` are text within and have their own type again after: pandas would hold long ids beside a null as doubles."""
    kinds = {c: df.schema[c].dataType for c in ids if not isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))}
    out = df.withColumns({c: F.col(c).cast("string") for c in kinds}) if kinds else df
    named = ", ".join(f"{c} {out.schema[c].dataType.simpleString()}" for c in ids)
    out = out.mapInPandas(of, f"{named}, {types}")
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) if kinds else out


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: a cut of the lineage that is compressed and read by column."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes the files of what ``written`` gave, once nothing will read them."""
    files = table.inputFiles()
    if files:
        session = table.sparkSession
        folder = session._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
