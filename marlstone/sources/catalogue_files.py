"""Strict files of the catalogue: descriptions, coordinates, expected neighbour sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_canonical_id
from .strict import read_csv
from .vector_files import NEIGHBOURS, _none, _schema

# The columns of the files.
TASTE = _schema(cocktail_id="string", cocktail_name_ko="string", cocktail_name_en="string", embedding_text="string", updated_at="string")
COORDINATES = _schema(cocktail_id="string", x="double", y="double", z="double")


def read_taste(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, text) of at least two items: positive unique ids, names and texts that are not blank, trimmed. A byte order mark is let pass."""
    rows = read_csv(spark, path, TASTE, escape='"')
    number = F.col("cocktail_id").try_cast("long")
    bad = F.coalesce(number <= 0, F.lit(True)) | (F.trim(F.coalesce("cocktail_name_ko", F.lit(""))) == "") | (F.trim(F.coalesce("embedding_text", F.lit(""))) == "")
    checked = _none(rows, bad, "an item without a positive id, a name or a text").select(number.alias("id"), F.trim("cocktail_name_ko").alias("name"), F.trim("embedding_text").alias("text"))
    _none(checked.groupBy("id").count(), F.col("count") > 1, "a repeated id")
    if checked.limit(2).count() < 2:
        raise ValueError("at least two items are needed")
    return checked


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(cocktail_id, x, y, z): canonical unique ids, finite numbers, at least one row."""
    rows = read_csv(spark, path, COORDINATES)
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    _none(rows, ~(is_canonical_id(F.col("cocktail_id")) & finite), "coordinates")
    _none(rows.groupBy("cocktail_id").count(), F.col("count") > 1, "a repeated id")
    if not rows.limit(1).count():
        raise ValueError("no coordinates")
    return rows


def read_expected(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(source_id, targets: sorted array) of a file of directed neighbours: canonical ids, no loops, each target once, k a source."""
    rows = read_csv(spark, path, NEIGHBOURS)
    _none(rows, ~(is_canonical_id(F.col("source_id")) & is_canonical_id(F.col("target_id")) & (F.col("source_id") != F.col("target_id"))), "neighbour")
    sets = rows.groupBy("source_id").agg(F.sort_array(F.collect_set("target_id")).alias("targets"), F.count("*").alias("n"))
    return _none(sets, (F.col("n") != k) | (F.size("targets") != k), "source").select("source_id", "targets")
