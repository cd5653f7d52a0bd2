"""Files of vectors, neighbours and edges: written once, read back and validated in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_canonical_id, is_identifier, is_sha256
from .strict import read_csv, write_csv_verified


def _schema(**kinds: str) -> T.StructType:
    types = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()])


# The columns of the files.
RUN = _schema(run_id="string", vector_sha256="string", dimension="int", k="int", ids_sha256="string")
NEIGHBOURS = _schema(run_id="string", source_id="string", target_id="string", rank="int", cosine="double")
EDGES = _schema(run_id="string", a_id="string", b_id="string", cosine="double", a_rank="int", b_rank="int")


def _none(df: DataFrame, problem, what: str) -> DataFrame:
    """``df``, if the expression ``problem`` is true for no row."""
    bad = df.where(F.coalesce(problem, F.lit(True))).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")
    return df


def read_run(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, RUN)
    if rows.count() != 1:
        raise ValueError("a run has one row")
    return _none(rows, ~(is_identifier(F.col("run_id")) & is_sha256(F.col("vector_sha256")) & is_sha256(F.col("ids_sha256")) & (F.col("dimension") > 0) & (F.col("k") > 0)), "run")


def check_neighbours(rows: DataFrame, k: int) -> DataFrame:
    """Directed neighbours: canonical ids, no loops, cosines in [-1, 1], and of each source the ranks 1..k once, each target once."""
    _none(rows, ~(is_canonical_id(F.col("source_id")) & is_canonical_id(F.col("target_id")) & (F.col("source_id") != F.col("target_id")) & F.col("cosine").between(-1, 1) & F.col("rank").between(1, k)), "neighbour")
    per = rows.groupBy("run_id", "source_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.countDistinct("target_id").alias("targets"))
    _none(per, (F.col("n") != k) | (F.col("ranks") != k) | (F.col("targets") != k), "source")
    return rows


def check_edges(rows: DataFrame) -> DataFrame:
    """Undirected edges: canonical ids, the numerically smaller first, each pair once, a rank from one side at least."""
    a, b = F.col("a_id").cast("decimal(38,0)"), F.col("b_id").cast("decimal(38,0)")
    some = F.col("a_rank").isNotNull() | F.col("b_rank").isNotNull()
    _none(rows, ~(is_canonical_id(F.col("a_id")) & is_canonical_id(F.col("b_id")) & (a < b) & F.col("cosine").between(-1, 1) & some), "edge")
    _none(rows.groupBy("run_id", "a_id", "b_id").count(), F.col("count") != 1, "edge")
    return rows


def write_neighbours(rows: DataFrame, path: str, k: int) -> None:
    write_csv_verified(check_neighbours(rows.select(NEIGHBOURS.fieldNames()), k), path)


def read_neighbours(spark: SparkSession, path: str, k: int) -> DataFrame:
    return check_neighbours(read_csv(spark, path, NEIGHBOURS), k)


def write_edges(rows: DataFrame, path: str) -> None:
    write_csv_verified(check_edges(rows.select(EDGES.fieldNames())), path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return check_edges(read_csv(spark, path, EDGES))


def write_bundle(run: DataFrame, neighbours: DataFrame, edges: DataFrame, folder: str, k: int) -> None:
    """The three files of a run in a new folder, each read back and compared."""
    write_csv_verified(run.select(RUN.fieldNames()), f"{folder}/run")
    write_neighbours(neighbours, f"{folder}/neighbours", k)
    write_edges(edges, f"{folder}/edges")


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three files of a run; the edges must be those of the neighbours, and all of the one run."""
    run = read_run(spark, f"{folder}/run")
    name, k = run.select("run_id", "k").first()
    neighbours, edges = read_neighbours(spark, f"{folder}/neighbours", k), read_edges(spark, f"{folder}/edges")
    for df in (neighbours, edges):
        _none(df, F.col("run_id") != name, "row of another run")
    both = [F.col(c).cast("decimal(38,0)") for c in ("source_id", "target_id")]
    pairs = neighbours.select(F.least(*both).alias("a"), F.greatest(*both).alias("b")).distinct()
    stored = edges.select(F.col("a_id").cast("decimal(38,0)").alias("a"), F.col("b_id").cast("decimal(38,0)").alias("b"))
    if pairs.exceptAll(stored).limit(1).count() or stored.exceptAll(pairs).limit(1).count():
        raise ValueError("edges that are not those of the neighbours")
    return run, neighbours, edges


def write_vectors(vectors: DataFrame, path: str, column: str = "vector") -> None:
    """(id, name, v) as CSV with the vector as a JSON array of eight places; the path must not exist."""
    rounded = F.to_json(F.transform("v", lambda x: F.round(x, 8)))
    vectors.select(F.col("id").alias("cocktail_id"), F.col("name").alias("cocktail_name_ko"), rounded.alias(column)).write.mode("errorifexists").options(header=True, escape='"').csv(path)


def read_vectors(spark: SparkSession, path: str, column: str = "vector") -> DataFrame:
    """What write_vectors wrote, as (id, name, v): ids positive and unique, vectors finite and of one length."""
    schema = _schema(cocktail_id="long", cocktail_name_ko="string").add(column, T.StringType())
    rows = read_csv(spark, path, schema, escape='"').select(F.col("cocktail_id").alias("id"), F.col("cocktail_name_ko").alias("name"), F.from_json(column, "array<double>").alias("v"))
    _none(rows, ~((F.col("id") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))), "vector")
    _none(rows.groupBy("id").count(), F.col("count") != 1, "id")
    if rows.select(F.size("v")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of several lengths")
    return rows


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with their fields in the order of their names; the path must not exist."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("errorifexists").text(path)


def write_shards(requests: DataFrame, path: str, shards: int = 8) -> None:
    """Requests (axis_order and more) as JSON lines, a folder ``shard=n`` for each axis_order modulo the number of shards."""
    shard = F.pmod("axis_order", F.lit(shards)).alias("shard")
    requests.select(shard, F.to_json(F.struct(*sorted(requests.columns))).alias("value")).repartition("shard").write.mode("errorifexists").partitionBy("shard").text(path)
