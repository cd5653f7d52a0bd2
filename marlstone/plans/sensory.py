"""Queries of projection, ingestion, search and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domain, ingest, ledger, projection, search, selection, sphere, vectors
from ..session import table
from ..streaming.likes import likes_by_window

AXES = 12
BASIC = [0, 1, 2, 3, 4]


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """(id, axis_order, p): softmax of each five dimensions."""
    v = domain.vectors(spark, d)
    axes = v.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(AXES - 1)), lambda i: F.struct(i.alias("axis_order"), F.slice("v", i * 5 + 1, 5).alias("x")))).alias("a"))
    return axes.select("id", "a.axis_order", projection.softmax(F.col("a.x")).alias("p"))


def _registry(spark: SparkSession) -> DataFrame:
    return spark.range(AXES).select(F.col("id").cast("int").alias("axis_order"), (F.col("id") % 4).alias("category"))


def graph48_project(spark: SparkSession, d: str) -> DataFrame:
    return projection.graph_space(_axes(spark, d), _registry(spark)).select("id", F.col("axis_order").cast("long").alias("axis"), F.round("value", 6).alias("value"))


def preference48_project(spark: SparkSession, d: str) -> DataFrame:
    return projection.preference_space(_axes(spark, d), BASIC).select("id", F.col("axis_order").cast("long").alias("axis"), F.round("value", 6).alias("value"))


def regroup_axes(spark: SparkSession, d: str) -> DataFrame:
    return projection.regroup_axes(_axes(spark, d), AXES).select("id", F.size("raw").cast("long").alias("n"), F.round(F.aggregate(F.transform("raw", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("weighted"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    names = domain.parts(spark, d).groupBy("name").agg(F.min("id").alias("id")).select("id", "name", F.col("name").alias("name_en"))
    return search.search(names, "red wid", 20)


ALIASES = [("article", "the", "the", 0), ("article", "a", "a ", 1), ("link", "and", "and", 0), ("link", "of", "of ", 1)]


def extract_descriptors(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "category string, code string, alias string, ord int")
    return search.first_descriptors(table(spark, d, "documents").select("doc_id", "text"), aliases)


def kmedoids(spark: SparkSession, d: str) -> DataFrame:
    return selection.k_medoids(domain.vectors(spark, d), 8)


def kcenter_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.farthest_first(domain.parts(spark, d).select("id", F.array_union(F.split("name", " "), F.array("glass", "base_tag")).alias("features")), 10)


def cost_guard(spark: SparkSession, d: str) -> DataFrame:
    """The cost of all requests of the items, and whether a job for them may be made beside none."""
    requests = domain.parts(spark, d).count() * 48
    cost = ingest.batch_cost(requests, 845, 32, "0.15", "1.25", spark)
    verdict = ledger.guard(spark.createDataFrame([], ledger.SCHEMA), cost, "0.00")
    return cost.select("requests").crossJoin(F.broadcast(verdict)).select("requests", F.col("projected").cast("double").alias("projected"), "verdict")


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each label's vectors at unit length: its first and last coordinate."""
    pooled = sphere.mean_pooled(domain.vectors(spark, d).select(F.col("label").alias("owner"), "v"))
    return pooled.select("owner", F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


def wide_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as 64 columns and back: the weighted sum of the coordinates."""
    names = [f"d{i}" for i in range(64)]
    back = ingest.wide_to_vector(ingest.vector_to_wide(domain.vectors(spark, d), names), names)
    return back.select("id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda t, x: t + x), 6).alias("weighted"))


def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    """The share of the variance that each of eight principal components explains."""
    _, shares = vectors.pca(domain.vectors(spark, d), 8)
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(shares)], "component int, explained double")


def events_by_window(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the streaming count on a batch."""
    counted = likes_by_window(table(spark, d, "events"))
    return counted.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


_P = "WITH x AS (SELECT vec_id AS id, a AS axis, [embedding[a * 5 + 1]::DOUBLE, embedding[a * 5 + 2], embedding[a * 5 + 3], embedding[a * 5 + 4], embedding[a * 5 + 5]] AS v FROM embeddings, range(12) t(a)), e AS (SELECT id, axis, exp(v[1] - list_max(v)) AS a, exp(v[2] - list_max(v)) AS b, exp(v[3] - list_max(v)) AS c, exp(v[4] - list_max(v)) AS d, exp(v[5] - list_max(v)) AS e FROM x), "
_ALL = [
    ("graph48_project", graph48_project, _P + "g AS (SELECT id, axis, (0.25 * b + 0.5 * c + 0.75 * d + e) / (a + b + c + d + e) * sqrt(1 / 3.0) AS y FROM e) SELECT id, axis, round(y / sqrt(sum(y * y) OVER (PARTITION BY id)), 6) AS value FROM g"),
    ("preference48_project", preference48_project, _P + "g AS (SELECT 1) SELECT id, axis, round(CASE WHEN axis < 5 THEN (0.2 * b + 0.65 * c + d + 0.8 * e) ELSE (0.25 * b + 0.5 * c + 0.75 * d + e) END / (a + b + c + d + e), 6) AS value FROM e"),
    ("regroup_axes", regroup_axes, _P + "g AS (SELECT id, (axis * 5 * (a + b + c + d + e) + a + 2 * b + 3 * c + 4 * d + 5 * e) / (a + b + c + d + e) AS y FROM e) SELECT id, count(*) * 5 AS n, round(sum(y), 6) AS weighted FROM g GROUP BY id"),
    ("extract_descriptors", extract_descriptors, "SELECT doc_id, category, code, place FROM (SELECT doc_id, category, code, instr(text, alias) AS place, row_number() OVER (PARTITION BY doc_id, category ORDER BY instr(text, alias), ord) AS r FROM documents, (VALUES ('article', 'the', 'the', 0), ('article', 'a', 'a ', 1), ('link', 'and', 'and', 0), ('link', 'of', 'of ', 1)) t(category, code, alias, ord) WHERE contains(text, alias)) WHERE r = 1"),
    ("events_by_window", events_by_window, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    ("mean_pool", mean_pool, "SELECT owner, round(max(CASE WHEN pos = 1 THEN x END) / sqrt(sum(x * x)), 6) AS first, round(max_by(x, pos) / sqrt(sum(x * x)), 6) AS last FROM (SELECT label AS owner, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY owner"),
    ("wide_round_trip", wide_round_trip, "SELECT id, round(sum(x * pos), 6) AS weighted FROM (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY id"),
    ("pca_explained", pca_explained, ""), ("name_search", name_search, ""), ("kmedoids", kmedoids, ""), ("kcenter_select", kcenter_select, ""), ("cost_guard", cost_guard, "SELECT requests, projected, CASE WHEN projected >= 10 THEN 'hard block' WHEN projected >= 7.5 THEN 'soft stop' ELSE 'allowed' END AS verdict FROM (SELECT requests, CAST(0.5 + requests * (845 * 0.15 + 32 * 1.25) / 1000000 AS DOUBLE) AS projected FROM (SELECT count(*) * 48 AS requests FROM part))"),
]
QUERIES = {name: f for name, f, _ in _ALL}
ORACLES = {name: sql for name, _, sql in _ALL if sql}
