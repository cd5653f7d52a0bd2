"""Queries over vectors and their neighbour graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import domain, graphs, pairs, rowwise, vectors
from ..session import cut
from .relations import RELATIONS, K, duckdb_sql, spark_sql

SHARED = {
    "knn_topk": "SELECT src, dst, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM @knn",
    "union_edges": "SELECT a_id, b_id, round(score, 6) AS score, CAST(a_rank AS BIGINT) AS a_rank, CAST(b_rank AS BIGINT) AS b_rank, mutual FROM @edges",
    "all_pairs": "SELECT src AS a_id, dst AS b_id, round(score, 6) AS score FROM @pairs WHERE src < dst",
    "recommendations_for": "SELECT dst, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM @knn WHERE src = 17",
    "coord_knn": "SELECT src, dst, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM @cknn",
    "rank_matrix": "SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank FROM @pairs",
    "recall_at_k": "SELECT round(avg(hits) / 5, 9) AS recall, round(avg(CASE WHEN hits = 5 THEN 1.0 ELSE 0.0 END), 9) AS full_recovery, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) AS any_hit, round(avg(hits), 9) AS mean_matches FROM (SELECT k.src, count(c.dst) AS hits FROM @knn k LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) t",
    "topk_parity": "SELECT count(*) AS sources, count_if(hits = 5) AS same_sets FROM (SELECT k.src, count(c.dst) AS hits FROM @knn k LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) t",
    "true_rank_summary": "SELECT round(PCT(r.rank, 0.5), 6) AS median_rank, round(PCT(r.rank, 0.9), 6) AS p90_rank, max(r.rank) AS max_rank, round(avg(CASE WHEN r.rank <= 10 THEN 1.0 ELSE 0.0 END), 9) AS recall_10, round(avg(CASE WHEN r.rank <= 20 THEN 1.0 ELSE 0.0 END), 9) AS recall_20, round(avg(CASE WHEN r.rank <= 50 THEN 1.0 ELSE 0.0 END), 9) AS recall_50 FROM @knn k JOIN (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank FROM @cpairs) r ON k.src = r.src AND k.dst = r.dst",
    "intruders": "SELECT count(*) AS n, count(DISTINCT r.src) AS sources, round(PCT(r.rank, 0.5), 6) AS median_rank, round(PCT(r.rank, 0.9), 6) AS p90_rank, max(r.rank) AS max_rank FROM @cknn c JOIN (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank FROM @pairs) r ON c.src = r.src AND c.dst = r.dst LEFT JOIN @knn k ON c.src = k.src AND c.dst = k.dst WHERE k.src IS NULL",
    "inspection_table": "SELECT k.src, count(c.dst) AS hits, min(r.rank) AS best_coordinate_rank, max(r.rank) AS worst_coordinate_rank FROM @knn k JOIN (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank FROM @cpairs) r ON k.src = r.src AND k.dst = r.dst LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src",
    "containment": "SELECT round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 9) AS containment FROM @knn k JOIN @v a ON a.id = k.src JOIN @v b ON b.id = k.dst",
    "cluster_flow": "SELECT f.ca, f.cb, round((f.n + coalesce(g.n, 0)) / sqrt(sa.n * 1.0 * sb.n), 9) AS flow FROM (SELECT a.label AS ca, b.label AS cb, count(*) AS n FROM @knn k JOIN @v a ON a.id = k.src JOIN @v b ON b.id = k.dst GROUP BY 1, 2) f LEFT JOIN (SELECT b.label AS ca, a.label AS cb, count(*) AS n FROM @knn k JOIN @v a ON a.id = k.src JOIN @v b ON b.id = k.dst GROUP BY 1, 2) g ON f.ca = g.ca AND f.cb = g.cb JOIN (SELECT label, count(*) AS n FROM @v GROUP BY label) sa ON sa.label = f.ca JOIN (SELECT label, count(*) AS n FROM @v GROUP BY label) sb ON sb.label = f.cb",
    "within_cluster_recall": "SELECT round(avg(hit), 9) AS recall FROM (SELECT k.src, avg(CASE WHEN c.dst IS NULL THEN 0.0 ELSE 1.0 END) AS hit FROM (SELECT * FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY p.score DESC, p.dst) AS r FROM @pairs p JOIN @v a ON a.id = p.src JOIN @v b ON b.id = p.dst AND a.label = b.label) x WHERE r <= 5) k LEFT JOIN (SELECT * FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY p.score DESC, p.dst) AS r FROM @cpairs p JOIN @v a ON a.id = p.src JOIN @v b ON b.id = p.dst AND a.label = b.label) y WHERE r <= 5) c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) t",
    "nonedge_sample": "SELECT src, dst, CAST(r AS BIGINT) AS r FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY sha2(concat('7', char(0), CAST(p.src AS STRING), char(0), CAST(p.dst AS STRING)), 256), p.dst) AS r FROM @pairs p LEFT JOIN @edges e ON e.a_id = least(p.src, p.dst) AND e.b_id = greatest(p.src, p.dst) WHERE e.a_id IS NULL) t WHERE r <= 3",
    "ranking_triples": "SELECT k.src AS center, k.dst AS near_id, n.dst AS far_id FROM (SELECT a_id AS src, b_id AS dst FROM @edges UNION ALL SELECT b_id, a_id FROM @edges) k JOIN (SELECT src, dst FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY sha2(concat('7', char(0), CAST(p.src AS STRING), char(0), CAST(p.dst AS STRING)), 256), p.dst) AS r FROM @pairs p LEFT JOIN @edges e ON e.a_id = least(p.src, p.dst) AND e.b_id = greatest(p.src, p.dst) WHERE e.a_id IS NULL) t WHERE r <= 2) n ON n.src = k.src",
    "query_recall": "SELECT round(sum(CASE WHEN k.rank <= 1 AND c.rank <= 1 THEN 1.0 ELSE 0.0 END) / count(DISTINCT k.src), 9) AS recall_1, round(sum(CASE WHEN k.rank <= 3 AND c.rank <= 3 THEN 1.0 ELSE 0.0 END) / (3 * count(DISTINCT k.src)), 9) AS recall_3, round(sum(CASE WHEN c.rank <= 5 THEN 1.0 ELSE 0.0 END) / (5 * count(DISTINCT k.src)), 9) AS recall_5, round(avg(k.score), 6) AS mean_score FROM @knn k LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst",
    "precision_lift": "SELECT round(avg(p), 9) AS precision_at_5, round(avg(p / share), 9) AS lift FROM (SELECT a.label, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS p, max(s.share) AS share FROM @knn k JOIN @v a ON a.id = k.src JOIN @v b ON b.id = k.dst JOIN (SELECT label, count(*) * 1.0 / (SELECT count(*) FROM @v) AS share FROM @v GROUP BY label) s ON s.label = a.label GROUP BY a.label) t",
    "spot_check": "SELECT CAST(k.rank AS BIGINT) AS rank, k.dst AS in_vectors, c.dst AS in_coordinates, o.src IS NOT NULL AS shared FROM @knn k JOIN @cknn c ON c.src = k.src AND c.rank = k.rank LEFT JOIN @cknn o ON o.src = k.src AND o.dst = k.dst WHERE k.src = 17",
    "assert_same_ids": "SELECT count_if(a.id IS NULL OR b.id IS NULL) AS mismatched, count(*) AS n FROM @v a FULL JOIN @c b ON a.id = b.id",
    "layout_gates": "SELECT 'recall_at_5' AS gate, round(avg(hits) / 5, 9) AS value, avg(hits) / 5 >= 0.6 AS passed FROM (SELECT k.src, count(c.dst) AS hits FROM @knn k LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) t UNION ALL SELECT 'any_hit', round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9), avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) >= 0.9 FROM (SELECT k.src, count(c.dst) AS hits FROM @knn k LEFT JOIN @cknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) u",
}

QUERIES = {name: spark_sql(text) for name, text in SHARED.items()}
ORACLES = {name: duckdb_sql(text).replace(" AS STRING)", " AS VARCHAR)").replace("sha2(", "sha256(").replace("), 256)", "))").replace("char(0)", "chr(0)") for name, text in SHARED.items()}


# the same results without all pairs: only the pairs asked for are ranked, and neighbours are sought within a label
_RANK = "(SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS BIGINT) AS rank FROM {}) r ON {}.src = r.src AND {}.dst = r.dst"
QUERIES["true_rank_summary"] = spark_sql(SHARED["true_rank_summary"].replace("@knn k JOIN " + _RANK.format("@cpairs", "k", "k"), "@knn_ranked r"))
QUERIES["intruders"] = spark_sql(SHARED["intruders"].replace("@cknn c JOIN " + _RANK.format("@pairs", "c", "c"), "@cknn_ranked r").replace("c.", "r."))
QUERIES["inspection_table"] = spark_sql(SHARED["inspection_table"].replace("@knn k JOIN " + _RANK.format("@cpairs", "k", "k"), "@knn_ranked r").replace("k.", "r."))
QUERIES["within_cluster_recall"] = spark_sql("SELECT round(avg(hit), 9) AS recall FROM (SELECT k.src, avg(CASE WHEN c.dst IS NULL THEN 0.0 ELSE 1.0 END) AS hit FROM @lknn k LEFT JOIN @lcknn c ON k.src = c.src AND k.dst = c.dst GROUP BY k.src) t")


#: Of each user the five latest likes, of each the five nearest that the user does not like, of an item the best score, then the five best.
_FAVOR = "SELECT user_id, id, round(best, 4) AS similarity, CAST(r AS BIGINT) AS r FROM (SELECT user_id, id, best, row_number() OVER (PARTITION BY user_id ORDER BY round(best, 4) DESC, id) AS r FROM (SELECT user_id, id, max(score) AS best FROM (SELECT l.user_id, p.dst AS id, p.score, row_number() OVER (PARTITION BY l.user_id, l.item_id ORDER BY p.score DESC, p.dst) AS n FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id) AS recency FROM @likes) l JOIN @pairs p ON p.src = l.item_id LEFT JOIN @likes o ON o.user_id = l.user_id AND o.item_id = p.dst WHERE l.recency <= 5 AND o.item_id IS NULL) c WHERE n <= 5 GROUP BY user_id, id) b) t WHERE r <= 5"


#: So many of the least digests are looked at before the edges are known.
DEPTH = 8


def _nonedges(spark: SparkSession, d: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst, r): of each row the ``count`` rows without an edge to it whose digest is least; and both directions of the edges."""
    v = domain.vectors(spark, d)
    edges = vectors.union_edges(vectors.knn(v, K))
    ends = cut(edges.selectExpr("a_id as src", "b_id as dst").union(edges.selectExpr("b_id", "a_id")))

    def free(depth: int, sources: DataFrame | None) -> DataFrame:
        left = vectors.least_digests(v, depth, "7", sources).join(ends, ["src", "dst"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("src").orderBy("digest", "dst"))
        return left.withColumn("r", rank.cast("long")).where(F.col("r") <= count).select("src", "dst", "r")

    first = cut(free(DEPTH, None))
    # a row with edges among its least: as many more as the most edges that such a row has
    enough = first.where(F.col("r") == count).select("src")
    short = v.join(enough.withColumnRenamed("src", "id"), "id", "left_anti")
    most = ends.join(short.select(F.col("id").alias("src")), "src").groupBy("src").count().agg(F.max("count")).first()[0]
    if most is None:
        return first, ends
    return first.join(enough, "src", "left_semi").unionByName(free(count + most, short)), ends


def nonedge_sample(spark: SparkSession, d: str) -> DataFrame:
    return _nonedges(spark, d, 3)[0]


def ranking_triples(spark: SparkSession, d: str) -> DataFrame:
    far, ends = _nonedges(spark, d, 2)
    return ends.select(F.col("src").alias("center"), F.col("dst").alias("near_id")).join(far.select(F.col("src").alias("center"), F.col("dst").alias("far_id")), "center")


def spot_check(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of item 17 among the vectors and in the layout, rank by rank: one scan of each."""

    def near(points: DataFrame, name: str) -> DataFrame:
        unit = vectors.normalised(points.select("id", "v"))
        query = unit.where("id = 17").first()
        found = vectors.nearest_to(unit, query["v"], K, "cosine", [17]) if query else unit.select("id", F.lit(0.0).alias("score")).limit(0)
        return found.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"), F.col("id").alias(name))

    one, other = near(domain.vectors(spark, d), "in_vectors"), near(domain.coordinates(spark, d), "in_coordinates")
    known = other.select(F.col("in_coordinates").alias("in_vectors"), F.lit(True).alias("shared"))
    return one.join(other, "rank").join(known, "in_vectors", "left").select("rank", "in_vectors", "in_coordinates", F.coalesce("shared", F.lit(False)).alias("shared"))


def rank_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every other row's rank by cosine, row by row: a row's others are sorted in the task that looks at it."""
    v = domain.vectors(spark, d)
    table = rowwise.stored(v)

    def look(ids):
        def met(first, own):
            unit, scores = pairs.unit(own), np.empty((len(own), len(ids)))
            for place, v in table.between(0, len(ids)):
                scores[:, place : place + len(v)] = rowwise.scaled(unit, pairs.unit(v))
            for i in range(len(own)):
                by = rowwise.descending(scores[i])
                by = by[by != first + i]
                yield pa.RecordBatch.from_pydict({"src": np.full(len(by), ids[first + i]), "dst": ids[by], "rank": np.arange(1, len(by) + 1)})

        return met, lambda: iter(())

    return rowwise.each_with_all(v, table, look, "src long, dst long, rank long", 16)


def layout_gates(spark: SparkSession, d: str) -> DataFrame:
    """The layout's recall against its gates: the hits of each row are counted once for both."""
    near, placed = RELATIONS["knn"][0](spark, d).select("src", "dst"), RELATIONS["cknn"][0](spark, d).select("src", "dst", F.lit(1).alias("hit"))
    hits = near.join(placed, ["src", "dst"], "left").groupBy("src").agg(F.count("hit").alias("hits"))
    recall, any_hit = F.avg("hits") / K, F.avg((F.col("hits") > 0).cast("double"))
    gate = lambda name, value, bound: F.struct(F.lit(name).alias("gate"), F.round(value, 9).alias("value"), (value >= bound).alias("passed"))
    return hits.agg(F.array(gate("recall_at_5", recall, 0.6), gate("any_hit", any_hit, 0.9)).alias("gates")).select(F.inline("gates"))


def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its cosine: compared once and rounded in the tile where it meets."""
    v = domain.vectors(spark, d)
    return pairs.each(v, vectors.width(v), "score", lambda scores: pairs.rounded(scores, 6)).withColumnsRenamed({"src": "a_id", "dst": "b_id"})


QUERIES |= {f.__name__: f for f in (nonedge_sample, ranking_triples, spot_check, rank_matrix, layout_gates, all_pairs)}


#: So many neighbours beyond five are looked at first.
SHALLOW = 8


def favor_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Items near a user's latest likes. Of n liked items, at most n stand among an item's nearest 5 + n, so no more neighbours are needed than those of the user with the most."""
    v = domain.vectors(spark, d)
    likes = domain.likes(spark, d)
    recent = likes.withColumn("recency", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "item_id"))).where("recency <= 5")
    known = likes.join(v.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    most = known.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    liked = known.select("user_id", F.col("item_id").alias("id"))

    def near(depth: int, sources: DataFrame | None = None) -> DataFrame:
        return vectors.knn(v, depth, sources=sources).select(F.col("src").alias("item_id"), F.col("dst").alias("id"), "score")

    def unliked(pairs: DataFrame, near: DataFrame) -> DataFrame:
        met = pairs.join(near, "item_id").join(liked, ["user_id", "id"], "left_anti")
        return met.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(F.col("score").desc(), "id"))).where("n <= 5")

    # most users like few of an item's nearest: only the items where these leave too few get a whole list
    pairs = recent.select("user_id", "item_id")
    first = cut(unliked(pairs, near(min(K + SHALLOW, K + most))))
    if most > SHALLOW:
        enough = first.where(F.col("n") == 5).select("user_id", "item_id")
        short = cut(pairs.join(v.select(F.col("id").alias("item_id")), "item_id", "left_semi").join(enough, ["user_id", "item_id"], "left_anti"))
        first = first.join(enough, ["user_id", "item_id"], "left_semi")
        items = short.select(F.col("item_id").alias("id")).distinct()
        if not items.isEmpty():
            first = first.unionByName(unliked(short, near(K + most, v.join(items, "id", "left_semi"))))
    best = first.groupBy("user_id", "id").agg(F.round(F.max("score"), 4).alias("similarity"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("similarity").desc(), "id")).cast("long"))
    return ranked.where("r <= 5").select("user_id", "id", "similarity", "r")


def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """The five rows nearest to item 17 by cosine, itself excluded."""
    v = domain.vectors(spark, d)
    query = v.where("id = 17").first()["v"]
    return vectors.nearest_to(v, query, 5, "cosine", [17]).select("id", F.round("score", 4).alias("similarity"))


def mips_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five rows of largest inner product with vector 3."""
    v = domain.vectors(spark, d)
    return vectors.nearest_to(v, v.where("id = 3").first()["v"], 5, "dot").select("id", F.round("score", 6).alias("score"))


def mips_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every row ranked by its inner product with vector 3: distance, then id."""
    v = domain.vectors(spark, d)
    query = F.array(*[F.lit(x) for x in v.where("id = 3").first()["v"]])
    scored = v.select("id", F.round(-vectors.dot(F.col("v"), query), vectors.PLACES).alias("distance"))
    return scored.orderBy("distance", "id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")).cast("long")).select("id", "rank", F.round("distance", 6).alias("distance"))


MASK = {0: 0.5, 7: 0.25, 40: 0.25}


def mips_masked(spark: SparkSession, d: str) -> DataFrame:
    return vectors.masked_mips(domain.vectors(spark, d), MASK, 10).select("id", "rank", F.round("score", 6).alias("score"))


def taste_recommend(spark: SparkSession, d: str) -> DataFrame:
    """A category-balanced query (each active category has equal mass, shared inside it) scored by inner product."""
    chosen = spark.createDataFrame([(0, "a", 2.0), (1, "a", 1.0), (16, "b", 1.0)], "axis int, category string, weight double")
    mass = chosen.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("category"))).withColumn("share", F.col("share") / chosen.select("category").distinct().count())
    weights = {r["axis"]: r["share"] for r in mass.collect()}
    return vectors.masked_mips(domain.vectors(spark, d), weights, 8).select("id", "rank", F.round("score", 6).alias("score"))


def knn_euclid(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(domain.vectors(spark, d), K, "euclidean").select("src", "dst", "rank", F.round(-F.col("score"), 6).alias("distance"))


def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    return vectors.validate(domain.vectors(spark, d))


def topology_audit(spark: SparkSession, d: str) -> DataFrame:
    return graphs.edge_audit(vectors.knn(domain.vectors(spark, d), K), K)


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the mutual neighbour graph."""
    v = domain.vectors(spark, d)
    return graphs.components(v.select("id"), vectors.union_edges(vectors.knn(v, K)).where("mutual"))


def component_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each component of the union graph: its size, its medoid with the mean similarity to all members, and the first coordinate of its centroid."""
    v = domain.vectors(spark, d)
    members = graphs.components(v.select("id"), vectors.union_edges(vectors.knn(v, K)))
    found = graphs.component_summaries(v, members)
    return found.select("component", "n", "medoid", F.round("mean_score", 6).alias("mean_score"), F.round(F.col("centroid")[0], 6).alias("first"))


def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The unit mean of each label's vectors, one row per dimension."""
    each = domain.vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return each.withColumn("n", F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("m") / F.col("n"), 6).alias("value"))


def cluster_reps(spark: SparkSession, d: str) -> DataFrame:
    """The eight vectors of each label nearest to its centroid by cosine."""
    v = domain.vectors(spark, d)
    mean = v.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    scored = v.join(F.broadcast(mean), "label").withColumn("score", F.round(vectors.dot(F.col("v"), F.col("c")) / (vectors.norm(F.col("v")) * vectors.norm(F.col("c"))), 9))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where("rank <= 8").select("label", "id", "rank", F.round("score", 6).alias("score"))


_Q3 = "(SELECT v FROM v WHERE id = 3)"
_OWN = {
    "similar_items": (similar_items, "SELECT id, round(round(list_cosine_similarity(v, (SELECT v FROM v WHERE id = 17)), 12), 4) AS similarity FROM @v WHERE id <> 17 ORDER BY round(list_cosine_similarity(v, (SELECT v FROM v WHERE id = 17)), 12) DESC, id LIMIT 5"),
    "mips_topk": (mips_topk, f"SELECT id, round(list_dot_product(v, {_Q3}), 6) AS score FROM @v ORDER BY round(list_dot_product(v, {_Q3}), 12) DESC, id LIMIT 5"),
    "mips_rank": (mips_rank, f"SELECT id, row_number() OVER (ORDER BY round(-list_dot_product(v, {_Q3}), 12), id) AS rank, round(-list_dot_product(v, {_Q3}), 6) AS distance FROM @v ORDER BY rank LIMIT 100"),
    "mips_masked": (mips_masked, "SELECT id, row_number() OVER (ORDER BY round(0.5 * v[1] + 0.25 * v[8] + 0.25 * v[41], 12) DESC, id) AS rank, round(0.5 * v[1] + 0.25 * v[8] + 0.25 * v[41], 6) AS score FROM @v ORDER BY rank LIMIT 10"),
    "taste_recommend": (taste_recommend, "SELECT id, row_number() OVER (ORDER BY round(v[1] / 3 + v[2] / 6 + v[17] / 2, 12) DESC, id) AS rank, round(v[1] / 3 + v[2] / 6 + v[17] / 2, 6) AS score FROM @v ORDER BY rank LIMIT 8"),
    "knn_euclid": (knn_euclid, "SELECT src, dst, rank, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS rank FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) ** 2 AS dist FROM @v a JOIN @v b ON a.id <> b.id)) WHERE rank <= 5"),
    "vector_validate": (vector_validate, "SELECT count(*) AS n, count_if(v IS NULL OR len(v) = 0)::BIGINT AS empty_vectors, count_if(len(list_filter(v, lambda x: NOT isfinite(x))) > 0)::BIGINT AS non_finite, count_if(list_dot_product(v, v) <= 1e-24)::BIGINT AS zero_norms, count(DISTINCT len(v)) AS dimensions, count(*) - count(DISTINCT id) AS repeated_ids, count_if(id IS NULL)::BIGINT AS null_ids FROM @v"),
    "topology_audit": (topology_audit, "SELECT count_if(n <> 5)::BIGINT AS bad_sizes, count_if(ranks <> n OR low < 1 OR high > 5)::BIGINT AS bad_ranks, count_if(targets <> n)::BIGINT AS repeated_targets, (SELECT count(*) FROM @knn WHERE src = dst) AS loops, (SELECT count(*) FROM @knn a JOIN @knn b ON a.src = b.src AND b.rank = a.rank + 1 WHERE b.score > a.score OR (b.score = a.score AND b.dst < a.dst)) AS bad_order, (SELECT count(*) FROM @knn a JOIN @knn b ON a.src = b.dst AND a.dst = b.src WHERE abs(a.score - b.score) > 1e-9) AS bad_opposites FROM (SELECT src, count(*) AS n, count(DISTINCT rank) AS ranks, count(DISTINCT dst) AS targets, min(rank) AS low, max(rank) AS high FROM @knn GROUP BY src)"),
    "connected_components": (connected_components, ""),
    "cluster_centroids": (cluster_centroids, "SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM @v) GROUP BY label, pos)"),
    "cluster_reps": (cluster_reps, "SELECT label, id, rank, round(score, 6) AS score FROM (SELECT label, id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM (SELECT a.label, a.id, round(list_cosine_similarity(a.v, m.c), 9) AS score FROM @v a JOIN (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM @v) GROUP BY label, pos) GROUP BY label) m ON m.label = a.label)) WHERE rank <= 8"),
}
QUERIES |= {name: f for name, (f, _) in _OWN.items()}
ORACLES |= {name: duckdb_sql(sql) for name, (_, sql) in _OWN.items() if sql}
# components by a recursive walk over the mutual edges
ORACLES["connected_components"] = duckdb_sql("SELECT n.id, least(n.id, coalesce(w.low, n.id)) AS component FROM @v n LEFT JOIN (SELECT id, min(other) AS low FROM walk GROUP BY id) w ON w.id = n.id /* @edges */").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT n.id,", ", walk AS (SELECT a_id AS id, b_id AS other FROM edges WHERE mutual UNION SELECT b_id, a_id FROM edges WHERE mutual UNION SELECT w.id, CASE WHEN e.a_id = w.other THEN e.b_id ELSE e.a_id END FROM walk w JOIN edges e ON e.mutual AND (e.a_id = w.other OR e.b_id = w.other)) SELECT n.id,", 1)

#: Components of the union graph by a recursive walk, means over all pairs of members.
_WALK = ", ends AS MATERIALIZED (SELECT a_id AS id, b_id AS other FROM edges UNION SELECT b_id, a_id FROM edges), walk AS (SELECT id, other FROM ends UNION SELECT w.id, e.other FROM walk w JOIN ends e ON e.id = w.other), member AS MATERIALIZED (SELECT n.id, least(n.id, coalesce(w.low, n.id)) AS component FROM v n LEFT JOIN (SELECT id, min(other) AS low FROM walk GROUP BY id) w ON w.id = n.id)"
_SUMMARY = "SELECT m.component, m.n, m.id AS medoid, round(m.mean_score, 6) AS mean_score, round(c.first, 6) AS first FROM (SELECT component, id, mean_score, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY round(mean_score, 9) DESC, id) AS r FROM (SELECT a.component, a.id, (1 + coalesce(sum(p.score), 0)) / (1 + count(p.score)) AS mean_score FROM member a LEFT JOIN (SELECT p.src, p.score, b.component FROM @pairs p JOIN member b ON b.id = p.dst) p ON p.src = a.id AND p.component = a.component GROUP BY 1, 2) s) m JOIN (SELECT component, max(CASE WHEN pos = 1 THEN x END) / sqrt(sum(x * x)) AS first FROM (SELECT component, pos, avg(x) AS x FROM (SELECT b.component, generate_subscripts(v, 1) AS pos, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM @v a JOIN member b ON a.id = b.id) u GROUP BY 1, 2) u GROUP BY component) c ON c.component = m.component WHERE m.r = 1 /* @edges */"
QUERIES["component_summary"] = component_summary
ORACLES["component_summary"] = duckdb_sql(_SUMMARY).replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT m.component, m.n", _WALK + " SELECT m.component, m.n", 1)
QUERIES["favor_recommend"] = favor_recommend
ORACLES["favor_recommend"] = duckdb_sql(_FAVOR)
