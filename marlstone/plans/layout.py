"""Quality metrics of a layout on the sphere against the vectors it came from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import domain, pairs, rowwise, selection, sphere, vectors
from ..session import cut
from .relations import RELATIONS, K, duckdb_sql, spark_sql

BANDS, SECTORS = 8, 16
CELLS = BANDS * SECTORS

_ANG = "acos(least(1.0, greatest(-1.0, score)))"
_BOTH = "SELECT src, dst, acos(least(1.0, greatest(-1.0, score))) AS a, acos(least(1.0, greatest(-1.0, placed))) AS b FROM @twins"
_SUMMARY = "round(min(x), 6) AS low, round(PCT(x, 0.1), 6) AS p10, round(PCT(x, 0.25), 6) AS p25, round(PCT(x, 0.5), 6) AS median, round(PCT(x, 0.75), 6) AS p75, round(PCT(x, 0.9), 6) AS p90, round(PCT(x, 0.95), 6) AS p95, round(max(x), 6) AS high, round(avg(x), 6) AS mean"

SHARED = {
    "dist_summary": f"SELECT {_SUMMARY} FROM (SELECT score AS x FROM @pairs WHERE src < dst) t",
    "nn_angles": f"SELECT {_SUMMARY} FROM (SELECT min({_ANG}) AS x FROM @cpairs GROUP BY src) t",
    "within_cluster_sep": "SELECT round(PCT(x, 0.1), 6) AS p10, round(PCT(x, 0.5), 6) AS median, round(avg(x), 6) AS mean FROM (SELECT min(degrees(acos(least(1.0, greatest(-1.0, p.score))))) AS x FROM @cpairs p JOIN @c a ON a.id = p.src JOIN @c b ON b.id = p.dst AND a.label = b.label GROUP BY p.src) t",
    "zscore_offdiag": "SELECT src, dst, round((score - m) / s, 6) AS z FROM @pairs CROSS JOIN (SELECT avg(score) AS m, stddev_pop(score) AS s FROM @pairs) t",
    "angle_corr": f"SELECT round(corr(a, b), 6) AS pearson FROM ({_BOTH}) t",
    "angle_spearman": f"SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM (SELECT round(a, 9) AS a, round(b, 9) AS b FROM ({_BOTH}) u) w) t",
    "edge_rmse": "SELECT round(sqrt(avg((s - p) * (s - p))), 6) AS rmse FROM (SELECT acos(least(1.0, greatest(-1.0, e.score))) AS s, acos(least(1.0, greatest(-1.0, a.x * b.x + a.y * b.y + a.z * b.z))) AS p FROM @edges e JOIN @c a ON a.id = e.a_id JOIN @c b ON b.id = e.b_id) t",
    "norm_error": "SELECT round(max(abs(sqrt(x * x + y * y + z * z) - 1)), 9) AS worst FROM @c",
    "normalized_stress": "SELECT round(sqrt(greatest(0.0, sdd - sdv * sdv / svv) / sdd), 6) AS stress, round(sdv / svv, 6) AS scale FROM (SELECT sum(d * d) AS sdd, sum(d * v) AS sdv, sum(v * v) AS svv FROM (SELECT 1 - score AS d, sqrt(greatest(0.0, 2 - 2 * placed)) AS v FROM @twins) u) t",
    "ks_uniform_sphere": f"SELECT round(max(greatest(r / n - cdf, cdf - (r - 1) / n)), 9) AS ks FROM (SELECT (1 - cos(x)) / 2 AS cdf, row_number() OVER (ORDER BY x) * 1.0 AS r, count(*) OVER () AS n FROM (SELECT {_ANG} AS x FROM @cpairs WHERE src < dst) u) t",
    "monotone_violations": f"SELECT count_if(b - prev < -1e-12) AS violations, count(*) AS n FROM (SELECT b, lag(b) OVER (PARTITION BY src ORDER BY a, dst) AS prev FROM ({_BOTH}) u) t",
    "stretch_deciles": f"SELECT decile, count(*) AS n, round(avg(b / a), 6) AS mean_stretch FROM (SELECT a, b, CASE WHEN a < q1 THEN 0 WHEN a < q2 THEN 1 WHEN a < q3 THEN 2 WHEN a < q4 THEN 3 WHEN a < q5 THEN 4 WHEN a < q6 THEN 5 WHEN a < q7 THEN 6 WHEN a < q8 THEN 7 WHEN a < q9 THEN 8 ELSE 9 END AS decile FROM ({_BOTH}) u CROSS JOIN (SELECT " + ", ".join(f"PCT(a, 0.{i}) AS q{i}" for i in range(1, 10)) + f" FROM ({_BOTH}) w) q) t GROUP BY decile",
    "cell_occupancy": "SELECT band, sector, count(*) AS n FROM (SELECT CAST(least(7, floor((z + 1) / 2 * 8)) AS BIGINT) AS band, CAST(least(15, floor((atan2(y, x) + pi()) / (2 * pi()) * 16)) AS BIGINT) AS sector FROM @c) t GROUP BY band, sector",
    "bias_metrics": "SELECT round(m.n, 9) AS mean_norm, round(CASE WHEN m.n < 1e-15 THEN 0.5 ELSE avg(CASE WHEN c.x * m.x + c.y * m.y + c.z * m.z >= 0 THEN 1.0 ELSE 0.0 END) END, 9) AS best_hemisphere FROM @c c CROSS JOIN (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, sqrt(avg(x) * avg(x) + avg(y) * avg(y) + avg(z) * avg(z)) AS n FROM @c) m GROUP BY m.n",
    "covering_radius": "SELECT round(max(near), 6) AS radius FROM (SELECT p.id, min(acos(least(1.0, greatest(-1.0, p.x * c.x + p.y * c.y + p.z * c.z)))) AS near FROM @probes p CROSS JOIN @c c GROUP BY p.id) t",
    "cluster_separation": f"SELECT round(avg(CASE WHEN same THEN g END), 6) AS intra, round(avg(CASE WHEN NOT same THEN g END), 6) AS inter, round(avg(CASE WHEN NOT same THEN g END) / avg(CASE WHEN same THEN g END), 6) AS separation FROM (SELECT a.label = b.label AS same, acos(least(1.0, greatest(-1.0, p.score))) AS g FROM @cpairs p JOIN @c a ON a.id = p.src JOIN @c b ON b.id = p.dst WHERE p.src < p.dst) t",
    "silhouette": "SELECT round(avg(s), 6) AS silhouette, round(PCT(s, 0.5), 6) AS median FROM (SELECT CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM (SELECT src, max(CASE WHEN same THEN m END) AS a, min(CASE WHEN NOT same THEN m END) AS b FROM (SELECT p.src, sb.label, sa.label = sb.label AS same, avg(acos(least(1.0, greatest(-1.0, p.score)))) AS m FROM @cpairs p JOIN @c sa ON sa.id = p.src JOIN @c sb ON sb.id = p.dst GROUP BY 1, 2, 3) u GROUP BY src) t) w",
    "centroid_spread": "SELECT round(min(g), 6) AS low, round(avg(g), 6) AS mean, round(max(g), 6) AS high FROM (SELECT acos(least(1.0, greatest(-1.0, (a.x * b.x + a.y * b.y + a.z * b.z) / (a.n * b.n)))) AS g FROM @means a JOIN @means b ON a.label < b.label WHERE a.n > 1e-12 AND b.n > 1e-12) t",
    "false_close_all": "SELECT count(*) AS false_close FROM (SELECT c.src, c.dst FROM @cknn c JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score, dst DESC) AS worst, count(*) OVER (PARTITION BY src) AS n FROM @pairs) p ON p.src = c.src AND p.dst = c.dst WHERE p.worst <= floor(p.n / 10)) t",
    "false_close_graph": "SELECT count(*) AS false_close FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY p.src ORDER BY p.score, p.dst DESC) AS worst, count(*) OVER (PARTITION BY p.src) AS n FROM @pairs p LEFT JOIN @edges e ON e.a_id = least(p.src, p.dst) AND e.b_id = greatest(p.src, p.dst) WHERE e.a_id IS NULL) w JOIN @cknn c ON c.src = w.src AND c.dst = w.dst WHERE w.worst <= greatest(1, ceil(w.n / 10))",
    "gate_check": "SELECT metric, value, bound, value <= bound AS passed FROM (SELECT 'norm_error' AS metric, round(max(abs(sqrt(x * x + y * y + z * z) - 1)), 9) AS value, 1e-12 AS bound FROM @c UNION ALL SELECT 'mean_norm', round(sqrt(avg(x) * avg(x) + avg(y) * avg(y) + avg(z) * avg(z)), 9), 0.4 FROM @c) t",
    "frontier_specs": "SELECT a.a, g.gamma, CASE WHEN a.a + (3.0 - a.a) * g.gamma / 2 > 4.5 THEN 'stretch too steep' END AS rejected FROM (SELECT 1 + n_nationkey / 20.0 AS a FROM @nation) a CROSS JOIN (SELECT 1.0 + r_regionkey / 2.0 AS gamma FROM @region) g",
    "relation_recall": "SELECT round(avg(CASE WHEN d.ca IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall FROM (SELECT ca, cb FROM (SELECT a.label AS ca, b.label AS cb, row_number() OVER (PARTITION BY a.label ORDER BY round(avg(p.score), 9) DESC, b.label) AS r FROM @pairs p JOIN @v a ON a.id = p.src JOIN @v b ON b.id = p.dst WHERE a.label <> b.label GROUP BY a.label, b.label) u WHERE r <= 3) s LEFT JOIN (SELECT ca, cb FROM (SELECT a.label AS ca, b.label AS cb, row_number() OVER (PARTITION BY a.label ORDER BY round(avg(p.score), 9) DESC, b.label) AS r FROM @cpairs p JOIN @c a ON a.id = p.src JOIN @c b ON b.id = p.dst WHERE a.label <> b.label GROUP BY a.label, b.label) w WHERE r <= 3) d ON d.ca = s.ca AND d.cb = s.cb",
}

QUERIES = {name: spark_sql(text) for name, text in SHARED.items()}
ORACLES = {name: duckdb_sql(text) for name, text in SHARED.items()}


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    """(id, v): the vectors followed by the layout's, and the widths of both."""
    return vectors.beside(domain.vectors(spark, d), domain.coordinates(spark, d))


def _placed(spark: SparkSession, d: str, first: int = 1) -> tuple[DataFrame, list[int]]:
    return domain.coordinates(spark, d, first).select("id", "v"), [3]


def _labelled(points: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """Vectors with their label as a tag; a row without one has NaN, which equals nothing."""
    return points.select("id", F.concat("v", F.array(F.coalesce(F.col("label").cast("double"), F.lit(float("nan"))))).alias("v")), [width]


def _quantiles(spark: SparkSession, n: int, found: dict[int, float], shares: dict[str, float], **more: float) -> DataFrame:
    """One row of quantiles of n values of which ``found`` has those around them; null without values."""
    row = {c: pairs.quantile(n, q, found.__getitem__) if n else None for c, q in shares.items()} | {c: x if n else None for c, x in more.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))


_SHARES = {"low": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "high": 1.0}


def dist_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of the cosines of all pairs, by a histogram and the values of the cells that hold them."""
    v = domain.vectors(spark, d)
    width = vectors.width(v)
    n, found = pairs.order_statistics(v, [width], lambda n: [p for q in _SHARES.values() for p in pairs.around(n, q)])
    total = pairs.summed(v, [width], lambda scores, *_: [scores[0]], ["total"]).first()["total"]
    row = _quantiles(spark, n, found, _SHARES, mean=total / max(1, n))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def angle_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of source and layout angles. Pairs whose cosines share one of ``pairs.FINE`` cells share the mean of their ranks."""
    rows, widths = _both(spark, d)
    ranks = [pairs.centred_ranks(counts) for counts in pairs.histograms(rows, widths, pairs.FINE)]
    known = spark.sparkContext.broadcast(ranks)

    def terms(scores, *_):
        a, b = (r.take(pairs.cell(s, pairs.FINE)) for r, s in zip(known.value, scores))
        return [a @ a, b @ b, a @ b]

    return pairs.summed(rows, widths, terms, ["aa", "bb", "ab"]).select(F.round(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")), 6).alias("spearman"))


def ks_uniform_sphere(spark: SparkSession, d: str) -> DataFrame:
    """The greatest distance of the pair angles' steps from those of the uniform sphere."""
    return pairs.ks_uniform(*_placed(spark, d)).select(F.round("ks", 9).alias("ks"))


def nn_angles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the angles to the nearest other point."""
    near = vectors.knn(domain.coordinates(spark, d), 1)
    return spark.sql(f"SELECT {_SUMMARY} FROM (SELECT {_ANG} AS x FROM {{near}}) t".replace("PCT(", "percentile("), near=near)


def within_cluster_sep(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the angles, in degrees, to the nearest point of the same label."""
    near = vectors.knn(domain.coordinates(spark, d), 1, within="label")
    angles = near.select(F.degrees(F.acos("score")).alias("x"))
    p = lambda q: F.round(F.percentile("x", F.lit(q)), 6)
    return angles.agg(p(0.1).alias("p10"), p(0.5).alias("median"), F.round(F.avg("x"), 6).alias("mean"))


def _false_close(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The layout's neighbours with their rank and cosine in the vectors, and the number of others that a vector has."""
    v = domain.vectors(spark, d)
    n = v.where("id is not null and v is not null").agg((F.count("*") - 1).alias("others"))
    return RELATIONS["cknn_ranked"][0](spark, d), n


def false_close_all(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the layout that are among the farthest tenth of the vectors."""
    ranked, n = _false_close(spark, d)
    far = ranked.crossJoin(F.broadcast(n)).where(F.expr("others + 1 - rank <= floor(others / 10)"))
    return far.agg(F.count("*").alias("false_close"))


def false_close_graph(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the layout without an edge that are among the farthest tenth, at least one, of the vectors without an edge."""
    ranked, n = _false_close(spark, d)
    edges = RELATIONS["edges"][0](spark, d).select("a_id", "b_id", "score")
    ends = cut(edges.select(F.col("a_id").alias("src"), F.col("b_id").alias("end"), "score").unionByName(edges.select(F.col("b_id").alias("src"), F.col("a_id").alias("end"), "score")))
    free = ranked.join(ends.select("src", F.col("end").alias("dst")), ["src", "dst"], "left_anti")
    # of the vectors behind dst, those with an edge do not count
    behind = free.join(ends.withColumnRenamed("score", "s"), "src").groupBy("src", "dst").agg(F.count("*").alias("degree"), F.count_if(F.expr("s < score or (s = score and end > dst)")).alias("behind"))
    met = free.join(behind, ["src", "dst"], "left").crossJoin(F.broadcast(n)).select((F.expr("others + 1 - rank") - F.coalesce("behind", F.lit(0))).alias("worst"), (F.col("others") - F.coalesce("degree", F.lit(0))).alias("n"))
    return met.where(F.expr("worst <= greatest(1, ceil(n / 10))")).agg(F.count("*").alias("false_close"))


def zscore_offdiag(spark: SparkSession, d: str) -> DataFrame:
    """The z-score of every ordered pair: mean and deviation from sums in tiles, then one pass that gives the pairs."""
    v = domain.vectors(spark, d)
    n, x, xx = pairs.summed(v, [vectors.width(v)], lambda scores, *_: [scores[0].size, scores[0], scores[0] * scores[0]], ["n", "x", "xx"]).first()
    mean = x / max(1.0, n)
    deviation = max(0.0, xx / max(1.0, n) - mean * mean) ** 0.5
    z = lambda scores: pairs.rounded((scores - mean) / deviation, 6) if deviation else scores
    found = pairs.each(v, vectors.width(v), "z", z, both=True)
    return found if deviation else found.withColumn("z", F.lit(None).cast("double"))


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median silhouette of the layout's labels: a point's angles are summed by label in the tiles."""
    points = domain.coordinates(spark, d)
    label = points.select(F.col("id").alias("src"), F.col("label").cast("long").alias("own"))
    size = label.where("own is not null").groupBy("own").count().withColumnRenamed("own", "label")
    sums = pairs.sums_by_label(points.select("id", "v", F.col("label").cast("long").alias("label")), 3)
    met = sums.join(label, "src", "right").join(F.broadcast(size), "label", "left").withColumn("n", F.expr("count - if(label = own, 1, 0)"))
    m = F.try_divide("angles", "n")
    each = met.groupBy("src").agg(F.max(F.when(F.col("label") == F.col("own"), m)).alias("a"), F.min(F.when(F.col("label") != F.col("own"), m)).alias("b"))
    several = label.agg(F.count("*").alias("points")).where("points > 1")
    s = F.when(F.col("a").isNull(), 0.0).when(F.greatest("a", "b") == 0, F.lit(float("nan"))).when(F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    scored = each.crossJoin(F.broadcast(several)).select(s.alias("s"))
    return scored.agg(F.round(F.avg("s"), 6).alias("silhouette"), F.round(F.percentile("s", F.lit(0.5)), 6).alias("median"))


def relation_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of each label's three nearest labels by the mean cosine of their rows, the share that the layout keeps. The mean is the product of the labels' mean unit vectors, so no pairs of rows are needed."""

    def near(points: DataFrame) -> DataFrame:
        size = vectors.norm(F.col("v"))
        known = points.where("label is not null and v is not null").withColumn("size", size)
        unit = known.select("label", F.posexplode(F.transform("v", lambda x: F.when(F.col("size") == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, F.col("size"))))).alias("pos", "x"))
        means = unit.groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
        means = cut(means)
        both = means.select(F.col("label").alias("ca"), F.col("m").alias("a")).join(means.select(F.col("label").alias("cb"), F.col("m").alias("b")), F.col("ca") != F.col("cb"))
        scored = both.select("ca", "cb", F.round(vectors.dot(F.col("a"), F.col("b")), 9).alias("score"))
        rank = F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("score"), "cb"))
        return scored.withColumn("r", rank).where("r <= 3").select("ca", "cb")

    true, drawn = near(domain.vectors(spark, d)), near(domain.coordinates(spark, d)).withColumn("kept", F.lit(1.0))
    return true.join(drawn, ["ca", "cb"], "left").agg(F.round(F.avg(F.coalesce("kept", F.lit(0.0))), 9).alias("recall"))


def cell_summary(spark: SparkSession, d: str) -> DataFrame:
    """The spread of the layout over 128 cells of equal area, beside what uniform points would give."""
    return sphere.cell_summary(RELATIONS["c"][0](spark, d), BANDS, SECTORS)


def nearest_compressed(spark: SparkSession, d: str) -> DataFrame:
    """Of the nearest twentieth of the source pairs (equal angles at the edge all count), the share that the layout draws closer."""
    rows, widths = _both(spark, d)
    n, found = pairs.order_statistics(rows, widths, lambda n: [n - max(1, int(np.floor(0.05 * n + 0.5)))])
    # the angle at the edge; those of lesser cosines may round to the same
    edge = np.round(np.arccos(np.clip(next(iter(found.values())), -1, 1)), 9) if n else 0.0

    def terms(scores, *_):
        a = np.round(np.arccos(scores[0]), 9)
        near = a <= edge
        return [np.count_nonzero(near), np.count_nonzero(np.round(np.arccos(scores[1][near]), 9) < a[near])]

    sums = pairs.summed(rows, widths, terms, ["n", "closer"])
    return sums.select(F.col("n").cast("long").alias("n"), F.round(F.try_divide("closer", "n"), 9).alias("compressed"))


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    return F.try_divide(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y))


def angle_corr(spark: SparkSession, d: str) -> DataFrame:
    def terms(scores, *_):
        a, b = (np.arccos(s) - np.pi / 2 for s in scores)
        return [a.size, a, b, a * a, b * b, a * b]

    names = ["n", "a", "b", "aa", "bb", "ab"]
    return pairs.summed(*_both(spark, d), terms, names).select(F.round(_correlation(*map(F.col, names)), 6).alias("pearson"))


def normalized_stress(spark: SparkSession, d: str) -> DataFrame:
    def terms(scores, *_):
        far, v = 1 - scores[0], 2 - 2 * scores[1]
        return [far * far, far * np.sqrt(v), v]

    sums = pairs.summed(*_both(spark, d), terms, ["sdd", "sdv", "svv"])
    stress = F.try_divide(F.greatest(F.lit(0.0), F.expr("sdd - sdv * try_divide(sdv, svv)")), F.col("sdd"))
    return sums.select(F.round(F.sqrt(stress), 6).alias("stress"), F.round(F.try_divide("sdv", "svv"), 6).alias("scale"))


#: Stands for the decile of a cell with an edge in it: its angles are held against the edges one by one.
_NEAR = 255


def _deciles(edges: np.ndarray) -> np.ndarray:
    """The decile of each cell of cosines."""
    corners = np.arccos(np.clip(np.arange(pairs.CELLS + 3) / (pairs.CELLS / 2) - 1, -1, 1))
    least, most = (np.searchsorted(edges, x, side="right") for x in (corners[1:] - 1e-9, corners[:-1] + 1e-9))
    found = np.where(least == most, least, _NEAR).astype(np.uint8)
    found[-1] = _NEAR  # (no cosine)
    return found


def stretch_deciles(spark: SparkSession, d: str) -> DataFrame:
    """The mean stretch of the pairs by decile of the source angle; the deciles' edges are exact quantiles."""
    rows, widths = _both(spark, d)
    shares = [i / 10 for i in range(1, 10)]
    # angles ascend as cosines fall
    n, found = pairs.order_statistics(rows, widths, lambda n: [n - 1 - p for q in shares for p in pairs.around(n, q)])
    if not n:
        return spark.createDataFrame([], "decile int, n long, mean_stretch double")
    edges = np.array([pairs.quantile(n, q, lambda p: float(np.arccos(found[n - 1 - p]))) for q in shares])
    known = spark.sparkContext.broadcast(_deciles(edges))

    def terms(scores, *_):
        a, b = (np.arccos(s) for s in scores)
        with np.errstate(invalid="ignore", divide="ignore"):  # equal vectors: as SQL's doubles have it
            stretch = b / a
        decile = known.value.take(pairs.cell(scores[0])).astype(np.intp)
        near = np.flatnonzero(decile == _NEAR)
        decile[near] = np.searchsorted(edges, a[near], side="right")
        return [*np.bincount(decile, minlength=10), *np.bincount(decile, weights=stretch, minlength=10)]

    sums = pairs.summed(rows, widths, terms, [f"{c}{i}" for c in "ns" for i in range(10)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("decile"), F.col(f"n{i}").cast("long").alias("n"), F.col(f"s{i}").alias("s")) for i in range(10)]))
    return sums.select(each.alias("e")).where("e.n > 0").select("e.decile", "e.n", F.round(F.col("e.s") / F.col("e.n"), 6).alias("mean_stretch"))


def _by_label(scores: list[np.ndarray], one: np.ndarray, other: np.ndarray, above: np.ndarray | None) -> list:
    """Terms: pairs of one label, the sum of their angles, pairs of different labels, the sum of theirs."""
    x = np.arccos(scores[0])
    same = pairs.flat(one[:, :1] == other[None, :, 0], above)
    known = pairs.flat(~np.isnan(one[:, :1] + other[None, :, 0]), above)
    within, all_known = same @ x, known @ x
    k = np.count_nonzero(same)
    return [k, within, np.count_nonzero(known) - k, all_known - within]


_LABEL_SUMS = ["same", "within", "different", "between"]


def _separation(points: DataFrame, width: int) -> DataFrame:
    """(intra, inter): mean angles of the pairs of one label and of different ones."""
    return pairs.summed(*_labelled(points, width), _by_label, _LABEL_SUMS).select(F.try_divide("within", "same").alias("intra"), F.try_divide("between", "different").alias("inter"))


def cluster_separation(spark: SparkSession, d: str) -> DataFrame:
    found = _separation(domain.coordinates(spark, d), 3)
    return found.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"), F.round(F.try_divide("inter", "intra"), 6).alias("separation"))


def monotone_violations(spark: SparkSession, d: str) -> DataFrame:
    """How often the layout's angle falls while the source angle rises, from each row to those of greater ids: a row's angles are sorted in the task that looks at it."""
    rows, (width, _) = _both(spark, d)
    table = rowwise.stored(rows)

    def look(ids):
        n = len(ids)
        total = np.zeros(2, np.int64)

        def met(first, own):
            a, b = pairs.unit(own[:, :width]), pairs.unit(own[:, width:])
            one, other = (np.empty((len(own), n - first)) for _ in "ab")
            for place, v in table.between(first, n):
                columns = slice(place - first, place - first + len(v))
                one[:, columns] = rowwise.scaled(a, pairs.unit(v[:, :width]))
                other[:, columns] = rowwise.scaled(b, pairs.unit(v[:, width:]))
            for i in range(len(own)):
                placed = other[i, i + 1 :][rowwise.descending(one[i, i + 1 :])] / 10.0**vectors.PLACES
                angles = np.arccos(np.where(np.isnan(placed), 1.0, placed))
                total[:] += [np.count_nonzero(np.diff(angles) < -1e-12), len(angles)]
            return iter(())

        return met, lambda: iter([pa.RecordBatch.from_pydict({"violations": total[:1], "n": total[1:]})])

    found = rowwise.each_with_all(rows, table, look, "violations long, n long", 24)
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("violations", "n")])


QUERIES |= {f.__name__: f for f in (monotone_violations, dist_summary, angle_spearman, ks_uniform_sphere, cell_summary, nearest_compressed, angle_corr, normalized_stress, stretch_deciles, cluster_separation, nn_angles, within_cluster_sep, false_close_all, false_close_graph, zscore_offdiag, silhouette, relation_recall)}
_CELL = f"least({BANDS - 1}, floor((z + 1) / 2 * {BANDS})) * {SECTORS} + least({SECTORS - 1}, floor((atan2(y, x) + pi()) / (2 * pi()) * {SECTORS}))"
ORACLES["cell_summary"] = duckdb_sql(
    f"SELECT count(*) AS cells, min(k) AS low, max(k) AS high, round(avg(k), 9) AS mean, round(stddev_pop(k), 9) AS std, count_if(k = 0) AS empty_cells, round(sqrt(sum(k) / {CELLS} * (1 - 1.0 / {CELLS})), 9) AS expected_std, round({CELLS} * pow(1 - 1.0 / {CELLS}, sum(k)), 9) AS expected_empty"
    f" FROM (SELECT r.range, count(p.cell) AS k FROM range({CELLS}) r LEFT JOIN (SELECT CAST({_CELL} AS BIGINT) AS cell FROM @c) p ON p.cell = r.range GROUP BY r.range) t"
)
ORACLES["nearest_compressed"] = duckdb_sql(f"SELECT count(*) AS n, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 9) AS compressed FROM (SELECT a, b, rank() OVER (ORDER BY a) AS r, count(*) OVER () AS n FROM (SELECT round(a, 9) AS a, round(b, 9) AS b FROM ({_BOTH}) u) w) t WHERE r <= greatest(1, floor(0.05 * n + 0.5))")


#: Layouts that are compared: the first of the three dimensions that each takes.
CANDIDATES = {"dims 1-3": 1, "dims 4-6": 4, "dims 7-9": 7}


def borda_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidate layouts by the sum of their places in separation, recall and distance from uniform."""
    near = vectors.knn(domain.vectors(spark, d), K).select("src", "dst")
    found = None
    for name, first in CANDIDATES.items():
        points = domain.coordinates(spark, d, first)
        separation = _separation(points, 3).select(F.round(F.try_divide("inter", "intra"), 9).alias("separation"))
        hits = vectors.knn(points, K).select("src", "dst").join(near, ["src", "dst"]).agg(F.count("*").alias("hits"))
        recall = points.agg(F.count("*").alias("n")).crossJoin(hits).select(F.round(F.col("hits") / (K * F.col("n")), 9).alias("recall"))
        ks = pairs.ks_uniform(*_placed(spark, d, first)).select(F.round("ks", 9).alias("ks"))
        row = separation.crossJoin(recall).crossJoin(ks).select(F.lit(name).alias("name"), "separation", "recall", "ks")
        found = row if found is None else found.unionByName(row)
    return selection.borda(found, ["separation", "recall"], ["ks"])


def _candidate_sql(name: str, s: int) -> str:
    points = f"SELECT id, label, [v[{s}], v[{s + 1}], v[{s + 2}]] AS u FROM v WHERE sqrt(v[{s}] ** 2 + v[{s + 1}] ** 2 + v[{s + 2}] ** 2) > 1e-12"
    both = "SELECT a.id AS src, b.id AS dst, a.label = b.label AS same, round(list_cosine_similarity(a.u, b.u), 12) AS score FROM c a JOIN c b ON a.id <> b.id"
    hits = "SELECT count(*) FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM p) q JOIN knn k ON k.src = q.src AND k.dst = q.dst WHERE r <= 5"
    ks = "SELECT max(greatest(r / n - cdf, cdf - (r - 1) / n)) FROM (SELECT (1 - score) / 2 AS cdf, row_number() OVER (ORDER BY score DESC) * 1.0 AS r, count(*) OVER () AS n FROM p WHERE src < dst)"
    return f"SELECT * FROM (WITH c AS ({points}), p AS MATERIALIZED ({both}) SELECT '{name}' AS name, round(avg(CASE WHEN NOT same THEN acos(score) END) / avg(CASE WHEN same THEN acos(score) END), 9) AS separation, round(({hits}) / (5.0 * (SELECT count(*) FROM c)), 9) AS recall, round(({ks}), 9) AS ks FROM p)"


QUERIES["borda_rank"] = borda_rank
_PLACES = "row_number() OVER (ORDER BY separation DESC, name) + row_number() OVER (ORDER BY recall DESC, name) + row_number() OVER (ORDER BY ks, name) - 3"
ORACLES["borda_rank"] = duckdb_sql(f"SELECT *, CAST({_PLACES} AS BIGINT) AS borda FROM (" + " UNION ALL ".join(_candidate_sql(n, s) for n, s in CANDIDATES.items()) + ") t /* @knn */")
