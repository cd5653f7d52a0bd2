"""Points and measures on the unit sphere, and ranks over whole tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import inverted


def fibonacci_sphere(spark: SparkSession, count: int) -> DataFrame:
    """(id, x, y, z): ``count`` points spread evenly, as probes of empty space."""
    at = F.col("id") + F.lit(0.5)
    z, phi = 1 - 2 * at / count, at * math.pi * (1 + math.sqrt(5))
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return spark.range(count).select("id", (r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), z.alias("z"))


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """1 - Phi(z), without loss of precision for large z."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))


def counted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column with ``n``, how often they occur, and ``before``, how many rows have a lesser one: range-sorted, with the sums of earlier partitions added."""
    counts = df.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    sums = counts.groupBy("_part").agg(F.sum("n").alias("_sum"))
    # (a row a partition)
    earlier = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_earlier"))
    within = F.sum("n").over(Window.partitionBy("_part").orderBy(column)) - F.col("n")
    return counts.withColumn("_within", within).join(F.broadcast(earlier), "_part").select(column, "n", (F.col("_earlier") + F.col("_within")).alias("before"))


def with_average_rank(df: DataFrame, column: str, rank: str) -> DataFrame:
    """``df`` with the rank of a column's value, from 1; equal values share the mean of their ranks."""
    return df.join(counted(df, column).select(column, (F.col("before") + (F.col("n") + 1) / 2).alias(rank)), column)


def ks_distance(df: DataFrame, column: str, cdf: Column) -> DataFrame:
    """(ks): the greatest distance of the column's steps from ``cdf``, an expression of the column."""
    steps = counted(df, column)
    total = df.agg(F.count("*").alias("total"))
    n = F.col("total")
    return steps.crossJoin(F.broadcast(total)).agg(F.max(F.greatest((F.col("before") + F.col("n")) / n - cdf, cdf - F.col("before") / n)).alias("ks"))


def mean_pooled(sentences: DataFrame) -> DataFrame:
    """(owner, v) to (owner, v): the mean of an owner's vectors, at unit length. Owners whose mean is zero go."""
    each = sentences.select("owner", F.posexplode("v").alias("i", "x")).groupBy("owner", "i").agg(F.avg("x").alias("x"))
    whole = each.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return whole.where("n > 1e-12").select("owner", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def label_sums(points: DataFrame) -> DataFrame:
    """(label, x, y, z) to (label, x, y, z, n): the sum of a label's points and its length."""
    sums = points.groupBy("label").agg(*[F.sum(c).alias(c) for c in "xyz"])
    return sums.withColumn("n", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def cell_summary(points: DataFrame, bands: int, sectors: int) -> DataFrame:
    """(x, y, z) to one row: points by cell of equal area (z bands by longitude sectors), empty cells counted as zero, beside the deviation and the empty cells expected of uniform points."""
    cells = bands * sectors
    band = F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z"))) + 1) / 2 * bands)
    sector = F.floor((F.atan2("y", "x") + math.pi) / (2 * math.pi) * sectors)
    counts = points.groupBy(F.least(band, F.lit(bands - 1)).alias("band"), F.least(sector, F.lit(sectors - 1)).alias("sector")).agg(F.count("*").alias("k"))
    n, filled, share = F.coalesce(F.sum("k"), F.lit(0)), F.count("*"), 1 / cells
    mean = n / cells
    return counts.agg(
        F.lit(cells).cast("long").alias("cells"), F.when(filled < cells, 0).otherwise(F.min("k")).cast("long").alias("low"), F.coalesce(F.max("k"), F.lit(0)).alias("high"), F.round(mean, 9).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)) / cells - mean * mean)), 9).alias("std"), (cells - filled).alias("empty_cells"),
        F.round(F.sqrt(n * share * (1 - share)), 9).alias("expected_std"), F.round(cells * F.pow(F.lit(1 - share), n), 9).alias("expected_empty"),
    )


def compressed_share(pairs: DataFrame, source: str, observed: str, fraction: float) -> DataFrame:
    """(n, compressed): of the ``fraction`` of rows of least ``source`` (at least one; those equal to the last all count), the share whose ``observed`` is less."""
    total = pairs.agg(F.count("*").alias("total"))
    wanted = F.greatest(F.lit(1.0), F.floor(F.lit(fraction) * F.col("total") + 0.5))
    edge = counted(pairs, source).crossJoin(F.broadcast(total)).where(F.col("before") < wanted).agg(F.max(source).alias("edge"))
    return pairs.crossJoin(F.broadcast(edge)).where(F.col(source) <= F.col("edge")).agg(F.count("*").alias("n"), F.avg((F.col(observed) < F.col(source)).cast("double")).alias("compressed"))


def uniform_points(spark: SparkSession, count: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, id, x, y, z): points drawn uniformly. A number depends on (seed, replicate, point, axis) alone, so the points are the same whatever the partitions."""
    ids = spark.range(replicates * count).select(F.floor(F.col("id") / max(1, count)).alias("replicate"), (F.col("id") % max(1, count)).alias("id"))
    draw = lambda axis: (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "replicate", "id", F.lit(axis)).cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    z, phi = 2 * draw(1) - 1, 2 * math.pi * draw(2)
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return ids.select("replicate", "id", (r * F.cos(phi)).alias("x"), (r * F.sin(phi)).alias("y"), z.alias("z"))


def uniform_reference(spark: SparkSession, count: int, replicates: int, seed: int, bands: int, sectors: int) -> DataFrame:
    """(metric, replicates, mean, low, high) of uniform points: angles to the nearest other point, length of the mean point, points by cell. Nearest points are searched replicate by replicate."""
    points = uniform_points(spark, count, replicates, seed)
    near = None
    for r in range(replicates):
        own = points.where(F.col("replicate") == r).select("id", F.array("x", "y", "z").alias("v"))
        best = inverted.nearest(own, 1, "dot").select(F.lit(r).cast("long").alias("replicate"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))).alias("angle"))
        near = best if near is None else near.unionByName(best)
    if near is None or not count:
        return spark.createDataFrame([], "metric string, replicates long, mean double, low double, high double")
    p = lambda q: F.percentile("angle", F.lit(q))
    nn = near.groupBy("replicate").agg(F.min("angle").alias("nn_min"), p(0.1).alias("nn_p10"), p(0.5).alias("nn_median"), p(0.9).alias("nn_p90"), F.max("angle").alias("nn_max"), F.avg("angle").alias("nn_mean"))
    bias = points.groupBy("replicate").agg(F.sqrt(sum((F.avg(c) * F.avg(c) for c in "yz"), F.avg("x") * F.avg("x"))).alias("mean_vector_norm"))
    band = F.least(F.floor((F.col("z") + 1) / 2 * bands), F.lit(bands - 1))
    sector = F.least(F.floor((F.atan2("y", "x") + math.pi) / (2 * math.pi) * sectors), F.lit(sectors - 1))
    filled = points.groupBy("replicate", band.alias("band"), sector.alias("sector")).agg(F.count("*").alias("k"))
    total = bands * sectors
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("k") * F.col("k")) / total - (F.sum("k") / total) * (F.sum("k") / total)))
    cells = filled.groupBy("replicate").agg(F.max("k").cast("double").alias("cell_max"), (total - F.count("*")).cast("double").alias("empty_cells"), spread.alias("cell_std"))
    wide = nn.join(bias, "replicate").join(cells, "replicate")
    long = wide.unpivot("replicate", [c for c in wide.columns if c != "replicate"], "metric", "value")
    return long.groupBy("metric").agg(F.count("*").alias("replicates"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


def spherical_cap(points: DataFrame, centre: tuple[float, float, float], radius: float, quantile: float = 1.0) -> DataFrame:
    """(id, px, py) of a flat layout to (id, x, y, z) on the cap of ``radius`` radians around ``centre``: the direction from the mean stays, and so does the distance in proportion, of which the given quantile reaches the rim and what is beyond is held there."""
    if not 0 < radius < math.pi or not 0.5 <= quantile <= 1:
        raise ValueError("the radius lies between 0 and pi, the quantile between 0.5 and 1")
    mean = points.agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    flat = points.join(F.broadcast(mean)).select("id", (F.col("px") - F.col("mx")).alias("px"), (F.col("py") - F.col("my")).alias("py")).withColumn("r", F.hypot("px", "py"))
    scale = flat.agg(F.percentile("r", F.lit(quantile))).first()[0]
    if scale is None:
        return points.select("id", *[F.lit(0.0).alias(c) for c in "xyz"]).limit(0)
    if scale <= 1e-12:
        raise ValueError("the layout is one point")
    n = math.sqrt(sum(c * c for c in centre))
    c = [x / n for x in centre]
    axis = (1.0, 0.0, 0.0) if abs(c[2]) > 0.9 else (0.0, 0.0, 1.0)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u = cross(axis, c)
    length = math.sqrt(sum(x * x for x in u))
    u = [x / length for x in u]
    v = cross(c, u)
    far, angle = F.least(F.lit(1.0), F.col("r") / scale) * radius, F.atan2("py", "px")
    return flat.select("id", *[(F.cos(far) * c[i] + F.sin(far) * (F.cos(angle) * u[i] + F.sin(angle) * v[i])).alias("xyz"[i]) for i in range(3)])
