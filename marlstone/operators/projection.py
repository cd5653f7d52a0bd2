"""Projection of per-axis probabilities of five levels (A to E) into a graph space and a preference space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 5
# What each level is worth; on basic tastes preference falls again at the top level.
RISING = [0.0, 0.25, 0.5, 0.75, 1.0]
BASIC_PREFERENCE = [0.0, 0.2, 0.65, 1.0, 0.8]


def softmax(logits: Column) -> Column:
    """Of an array: shifted by its maximum, so that no exponent overflows."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def expected(probabilities: Column, utilities: list[float]) -> Column:
    return F.aggregate(F.zip_with(probabilities, F.array(*map(F.lit, utilities)), lambda p, u: p * u), F.lit(0.0), lambda s, x: s + x)


def regroup_axes(long: DataFrame, axes: int) -> DataFrame:
    """(id, axis_order, p) to (id, raw): the axes' probabilities one after the other; items without exactly the axes 0 to axes - 1 go."""
    rows = long.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("axis_order", "p"))).alias("rows"))
    whole = F.transform("rows", lambda r: r["axis_order"]) == F.sequence(F.lit(0), F.lit(axes - 1))
    return rows.where(whole).select("id", F.flatten(F.transform("rows", lambda r: r["p"])).alias("raw"))


def graph_space(long: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, axis_order, p) with a small registry (axis_order, category) to (id, axis_order, value): expected level by the root of the category's size, at unit length; zero items go."""
    sizes = registry.withColumn("size", F.count("*").over(Window.partitionBy("category")))
    raw = long.join(F.broadcast(sizes), "axis_order").select("id", "axis_order", (expected(F.col("p"), RISING) * F.sqrt(1 / F.col("size"))).alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return raw.withColumn("n", n).where("n > 1e-12").select("id", "axis_order", (F.col("x") / F.col("n")).alias("value"))


def preference_space(long: DataFrame, basic: list[int]) -> DataFrame:
    """(id, axis_order, p) to (id, axis_order, value), values in [0, 1] and not normalised."""
    return long.select("id", "axis_order", F.when(F.col("axis_order").isin(basic), expected(F.col("p"), BASIC_PREFERENCE)).otherwise(expected(F.col("p"), RISING)).alias("value"))


def balanced_query(selections: DataFrame) -> DataFrame:
    """(axis_order, category, weight) to (axis_order, share): every category with a selection has the same mass, shared by weight; the last axis takes what rounding leaves."""
    active = selections.where("weight > 0")
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("category"))
    n = active.agg(F.countDistinct("category").alias("n"))
    shares = active.select("axis_order", "category", share.alias("share")).join(F.broadcast(n)).select("axis_order", (F.col("share") / F.col("n")).alias("share"))
    last = Window.orderBy(F.desc("axis_order"))
    total = F.sum("share").over(Window.partitionBy())
    return shares.withColumn("total", total).withColumn("r", F.row_number().over(last)).select("axis_order", F.when(F.col("r") == 1, 1 - (F.col("total") - F.col("share"))).otherwise(F.col("share")).alias("share"))


def balanced_queries(selections: DataFrame) -> DataFrame:
    """(request, axis_order, category, weight) to (request, axis_order, share), a query vector of sum 1 for each request: its categories have equal mass, shared by weight, and its last axis takes what rounding leaves.

    Axes are unique within a request, weights positive; others raise. Requests without a selection do not appear.
    """
    checked = selections.withColumn("repeats", F.count("*").over(Window.partitionBy("request", "axis_order")))
    wrong = F.coalesce(F.col("weight") <= 0, F.lit(True)) | F.col("axis_order").isNull() | F.col("category").isNull()
    weight = F.when(wrong, F.raise_error(F.lit("a selection without an axis, a category or a positive weight"))).when(F.col("repeats") > 1, F.raise_error(F.lit("an axis selected twice"))).otherwise(F.col("weight"))
    own = Window.partitionBy("request", "category")
    scaled = checked.withColumn("w", weight / F.max("weight").over(own))
    mass = F.size(F.collect_set("category").over(Window.partitionBy("request")))
    shares = scaled.withColumn("share", F.col("w") / F.sum("w").over(own) / mass)
    of = Window.partitionBy("request")
    rest = 1 - (F.sum("share").over(of) - F.col("share"))
    last = F.col("axis_order") == F.max("axis_order").over(of)
    return shares.select("request", "axis_order", F.when(last, rest).otherwise(F.col("share")).alias("share"))
