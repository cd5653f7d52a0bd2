"""Graph operators on DataFrames of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import vectors


#: At most twice so many nodes are treated as hubs, whatever the size of the graph.
HUBS = 50_000
#: Edges that a task contracts at a time before the first round.
CHUNK_EDGES = 1 << 20


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) to fewer ones with the same components: of each chunk, every node with the least one that the chunk's edges lead to."""

    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        ends = pd.concat(parts)
        nodes, at = np.unique(ends[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        least = np.arange(len(nodes))
        while (apart := least[a] != least[b]).any():
            x, y = least[a[apart]], least[b[apart]]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(nearer := least[least], least):
                least = nearer
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        return pd.DataFrame({"u": nodes[moved], "v": nodes[least[moved]]})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK_EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Edges with the least neighbour ``m`` of their node u. Nodes of more than ``hub`` edges, few by their definition, are sent to all executors: a hub's edges need not meet in one task."""
    marked = edges.join(F.broadcast(least.where(F.col("n") > hub).select("u", "m")), "u", "left")
    rest = marked.where("m is null").drop("m").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return marked.where("m is not null").unionByName(rest)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest id among the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least, hub).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def linked(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of long ids, in any direction, loops and repeats allowed, to (node, component), by alternating star contractions, after each task has contracted its own edges.

    component is the smallest id that can be reached from node. Nodes without an edge to another
    node do not appear. Rows with a null end are ignored; no edges give no rows. The number of
    rounds grows with the logarithm of the component size, and each round ends in a checkpoint.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct().mapInPandas(_contracted, "u long, v long"))
    before = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        hub = max(1000, n // HUBS)
        now = cut(_small_star(_large_star(now, hub), hub))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) and (a_id, b_id) to (id, component): the smallest id that can be reached, itself included."""
    found = linked(edges.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def component_summaries(points: DataFrame, members: DataFrame, large: int = 1000) -> DataFrame:
    """(id, v) and (id, component) to (component, n, medoid, mean_score, centroid).

    The medoid has the greatest mean cosine to all members, itself included, then the least id;
    the mean is its unit vector's product with the mean of all, so no pairs are formed. The
    centroid is that mean at unit length, the medoid's vector where it is zero. Sums of components
    of more than ``large`` members, at most 1 in ``large`` nodes, are sent to all executors.
    Null and zero vectors are left out.
    """
    unit = vectors.normalised(points.select("id", "v")).join(members.select("id", "component"), "id")
    each = unit.select("component", F.posexplode("v").alias("i", "x")).groupBy("component", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    means = each.groupBy("component").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    marked = unit.join(F.broadcast(means.where(F.col("n") > large)), "component", "left")
    small = marked.where("mean is null").drop("n", "mean").join(means.where(F.col("n") <= large), "component")
    scored = marked.where("mean is not null").unionByName(small).withColumn("score", vectors.dot(F.col("v"), F.col("mean")))
    best = scored.groupBy("component").agg(F.max("n").alias("n"), F.max(F.struct(F.round("score", 9).alias("order"), (-F.col("id")).alias("back"), "score", "v")).alias("b"), F.first("mean").alias("mean"))
    length = vectors.norm(F.col("mean"))
    centroid = F.when(length <= 1e-12, F.col("b.v")).otherwise(F.transform("mean", lambda x: x / F.col("length")))
    return best.withColumn("length", length).select("component", "n", (-F.col("b.back")).alias("medoid"), F.col("b.score").alias("mean_score"), centroid.alias("centroid"))


def edge_audit(neighbours: DataFrame, k: int) -> DataFrame:
    """Directed neighbours to one row of violation counts: sources without exactly k rows, ranks outside 1..k or repeated, repeated targets, loops, order by score and id, opposite scores that differ."""
    per = neighbours.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.countDistinct("dst").alias("targets"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    counts = per.agg(F.count_if(F.col("n") != k).alias("bad_sizes"), F.count_if((F.col("ranks") != F.col("n")) | (F.col("low") < 1) | (F.col("high") > k)).alias("bad_ranks"), F.count_if(F.col("targets") != F.col("n")).alias("repeated_targets"))
    from pyspark.sql import Window

    before = Window.partitionBy("src").orderBy("rank")
    order = neighbours.withColumn("ps", F.lag("score").over(before)).withColumn("pd", F.lag("dst").over(before))
    wrong = order.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if((F.col("score") > F.col("ps")) | ((F.col("score") == F.col("ps")) & (F.col("dst") < F.col("pd")))).alias("bad_order"))
    turned = neighbours.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("score").alias("other"))
    opposite = neighbours.join(turned, ["src", "dst"]).agg(F.count_if(F.abs(F.col("score") - F.col("other")) > 1e-9).alias("bad_opposites"))
    return counts.join(F.broadcast(wrong)).join(F.broadcast(opposite))
