"""Hidden hubs: every member of a component is tied to the component's hub, and the hubs to each other by a minimum spanning tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import graphs, vectors

#: Similarities are compared after rounding to so many places, so that both ends of an edge see it alike.
PLACES = 9


def nearest_outside(points: DataFrame) -> DataFrame:
    """(id, v, fragment) with unit vectors to (id, other, score): of each row the most similar one of another fragment, of equal ones the least id. Rows without another fragment do not appear."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources, tile = [], None

        def done() -> Iterator[pd.DataFrame]:
            for ids, _, _, score, other in sources:
                found = np.isfinite(score)
                yield pd.DataFrame({"id": ids[found], "other": other[found], "score": score[found]})

        for at, kind, ids, rows in vectors._blocks(batches):
            if at != tile:
                yield from done()
                sources, tile = [], at
            v, fragment = rows[:, :-1], rows[:, -1]
            if kind == 0:
                sources.append([ids, v, fragment, np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)])
                continue
            for source in sources:
                scores = np.round(np.clip(source[1] @ v.T, -1, 1), PLACES) + 0.0
                scores[source[2][:, None] == fragment[None]] = -np.inf
                top = scores.argmax(axis=1)  # (ids ascend within a block)
                score, other = scores[np.arange(len(top)), top], ids[top]
                better = (score > source[3]) | ((score == source[3]) & (other < source[4]))
                source[3], source[4] = np.where(better, score, source[3]), np.where(better, other, source[4])
        yield from done()

    # (a fragment's number is exact as a double: it is one of the ids below 2^53)
    marked = points.select("id", F.concat("v", F.array(F.col("fragment").cast("double"))).alias("v"))
    tiles, _ = vectors._tiles(marked, vectors.BLOCK_ROWS, vectors.GROUP_BYTES)
    rank = F.max(F.struct("score", (-F.col("other")).alias("back"))).alias("b")
    return tiles.mapInPandas(best, "id long, other long, score double").groupBy("id").agg(rank).select("id", (-F.col("b.back")).alias("other"), "b.score")


def spanning_tree(points: DataFrame) -> DataFrame:
    """(id, v) to the edges (a, b, score; a < b) of the spanning tree of greatest cosines, so of least angles, by Boruvka's rounds; equal cosines stand in the order of a, then b.

    In a round each fragment takes its best edge to another, and fragments that an edge joins become one,
    so the rounds grow with the logarithm of the number of rows. Ids are unique and from 0 to below 2^53. Null and zero vectors are left out.
    """
    now = cut(vectors.normalised(points.select("id", "v")).withColumn("fragment", F.col("id")))
    tree = None
    while now.select("fragment").distinct().limit(2).count() > 1:
        of = now.select("id", "fragment")
        near = cut(nearest_outside(now).join(of, "id").join(of.select(F.col("id").alias("other"), F.col("fragment").alias("joined")), "other"))
        a, b = F.least("id", "other"), F.greatest("id", "other")
        best = near.groupBy("fragment").agg(F.max(F.struct("score", (-a).alias("a"), (-b).alias("b"), "joined")).alias("e"))
        best = cut(best.select("fragment", "e.joined", (-F.col("e.a")).alias("a"), (-F.col("e.b")).alias("b"), "e.score"))
        merged = graphs.linked(best.select(F.col("fragment").alias("u"), F.col("joined").alias("v")))
        now = cut(now.join(merged, F.col("fragment") == F.col("node"), "left").select("id", "v", F.coalesce("component", "fragment").alias("fragment")))
        edges = best.select("a", "b", "score").distinct()
        tree = edges if tree is None else tree.unionByName(edges)
    return now.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).where("false") if tree is None else tree


def hub_edges(points: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, v, hub) and (hub, v) to (kind, a, b, score): ``anchor`` from a hub to each of its members, ``tree`` between hubs. Hubs are numbers from 0 to below 2^53."""
    unit = vectors.normalised(points.select("id", "hub", "v"))
    centre = vectors.normalised(hubs.select("hub", "v"))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.dot(F.col("v"), F.col("c"))))
    anchors = unit.join(centre.select("hub", F.col("v").alias("c")), "hub").select(F.lit("anchor").alias("kind"), F.col("hub").alias("a"), F.col("id").alias("b"), clamped.alias("score"))
    tree = spanning_tree(centre.select(F.col("hub").alias("id"), "v"))
    return anchors.unionByName(tree.select(F.lit("tree").alias("kind"), "a", "b", "score"))


def augmented_components(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row (nodes, hubs, edges, components) of the graph of nodes (id), their edges (a_id, b_id) and the hidden edges of ``hub_edges``. Hubs are nodes of their own: hub h is -1 - h."""
    hub = lambda c: -1 - F.col(c)
    ends = hidden.select(hub("a").alias("a_id"), F.when(F.col("kind") == "tree", hub("b")).otherwise(F.col("b")).alias("b_id"))
    hubs = hidden.select(F.explode(F.when(F.col("kind") == "tree", F.array(hub("a"), hub("b"))).otherwise(F.array(hub("a")))).alias("id")).distinct()
    every = cut(edges.select("a_id", "b_id").unionByName(ends))
    found = graphs.components(nodes.select("id").unionByName(hubs), every)
    counts = nodes.agg(F.count("*").alias("nodes")).join(hubs.agg(F.count("*").alias("hubs"))).join(every.agg(F.count("*").alias("edges")))
    return counts.join(found.agg(F.countDistinct("component").alias("components")))
