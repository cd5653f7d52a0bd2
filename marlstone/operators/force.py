"""Force layout of a weighted graph on the unit sphere, in bulk-synchronous rounds.

Positions are a table by start and node. In a round they are sent along the edges: springs pull two
ends to the cosine of their edge, sampled non-edges push ends apart that are too close, triples hold a
neighbour nearer than a stranger, and each node is held near its first place. The forces on a
node are summed by key, so a hub's edges are summed in parts; the energy of each start is summed in the
same pass, and only these sums reach the driver. A step that raised a start's energy is taken back and halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordering import numbered

GOLDEN = math.pi * (3 - math.sqrt(5))


@dataclass(frozen=True)
class ForceConfig:
    """Rounds, starts, weights and margins (radians or cosines) of the layout."""

    seed: int = 20260806
    rounds: int = 450
    starts: int = 16
    rate: float = 0.045
    edge_weight: float = 1.0
    hub_weight: float = 0.30
    nonedge_margin: float = 0.52
    nonedges: int = 18
    nonedge_weight: float = 0.30
    ranking_margin: float = 0.06
    ranking_weight: float = 0.30
    ranking_per_edge: int = 3
    anchor_weight: float = 0.006
    radius: float = 0.30
    passes: int = 4
    slack: float = 1e-6


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, not on how rows are dealt out."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def sampled_nonedges(nodes: DataFrame, edges: DataFrame, per_node: int, seed: int) -> DataFrame:
    """(id) and (a_id, b_id) to (src, dst, r): up to ``per_node`` others that no edge ties to src, r from 1, drawn by hashes; the table of all pairs is never formed."""
    placed = numbered(nodes.select("id"), "place", "id")
    n = placed.count()
    draws = placed.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3 * per_node))).alias("draw"))
    drawn = draws.withColumn("place", F.floor(_uniform(F.lit(seed), "src", "draw") * n))
    met = drawn.join(placed.select(F.col("id").alias("dst"), "place"), "place").where("src <> dst").groupBy("src", "dst").agg(F.min("draw").alias("draw"))
    known = edges.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")).unionByName(edges.select(F.col("b_id").alias("src"), F.col("a_id").alias("dst")))
    free = met.join(known, ["src", "dst"], "left_anti")
    by_node = free.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "dst"))), 1, per_node).alias("s"))  # (at most 3 * per_node)
    return by_node.select("src", F.posexplode("s").alias("r", "x")).select("src", "x.dst", (F.col("r") + 1).alias("r"))


def ranking_triples(edges: DataFrame, nonedges: DataFrame, per_edge: int) -> DataFrame:
    """(center, near, far): each end of an edge with its other end and its first non-neighbours."""
    ends = edges.select(F.col("a_id").alias("center"), F.col("b_id").alias("near")).unionByName(edges.select(F.col("b_id").alias("center"), F.col("a_id").alias("near")))
    return ends.join(nonedges.where(F.col("r") <= per_edge).select(F.col("src").alias("center"), F.col("dst").alias("far")), "center")


def first_places(members: DataFrame, config: ForceConfig) -> DataFrame:
    """(id, component) to (start, id, x, y, z): components at evenly spread points, their members in a spiral around; the hub of component number h is -1 - h."""
    parts = numbered(members.groupBy("component").agg(F.count("*").alias("size")), "hub", "component")
    total = parts.count()
    placed = numbered(members.select("id", "component"), "place", "component", "id")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    rows = placed.join(parts, "component").join(first, "component").select("id", "hub", "size", (F.col("place") - F.col("first")).alias("at"))
    rows = rows.unionByName(parts.select((-1 - F.col("hub")).alias("id"), "hub", "size", F.lit(-1).cast("long").alias("at")))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(config.starts - 1)))).withColumn("phase", _uniform(F.lit(config.seed), "start", "hub") * (2 * math.pi) + F.col("start") * GOLDEN)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hub, at, size, phase = (b[c].to_numpy(float) for c in ("hub", "at", "size", "phase"))
            y = 1 - 2 * hub / max(1, total - 1) if total > 1 else np.zeros(len(b))
            ring = np.sqrt(np.maximum(0, 1 - y * y)) if total > 1 else np.zeros(len(b))
            centre = np.stack((np.cos(GOLDEN * hub) * ring, y, np.sin(GOLDEN * hub) * ring if total > 1 else np.ones(len(b))), axis=1)
            axis = np.eye(3)[np.abs(centre).argmin(axis=1)]
            u = axis - (axis * centre).sum(axis=1, keepdims=True) * centre
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            v = np.cross(centre, u)
            radius = (config.radius * (0.35 + 0.65 * np.sqrt((np.maximum(at, 0) + 0.5) / size)))[:, None]
            angle = (phase + GOLDEN * at)[:, None]
            point = np.where(at[:, None] < 0, centre, np.cos(radius) * centre + np.sin(radius) * (np.cos(angle) * u + np.sin(angle) * v))
            point /= np.linalg.norm(point, axis=1, keepdims=True)
            yield pd.DataFrame({"start": b["start"], "id": b["id"], "x": point[:, 0], "y": point[:, 1], "z": point[:, 2]})

    return rows.select("start", "id", "hub", "at", "size", "phase").mapInPandas(place, "start int, id long, x double, y double, z double")


def _dot(a: str, b: str) -> Column:
    return sum((F.col(f"{a}.{c}") * F.col(f"{b}.{c}") for c in "yz"), F.col(f"{a}.x") * F.col(f"{b}.x"))


def _at(places: DataFrame, key: str) -> DataFrame:
    return places.select("start", F.col("id").alias(key), F.struct("x", "y", "z").alias(f"{key}_p"))


def _force(of: str, by: str, factor: Column) -> Column:
    return F.struct(F.col(of).alias("id"), *[(factor * F.col(f"{by}_p.{c}")).alias(f"g{c}") for c in "xyz"])


def forces(places: DataFrame, springs: DataFrame, nonedges: DataFrame, triples: DataFrame, config: ForceConfig) -> tuple[DataFrame, DataFrame]:
    """The gradient (start, id, gx, gy, gz) and the energy (start, energy) of springs (a, b, target, weight), non-edges (a, b) and triples (center, near, far), without the anchoring."""
    pairs = springs.select("a", "b", "target", "weight", F.lit(False).alias("one_sided"))
    pairs = pairs.unionByName(nonedges.select("a", "b", F.lit(math.cos(config.nonedge_margin)).alias("target"), F.lit(config.nonedge_weight).alias("weight"), F.lit(True).alias("one_sided")))
    met = pairs.join(_at(places, "a"), "a").join(_at(places, "b"), ["start", "b"])
    off = _dot("a_p", "b_p") - F.col("target")
    off = F.when(F.col("one_sided"), F.greatest(off, F.lit(0.0))).otherwise(off)
    pulled = met.withColumn("off", off).where("off <> 0").withColumn("energy", F.col("weight") * F.col("off") * F.col("off"))
    factor = 2 * F.col("weight") * F.col("off")
    first = pulled.select("start", "energy", F.array(_force("a", "b", factor), _force("b", "a", factor)).alias("on"))
    seen = triples.join(_at(places, "center"), "center").join(_at(places, "near"), ["start", "near"]).join(_at(places, "far"), ["start", "far"])
    hinge = config.ranking_margin + _dot("center_p", "far_p") - _dot("center_p", "near_p")
    seen = seen.withColumn("h", hinge).where("h > 0")
    factor = 2 * config.ranking_weight * F.col("h")
    second = seen.select("start", (config.ranking_weight * F.col("h") * F.col("h")).alias("energy"), F.array(_force("center", "far", factor), _force("center", "near", -factor), _force("near", "center", -factor), _force("far", "center", factor)).alias("on"))
    # (the energy rides on the first force of a pair or triple, so one pass sums both)
    every = first.unionByName(second).select("start", "energy", F.posexplode("on").alias("k", "f"))
    summed = cut(every.groupBy("start", "f.id").agg(*[F.sum(f"f.g{c}").alias(f"g{c}") for c in "xyz"], F.sum(F.when(F.col("k") == 0, F.col("energy")).otherwise(0.0)).alias("energy")))
    return summed.drop("energy"), summed.groupBy("start").agg(F.sum("energy").alias("energy"))


_GRADIENT = ["gx", "gy", "gz"]


def _with_gradient(places: DataFrame, springs: DataFrame, nonedges: DataFrame, triples: DataFrame, config: ForceConfig) -> tuple[DataFrame, dict[int, float]]:
    """``places`` (start, id, x, y, z, x0, y0, z0) with the tangential gradient, its length at most 8, and the energy of each start."""
    summed, energy = forces(places, springs, nonedges, triples, config)
    w = config.anchor_weight
    joined = places.join(summed, ["start", "id"], "left").fillna(0.0, _GRADIENT)
    full = joined.withColumns({f"g{c}": F.col(f"g{c}") + 2 * w * (F.col(c) - F.col(f"{c}0")) for c in "xyz"})
    radial = sum((F.col(f"g{c}") * F.col(c) for c in "yz"), F.col("gx") * F.col("x"))
    flat = full.withColumn("radial", radial).withColumns({f"g{c}": F.col(f"g{c}") - F.col("radial") * F.col(c) for c in "xyz"})
    length = F.sqrt(sum((F.col(g) * F.col(g) for g in _GRADIENT[1:]), F.col("gx") * F.col("gx")))
    held = cut(flat.withColumn("shrink", F.greatest(F.lit(1.0), length / 8)).withColumns({g: F.col(g) / F.col("shrink") for g in _GRADIENT}).drop("radial", "shrink"))
    anchored = held.groupBy("start").agg(F.sum(w * sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0))).alias("energy"))
    total = energy.unionByName(anchored).groupBy("start").agg(F.sum("energy").alias("energy"))
    return held, {r["start"]: r["energy"] for r in total.collect()}  # (a row a start)


def _stepped(held: DataFrame, rates: dict[int, float]) -> DataFrame:
    """Positions a step down the gradient, back on the sphere."""
    rate = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[F.col("start")]
    out = held.withColumn("rate", rate).withColumns({c: F.col(c) - F.col("rate") * F.col(f"g{c}") for c in "xyz"})
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return out.withColumn("n", n).withColumns({c: F.col(c) / F.col("n") for c in "xyz"}).select("start", "id", "x", "y", "z", "x0", "y0", "z0")


def descend(places: DataFrame, springs: DataFrame, nonedges: DataFrame, triples: DataFrame, config: ForceConfig) -> tuple[DataFrame, list[dict[int, float]]]:
    """``places`` (start, id, x, y, z) after ``config.rounds`` rounds, and the energy of each start in every round: it never rises."""
    now = places.withColumns({f"{c}0": F.col(c) for c in "xyz"})
    held, energy = _with_gradient(now, springs, nonedges, triples, config)
    scale, history = dict.fromkeys(energy, 1.0), [dict(energy)]
    for k in range(config.rounds):
        rate = config.rate * (1 - 0.82 * k / max(1, config.rounds - 1))
        tried, found = _with_gradient(cut(_stepped(held, {s: rate * scale[s] for s in energy})), springs, nonedges, triples, config)
        better = [s for s in energy if found[s] <= energy[s]]
        scale = {s: min(1.0, 2 * scale[s]) if s in better else scale[s] / 2 for s in energy}
        energy = {s: found[s] if s in better else energy[s] for s in energy}
        history.append(dict(energy))
        # of a start whose energy rose, the former positions stay
        held = tried if len(better) == len(energy) else held if not better else tried.where(F.col("start").isin(better)).unionByName(held.where(~F.col("start").isin(better)))
    return held.select("start", "id", "x", "y", "z"), history


def push_apart(places: DataFrame, nonedges: DataFrame, margin: float, passes: int) -> DataFrame:
    """Positions after passes in which non-edges (a, b) closer than ``margin`` radians are pushed apart to it.

    In a pass each node offers itself to its closest such pair, of equal ones the least; the pairs that both
    ends agree on move, each end half the way, so no node moves twice in a pass.
    """
    for _ in range(passes):
        met = nonedges.join(_at(places, "a"), "a").join(_at(places, "b"), ["start", "b"]).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("a_p", "b_p"))))).where(F.col("angle") < margin)
        close = cut(met.select("start", "a", "b", "angle", "a_p", "b_p"))
        ends = close.select("start", F.explode(F.array("a", "b")).alias("id"), F.struct("angle", "a", "b").alias("pair"))
        chosen = ends.groupBy("start", "id").agg(F.min("pair").alias("pair"))
        agreed = chosen.groupBy("start", "pair").count().where("count = 2").select("start", "pair.a", "pair.b")

        def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                p = [np.array([[x[c] for c in "xyz"] for x in d[side]], float).reshape(len(d), 3) for side in ("a_p", "b_p")]
                angle = d["angle"].to_numpy()[:, None]
                dot, sine = np.cos(angle), np.maximum(np.sin(angle), 1e-300)
                axis = np.eye(3)[np.abs(p[0]).argmin(axis=1)] if len(d) else np.zeros((0, 3))
                any_way = axis - (axis * p[0]).sum(axis=1, keepdims=True) * p[0]
                any_way /= np.linalg.norm(any_way, axis=1, keepdims=True)
                half = (margin - angle) / 2
                for side, (own, other, sign) in enumerate(((p[0], p[1], 1), (p[1], p[0], -1))):
                    toward = np.where(angle <= 1e-10, sign * any_way, (other - dot * own) / sine)
                    out = np.cos(half) * own - np.sin(half) * toward
                    out /= np.linalg.norm(out, axis=1, keepdims=True)
                    yield pd.DataFrame({"start": d["start"], "id": d["ab"[side]], "mx": out[:, 0], "my": out[:, 1], "mz": out[:, 2]})

        moved = close.join(agreed, ["start", "a", "b"]).mapInPandas(apart, "start int, id long, mx double, my double, mz double")
        places = cut(places.join(moved, ["start", "id"], "left").select("start", "id", *[F.coalesce(f"m{c}", c).alias(c) for c in "xyz"]))
    return places


def objectives(places: DataFrame, edges: DataFrame, hidden: DataFrame, triples: DataFrame, config: ForceConfig) -> DataFrame:
    """(start, edge_rmse, hub_rmse, violations, objective) of edges and hidden edges (a, b, target) by angle, and the share of triples whose far end is not far enough."""

    def rmse(pairs: DataFrame, name: str) -> DataFrame:
        angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
        met = pairs.join(_at(places, "a"), "a").join(_at(places, "b"), ["start", "b"])
        off = angle(_dot("a_p", "b_p")) - angle(F.col("target"))
        return met.groupBy("start").agg(F.sqrt(F.avg(off * off)).alias(name))

    seen = triples.join(_at(places, "center"), "center").join(_at(places, "near"), ["start", "near"]).join(_at(places, "far"), ["start", "far"])
    bad = config.ranking_margin + _dot("center_p", "far_p") - _dot("center_p", "near_p") > 0
    shares = seen.groupBy("start").agg(F.avg(bad.cast("double")).alias("violations"))
    out = places.select("start").distinct().join(rmse(edges, "edge_rmse"), "start", "left").join(rmse(hidden, "hub_rmse"), "start", "left").join(shares, "start", "left").fillna(0.0)
    return out.withColumn("objective", F.col("edge_rmse") + 0.15 * F.col("hub_rmse") + 0.10 * F.col("violations"))


def force_layout(nodes: DataFrame, edges: DataFrame, members: DataFrame, hidden: DataFrame, config: ForceConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The best start's positions (id, x, y, z) and the report (start, edge_rmse, hub_rmse, violations, objective, chosen).

    ``nodes`` (id, not negative), ``edges`` (a_id, b_id, score), ``members`` (id, component) and ``hidden`` edges between
    node numbers (a, b, score), in which the hub of the h-th component, from 0, is -1 - h. Hubs are laid out and left out.
    """
    config = config or ForceConfig()
    sampled = cut(sampled_nonedges(nodes, edges, config.nonedges, config.seed))
    triples = cut(ranking_triples(edges, sampled, config.ranking_per_edge))
    nonedges = cut(sampled.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    visible = edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("score").alias("target"))
    private = hidden.select("a", "b", F.col("score").alias("target"))
    springs = cut(visible.withColumn("weight", F.lit(config.edge_weight)).unionByName(private.withColumn("weight", F.lit(config.hub_weight))))
    places, _ = descend(cut(first_places(members, config)), springs, nonedges, triples, config)
    places = push_apart(cut(places), nonedges, config.nonedge_margin + config.slack, config.passes)
    judged = objectives(places, visible, private, triples, config)
    rows = judged.collect()  # (a row a start)
    best = min(((r["objective"], r["start"]) for r in rows), default=(0.0, 0))[1]
    return places.where((F.col("start") == best) & (F.col("id") >= 0)).select("id", "x", "y", "z"), judged.withColumn("chosen", F.col("start") == best)
