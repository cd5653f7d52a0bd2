"""Neighbours by an inverted file: vectors in cells around centroids, with bounds that leave out whole blocks of cells.

Every row lies in the cell of its nearest centroid; a block of a cell knows its centre and the greatest angle of its rows to
it (its radius). A row at angle t from a centre is at least t - radius from all in the block, so
once a row has k neighbours within less than that, the block cannot change them. The search has two
phases: each block of sources meets the nearest cells; then, of the others, those blocks that the
bound leaves. With the second phase the result is exact; without it the search only probes.
Blocks meet in tiles of bounded size, as in ``vectors``: a group of sources with a span of those targets that any of them needs, so
a block is sent once for each group or span that needs it, not for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import vectors

#: Centroids are fitted on so many rows at most, those of the least hash of their id.
SAMPLE = 20_000
CELLS = 1024
ROUNDS = 8
BLOCK_ROWS = 2048
#: Above the error of an angle: bounds are that much wider.
SLACK = 1e-6
#: Up to so many rows, all are compared: the search's own steps would take longer.
FEW = 1 << 16
#: Rows of a cell, on average, where few dimensions let the bounds leave out most.
CELL_ROWS = 256


def fit_centroids(unit: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (cells x dimension, unit length) by rounds of k-means on a bounded sample; fewer where there are fewer rows."""
    rows = unit.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r["v"] for r in rows], float)
    if not len(points):
        return np.zeros((0, 0))
    centroids = points[np.linspace(0, len(points) - 1, min(cells, CELLS, len(points))).astype(int)]
    for _ in range(rounds):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def blocks_of_cells(unit: DataFrame, centroids: np.ndarray, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, v unit) to blocks (block, cell, n, centre, radius, ids, vs), ids ascending: rows of one cell, a large cell in several blocks."""
    sent = unit.sparkSession.sparkContext.broadcast(centroids)  # (CELLS rows at most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                cell = np.concatenate([(v[low : low + 1024] @ sent.value.T).argmax(axis=1) for low in range(0, len(v), 1024)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, v = b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()
                by = np.argsort(ids, kind="stable")
                ids, v = ids[by], v.reshape(len(ids), -1)[by]
                centre = v.sum(axis=0)
                length = np.linalg.norm(centre)
                centre = centre / length if length > 1e-9 else v[0]
                yield pa.RecordBatch.from_pydict({"cell": [b.column(0)[i].as_py()], "n": [len(ids)], "centre": [centre], "radius": [float(_angles(v, centre[None]).max())], "ids": [ids], "vs": [v.ravel()]})

    placed = cut(unit.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell int"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = dealt.groupBy("cell", "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs")).select("cell", "ids", "vs")
    found = packed.mapInArrow(bounded, "cell long, n long, centre array<double>, radius double, ids array<long>, vs array<double>")
    return cut(found.withColumn("block", F.monotonically_increasing_id()))


def _dealt(blocks: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """What is known of each block but its rows, a row for each BLOCK_ROWS rows, with its group as a source and its span as a target, blocks of near cells together; and the number of spans."""
    meta = blocks.select("block", "cell", "n", "centre", "radius")
    n, width = meta.agg(F.sum("n"), F.max(F.size("centre"))).first()
    span = max(1, group_bytes // (8 * width))
    group = max(1, min(span, math.ceil(n / (2 * blocks.sparkSession.sparkContext.defaultParallelism))))
    before = F.sum("n").over(Window.orderBy("cell", "block")) - F.col("n")
    return cut(meta.withColumn("group", F.floor(before / group)).withColumn("span", F.floor(before / span))), math.ceil(n / span)


def _meet(blocks: DataFrame, meta: DataFrame, spans: int, pairs: DataFrame, k: int, metric: str, found: DataFrame | None) -> DataFrame:
    """The k best of each row of a source block among the target blocks paired with it (source, target, bound), with the bound of each row applied before a block is compared: (source, src, dst, score), the k best of each tile, and rows (source, null, compared rows)."""
    of = lambda name, *more: meta.select(F.col("block").alias(name), *more)
    placed = pairs.join(of("source", "group"), "source").join(of("target", "span"), "target").withColumn("tile", F.col("group") * spans + F.col("span"))
    rows = ["ids", "vs", "centre", "radius"]
    none = lambda t: F.lit(None).cast(t)
    sources = placed.select("tile", F.col("source").alias("block")).distinct().join(blocks.select("block", *rows), "block")
    sources = sources.join(found, "block", "left") if found is not None else sources.withColumn("known", none("array<long>")).withColumn("worst", none("array<double>"))
    sources = sources.select("tile", F.lit(0).alias("kind"), F.lit(-1.0).alias("order"), "block", F.array().cast("array<long>").alias("sources"), *rows, "known", "worst")
    targets = placed.groupBy("tile", F.col("target").alias("block")).agg(F.collect_list("source").alias("sources"), F.min("bound").alias("order")).join(blocks.select("block", *rows), "block")
    targets = targets.select("tile", F.lit(1).alias("kind"), "order", "block", "sources", *rows, none("array<long>").alias("known"), none("array<double>").alias("worst"))
    groups = meta.agg(F.max("group")).first()[0] + 1
    tasks = min(groups * spans, vectors.MAX_TASKS)
    dealt = sources.unionByName(targets).repartitionById(tasks, (F.col("tile") % tasks).cast("int")).sortWithinPartitions("tile", "kind", "order")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None

        def done() -> Iterator[pa.RecordBatch]:
            for block, x in held.items():
                good = np.isfinite(x["best"])
                src, m = np.broadcast_to(x["ids"][:, None], good.shape)[good], int(good.sum())
                values = {"source": [block] * (m + 1), "src": [*src, None], "dst": [*x["found"][good], None], "score": [*x["best"][good], None], "compared": [0] * m + [x["compared"]]}
                yield pa.RecordBatch.from_arrays([pa.array(values[c], pa.float64() if c == "score" else pa.int64()) for c in values], names=list(values))

        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            array = lambda name, i: column[name][i].values.to_numpy()  # noqa: B023, E731
            for i in range(batch.num_rows):
                tile, ids = column["tile"][i].as_py(), array("ids", i)
                if tile != now:
                    yield from done()
                    held, now = {}, tile
                v = vectors._prepared(array("vs", i).reshape(len(ids), -1), metric)
                if column["kind"][i].as_py() == 0:
                    floor = np.full(len(ids), -np.inf)
                    if column["known"][i].is_valid:
                        floor[np.searchsorted(ids, array("known", i))] = array("worst", i)
                    held[column["block"][i].as_py()] = {"ids": ids, "v": v, "floor": floor, "best": np.full((len(ids), k), -np.inf), "found": np.full((len(ids), k), np.iinfo(np.int64).max), "compared": 0}
                    continue
                centre, radius = array("centre", i), column["radius"][i].as_py()
                for block in array("sources", i).tolist():
                    x = held[block]
                    worst = np.maximum(x["floor"], x["best"][:, -1])
                    # (without a kth best all are let in)
                    reach = np.where(np.isfinite(worst), np.arccos(np.clip(worst, -1, 1)), np.inf)
                    active = np.flatnonzero(_angles(x["v"], centre[None])[:, 0] - radius - SLACK <= reach)
                    x["compared"] += len(active) * len(ids)
                    for low in range(0, len(active), vectors.ROWS):
                        some = active[low : low + vectors.ROWS]
                        best, other = x["best"][some], x["found"][some]
                        vectors._improve(x["ids"][some], x["v"][some], ids, v, metric, best, other)
                        x["best"][some], x["found"][some] = best, other
        yield from done()

    return dealt.mapInArrow(search, "source long, src long, dst long, score double, compared long")


def _pairs(meta: DataFrame, centroids: np.ndarray, probes: int) -> tuple[DataFrame, DataFrame]:
    """Source and target blocks: those of a source's own cell and the nearest ``probes`` cells, and the others, with the angle between the blocks' centres less both radii as bound."""
    between = _angles(centroids, centroids)
    np.fill_diagonal(between, -1)
    nearest = np.argsort(between, axis=1, kind="stable")[:, : max(1, probes)]
    a, b = np.repeat(np.arange(len(centroids)), nearest.shape[1]), nearest.ravel()
    near = meta.sparkSession.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").withColumn("near", F.lit(True))
    side = lambda name, x: meta.select(F.col("block").alias(name), F.col("cell").alias(x), F.col("centre").alias(f"c_{x}"), F.col("radius").alias(f"r_{x}"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.dot(F.col("c_a"), F.col("c_b")))))
    met = side("source", "a").crossJoin(F.broadcast(side("target", "b"))).withColumn("bound", F.greatest(F.lit(0.0), angle - F.col("r_a") - F.col("r_b")))
    every = met.select("source", "target", "a", "b", "bound").join(F.broadcast(near), ["a", "b"], "left").select("source", "target", "bound", "near")
    return every.where("near").drop("near"), every.where("near is null").drop("near")


def search(points: DataFrame, k: int, cells: int, probes: int, exact: bool = True, sample: int = SAMPLE, metric: str = "cosine", group_bytes: int = vectors.GROUP_BYTES) -> tuple[DataFrame, dict[str, int]]:
    """(id, v) to ((src, dst, rank, score), report) by cosine, like ``vectors.knn``; with the metric ``dot`` the rows are unit vectors already and are taken as they are.

    ``exact`` finds the same neighbours as comparing all; else only the nearest ``probes`` cells are searched. The
    report: pairs of blocks in all, met in the first and in the second phase, skipped, and pairs of rows compared, of all.
    Null and zero vectors are left out; an empty table gives no rows.
    """
    known = points.where("id is not null and v is not null").select("id", "v")
    unit = cut(vectors.normalised(known) if metric == "cosine" else known)
    centroids = fit_centroids(unit, cells, sample)
    blocks = blocks_of_cells(unit, centroids) if len(centroids) else None
    if blocks is None:
        return points.sparkSession.createDataFrame([], "src long, dst long, rank long, score double"), dict.fromkeys(("blocks", "first", "second", "skipped", "compared", "rows"), 0)
    meta, spans = _dealt(blocks, group_bytes)
    near, far = _pairs(meta, centroids, probes)
    first = cut(_meet(blocks, meta, spans, near, k, metric, None))
    hits, second, n_second = first.where("src is not null"), None, 0
    if exact:
        kth = hits.groupBy("source", "src").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("worst")).where("worst is not null")
        # (of a block of sources: its rows' k-th best, and the widest angle that any of them still looks into)
        reach = kth.groupBy(F.col("source").alias("block")).agg(F.count("*").alias("full"), F.min("worst").alias("least"), F.collect_list(F.struct("src", "worst")).alias("rows"))
        reach = meta.select("block", "n").join(reach, "block", "left").withColumn("reach", F.when(F.col("full") == F.col("n"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "least")))))
        reach = cut(reach.select("block", "reach", F.col("rows.src").alias("known"), F.col("rows.worst").alias("worst")))
        wide = reach.select(F.col("block").alias("source"), "reach")
        needed = cut(far.join(F.broadcast(wide), "source").where(F.coalesce(F.col("bound") - SLACK <= F.col("reach"), F.lit(True))).select("source", "target", "bound"))
        n_second = needed.count()
        second = cut(_meet(blocks, meta, spans, needed, k, metric, reach.select("block", "known", "worst")))
        hits = hits.unionByName(second.where("src is not null"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    out = hits.select("src", "dst", "score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("src", "dst", "rank", "score")
    n_blocks, n_first, rows = meta.count(), near.count(), unit.count()
    compared = sum(int(x.where("src is null").agg(F.sum("compared")).first()[0] or 0) for x in (first, second) if x is not None)
    return out, {"blocks": n_blocks**2, "first": n_first, "second": n_second, "skipped": n_blocks**2 - n_first - n_second, "compared": compared, "rows": rows**2}


def nearest(points: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``vectors.knn`` for many points in few dimensions, where the bounds leave a row a few blocks, so that the work grows about as the points do: the same neighbours."""
    n = points.where("id is not null and v is not null").count()
    if n <= FEW:
        return vectors.knn(points, k, metric)
    return search(points, k, n // CELL_ROWS, 1, metric=metric)[0]
