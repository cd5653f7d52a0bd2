"""Vector operators: validation, exact neighbours and all-pairs similarities in blocks, inner-product ranking.

Exact similarity of all rows is work that grows with their square; it is dealt out as tiles of
bounded size, a matrix product for each two blocks, and only what is asked for leaves a tile.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a task compares two blocks at a time.
BLOCK_ROWS = 2048
#: Bytes of the vectors that a task holds as sources.
GROUP_BYTES = 32 << 20
#: Small inputs are dealt out in groups of so many rows at least.
MIN_ROWS = 256
MAX_TASKS = 20_000
#: Scores are compared after rounding to so many places, so that equal vectors tie.
PLACES = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(vectors: DataFrame, v: str = "v") -> DataFrame:
    """``vectors`` with unit vectors; rows with a null or zero vector go."""
    n = norm(F.col(v))
    return vectors.where(F.col(v).isNotNull()).withColumn("_n", n).where("_n > 1e-12").withColumn(v, F.transform(v, lambda x: x / F.col("_n"))).drop("_n")


def _tiles(vectors: DataFrame, block_rows: int, group_bytes: int, sources: DataFrame | None = None, per_core: int = 1) -> tuple[DataFrame, int]:
    """(id, v) to rows (tile, kind, ids, vs, ws), sorted by tile and kind within partitions, and the number of spans.

    A tile is a group of blocks as sources (kind 0) with a span of blocks as targets (kind 1); groups
    and spans are of ``group_bytes`` at most, so a row is sent rows * width / group_bytes times twice.
    Of ``sources``, if given, the rows are the sources. A column ``w`` of longs, as many in each row, goes along.
    There are ``per_core`` groups for each core, if the rows are enough.
    """

    def known(df: DataFrame) -> DataFrame:
        w = F.col("w") if "w" in df.columns else F.array().cast("array<long>")
        return df.where("id is not null and v is not null").select("id", "v", w.alias("w"))

    n, width = vectors.where("id is not null and v is not null").agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rows = max(block_rows, group_bytes // (8 * max(1, width)))
    spans = max(1, math.ceil(n / rows))
    groups = max(spans, min(per_core * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n / MIN_ROWS)))
    blocks = max(groups, math.ceil(n / block_rows))

    def side(df: DataFrame, kind: int, others: int, tile: Column) -> DataFrame:
        packed = known(df).groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"), F.flatten(F.collect_list("w")).alias("ws"))
        each = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return each.select(tile.cast("int").alias("tile"), F.lit(kind).alias("kind"), "ids", "vs", "ws")

    first = side(vectors if sources is None else sources, 0, spans, F.col("b") % groups * spans + F.col("other"))
    targets = side(vectors, 1, groups, F.col("other") * spans + F.col("b") % spans)
    tasks = min(groups * spans, MAX_TASKS)
    return first.unionByName(targets).repartitionById(tasks, F.col("tile") % tasks).sortWithinPartitions("tile", "kind"), spans


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks as (tile, kind, ids, vectors, tags), ids ascending."""
    for batch in batches:
        tile, kind = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            ids, v, w = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            by = np.argsort(ids, kind="stable")
            yield tile[i].as_py(), kind[i].as_py(), ids[by], v.reshape(len(ids), -1)[by], w.reshape(len(ids), -1)[by]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks as (tile, kind, ids, vectors), ids ascending."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids, v = np.asarray(row.ids), np.asarray(row.vs, float)
            by = np.argsort(ids, kind="stable")
            yield row.tile, row.kind, ids[by], v.reshape(len(ids), -1)[by]


def _scores(a_id: np.ndarray, a: np.ndarray, b_id: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of a with those of b, rounded; minus infinity for a row with itself. b_id ascends."""
    if metric == "cosine":
        with np.errstate(invalid="ignore"):  # a zero vector has no cosine
            a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
            scores = np.clip(a @ b.T, -1, 1)
    elif metric == "dot":
        scores = a @ b.T
    elif metric == "euclidean":  # negative squared distance
        scores = 2 * (a @ b.T) - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)[None]
    else:
        raise ValueError(f"unknown metric {metric}")
    scores = np.round(scores, PLACES) + 0.0
    at, end = np.searchsorted(b_id, a_id), np.searchsorted(b_id, a_id, side="right")
    while len(own := np.flatnonzero(at < end)):
        scores[own, at[own]] = -np.inf
        at = at + 1
    return scores


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest scores of each row, in any order; of equal ones the first columns."""
    n, m = scores.shape
    if k >= m:
        return np.broadcast_to(np.arange(m), (n, m))
    edge = np.partition(scores, m - k, axis=1)[:, m - k]
    enough = scores >= edge[:, None]
    tied = np.flatnonzero(enough.sum(axis=1) > k)
    if len(tied):
        spare = enough[tied] & (scores[tied] == edge[tied, None])
        over = spare.sum(axis=1) - (enough[tied].sum(axis=1) - k)
        enough[tied] &= ~(spare & (np.cumsum(spare, axis=1) > over[:, None]))
    return np.nonzero(enough)[1].reshape(n, k)


#: Source rows and target rows that are compared at once: few enough for a core's cache.
ROWS, COLUMNS = 64, 1024


def _prepared(v: np.ndarray, metric: str) -> np.ndarray:
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    if metric != "cosine":
        return v
    with np.errstate(invalid="ignore", divide="ignore"):  # a zero vector has no cosine
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _products(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of prepared rows, not yet rounded."""
    found = a @ b.T
    if metric == "euclidean":  # negative squared distance
        found = 2 * found - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)[None]
    return found


def _without_own(scores: np.ndarray, a_id: np.ndarray, b_id: np.ndarray, value: float) -> None:
    """Gives a row with itself ``value``. b_id ascends."""
    at, end = np.searchsorted(b_id, a_id), np.searchsorted(b_id, a_id, side="right")
    while len(own := np.flatnonzero(at < end)):
        scores[own, at[own]] = value
        at = at + 1


def _improve(own: np.ndarray, a: np.ndarray, ids: np.ndarray, v: np.ndarray, metric: str, best: np.ndarray, found: np.ndarray) -> None:
    """Puts into best and found, rows of the k best so far, what is better among the targets: by rounded score, then id."""
    k = best.shape[1]
    for left in range(0, len(ids), COLUMNS):
        there = ids[left : left + COLUMNS]
        scores = _products(a, v[left : left + COLUMNS], metric)
        _without_own(scores, own, there, -np.inf)
        edge = best[:, -1].copy()
        if len(there) > k and np.isneginf(edge).any():
            edge = np.maximum(edge, np.partition(np.where(np.isnan(scores), -np.inf, scores), len(there) - k, axis=1)[:, len(there) - k])
        near = np.flatnonzero(scores >= (edge - 1e-11 * np.maximum(1, np.abs(np.where(np.isfinite(edge), edge, 0))))[:, None])
        if not len(near):
            continue
        r, c = np.divmod(near, len(there))
        x = scores[r, c]
        x = np.round(np.clip(x, -1, 1) if metric == "cosine" else x, PLACES) + 0.0
        to = there[c]
        better = np.isfinite(scores[r, c]) & ((x > best[r, -1]) | ((x == best[r, -1]) & (to < found[r, -1])))
        r, x, to = r[better], x[better], to[better]
        if not len(r):
            continue
        changed = np.unique(r)
        row = np.concatenate((np.repeat(changed, k), r))
        score, target = np.concatenate((best[changed].ravel(), x)), np.concatenate((found[changed].ravel(), to))
        order = np.lexsort((target, -score, row))
        row = row[order]
        starts = np.searchsorted(row, changed)
        take = order[(starts[:, None] + np.arange(k)[None]).ravel()]
        best[changed], found[changed] = score[take].reshape(-1, k), target[take].reshape(-1, k)


def knn(vectors: DataFrame, k: int, metric: str = "cosine", block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES, within: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(id long, v array<double>) to (src, dst, rank, score): the k best others of each row, by score, then id. Ids are unique; null ids and vectors are left out; a zero vector has no cosine, so it neither has neighbours nor is one. With ``within``, a column of whole numbers, only rows of the same number are neighbours, and none where it is null. With ``sources`` (id, v), rows of the table, only their neighbours are sought."""

    if within is not None and sources is not None:
        raise ValueError("either within or sources")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, tile = [], None

        def done() -> Iterator[pa.RecordBatch]:
            for ids, _, _, scores, found in sources:
                keep = np.isfinite(scores)
                rank = np.broadcast_to(np.arange(1, k + 1), keep.shape)
                yield pa.RecordBatch.from_pydict({"src": np.broadcast_to(ids[:, None], keep.shape)[keep], "dst": found[keep], "rank": rank[keep], "score": scores[keep]})

        def parts(w: np.ndarray) -> dict[int, np.ndarray | slice]:
            return {0: slice(None)} if within is None else {x: np.flatnonzero(w[:, 0] == x) for x in np.unique(w[:, 0])}

        for at, kind, ids, v, w in _met(batches):
            if at != tile:
                yield from done()
                sources, tile = [], at
            v, own_parts = _prepared(v, metric), parts(w)
            if kind == 0:
                sources.append((ids, v, own_parts, np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)))
                continue
            there = {x: (ids[p], v[p]) for x, p in own_parts.items()}
            for own, a, at_label, scores, found in sources:
                for x, p in at_label.items():
                    if x not in there:
                        continue
                    rows = np.arange(len(own)) if isinstance(p, slice) else p
                    for low in range(0, len(rows), ROWS):
                        some = slice(rows[low], rows[min(low + ROWS, len(rows)) - 1] + 1) if isinstance(p, slice) else rows[low : low + ROWS]
                        top, to = scores[some], found[some]
                        _improve(own[some], a[some], *there[x], metric, top, to)
                        scores[some], found[some] = top, to
        yield from done()

    if within is not None:
        vectors = vectors.where(F.col(within).isNotNull()).select("id", "v", F.array(F.col(within).cast("long")).alias("w"))
    else:
        vectors = vectors.select("id", "v")
    tiles, spans = _tiles(vectors, block_rows, group_bytes, sources)
    part = tiles.mapInArrow(best, "src long, dst long, rank long, score double")
    if spans == 1:  # each source has met all targets in one task
        return part
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return part.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


#: Cosines that round to the same differ from it by no more.
HALF = 0.5 * 10.0**-PLACES
#: Stands for a cosine that a zero vector has not: beyond all others, as in SQL's order.
NO_COSINE, UNASKED = 4.0, 9.0


def ranks_of(vectors: DataFrame, wanted: DataFrame, most: int, block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, v) and pairs (src, dst), at most ``most`` of a src, to (src, dst, rank, score): the place of dst among all others of src by cosine, then id. Only the others that come before it are counted, in the tiles where they meet src."""
    known = vectors.where("id is not null and v is not null").select("id", "v")
    one, other = known.select(F.col("id").alias("src"), F.col("v").alias("a")), known.select(F.col("id").alias("dst"), F.col("v").alias("b"))
    cosine = F.try_divide(dot(F.col("a"), F.col("b")), norm(F.col("a")) * norm(F.col("b")))
    score = F.coalesce(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)), PLACES), F.lit(NO_COSINE))
    asked = wanted.join(one, "src").join(other, "dst").groupBy("src").agg(F.collect_list(F.struct(score.alias("s"), "dst")).alias("asked"), F.first("a").alias("a"))
    padded = F.slice(F.concat("asked", F.array_repeat(F.struct(F.lit(UNASKED).alias("s"), F.lit(0).cast("long").alias("dst")), most)), 1, most)
    sources = asked.withColumn("asked", padded).select(F.col("src").alias("id"), F.concat("a", F.col("asked.s")).alias("v"), F.col("asked.dst").alias("w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, tile = [], None

        def done() -> Iterator[pa.RecordBatch]:
            for ids, _, edge, dst, before in sources:
                real = edge < UNASKED
                yield pa.RecordBatch.from_pydict({"src": np.broadcast_to(ids[:, None], real.shape)[real], "dst": dst[real], "score": edge[real], "before": before[real]})

        for at, kind, ids, v, w in _met(batches):
            if at != tile:
                yield from done()
                sources, tile = [], at
            if kind == 0:
                sources.append((ids, _prepared(v[:, :-most], "cosine"), v[:, -most:], w, np.zeros(w.shape, np.int64)))
                continue
            v = _prepared(v, "cosine")
            for own, a, edge, dst, before in sources:
                for low in range(0, len(own), ROWS):
                    rows = slice(low, low + ROWS)
                    for left in range(0, len(ids), COLUMNS):
                        there = ids[left : left + COLUMNS]
                        scores = np.clip(a[rows] @ v[left : left + COLUMNS].T, -1, 1)
                        scores[np.isnan(scores)] = NO_COSINE
                        _without_own(scores, own[rows], there, -np.inf)
                        before[rows] += _before(scores, there, edge[rows], dst[rows])
        yield from done()

    counted = _tiles(known, block_rows, group_bytes, sources)[0].mapInArrow(count, "src long, dst long, score double, before long")
    return counted.groupBy("src", "dst").agg((1 + F.sum("before")).alias("rank"), F.first("score").alias("score"))


def _before(scores: np.ndarray, ids: np.ndarray, edge: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """How many of a row's scores come before each of its edges: greater ones, and equal ones of lesser ids."""
    found = np.empty(edge.shape, np.int64)
    for q in range(edge.shape[1]):
        found[:, q] = np.count_nonzero(scores > edge[:, q, None] + HALF, axis=1)
        tied = np.flatnonzero(np.count_nonzero(scores >= edge[:, q, None] - HALF, axis=1) > found[:, q])
        if len(tied):
            equal = np.abs(scores[tied] - edge[tied, q, None]) <= HALF
            found[tied, q] += np.count_nonzero(equal & (ids[None] < dst[tied, q, None]), axis=1)
    return found


def all_pairs(vectors: DataFrame, metric: str = "cosine", block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, v) to (src, dst, score) for every ordered pair of different ids. The result has the square of the input's rows: for audits of small sets."""

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources, tile = [], None
        for at, kind, ids, v in _blocks(batches):
            if at != tile:
                sources, tile = [], at
            if kind == 0:
                sources.append((ids, v))
                continue
            for own, a in sources:
                for low in range(0, len(own), 256):
                    scores = _scores(own[low : low + 256], a[low : low + 256], ids, v, metric)
                    other = ~np.isneginf(scores)
                    yield pd.DataFrame({"src": np.broadcast_to(own[low : low + 256, None], other.shape)[other], "dst": np.broadcast_to(ids[None], other.shape)[other], "score": scores[other]})

    return _tiles(vectors, block_rows, group_bytes)[0].mapInPandas(every, "src long, dst long, score double")


def width(vectors: DataFrame) -> int:
    """The dimensions of the vectors; 0 without any."""
    return vectors.where("v is not null").agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


def beside(left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[int]]:
    """(id, v) of the ids that both have, the one vector followed by the other, and the widths of the two."""
    both = left.select("id", "v").where("v is not null").join(right.where("v is not null").select("id", F.col("v").alias("w")), "id").select("id", F.concat("v", "w").alias("v"))
    return both, [width(left), width(right)]


def paired(left: DataFrame, right: DataFrame, block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, v) of two spaces to (src, dst, score, placed) of every pair src < dst of ids that both have: the cosines in the one and in the other, from one pass over tiles that hold both vectors of a row. For audits of small sets, like ``all_pairs``."""
    both, (width, _) = beside(left, right)

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources, tile = [], None
        for at, kind, ids, v in _blocks(batches):
            if at != tile:
                sources, tile = [], at
            if kind == 0:
                sources.append((ids, v))
                continue
            for own, a in sources:
                for low in range(0, len(own), 256):
                    part, x = own[low : low + 256], a[low : low + 256]
                    one, other = (_scores(part, x[:, c], ids, v[:, c], "cosine") for c in (slice(0, width), slice(width, None)))
                    above = part[:, None] < ids[None]
                    yield pd.DataFrame({"src": np.broadcast_to(part[:, None], above.shape)[above], "dst": np.broadcast_to(ids[None], above.shape)[above], "score": one[above], "placed": other[above]})

    return _tiles(both, block_rows, group_bytes)[0].mapInPandas(every, "src long, dst long, score double, placed double")


def _digest(start: hashlib._Hash, text: bytes) -> bytes:
    h = start.copy()
    h.update(text)
    return h.digest()


#: Digests take long and their rows are short: so many groups of sources for each core even out what the cores do.
DIGEST_GROUPS = 16


def least_digests(vectors: DataFrame, depth: int, prefix: str, sources: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of each row the ``depth`` others whose SHA-256 of (prefix, src, dst), joined by zero characters, is least: (src, dst, digest), in the tiles where they meet. Every ordered pair is hashed, so the work grows with the square of the rows."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tile = {}, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(i, j, g) for i, best in found.items() for g, j in best]
            yield pa.RecordBatch.from_pydict({"src": pa.array([r[0] for r in rows], pa.int64()), "dst": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.binary())})

        for at, kind, ids, _, _ in _met(batches):
            if at != tile:
                yield from done()
                found, tile = {}, at
            if kind == 0:
                found |= {i: [] for i in ids.tolist()}
                continue
            others = [str(j).encode() for j in ids.tolist()]
            for i, best in found.items():
                start = hashlib.sha256(f"{prefix}\0{i}\0".encode())
                copy, edge, near = start.copy, best[-1][0] if len(best) == depth else b"\xff" * 33, []
                for text in others:
                    h = copy()
                    h.update(text)
                    if h.digest() <= edge:
                        near.append(text)
                # (few, so they are hashed again)
                fresh = [(_digest(start, text), j) for text in near if (j := int(text)) != i]
                if fresh:
                    found[i] = sorted(best + fresh)[:depth]
        yield from done()

    bare = lambda df: df.where("v is not null").select("id", F.array().cast("array<double>").alias("v"))
    tiles, spans = _tiles(bare(vectors), block_rows, GROUP_BYTES, None if sources is None else bare(sources), DIGEST_GROUPS)
    part = tiles.mapInArrow(least, "src long, dst long, digest binary")
    if spans == 1:
        return part
    rank = F.row_number().over(Window.partitionBy("src").orderBy("digest", "dst"))
    return part.withColumn("_r", rank).where(F.col("_r") <= depth).drop("_r")


def nearest_to(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", exclude: list[int] = ()) -> DataFrame:
    """The k best rows for one query vector: (id, score), by score, then id. One scan, no shuffle but the top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.col("v"), q) if metric == "dot" else dot(F.col("v"), q) / (norm(F.col("v")) * F.lit(math.sqrt(sum(x * x for x in query))))
    kept = vectors.where(F.col("v").isNotNull() & ~F.col("id").isin(list(exclude)))
    return kept.select("id", F.round(score, PLACES).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def masked_mips(vectors: DataFrame, weights: dict[int, float], k: int) -> DataFrame:
    """Maximum inner product over the non-zero coordinates of a sparse query alone (position from 0 to weight): (id, score, rank)."""
    score = sum((F.col("v")[i] * F.lit(float(w)) for i, w in sorted(weights.items()) if w), F.lit(0.0))
    top = vectors.where("v is not null").select("id", F.round(score, PLACES).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def union_edges(neighbours: DataFrame) -> DataFrame:
    """Directed (src, dst, rank, score) to undirected edges (a_id, b_id, score, a_rank, b_rank, mutual)."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    grouped = neighbours.groupBy(a.alias("a_id"), b.alias("b_id")).agg(F.max("score").alias("score"), F.max(F.when(F.col("src") < F.col("dst"), F.col("rank"))).alias("a_rank"), F.max(F.when(F.col("src") > F.col("dst"), F.col("rank"))).alias("b_rank"))
    return grouped.withColumn("mutual", F.col("a_rank").isNotNull() & F.col("b_rank").isNotNull())


def validate(vectors: DataFrame) -> DataFrame:
    """One row of violation counts of (id, v): null ids, repeated ids, null or empty vectors, non-finite values, zero norms, and the number of dimensions seen."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ids = vectors.groupBy("id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_ids"), F.count_if(F.col("id").isNull()).alias("null_ids"))
    rest = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull() | (F.size("v") == 0)).alias("empty_vectors"), F.count_if(bad).alias("non_finite"), F.count_if(~bad & (norm(F.col("v")) <= 1e-12)).alias("zero_norms"), F.countDistinct(F.size("v")).alias("dimensions"))
    return rest.join(F.broadcast(ids))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(id, v) to ((id, v) of k principal components at unit length, the share of the variance that each explains).

    The covariance is summed in the executors; only its square of the dimension comes to the
    driver. Components point so that their largest weight is positive. Null vectors are left out.
    """
    # (here, so that the workers of the tiles need not load it)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = vectors.where("v is not null").select("id", "v")
    means = {r["i"]: r["m"] for r in kept.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()}
    centre = F.array(*[F.lit(means[i]) for i in range(len(means))])
    centred = kept.select("id", array_to_vector(F.zip_with("v", centre, lambda x, m: x - m)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(centred)
    weights = model.pc.toArray()
    signs = [1.0 if column[np.abs(column).argmax()] > 0 else -1.0 for column in weights.T]
    turned = F.transform(vector_to_array("y"), lambda y, i: y * F.element_at(F.array(*map(F.lit, signs)), i + 1))
    return normalised(model.transform(centred).select("id", turned.alias("v"))), [float(x) for x in model.explainedVariance.toArray()]
