"""Hard negatives by a norm-bucketed search for the greatest inner products.

Candidates are sorted by norm from the greatest down and cut into buckets. An anchor's score with
anything in a bucket cannot pass the product of its norm and the bucket's greatest (Cauchy-Schwarz),
so a bucket is skipped where that product falls below what the anchor still looks for: its running
k-th best score and the lower limit of its window. Groups of anchors meet spans of buckets in tiles;
a tile keeps the best of its own, and the tiles' few are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between so many hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Candidates of a bucket, anchors of a group, windows compared at once.
BUCKET, GROUP, AT_ONCE = 2048, 2048, 256
MAX_TASKS = 20_000
#: Squared lengths from here on could give scores beyond 64 bits.
LONGEST = float(1 << 62)
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label) to (key, id, label, q, sq): components as whole numbers (in doubles), squared length.

    Rows with a null label or vector, any null or non-finite component, or a squared length of 2^62 or
    more (scores would not fit a long) take no part. Labels of ids divisible by 7 become (label + 1) % 10.
    """
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    near = F.forall(x, lambda e: F.abs(e) < float(1 << 30))  # (of others the square alone is too long)
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.coalesce(sound, F.lit(False))).where(near)
    rows = rows.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("q"))
    return cut(rows.withColumn("sq", F.aggregate("q", F.lit(0.0), lambda s, e: s + e * e)).where(F.col("sq") < LONGEST))


_BLOCK = pa.schema([("sq", pa.float64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "nulls", "keys", "labels", "vs"))])
_BLOCK_TYPES = "sq double, width int, ids binary, nulls binary, keys binary, labels binary, vs binary"


def _matrices(batch: pa.RecordBatch, names: tuple[str, str, str, str]) -> tuple[np.ndarray, ...]:
    """Of a batch: ids, which are null, keys, labels, the flat vectors and where each begins."""
    id_, key, label, q = (batch.column(c) for c in names)
    starts = np.concatenate(([0], np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False))))
    return id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(zero_copy_only=False), key.to_numpy(), label.to_numpy(), q.flatten().to_numpy(), starts


def buckets(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """Rows (key, id, label, q, sq) sorted by norm, the greatest first, and cut into buckets of at most ``size`` rows of one width; ``sq`` is a bucket's greatest squared length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, nulls, keys, labels, flat, starts = _matrices(batch, ("id", "key", "label", "q"))
            sq, widths = batch.column("sq").to_numpy(), np.diff(starts)
            edges = [0, *(np.flatnonzero(np.diff(widths)) + 1), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for a in range(lo, hi, size):
                    b = min(hi, a + size)
                    arrays = (ids[a:b], nulls[a:b], keys[a:b], labels[a:b], flat[starts[a] : starts[b]])
                    columns = [[float(sq[a:b].max())], [int(widths[a])], *([x.tobytes()] for x in arrays)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

    order = [F.desc("sq"), F.asc("id"), F.asc("key")]
    dealt = rows.select("key", "id", "label", "q", "sq").repartitionByRange(F.size("q"), *order).sortWithinPartitions(F.size("q"), *order)
    return cut(dealt.mapInArrow(pack, _BLOCK_TYPES))


def _products(a: np.ndarray, a_norm: float, b: np.ndarray, b_norm: float) -> np.ndarray:
    """Exact inner products: of doubles where no sum, nor a part of it, can pass 53 bits, else of Python's whole numbers."""
    if a_norm * b_norm < _EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m] for m in (a, b))
    return np.array([[sum(map(int.__mul__, x, y)) for y in right] for x in left], np.int64).reshape(len(a), len(b))


class _Seekers:
    """Anchors of one width and their windows, with the k best found so far for each window."""

    def __init__(self, rows: list[tuple], same: bool, k: int):
        self.same, self.k = same, k
        self.keys, self.labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.vs, self.norms = np.array([r[2] for r in rows]).reshape(len(rows), -1), np.sqrt([r[3] for r in rows])
        windows = [(i, *w) for i, r in enumerate(rows) for w in r[4]]
        self.owner, self.place, self.low, self.high = (np.array([w[c] for w in windows], np.int64) for c in range(4))
        self.worst = np.full(len(windows), _NONE)
        self.found = [(np.zeros(0, np.int64),) * 3] * len(windows)

    def meet(self, sq: float, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, vs: np.ndarray) -> bool:
        """Takes a bucket in; false if its bound lets no window take anything of it, nor of any later bucket."""
        limit = self.norms * math.sqrt(sq) * (1 + 1e-9) + 1  # (a little above, for the rounding of the roots)
        open_ = np.flatnonzero(limit[self.owner] >= np.maximum(self.low, self.worst))
        if not len(open_):
            return False
        anchors, at = np.unique(self.owner[open_], return_inverse=True)
        scores = _products(self.vs[anchors], float(self.norms[anchors].max()), vs, math.sqrt(sq))
        for lo in range(0, len(open_), AT_ONCE):
            windows, rows = open_[lo : lo + AT_ONCE], at[lo : lo + AT_ONCE]
            own, a = scores[rows], anchors[rows]
            fits = (own >= np.maximum(self.low, self.worst)[windows, None]) & (own <= self.high[windows, None])
            fits &= ((labels == self.labels[a, None]) & (keys != self.keys[a, None])) if self.same else (labels != self.labels[a, None])
            for i in np.flatnonzero(fits.any(axis=1)):
                self._take(windows[i], own[i, fits[i]], ids[fits[i]], keys[fits[i]])
        return True

    def _take(self, window: int, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        scores, ids, keys = (np.concatenate(x) for x in zip(self.found[window], (scores, ids, keys), strict=True))
        best = np.lexsort((keys, ids, -scores))[: self.k]
        self.found[window] = scores[best], ids[best], keys[best]
        if len(best) == self.k:
            self.worst[window] = scores[best[-1]]

    def rows(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        scores, ids, keys = (np.concatenate([f[c] for f in self.found] or [np.zeros(0, np.int64)]) for c in range(3))
        arrays = np.repeat(self.keys[self.owner], n), np.repeat(self.place, n), scores, pa.array(ids, mask=ids == _LAST), keys
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "place", "score", "other_id", "other_key"])


def search(anchors: DataFrame, packed: DataFrame, k: int, same: bool, group: int = GROUP) -> DataFrame:
    """The k best rows of all buckets for each window of each anchor: (key, place, rank, other_id, score).

    ``anchors`` (key, label, q, sq, windows: array of (place, low, high)). A row fits a window if its
    score lies within, both ends included, and its label is the anchor's (``same``; never the anchor itself) or another.
    Greater scores come first, then smaller ids, null ids last, then keys. Rows of another width have no score.
    """
    parallel = anchors.sparkSession.sparkContext.defaultParallelism
    groups, spans = max(1, math.ceil(anchors.count() / group)), max(1, min(parallel, packed.count()))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, seekers, ended = None, {}, {}, set()
        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != tile:
                    yield from (s.rows() for s in seekers.values())
                    tile, waiting, seekers, ended = row["tile"], {}, {}, set()
                width = row["width"]
                if row["kind"] == 0:
                    waiting.setdefault(width, []).append((row["key"], row["label"], row["q"], row["sq"], [(w["place"], w["low"], w["high"]) for w in row["windows"]]))
                elif width not in ended:
                    if width in waiting:
                        seekers[width] = _Seekers(waiting.pop(width), same, k)
                    ids, nulls, keys, labels, vs = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("nulls", bool), ("keys", np.int64), ("labels", np.int64), ("vs", np.float64)))
                    if width not in seekers or not seekers[width].meet(row["sq"], np.where(nulls, _LAST, ids), keys, labels, vs.reshape(len(ids), width)):
                        ended.add(width)
        yield from (s.rows() for s in seekers.values())

    number = F.monotonically_increasing_id()
    left = anchors.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(0).alias("kind"), "sq", F.size("q").alias("width"), "key", "label", "q", "windows")
    right = packed.withColumn("span", ((number % (1 << 33) + F.shiftright(number, 33)) % spans).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "span", F.lit(1).alias("kind"), "sq", "width", "ids", "nulls", "keys", "labels", "vs")
    tasks = min(groups * spans, MAX_TASKS)
    tiles = left.unionByName(right, allowMissingColumns=True).withColumn("tile", (F.col("group") * spans + F.col("span")).cast("int")).drop("group", "span")
    dealt = tiles.repartitionById(tasks, F.col("tile") % tasks).sortWithinPartitions("tile", "kind", F.desc("sq"))
    best = dealt.mapInArrow(sweep, "key long, place long, score long, other_id long, other_key long")
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "place", "rank", "other_id", "score")


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``embeddings`` (vec_id, embedding, label; more columns are ignored) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows with a vec_id divisible by ``every``. Which rows take no part is told at ``prepared``;
    rows with a null vec_id do, after all others of their score. Repeated rows are rows like any other, so a copy of
    an anchor may be its positive. A positive of negative score has no window. An empty table gives no rows.
    """
    rows = prepared(embeddings)
    packed = buckets(rows)
    anchors = rows.where(F.col("id") % every == 0)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(int(_NONE) + 1).alias("low"), F.lit(int(_LAST)).alias("high")))
    near = cut(search(anchors.withColumn("windows", all_), packed, positives, True).select("key", F.col("rank").cast("long").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score").cast("decimal(20,0)")
    limits = near.where("positive_score >= 0").select("key", "place", F.call_function("div", p * low + 99, F.lit(100).cast("decimal(3,0)")).alias("low"), F.call_function("div", p * high, F.lit(100).cast("decimal(3,0)")).alias("high"))
    windows = limits.where("low <= high").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("windows"))  # (as many as positives)
    found = search(anchors.join(windows, "key"), packed, negatives, False)
    named = found.join(near, ["key", "place"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
