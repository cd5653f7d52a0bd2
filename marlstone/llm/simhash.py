"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan
distance of two count vectors never exceeds the Hamming distance of the fingerprints. Counts are
held in unary (0, 1, 2 as 00, 01, 11), so that the Manhattan distance is the bit count of an
exclusive or. The 32 axes are split into two grids of 16: at a distance of up to 3, one of the
two grids has a distance of up to 1, so there the two points lie in the same cell or in cells one
step apart. A range join on the cells of each grid therefore finds every pair; the Manhattan
bound and then the exact Hamming distance are applied to what meets in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import linked
from .common import cut, map_pandas

RADIUS = 3
SHINGLE = 3
SEED = 42
#: A cell's points are compared in blocks of so many, each block pair in a row of its own.
BLOCK = 2048
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as an unsigned number (null or no word: 0)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    step = 1 << 14
    for k in range(0, len(starts), step):
        h = np.array([one(joined[a:b], SEED) for a, b in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, k1, k2, fp): fp the fingerprint's 64 bits as a signed long, k1 and k2 two hashes that together tell rows apart."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch["text"]), np.uint64, len(batch))
            yield batch.drop(columns="text").assign(fp=fp.view(np.int64))

    return map_pandas(docs.select("doc_id", "text", *row_keys()), of, "k1 long, k2 long, fp long", "doc_id")


def row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]


def unary_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, in unary."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (node, fp): the cell of each point in both grids, and the cells one step up on one axis."""
    halves = F.array(*[F.struct(F.lit(g).alias("grid"), F.shiftrightunsigned(unary_counts(F.col("fp")), 32 * g).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")) for g in (0, 1)])
    home = points.select("node", "fp", F.inline(halves))
    # a step up sets the lower bit of a segment, or the upper where the lower is set already
    steps = [F.when(F.col("cell").bitwiseAND(F.lit(2 << 2 * i)) == 0, F.col("cell").bitwiseOR(F.when(F.col("cell").bitwiseAND(F.lit(1 << 2 * i)) == 0, F.lit(1 << 2 * i)).otherwise(F.lit(2 << 2 * i)))) for i in range(16)]
    up = home.select("node", "fp", "grid", F.explode(F.array_compact(F.array(*steps))).alias("cell"))
    return home, up


def _tree(a_fp: np.ndarray, b_fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places in a, places in b) that connect what lies within the radius: a breadth-first forest. A point leaves the search when it is reached, so a group of n near points costs about n comparisons each way, and no list of all pairs is made."""
    sides = ((a_fp, _unary(a_fp)), (b_fp, _unary(b_fp)))
    rest = [np.arange(len(a_fp)), np.arange(len(b_fp))]
    while len(rest[0]) and len(rest[1]):
        first, rest[0] = rest[0][0], rest[0][1:]
        queue = [(0, first)]
        while queue:
            side, x = queue.pop()
            left = rest[1 - side]
            fp, un = sides[1 - side]
            near = np.bitwise_count(un[left] ^ sides[side][1][x]) <= radius
            near[near] = np.bitwise_count(fp[left[near]] ^ sides[side][0][x]) <= radius
            if near.any():
                found, rest[1 - side] = left[near], left[~near]
                yield (np.full(len(found), x), found) if side == 0 else (found, np.full(len(found), x))
                queue += [(1 - side, y) for y in found.tolist()]


def _forest(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Of each row (two blocks of a cell's points): links that connect all that lie within the radius."""
    for batch in batches:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a_node, a_fp, b_node, b_fp in zip(batch["a_node"], batch["a_fp"], batch["b_node"], batch["b_fp"], strict=True):
            a_node, b_node = np.asarray(a_node, np.int64), np.asarray(b_node, np.int64)
            for x, y in _tree(np.asarray(a_fp, np.int64).view(np.uint64), np.asarray(b_fp, np.int64).view(np.uint64), radius):
                us.append(a_node[x])
                vs.append(b_node[y])
        links = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})
        yield links[links["u"] != links["v"]]


def _unary(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(_LOW), (fp >> np.uint64(1)) & np.uint64(_LOW)
    return low | high | ((low & high) << np.uint64(1))


def near_links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``points`` (node long, fp long; each fp once) to links (u, v).

    The links have the same connected components as all pairs of points within ``radius`` bits
    (at most 3), but within a cell they are a spanning forest, never all pairs. A cell with more
    than ``block`` points is dealt out in pairs of blocks.
    """
    if radius > 3:
        raise ValueError("two grids with one step cover distances up to 3")
    home, up = _cells(points)
    sides = home.withColumn("a", F.lit(False)).unionByName(up.withColumn("a", F.lit(True)))
    counts = sides.groupBy("grid", "cell").agg(F.count_if("a").alias("n_up"), F.count_if(~F.col("a")).alias("n_home")).where("n_home > 1 or (n_home = 1 and n_up > 0)")
    dealt = sides.join(counts, ["grid", "cell"])
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    # the points at home meet each other and the points one step below
    first = dealt.withColumn("i", F.pmod(F.xxhash64("fp"), F.greatest(parts("n_up"), parts("n_home"), F.lit(1))).cast("int"))
    first = first.select("grid", "cell", "i", "node", "fp", F.explode(F.sequence(F.lit(0), F.greatest(parts("n_home"), F.lit(1)) - 1)).alias("j"), F.lit("a").alias("side"))
    second = dealt.where(~F.col("a")).withColumn("j", F.pmod(F.xxhash64("node"), parts("n_home")).cast("int"))
    second = second.select("grid", "cell", F.explode(F.sequence(F.lit(0), F.greatest(parts("n_up"), parts("n_home"), F.lit(1)) - 1)).alias("i"), "node", "fp", "j", F.lit("b").alias("side"))
    point = F.struct("node", "fp")
    met = first.unionByName(second).groupBy("grid", "cell", "i", "j").agg(F.collect_list(F.when(F.col("side") == "a", point)).alias("a"), F.collect_list(F.when(F.col("side") == "b", point)).alias("b"))
    met = met.where("size(a) > 0 and size(b) > 0 and not (size(a) = 1 and size(b) = 1 and a[0].node = b[0].node)")
    met = met.selectExpr("a.node as a_node", "a.fp as a_fp", "b.node as b_node", "b.fp as b_fp")
    return met.mapInPandas(lambda batches: _forest(batches, radius), "u long, v long")


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, group): a number for each group of linked fingerprints."""
    marked = cut(fingerprints(docs, shingle))
    points = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    found = linked(near_links(points.select("node", "fp"), radius))
    return marked, cut(points.join(found, "node", "left").select("fp", "least", F.coalesce("component", "fp").alias("group")))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) to (doc_id, fingerprint, component_id), one row per document.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that
    can be reached. Null and empty texts have fingerprint zero and link like any other; repeated rows
    stay; component_id is null where all documents of a group have a null doc_id; an empty table gives
    no rows. Equal fingerprints are one point, so copies cost nothing.
    """
    marked, named = _grouped(docs, shingle, radius)
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(least, "group").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", hexed, "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (a null one last), of several with that id the one of the smallest hash, of equal rows one."""
    marked, named = _grouped(docs, shingle, radius)
    first = marked.join(named.select("fp", "group"), "fp").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")).alias("row"))
    k1, k2 = row_keys()
    kept = first.select(F.col("row.k1").alias("__k1"), F.col("row.k2").alias("__k2"))
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).join(kept, ["__k1", "__k2"], "left_semi")
    return rows.dropDuplicates(["__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in docs.columns])
