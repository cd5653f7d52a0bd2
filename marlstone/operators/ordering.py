"""Places in a whole table's order, and inversions between two orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a block whose inversions one task counts.
BLOCK = 1 << 18
#: At most so many blocks each way: their counts of common rows, a square, come to the driver.
BLOCKS = 1024


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``, the place of a row in the order of the columns, from 0, without gaps: range-sorted, with the sizes of earlier partitions added. Rows that are equal in all of ``order`` stand in any order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    index = F.monotonically_increasing_id()
    placed = cut(ranged.withColumn("_part", F.shiftright(index, 33)).withColumn("_at", index.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # (a row a partition)
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    earlier = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return placed.join(F.broadcast(earlier), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _inverted(values: np.ndarray) -> int:
    """Pairs of places whose values stand the other way round, by merging: at each width, how many of a left half stay above each of a right half."""
    ranks = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    n, width, total = len(ranks), 1, 0
    while width < n:
        half = np.arange(n) // width
        pair = half // 2
        by = np.lexsort((ranks, pair))
        right = half[by] % 2 == 1
        lefts = np.cumsum(~right)  # lefts of all pairs up to here
        sizes = np.bincount(pair[half % 2 == 0], minlength=int(pair[-1]) + 1)
        through = np.cumsum(sizes)
        total += int((through[pair[by]][right] - lefts[right]).sum())
        width *= 2
    return total


def _blocks(pairs: DataFrame, keys: list[str], order: str, of: str) -> int:
    """The inversions of ``of`` against ``order`` within each block."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [_inverted(group.sort_values(order)[of].to_numpy())]})

    total = pairs.select(*keys, order, of).groupBy(*keys).applyInPandas(count, "n long").agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0]
    return int(total or 0)


def inversions(pairs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """(n, comparable, inverted, rate, kendall_tau) of all pairs of rows: those that ``a`` and ``b`` order differently, exactly.

    Rows get their places by a and by b (ties of the one in the order of the other, so that they are no
    inversions), and each order is cut into blocks. Pairs in one block of either order are counted by
    merging, those in one block of both are taken off once, and those in two blocks of each follow from the numbers of
    rows that the blocks share. Pairs tied in a are not comparable; ``kendall_tau`` is tau-a (1 - 2 inverted / pairs) without ties.
    Rows with a null in either column are left out; fewer than two rows give no rate.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    rows = numbered(numbered(rows, "p", "_a", "_b"), "q", "_b", "_a", "p")
    n = rows.count()
    size = max(block, -(-n // BLOCKS))
    placed = cut(rows.select("_a", "p", "q", F.floor(F.col("p") / size).alias("i"), F.floor(F.col("q") / size).alias("j")))
    shared = np.zeros((-(-n // size), -(-n // size)), object)
    for r in placed.groupBy("i", "j").count().collect():
        shared[r["i"], r["j"]] = r["count"]
    crossing, above = 0, np.zeros(shared.shape[1], object)
    for row in shared:  # rows of earlier blocks by p, in a later block by q
        later = np.concatenate((np.cumsum(above[::-1])[::-1][1:], [0])) if len(above) else above
        crossing += int((row * later).sum())
        above = above + row
    inverted = crossing + _blocks(placed, ["i"], "p", "q") + _blocks(placed, ["j"], "p", "q") - _blocks(placed, ["i", "j"], "p", "q")
    ties = placed.groupBy("_a").count().agg(F.sum(F.expr("cast(count as decimal(38,0)) * (count - 1) / 2"))).first()[0]
    comparable = n * (n - 1) // 2 - int(ties or 0)
    rate = inverted / comparable if comparable else None
    return pairs.sparkSession.createDataFrame([(n, comparable, inverted, rate, None if rate is None else 1 - 2 * rate)], "n long, comparable long, inverted long, rate double, kendall_tau double")

