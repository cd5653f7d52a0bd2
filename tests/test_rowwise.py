"""What needs a row's whole order is made row by row, so no pair is shuffled."""

import numpy as np
import pytest

from marlstone.operators import optimise, rowwise, vectors
from marlstone.plans import registry
from marlstone.plans.relations import RELATIONS

SF = "/root/testdata/sf0.001"
ROWWISE = ["experiment_grid", "monotone_violations", "rank_matrix"]


@pytest.mark.parametrize("name", ROWWISE)
def test_no_pair_is_shuffled(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("all pairs as rows")

    for relation in ("pairs", "twins"):
        monkeypatch.setitem(RELATIONS, relation, (refused, ""))
    monkeypatch.setattr(vectors, "all_pairs", refused)
    monkeypatch.setattr(vectors, "paired", refused)
    monkeypatch.setattr(rowwise, "FILE_BYTES", 5000)
    monkeypatch.setattr(rowwise, "HELD_BYTES", 5000)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_order_of_ties_and_of_none():
    whole = np.array([5.0, np.nan, 7.0, 5.0, -3.0, 7.0, np.nan])
    assert rowwise.descending(whole).tolist() == [1, 6, 2, 5, 0, 3, 4]


def test_rows_in_files(spark, monkeypatch):
    monkeypatch.setattr(rowwise, "FILE_BYTES", 500)
    monkeypatch.setattr(rowwise, "BLOCK_BYTES", 100)
    df = spark.createDataFrame([(2**53 + i * 7 % 50, [float(i * 7 % 50), 1.0]) for i in range(50)] + [(None, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    table = rowwise.stored(df)
    assert len(table.files) > 1 and table.ids().tolist() == [2**53 + i for i in range(50)]
    assert table.at(3, 44)[:, 0].tolist() == list(range(3, 44)) and [p for p, _ in table.between(0, 50)][0] == 0
    assert rowwise.stored(df.limit(0)).n == 0


def test_gradients_are_added_up_in_the_task(spark, monkeypatch):
    """400 strips of one source, but a row of each task alone leaves it."""
    made = []
    each = rowwise.each_with_all
    monkeypatch.setattr(rowwise, "each_with_all", lambda *a: made.append(each(*a)) or made[-1])
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, v.tolist(), x.tolist()) for i, (v, x) in enumerate(zip(r.normal(size=(400, 5)), r.normal(size=(400, 3))))], "id long, v array<double>, x array<double>")
    g, loss = optimise.evaluated(rows, optimise.rank_objective(optimise.RankConfig(), 0.3), 400, 24 * 400)
    whole, again = optimise.evaluated(rows, optimise.rank_objective(optimise.RankConfig(), 0.3), 400)
    assert made[0].count() == 4 * spark.sparkContext.defaultParallelism * 400
    assert loss == pytest.approx(again) and np.allclose([x.g for x in g.orderBy("id").collect()], [x.g for x in whole.orderBy("id").collect()])
