import numpy as np
import pytest

from marlstone.operators import vectors

N = 400


def _points():
    return np.random.default_rng(3).integers(-1, 2, (N, 4)).astype(float)  # many ties, and zero vectors


def _all_scores(x, metric):
    if metric == "cosine":
        with np.errstate(invalid="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sums = (x * x).sum(axis=1)
    scores = 2 * x @ x.T - sums[:, None] - sums[None] if metric == "euclidean" else x @ x.T
    return np.round(scores, 12) + 0.0


def _table(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(N, None), (None, [1.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("tiles", [{}, {"block_rows": 50, "group_bytes": 4000}])
def test_neighbours_equal_those_of_the_whole_matrix(spark, metric, tiles):
    x = _points()
    scores = _all_scores(x, metric)
    scores[np.isnan(scores)] = -np.inf
    np.fill_diagonal(scores, -np.inf)
    want = []
    for i, row in enumerate(scores):
        best = np.lexsort((np.arange(N), -row))[:7]
        want += [(i, int(j), r + 1, row[j]) for r, j in enumerate(best) if np.isfinite(row[j])]
    got = sorted((tuple(r) for r in vectors.knn(_table(spark, x), 7, metric, **tiles).collect()), key=lambda r: (r[0], r[2]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_more_neighbours_than_rows_and_empty_tables(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    assert sorted((r.src, r.dst, r.rank) for r in vectors.knn(few, 9).collect()) == [(1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2)]
    assert vectors.knn(few.limit(0), 3).count() == 0 and vectors.all_pairs(few.limit(0)).count() == 0


def test_all_pairs_come_once(spark):
    x = _points()
    scores = _all_scores(x, "dot")
    got = {(r.src, r.dst): r.score for r in vectors.all_pairs(_table(spark, x), "dot", 50, 4000).collect()}
    assert got == {(i, j): scores[i, j] for i in range(N) for j in range(N) if i != j}
    assert vectors.all_pairs(_table(spark, x), "dot", 50, 4000).count() == N * (N - 1)


def test_neighbours_of_some_sources(spark):
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(300, 5)))], "id long, v array<double>")
    some = points.where("id % 7 = 3")
    got = vectors.knn(points, 20, block_rows=32, group_bytes=2048, sources=some)
    want = vectors.knn(points, 20).where("src % 7 = 3")
    assert sorted(map(tuple, got.select("src", "dst", "rank").collect())) == sorted(map(tuple, want.select("src", "dst", "rank").collect()))
    assert vectors.knn(points, 5, sources=some.where("false")).count() == 0
