"""The inverted file against the exact neighbours."""

import numpy as np
import pytest

from marlstone.operators import inverted, vectors


def clustered(spark, n=600, d=8, centres=12, spread=0.05):
    r = np.random.default_rng(3)
    c = r.normal(size=(centres, d))
    v = c[np.arange(n) % centres] + spread * r.normal(size=(n, d))
    v[7] = v[19]  # equal rows tie
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (n + 1, [0.0] * d)], "id long, v array<double>")


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_exact_search_equals_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_ROWS", 40)
    points = clustered(spark, spread=spread)
    got, report = inverted.search(points, 5, 12, 1)
    want = vectors.knn(points, 5)
    assert sorted(map(tuple, got.select("src", "dst", "rank", "score").collect())) == sorted(map(tuple, want.select("src", "dst", "rank", "score").collect()))
    assert report["first"] + report["second"] + report["skipped"] == report["blocks"]
    if spread < 1:
        assert report["skipped"] > report["blocks"] / 2 and report["compared"] < report["rows"] / 4


def test_probing_reaches_most(spark):
    points = clustered(spark, spread=0.3)
    got, report = inverted.search(points, 5, 12, 4, exact=False)
    found = {(r.src, r.dst) for r in got.collect()}
    true = {(r.src, r.dst) for r in vectors.knn(points, 5).collect()}
    assert len(found & true) >= 0.9 * len(true) and report["second"] == 0 and report["compared"] < report["rows"]


def test_small_tables(spark):
    points = clustered(spark)
    assert inverted.search(points.limit(0), 5, 12, 1)[0].count() == 0
    assert inverted.search(points.where("id = 3"), 5, 12, 1)[0].count() == 0
    few = points.where("id < 4")
    assert sorted(map(tuple, inverted.search(few, 5, 2, 1)[0].select("src", "dst").collect())) == [(a, b) for a in range(4) for b in range(4) if a != b]


def test_nearest_in_few_dimensions_looks_into_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(inverted, "FEW", 100)
    monkeypatch.setattr(inverted, "CELL_ROWS", 40)
    r = np.random.default_rng(4)
    v = r.normal(size=(4000, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[3000:3300] = v[5]  # copies tie
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0, 0.0, 0.0])], "id long, v array<double>")
    for metric in ("dot", "cosine"):
        same = lambda df: sorted(map(tuple, df.select("src", "dst", "rank", "score").collect()))
        assert same(inverted.nearest(points, 3, metric)) == same(vectors.knn(points, 3, metric))
    _, report = inverted.search(points, 3, 100, 1, metric="dot")
    assert report["compared"] < report["rows"] / 8


def test_a_block_is_sent_once_for_a_group_of_sources(spark, monkeypatch):
    sent = []
    tiled = inverted._meet

    def meet(blocks, meta, spans, pairs, *rest):
        sent.append((spans, meta.agg({"group": "max"}).first()[0] + 1, pairs.count()))
        return tiled(blocks, meta, spans, pairs, *rest)

    monkeypatch.setattr(inverted, "_meet", meet)
    points = clustered(spark, spread=2.0)
    got, _ = inverted.search(points, 5, 60, 4, group_bytes=200 * 64)
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted(map(tuple, vectors.knn(points, 5).select("src", "dst").collect()))
    assert all(spans == 3 and groups * spans < met for spans, groups, met in sent[1:])


def test_gates_share_one_count_of_hits(spark):
    from marlstone.plans import registry

    plan = registry.QUERIES["layout_gates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
