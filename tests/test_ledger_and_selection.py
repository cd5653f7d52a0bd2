import datetime
import hashlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import types as T

from marlstone.operators import graphs, ledger, selection, sphere, vectors
from marlstone.sources import strict

NOON = datetime.datetime(2024, 5, 1, 12)


def cost(spark, value):
    return spark.createDataFrame([(Decimal(value),)], "cost decimal(18,6)")


def test_ledger(spark):
    empty = spark.createDataFrame([], ledger.SCHEMA)
    verdict = lambda jobs, value, spent="0", **k: ledger.guard(jobs, cost(spark, value), spent, **k).first()["verdict"]
    assert verdict(empty, "6.999999") == "allowed"
    assert verdict(empty, "7.0") == "soft stop" and verdict(empty, "7.0", allow_soft_stop=True) == "allowed"
    assert verdict(empty, "5", "4.5") == "hard block" and verdict(empty, "9.5", allow_soft_stop=True) == "hard block"
    jobs = ledger.with_job(empty, "r1", "a", cost(spark, "1"), "0", NOON)
    assert jobs.first()["state"] == "JOB_STATE_PENDING" and verdict(jobs, "1") == "blocked by the latest job"
    with pytest.raises(ValueError):
        ledger.with_job(jobs, "r1", "b", cost(spark, "1"), "0", NOON)
    done = ledger.with_state(jobs, "a", "JOB_STATE_FAILED", NOON)
    assert verdict(done, "1") == "allowed"
    odd = ledger.with_state(done, "a", None, NOON)
    assert odd.first()["state"] == "UNKNOWN" and verdict(odd, "1") == "blocked by the latest job"
    for bad in (lambda: ledger.with_state(jobs, "none", "JOB_STATE_FAILED", NOON), lambda: ledger.with_state(jobs.union(jobs), "a", "JOB_STATE_FAILED", NOON)):
        with pytest.raises(ValueError):
            bad()


def test_borda(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5, 0.1), ("b", 2.0, 0.5, 0.3), ("c", 3.0, 0.1, 0.1)], "name string, s double, r double, k double")
    assert {r["name"]: r["borda"] for r in selection.borda(rows, ["s", "r"], ["k"]).collect()} == {"a": 2, "b": 4, "c": 3}


def test_pca(spark):
    x = np.random.default_rng(3).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5] + 7
    found, shares = vectors.pca(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>"), 2)
    centred = x - x.mean(axis=0)
    _, s, w = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(shares, (s * s / (s * s).sum())[:2])
    w = w[:2] * np.sign(w[:2][np.arange(2), np.abs(w[:2]).argmax(axis=1)])[:, None]
    y = centred @ w.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    got = {r["id"]: r["v"] for r in found.collect()}
    assert sorted(got) == list(range(60)) and np.allclose([got[i] for i in range(60)], y)


@pytest.mark.parametrize("large", [0, 1000])
def test_component_summaries(spark, large):
    rng = np.random.default_rng(5)
    x = {i: rng.normal(size=4) for i in range(20)} | {20: np.array([1.0, 0, 0, 0]), 21: np.array([-1.0, 0, 0, 0])}
    member = {i: (0 if i < 12 else 12 if i < 19 else i if i == 19 else 20) for i in x}
    points = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in x.items()] + [(50, None)], "id long, v array<double>")
    got = {r["component"]: r for r in graphs.component_summaries(points, spark.createDataFrame(list(member.items()), "id long, component long"), large).collect()}
    for c in set(member.values()):
        ids = [i for i in x if member[i] == c]
        unit = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
        mean = (unit @ unit.T).mean(axis=1)
        best = min(range(len(ids)), key=lambda i: (-round(mean[i], 9), ids[i]))
        middle = unit.mean(axis=0)
        middle = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-12 else unit[best]
        assert (got[c]["n"], got[c]["medoid"]) == (len(ids), ids[best])
        assert np.isclose(got[c]["mean_score"], mean[best]) and np.allclose(got[c]["centroid"], middle)
    assert len(got) == 4


def test_cells_and_compressed_pairs(spark):
    points = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    row = sphere.cell_summary(points, 2, 2).first()
    assert (row["cells"], row["low"], row["high"], row["empty_cells"], row["mean"]) == (4, 0, 3, 3, 0.75)
    assert sphere.cell_summary(points.limit(0), 2, 2).first()["empty_cells"] == 4
    pairs = spark.createDataFrame([(0.1, 0.05), (0.1, 0.2), (0.3, 0.1), (0.4, 0.1)], "a double, b double")
    assert tuple(sphere.compressed_share(pairs, "a", "b", 0.25).first()) == (2, 0.5)
    assert tuple(sphere.compressed_share(pairs, "a", "b", 0.75).first()) == (3, 2 / 3)


def test_registry(spark, tmp_path):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("axis_order", "axis_id", "label")])
    expected = spark.createDataFrame([("0", "sweet"), ("1", "sour")], "axis_order string, axis_id string")
    body = b"axis_order,axis_id,label\n0,sweet, Sweet \n1,sour,Sour\n"
    path = tmp_path / "axes.csv"
    path.write_bytes(body)
    digest = hashlib.sha256(body).hexdigest()
    read = lambda h, e: strict.read_registry(spark, str(path), schema, h, e, "axis_order", ["label"])
    assert [r["label"] for r in read(digest, expected).collect()] == ["Sweet", "Sour"]
    for h, e in (("0" * 64, expected), (digest, expected.limit(1))):
        with pytest.raises(ValueError):
            read(h, e)
    path.write_bytes(body.replace(b"Sour", b" "))
    with pytest.raises(ValueError):
        read(hashlib.sha256(path.read_bytes()).hexdigest(), expected)
