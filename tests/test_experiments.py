"""Stretches, gates and selection against plain numbers."""

import math

import pytest

from marlstone.operators import experiments as ex

ANGLES = [(0.2, 0.5), (0.7, 0.9), (1.1, 2.0), (1.4, 3.0)]


@pytest.fixture(scope="module")
def measured(spark):
    pairs = spark.createDataFrame(ANGLES, "angle double, placed double")
    settings = ex.frontier(spark).union(spark.createDataFrame([("flat", "convex", 0.9, 2.0, 1.0), ("none", "convex", None, 2.0, 1.0)], "label string, family string, a double, gamma double, scale double"))
    return ex.measured(pairs, settings, 1.4)


def test_measures(measured):
    got = {(r.label, r.metric): (r.value, r.reason) for r in measured.collect()}
    b = (math.pi - 2 * 1.4) / 1.4**1.5
    base = [min(2 * t + b * t**1.5, math.pi) for t, _ in ANGLES]
    target = [min(1.5 * y, math.pi) for y in base]
    label = "convex-a2.0-g1.5-s1.5"
    assert got[label, "clamped_pair_fraction"][0] == sum(1.5 * y > math.pi + 1e-15 for y in base) / 4
    assert got[label, "max_unclamped_target"][0] == pytest.approx(1.5 * math.pi)
    assert got[label, "target_rmse"][0] == pytest.approx(math.sqrt(sum((p - y) ** 2 for (_, p), y in zip(ANGLES, target, strict=True)) / 4))
    assert got[label, "min_expansion_ratio"][0] == pytest.approx(min(y / t for (t, _), y in zip(ANGLES, target, strict=True)))
    assert got["flat", "pairs"] == (None, "a must be above 1, or the nearest pairs are drawn closer")
    assert got["none", "pairs"] == (None, "a parameter is missing") and got[label, "pairs"] == (4.0, None)


def test_gates_and_selection(spark, measured):
    gates = spark.createDataFrame([("target_rmse", "<=", 0.9), ("min_expansion_ratio", ">=", 1.5), ("unheard_of", ">=", 1.0), ("pairs", "==", 4.0)], "metric string, operator string, bound double")
    checks = ex.gated(measured, gates)
    rows = {(r.label, r.metric): r for r in checks.collect()}
    assert rows["flat", "target_rmse"].passed is None and rows["flat", "target_rmse"].reason.startswith("a must")
    assert rows["convex-a2.0-g1.5", "unheard_of"].reason == "not measured" and rows["convex-a2.0-g1.5", "pairs"].reason == "unknown operator"
    assert all(r.passed is None or r.passed == (r.value <= 0.9 if r.operator == "<=" else r.value >= 1.5) for r in rows.values())
    assert ex.selected(measured, ex.accepted(checks), ["min_expansion_ratio"], ["target_rmse"], "target_rmse").first().status == "BLOCKED"
    verdicts = ex.accepted(ex.gated(measured, gates.limit(2)))
    passed = {r.label for r in verdicts.where("passed").collect()}
    assert passed and "flat" not in passed
    values = {(r.label, r.metric): r.value for r in measured.collect()}
    rank = lambda m, sign: {x: 1 + sum(sign * values[y, m] < sign * values[x, m] for y in passed) for x in passed}
    ratio, rmse = rank("min_expansion_ratio", -1), rank("target_rmse", 1)
    best = min(passed, key=lambda x: (ratio[x] + rmse[x], values[x, "target_rmse"], x))
    got = ex.selected(measured, verdicts, ["min_expansion_ratio"], ["target_rmse"], "target_rmse").first()
    assert (got.label, got.places, got.status) == (best, ratio[best] + rmse[best], "SELECTED")
