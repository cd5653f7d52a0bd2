"""Experiments over stretches of the source angles: settings from a table, all measured in one pass over the pairs, then held against a table of gates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs as pair_folds

#: Settings that one pass measures: each is a handful of sums.
MOST_SETTINGS = 500
#: Points at which a stretch is looked at between 0 and the greatest angle.
GRID = 2000

# Slopes, exponents and scales of the experiments, and the gates (metric, operator, bound).
SLOPES = [1.4, 1.6, 1.8, 2.0, 2.1]
EXPONENTS = [1.5, 2.0]
SCALES = [1.15, 1.3, 1.5, 1.75, 2.0]
SCALED = (2.0, 1.5)
HARD_GATES = [("unit_norm_max_error", "<=", 1e-12), ("near_decile_median_stretch", ">=", 1.00), ("nearest_5pct_fraction_compressed", "<=", 0.20)]
REVISED_GATES = [("mean_recall_at_5", ">=", 0.55), ("hit_rate_at_5", ">=", 0.90), ("union_edge_rmse_radians_original_acos", "<=", 0.40), ("unit_norm_max_error", "<=", 1e-12), ("bottom_decile_false_close_count", "<=", 500.0)]


def frontier(spark) -> DataFrame:
    """(label, family, a, gamma, scale): every slope with every exponent, then one of them scaled as a whole."""
    rows = [(f"convex-a{a}-g{g}", "convex", a, g, 1.0) for a in SLOPES for g in EXPONENTS]
    rows += [(f"convex-a{SCALED[0]}-g{SCALED[1]}-s{s}", "convex_global_scale", *SCALED, s) for s in SCALES]
    return spark.createDataFrame(rows, "label string, family string, a double, gamma double, scale double")


def with_contract(settings: DataFrame, theta_max: float) -> DataFrame:
    """Settings with the coefficient ``b`` that takes the greatest angle to pi, and ``rejected``: why a setting is no increasing, convex and expanding stretch (null: it is one)."""
    at = F.col("a") * theta_max
    b = (math.pi - at) / F.pow(F.lit(theta_max), F.col("gamma"))
    reason = (
        F.when(F.col("a").isNull() | F.col("gamma").isNull() | F.col("scale").isNull(), "a parameter is missing")
        .when(F.col("a") <= 1, "a must be above 1, or the nearest pairs are drawn closer")
        .when(F.col("gamma") <= 1, "gamma must be above 1, or the stretch is not convex")
        .when(F.col("scale") <= 0, "scale must be positive")
        .when(at >= math.pi, "a takes the greatest angle beyond pi")
    )
    return settings.withColumns({"b": b, "rejected": reason})


def _measures(angle: Column, placed: Column, a: float, b: float, gamma: float, scale: float) -> dict[str, Column]:
    base = F.least(a * angle + b * F.pow(angle, F.lit(gamma)), F.lit(math.pi))
    target = F.least(scale * base, F.lit(math.pi))
    off = placed - target
    return {
        "pairs": F.count(angle).cast("double"),
        "clamped_pair_fraction": F.avg((scale * base > math.pi + 1e-15).cast("double")),
        "max_unclamped_target": F.max(scale * base),
        "min_expansion_ratio": F.min(F.when(angle > 0, target / angle)),
        "target_rmse": F.sqrt(F.avg(off * off)),
        "mean_stretch_error": F.avg(F.when(target > 0, F.abs(placed / target - 1))),
    }


def _known(settings: DataFrame, theta_max: float) -> list:
    rows = with_contract(settings, theta_max).limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings in one pass")
    return rows


def _long(spark, rows: list, names: list[str], found: dict) -> DataFrame:
    out = []
    for i, r in enumerate(rows):
        for n in names:
            value = None if r["rejected"] is not None else found[f"{i}_{n}"]
            out.append((r["label"], r["family"], n, value, r["rejected"] or ("no pairs" if value is None else None)))
    return spark.createDataFrame(out, "label string, family string, metric string, value double, reason string")


def measured(pairs: DataFrame, settings: DataFrame, theta_max: float) -> DataFrame:
    """(angle, placed) of pairs and settings to (label, family, metric, value, reason), all settings in one pass; a rejected setting has null values with its reason, and so has a metric that no pair gives."""
    rows = _known(settings, theta_max)
    columns, names = [], list(_measures(F.col("angle"), F.col("placed"), 1.0, 0.0, 1.0, 1.0))
    for i, r in enumerate(rows):
        if r["rejected"] is None:
            columns += [c.alias(f"{i}_{n}") for n, c in _measures(F.col("angle"), F.col("placed"), r["a"], r["b"], r["gamma"], r["scale"]).items()]
    found = pairs.agg(*columns).first() if columns else {}
    return _long(pairs.sparkSession, rows, names, found)


def angles_of(cosines: np.ndarray) -> np.ndarray:
    """Angles, rounded as the pairs' are; what has no cosine stands for 1, as in SQL."""
    return np.round(np.arccos(np.where(np.isnan(cosines), 1.0, cosines)), 9)


def greatest_angle(both: DataFrame, widths: list[int]) -> float | None:
    """The greatest angle of all pairs in the first space; null without pairs."""

    def fold() -> tuple:
        least = [np.inf]

        def meet(scores, one, other, above):
            x = pair_folds.flat(scores[0], above)
            least[0] = min(least[0], np.where(np.isnan(x), 1.0, x).min(initial=np.inf))

        return meet, lambda: {"x": least if np.isfinite(least[0]) else np.zeros(0)}

    x = pair_folds.folded(both, widths, fold, "x double").agg(F.min("x")).first()[0]
    return None if x is None else float(angles_of(np.array([x]))[0])


def measured_in_tiles(both: DataFrame, widths: list[int], settings: DataFrame, theta_max: float) -> DataFrame:
    """As ``measured``, of all pairs of (id, v) with vectors in two spaces one after the other: the pairs are measured in the tiles where they meet, and only sums leave them."""
    rows = _known(settings, theta_max)
    kept = [(i, r["a"], r["b"], r["gamma"], r["scale"]) for i, r in enumerate(rows) if r["rejected"] is None]
    sums, most, least = ["n", "clamped", "off", "stretch", "n_stretch"], ["high"], ["low"]

    def fold() -> tuple:
        total = {i: np.array([0.0] * len(sums) + [-np.inf, np.inf]) for i, *_ in kept}

        def meet(scores, one, other, above):
            angle, placed = (angles_of(pair_folds.flat(s, above)) for s in scores)
            if not angle.size:
                return
            powers, bases, positive = {}, {}, angle > 0
            every = positive.all()
            for i, a, b, gamma, scale in kept:
                if gamma not in powers:
                    powers[gamma] = np.power(angle, gamma)
                if (a, b, gamma) not in bases:
                    bases[a, b, gamma] = np.minimum(a * angle + b * powers[gamma], math.pi)
                raw = scale * bases[a, b, gamma]
                target = np.minimum(raw, math.pi)
                off = (placed - target).ravel()
                there = target > 0
                few = (lambda x: x) if every else (lambda x: x[positive])
                stretch = np.abs(off / target.ravel()) if there.all() else np.abs(placed[there] / target[there] - 1)
                t = total[i]
                t[:5] += [angle.size, np.count_nonzero(raw > math.pi + 1e-15), off @ off, stretch.sum(), stretch.size]
                t[5], t[6] = max(t[5], raw.max()), min(t[6], (few(target) / few(angle)).min(initial=np.inf))

        def done() -> dict:
            met = {i: t for i, t in total.items() if t[0]}
            return {"i": list(met)} | {c: [t[k] for t in met.values()] for k, c in enumerate(sums + most + least)}

        return meet, done

    parts = pair_folds.folded(both, widths, fold, "i long, " + ", ".join(f"{c} double" for c in sums + most + least))
    found = {}
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in sums], F.max("high").alias("high"), F.min("low").alias("low")).collect():  # (a row a setting)
        n = r["n"]
        values = {"pairs": n, "clamped_pair_fraction": r["clamped"] / n, "max_unclamped_target": r["high"], "min_expansion_ratio": r["low"] if math.isfinite(r["low"]) else None, "target_rmse": math.sqrt(r["off"] / n), "mean_stretch_error": r["stretch"] / r["n_stretch"] if r["n_stretch"] else None}
        found |= {f"{r['i']}_{m}": x for m, x in values.items()}
    names = ["pairs", "clamped_pair_fraction", "max_unclamped_target", "min_expansion_ratio", "target_rmse", "mean_stretch_error"]
    for i, *_ in kept:
        for m in names:
            found.setdefault(f"{i}_{m}", 0.0 if m == "pairs" else None)
    return _long(both.sparkSession, rows, names, found)


def gated(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(label, metric, value, reason) against (metric, operator, bound) to a row for each label and gate: label, metric, value, operator, bound, passed, reason.

    A gate whose metric a label does not have is null with the reason ``not measured``, one with another
    operator than >= and <= with ``unknown operator``; what is null has not passed.
    """
    every = metrics.select("label").distinct().join(F.broadcast(gates.limit(MOST_SETTINGS)))
    met = every.join(metrics.select("label", "metric", "value", "reason"), ["label", "metric"], "left")
    known = F.col("operator").isin(">=", "<=")
    passed = F.when(F.col("operator") == ">=", F.col("value") >= F.col("bound")).when(F.col("operator") == "<=", F.col("value") <= F.col("bound"))
    reason = F.when(~known, "unknown operator").when(F.col("value").isNull(), F.coalesce("reason", F.lit("not measured")))
    return met.select("label", "metric", F.when(known, F.col("value")).alias("value"), "operator", "bound", passed.alias("passed"), reason.alias("reason"))


def accepted(checks: DataFrame) -> DataFrame:
    """(label, passed, failed, unmeasured): whether all gates are passed, and the names of those that are not and that have no value."""
    names = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.col("metric"))))
    return checks.groupBy("label").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"), names(~F.col("passed")).alias("failed"), names(F.col("passed").isNull()).alias("unmeasured"))


def selected(metrics: DataFrame, verdicts: DataFrame, higher: list[str], lower: list[str], ties: str) -> DataFrame:
    """The accepted label of the least sum of places by the metrics ``higher`` and ``lower`` (equal values share the better place), ties to the lesser ``ties``: (label, places, status). None accepted: one row with status BLOCKED."""
    from pyspark.sql import Window

    wide = metrics.join(verdicts.where("passed").select("label"), "label").groupBy("label").pivot("metric", sorted({*higher, *lower, ties})).agg(F.max("value"))
    # (few labels: those of one experiment)
    places = [F.rank().over(Window.orderBy(F.desc_nulls_last(m))) for m in higher] + [F.rank().over(Window.orderBy(F.asc_nulls_last(m))) for m in lower]
    best = wide.withColumn("places", sum(places, F.lit(0)).cast("long")).orderBy("places", F.asc_nulls_last(ties), "label").limit(1).select("label", "places", F.lit("SELECTED").alias("status"))
    blocked = metrics.sparkSession.createDataFrame([(None, None, "BLOCKED")], "label string, places long, status string")
    return best.unionByName(blocked).orderBy(F.desc("status")).limit(1)
