"""Layouts, hubs and inversions against plain numpy versions."""

import math

import numpy as np
import pytest

from marlstone.operators import force, hubs, optimise, ordering


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 6))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


def kruskal(v):
    n = len(v)
    edges = sorted((-round(float(np.clip(v[a] @ v[b], -1, 1)), 9), a, b) for a in range(n) for b in range(a + 1, n))
    group, tree = list(range(n)), []
    for s, a, b in edges:
        if group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
            tree.append((a, b, -s))
    return sorted(tree)


def test_spanning_tree_equals_kruskal(spark, cloud):
    v = np.concatenate((cloud, cloud[:5]))  # equal vectors tie
    got = sorted((r.a, r.b, round(r.score, 9)) for r in hubs.spanning_tree(table(spark, v)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in kruskal(v)] and np.allclose([x[2] for x in got], [x[2] for x in kruskal(v)])
    assert hubs.spanning_tree(table(spark, v[:1])).count() == 0 and hubs.spanning_tree(table(spark, v).limit(0)).count() == 0


def test_hidden_edges_join_all_components(spark, cloud):
    points = table(spark, cloud).selectExpr("id", "v", "id % 7 as hub")
    centres = table(spark, [cloud[h::7].mean(axis=0) for h in range(7)]).withColumnRenamed("id", "hub")
    hidden = hubs.hub_edges(points, centres)
    assert {(r["kind"], r["count"]) for r in hidden.groupBy("kind").count().collect()} == {("anchor", 60), ("tree", 6)}
    edges = spark.createDataFrame([(0, 7)], "a_id long, b_id long")
    assert tuple(hubs.augmented_components(points, edges, hidden).first()) == (60, 7, 67, 1)


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_inversions_are_exact(spark, block):
    r = np.random.default_rng(block)
    a, b = r.integers(0, 12, 90), r.integers(0, 12, 90)
    pairs = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 1)], "a int, b int")
    got = ordering.inversions(pairs, "a", "b", block).first()
    wrong = sum((a[i] - a[j]) * (b[i] - b[j]) < 0 for i in range(90) for j in range(i))
    comparable = sum(a[i] != a[j] for i in range(90) for j in range(i))
    assert (got.n, got.comparable, got.inverted) == (90, comparable, wrong)
    assert ordering.inversions(pairs.limit(0), "a", "b").first().rate is None


def plain_descent(p, springs, nonedges, triples, config):
    """The rounds of one start in numpy."""

    def look(p):
        g, e = np.zeros_like(p), 0.0
        for a, b, t, w in springs:
            off = p[a] @ p[b] - t
            e += w * off * off
            g[a] += 2 * w * off * p[b]
            g[b] += 2 * w * off * p[a]
        for a, b in nonedges:
            off = max(0.0, p[a] @ p[b] - math.cos(config.nonedge_margin))
            e += config.nonedge_weight * off * off
            g[a] += 2 * config.nonedge_weight * off * p[b]
            g[b] += 2 * config.nonedge_weight * off * p[a]
        for c, n, f in triples:
            h = max(0.0, config.ranking_margin + p[c] @ p[f] - p[c] @ p[n])
            e += config.ranking_weight * h * h
            k = 2 * config.ranking_weight * h
            g[c] += k * (p[f] - p[n])
            g[n] -= k * p[c]
            g[f] += k * p[c]
        g += 2 * config.anchor_weight * (p - first)
        e += config.anchor_weight * ((p - first) ** 2).sum()
        g -= (g * p).sum(axis=1, keepdims=True) * p
        return g / np.maximum(1, np.linalg.norm(g, axis=1, keepdims=True) / 8), e

    first = p.copy()
    g, e = look(p)
    scale, history = 1.0, [e]
    for k in range(config.rounds):
        step = config.rate * (1 - 0.82 * k / max(1, config.rounds - 1)) * scale
        q = p - step * g
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        gq, eq = look(q)
        if eq <= e:
            p, g, e, scale = q, gq, eq, min(1.0, 2 * scale)
        else:
            scale /= 2
        history.append(e)
    return p, history


def test_force_rounds_equal_numpy(spark, cloud):
    config = force.ForceConfig(rounds=4, starts=2, nonedges=4, ranking_per_edge=2, rate=0.4)
    nodes = table(spark, cloud).select("id")
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 60, float(cloud[i] @ cloud[(i * 7 + 3) % 60])) for i in range(60) if i < (i * 7 + 3) % 60], "a_id long, b_id long, score double")
    members = nodes.selectExpr("id", "id % 3 as component")
    sampled = force.sampled_nonedges(nodes, edges, config.nonedges, config.seed)
    drawn = {(r.src, r.dst) for r in sampled.collect()}
    tied = {(r.a_id, r.b_id) for r in edges.collect()}
    assert sampled.groupBy("src").count().where("count = 4").count() == 60
    assert not any(a == b or (a, b) in tied or (b, a) in tied for a, b in drawn)
    assert drawn == {(r.src, r.dst) for r in force.sampled_nonedges(nodes.repartition(3), edges, config.nonedges, config.seed).collect()}
    triples = force.ranking_triples(edges, sampled, 2)
    nonedges = sampled.selectExpr("least(src, dst) as a", "greatest(src, dst) as b").distinct()
    springs = edges.selectExpr("a_id as a", "b_id as b", "score as target", "1.0D as weight")
    places = force.first_places(members, config)
    rows = sorted(map(tuple, places.collect()))
    assert len(rows) == 2 * 63 and np.allclose(np.linalg.norm([r[2:] for r in rows], axis=1), 1)
    got, history = force.descend(places, springs, nonedges, triples, config)
    for start in (0, 1):
        index = {r[1]: k for k, r in enumerate([r for r in rows if r[0] == start])}
        p = np.array([r[2:] for r in rows if r[0] == start])
        want, energies = plain_descent(
            p, [(index[r.a], index[r.b], r.target, r.weight) for r in springs.collect()], [(index[r.a], index[r.b]) for r in nonedges.collect()],
            [(index[r.center], index[r.near], index[r.far]) for r in triples.collect()], config,
        )
        here = np.array([[r.x, r.y, r.z] for r in got.where(f"start = {start}").orderBy("id").collect()])
        assert np.abs(here - want[[index[i] for i in sorted(index)]]).max() < 1e-6
        assert np.allclose([h[start] for h in history], energies) and all(x >= y for x, y in zip(energies, energies[1:], strict=False))
    pushed = force.push_apart(got, nonedges, config.nonedge_margin, 3)
    before, after = ({(r.start, r.id): np.array([r.x, r.y, r.z]) for r in t.collect()} for t in (got, pushed))
    close = lambda p: sum(max(0.0, config.nonedge_margin - math.acos(np.clip(p[s, r.a] @ p[s, r.b], -1, 1))) for s in (0, 1) for r in nonedges.collect())
    assert close(after) < close(before)


def test_spectral_start_is_the_leading_subspace(spark, cloud):
    got = np.array([r.x for r in optimise.spectral_start(table(spark, 3 * cloud)).orderBy("id").collect()])
    gram = cloud @ cloud.T
    values, vectors = np.linalg.eigh(gram)
    want = vectors[:, -3:] * np.sqrt(values[-3:])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, want @ want.T)


def plain_objective(cloud, x, config, temperature):
    """The rank-scaled objective by its definition, for one position matrix."""
    p = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, loss = len(p), 0.0
    for i in range(n):
        others = sorted((j for j in range(n) if j != i), key=lambda j: (-round(float(cloud[i] @ cloud[j]), 12), j))
        near = others[: config.k]
        total = sum(math.exp(p[i] @ p[j] / temperature) for j in others)
        for rank, j in enumerate(others, 1):
            loss += config.stress * (p[i] @ p[j] - cloud[i] @ cloud[j]) ** 2 / rank**config.rank_power
            if j in near:
                loss -= config.neighbourhood * (p[i] @ p[j] / temperature - math.log(total))
            else:
                loss += config.hinge * sum(max(0.0, config.hinge_margin + p[i] @ p[j] - p[i] @ p[m]) ** 2 for m in near)
    return loss


def test_gradient_and_descent_of_the_rank_layout(spark, cloud):
    v = cloud[:20]
    config = optimise.RankConfig(hinge=0.5, temperature=0.3)
    objective = optimise.rank_objective(config, 0.3)
    x = np.random.default_rng(2).normal(size=(20, 3))
    rows = spark.createDataFrame([(i, v[i].tolist(), x[i].tolist()) for i in range(20)], "id long, v array<double>, x array<double>")
    for strip in (optimise.STRIP_BYTES, 24 * 20 * 6):
        g, loss = optimise.evaluated(rows, objective, 20, strip)
        assert abs(loss - plain_objective(v, x, config, 0.3)) < 1e-8
        got = {r.id: r.g for r in g.collect()}
    for i, c in ((0, 0), (7, 2), (19, 1)):
        up, down = x.copy(), x.copy()
        up[i, c] += 1e-6
        down[i, c] -= 1e-6
        assert abs(got[i][c] - (plain_objective(v, up, config, 0.3) - plain_objective(v, down, config, 0.3)) / 2e-6) < 1e-4
    found, losses = optimise.minimise(rows.select("id", "v"), rows.select("id", "x"), objective, 5)
    plain_x, plain_losses = plain_lbfgs(v, x, objective, 5)
    assert all(a >= b for a, b in zip(losses, losses[1:], strict=False)) and np.allclose(losses, plain_losses, rtol=1e-9)
    here = np.array([r.x for r in found.orderBy("id").collect()])
    assert np.abs(here - plain_x / np.linalg.norm(plain_x, axis=1, keepdims=True)).max() < 1e-6


def plain_lbfgs(v, x, objective, iterations, memory=5):
    similar = np.clip(v @ v.T, -1, 1)
    np.fill_diagonal(similar, np.nan)

    def look(x):
        lengths = np.linalg.norm(x, axis=1, keepdims=True)
        p = x / lengths
        loss, a, b = objective(similar.copy(), p, p, np.arange(len(x)))
        g = a + b
        return loss, (g - (g * p).sum(axis=1, keepdims=True) * p) / lengths

    loss, g = look(x)
    losses, kept = [loss], []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y in reversed(kept):
            a = (s * q).sum() / (s * y).sum()
            alphas.append(a)
            q -= a * y
        if kept:
            s, y = kept[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(kept, reversed(alphas), strict=True):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        d, rate = -q, 1.0 if kept else min(1.0, 1 / np.linalg.norm(g))
        while look(x + rate * d)[0] > loss + 1e-4 * rate * (g * d).sum():
            rate /= 2
        fresh = look(x + rate * d)
        if (rate * d * (fresh[1] - g)).sum() > 1e-10:
            kept = [*kept, (rate * d, fresh[1] - g)][-memory:]
        x, (loss, g) = x + rate * d, fresh
        losses.append(loss)
    return x, losses


def test_angle_objective(spark, cloud):
    v, x = cloud[:12], np.random.default_rng(3).normal(size=(12, 3))
    rows = spark.createDataFrame([(i, v[i].tolist(), x[i].tolist()) for i in range(12)], "id long, v array<double>, x array<double>")
    _, loss = optimise.evaluated(rows, optimise.angle_objective(lambda t: np.minimum(2 * t, math.pi)), 12)
    p = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum((math.acos(p[i] @ p[j]) - min(2 * math.acos(np.clip(v[i] @ v[j], -1, 1)), math.pi)) ** 2 for i in range(12) for j in range(12) if i != j) / 2
    assert abs(loss - want) < 1e-8


def test_starts_go_down_side_by_side(spark, cloud):
    """In rounds over strips of three sources, or each in a task of its own: the same way down, in a job a round for all starts."""
    config = optimise.RankConfig(starts=3, schedule=(20.0, 1.0))
    points = table(spark, cloud)
    starts = [optimise.spectral_start(points), *[optimise.random_start(points, s) for s in (1, 2)]]
    stages = [optimise.rank_objective(config, 0.3), optimise.rank_objective(config, 0.1)]
    whole, losses = optimise.descend(points, starts, stages, 4)
    strips, again = optimise.descend(points, starts, stages, 4, strip_bytes=24 * 60 * 3)
    assert [len(x) for x in losses] == [2, 2, 2] and all(len(y) == 5 and y == sorted(y, reverse=True) for x in losses for y in x)
    for s in range(3):
        assert np.allclose(losses[s], again[s], rtol=1e-9)
        one, other = (np.array([r.x for r in f(s).orderBy("id").collect()]) for f in (whole, strips))
        assert np.allclose(one, other, atol=1e-6) and np.allclose(np.linalg.norm(one, axis=1), 1)


def test_the_layouts_query_runs_all_starts(spark, monkeypatch):
    """The query's job is that of the operator's own settings, no shorter one."""
    from marlstone.plans import registry

    made = []
    monkeypatch.setattr(optimise, "rank_layout", lambda points, config=None: made.append(config) or (optimise.spectral_start(points), None))
    assert registry.QUERIES["rank_layout"](spark, "/root/testdata/sf0.001").count() > 0
    config = made[0] or optimise.RankConfig()
    assert (config.starts, config.schedule, config.iterations) == (8, (20.0, 5.0, 1.0), 3000)
