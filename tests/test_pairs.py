import numpy as np
import pytest

from marlstone.operators import pairs, vectors
from marlstone.plans import registry
from marlstone.plans.relations import RELATIONS

SF = "/root/testdata/sf0.001"
#: Queries of sums, quantiles and ranks over all pairs; their values are held against DuckDB in test_queries.
FOLDED = [
    "borda_rank",
    "ks_uniform_sphere",
    "nearest_compressed",
    "true_rank_summary",
    "dist_summary",
    "stretch_deciles",
    "false_close_all",
    "false_close_graph",
    "inspection_table",
    "intruders",
    "within_cluster_sep",
    "within_cluster_recall",
    "cluster_separation",
    "angle_corr",
    "nn_angles",
    "normalized_stress",
    "angle_spearman",
    "nonedge_sample",
    "ranking_triples",
    "silhouette",
    "relation_recall",
    "spot_check",
]


@pytest.mark.parametrize("name", FOLDED)
def test_no_pair_leaves_its_tile(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("all pairs as rows")

    for relation in ("pairs", "cpairs", "twins"):
        monkeypatch.setitem(RELATIONS, relation, (refused, ""))
    monkeypatch.setattr(vectors, "all_pairs", refused)
    monkeypatch.setattr(vectors, "paired", refused)
    assert registry.QUERIES[name](spark, SF).count() > 0


def _copies(spark):
    """Vectors in groups of copies, with ids beyond 2^53."""
    base = np.random.default_rng(3).normal(size=(40, 6))
    v = base[np.arange(300) % 40]
    ids = 2**53 + np.arange(300)
    return ids, v, spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in zip(ids, v)], "id long, v array<double>")


def _cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.round(np.clip(u @ u.T, -1, 1), 12)


def test_ranks_of_copies(spark):
    ids, v, df = _copies(spark)
    scores = _cosines(v)
    wanted = [(i, (i * 7 + 3 * q + 1) % 300) for i in range(0, 300, 2) for q in range(3)]
    wanted = sorted({(i, j) for i, j in wanted if i != j})
    asked = spark.createDataFrame([(int(ids[i]), int(ids[j])) for i, j in wanted], "src long, dst long")
    got = {(r["src"], r["dst"]): r["rank"] for r in vectors.ranks_of(df, asked, 3, 32, 2048).collect()}
    before = lambda i, j: sum(k != i and (scores[i, k] > scores[i, j] or (scores[i, k] == scores[i, j] and k < j)) for k in range(300))
    assert got == {(ids[i], ids[j]): 1 + before(i, j) for i, j in wanted}


def test_quantiles_and_steps_of_copies(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MIN_ROWS", 40)
    _, v, df = _copies(spark)
    x = np.sort(_cosines(v)[np.triu_indices(300, 1)])
    places = [0, 1, 1000, len(x) // 2, len(x) - 2, len(x) - 1]
    n, found = pairs.order_statistics(df, [6], lambda n: places)
    assert n == len(x) and [found[p] for p in places] == pytest.approx([x[p] for p in places], abs=2e-12)
    cdf, r = (1 - x[::-1]) / 2, np.arange(1, len(x) + 1)
    assert pairs.ks_uniform(df, [6]).first()["ks"] == pytest.approx(np.max(np.maximum(r / len(x) - cdf, cdf - (r - 1) / len(x))), abs=1e-9)


def test_neighbours_within_a_label(spark):
    ids, v, df = _copies(spark)
    df = df.selectExpr("id", "v", "if(id % 5 = 4, null, cast(id % 5 as int)) as label")
    scores, label = _cosines(v), ids % 5
    got = {}
    for r in vectors.knn(df, 4, block_rows=32, group_bytes=2048, within="label").collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(300):
        others = [k for k in range(300) if k != i and label[k] == label[i] != 4]
        assert [got.get(ids[i], {})[q] for q in sorted(got.get(ids[i], {}))] == [ids[k] for k in sorted(others, key=lambda k: (-scores[i, k], k))[:4]]


def test_zscores_of_every_pair(spark):
    got = registry.QUERIES["zscore_offdiag"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.columns == ["src", "dst", "z"] and got.count() == n * (n - 1)


def _refused(*_, **__):
    raise AssertionError("a pair is compared twice")


def test_rounding_is_that_of_spark(spark):
    x = np.concatenate((np.random.default_rng(1).normal(size=2000) * 3, [0.5, 1.0000005, -1.0000005, 2.5e-7, -4e-7, 1.0000015, 8589.9345915, 123456789.1234565, -1e300, np.inf, -np.inf, np.nan], np.arange(-40, 40) / 2e6 + 0.25))
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").selectExpr("i", "round(x, 6) as r").toPandas().sort_values("i")["r"].to_numpy()
    mine = pairs.rounded(x, 6)
    assert np.array_equal(mine, got, equal_nan=True) and not np.signbit(mine[mine == 0]).any()
    assert len(pairs.rounded(np.array([]), 6)) == 0


@pytest.mark.parametrize("both", [False, True])
def test_each_pair_is_compared_once(spark, both):
    ids, v, df = _copies(spark)
    scores = _cosines(v)
    compared = spark.sparkContext.accumulator(0)

    def value(x):
        compared.add(len(x))
        return x

    got = {}
    for r in pairs.each(df, 6, "score", value, both, group_bytes=4096).collect():
        assert (r.src, r.dst) not in got
        got[r.src, r.dst] = r.score
    want = {(ids[i], ids[j]): scores[i, j] for i in range(300) for j in range(300) if (ids[i] != ids[j] if both else ids[i] < ids[j])}
    assert got.keys() == want.keys() and compared.value == 300 * 299 // 2
    assert all(got[k] == pytest.approx(want[k], abs=1e-11, nan_ok=True) for k in want)


def test_all_pairs_of_the_query_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "all_pairs", _refused)
    got = registry.QUERIES["all_pairs"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.columns == ["a_id", "b_id", "score"] and got.where("a_id < b_id").count() == got.count() == n * (n - 1) // 2


def test_zscores_are_made_where_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(vectors, "all_pairs", _refused)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, v array<double>")
    monkeypatch.setattr("marlstone.operators.domain.vectors", lambda *_: same)
    got = registry.QUERIES["zscore_offdiag"](spark, SF)  # (no deviation, no z-score)
    assert got.count() == 20 and got.where("z is not null").count() == 0


@pytest.mark.parametrize("most", [1 << 26, 500, 1])
def test_crowded_cells_are_cut_up(spark, monkeypatch, most):
    """No more than ``MOST`` pairs are looked at one by one, unless they are of one cosine; the results stay exact."""
    monkeypatch.setattr(pairs, "MOST", 16 * most)
    looked = []
    within = pairs.within_cells
    monkeypatch.setattr(pairs, "within_cells", lambda rows, widths, cells: looked.append((cells.n.sum(), cells.bits)) or within(rows, widths, cells))
    v = np.random.default_rng(4).normal(size=(500, 3))
    v[250:300] = v[:50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    x = np.sort(_cosines(v)[np.triu_indices(500, 1)])
    cdf, r = (1 - x[::-1]) / 2, np.arange(1, len(x) + 1)
    assert pairs.ks_uniform(df, [3]).first()["ks"] == pytest.approx(np.max(np.maximum(r / len(x) - cdf, cdf - (r - 1) / len(x))), abs=1e-11)
    n, found = pairs.order_statistics(df, [3], lambda n: [0, n // 3, n - 1])
    assert n == len(x) and [found[p] for p in (0, n // 3, n - 1)] == pytest.approx([x[0], x[n // 3], x[-1]], abs=2e-12)
    assert all(held <= 16 * most or bits == pairs.FINEST for held, bits in looked)


def test_one_pass_for_both_spaces(spark, monkeypatch):
    """Ranks in two spaces need one histogram pass and one of sums; a histogram of one space compares no other."""
    made, widths = [], []
    folded = pairs.folded
    monkeypatch.setattr(pairs, "folded", lambda rows, w, *a: made.append(1) or widths.append(w) or folded(rows, w, *a))
    registry.QUERIES["angle_spearman"](spark, SF).collect()
    assert len(made) == 2
    widths.clear()
    registry.QUERIES["stretch_deciles"](spark, SF).collect()
    assert [len(w) for w in widths] == [1, 1, 2]


def test_deciles_of_cells_are_those_of_the_angles():
    from marlstone.plans import layout

    edges = np.array([0.3, 0.3, 0.8, 1.2, 1.5, 1.6, 2.0, 2.5, 3.0])
    table = layout._deciles(edges)
    x = np.concatenate((np.random.default_rng(1).uniform(-1, 1, 5000), np.cos(edges), [-1.0, 1.0, np.nan]))
    got = table[pairs.cell(x)]
    want = np.searchsorted(edges, np.arccos(x), side="right")
    assert len(table) == pairs.CELLS + 2 and np.all((got == want) | (got == layout._NEAR))
    assert np.all(got[5000:5009] == layout._NEAR) and np.count_nonzero(table == layout._NEAR) <= 2 * len(edges) + 1


def test_digests_are_dealt_out_evenly(spark, monkeypatch):
    """Many groups of about as many sources, so that no core waits for another that has a block more; the digests are the least."""
    import hashlib

    made, tiles = [], vectors._tiles
    monkeypatch.setattr(vectors, "MIN_ROWS", 10)
    monkeypatch.setattr(vectors, "_tiles", lambda *a: made.append(tiles(*a)) or made[-1])
    ids, _, df = _copies(spark)
    found = vectors.least_digests(df, 3, "7", block_rows=64)
    dealt = [r["n"] for r in made[0][0].where("kind = 0").groupBy("tile").agg({"ids": "count"}).withColumnRenamed("count(ids)", "n").collect()]
    assert len(dealt) > 2 * spark.sparkContext.defaultParallelism and max(dealt) == 1
    got = {}
    for r in found.collect():
        got.setdefault(r["src"], []).append((bytes(r["digest"]), r["dst"]))
    want = lambda i: sorted((hashlib.sha256(f"7\0{i}\0{j}".encode()).digest(), j) for j in ids.tolist() if j != i)[:3]
    assert {i: sorted(x) for i, x in got.items()} == {i: want(i) for i in ids.tolist()}
