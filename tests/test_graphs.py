import random

from marlstone.operators import graphs


def test_components_with_hubs_chains_and_repeats(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, 9000), (7, 8), (8, 7), (None, 3), (4, None)]
    edges += [(rng.randint(10_000, 10_400), rng.randint(10_000, 10_400)) for _ in range(300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.linked(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if x != 9000 and any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert graphs.linked(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    import pytest

    from marlstone.session import shared_dir

    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake)


def test_local_contraction_keeps_components_over_chunks(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(graphs, "CHUNK_EDGES", 50)
    rng = random.Random(8)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1001 - i, 1000 - i) for i in range(100)]
    batches = [pd.DataFrame(pairs[at : at + 20], columns=["u", "v"]) for at in range(0, len(pairs), 20)]
    fewer = pd.concat(list(graphs._contracted(iter(batches))))

    def classes(edges):
        of = {}
        for u, v in edges:
            both = of.get(u, {u}) | of.get(v, {v})
            for x in both:
                of[x] = both
        return {frozenset(s) for s in of.values() if len(s) > 1}

    assert len(fewer) <= len(pairs) and (fewer.u > fewer.v).all()
    assert classes(fewer.itertuples(index=False)) == classes(pairs)
    assert list(graphs._contracted(iter([]))) == []
