"""Golden cases worked out by hand, and negative cases of the validators."""

import hashlib
import json
import math

import pytest
from pyspark.sql import types as T

from marlstone.functions import hangul
from marlstone.operators import graphs, ingest, projection, search, selection, vectors
from marlstone.sources import strict


def test_hangul():
    assert hangul.leads("칼루아 밀크") == "ㅋㄹㅇㅁㅋ"
    assert hangul.jamo("가 값-B") == "ㄱㅏㄱㅏㅄb"
    assert hangul.sanitize("  a\x00​  b" + "c" * 60) == "a b" + "c" * 37
    assert hangul.partial_ratio("abc", "xxabcxx") == 100 and hangul.partial_ratio("abc", "zzz") == 0
    assert hangul.partial_ratio("", "") == 100


def test_search_tiers(spark):
    names = spark.createDataFrame([(1, "gin", "gin"), (2, "gin fizz", "gin fizz"), (3, "pink gin", "pink gin"), (4, "칼루아 밀크", None), (5, None, "rum")], "id long, name string, name_en string")
    rows = search.search(names, "gin", 10).collect()
    assert [(r.id, r.tier, round(r.score, 6), r.field, r.total) for r in rows] == [(1, 4, 1.0, "ko", 3), (2, 3, round(3 / 7, 6), "ko", 3), (3, 2, round(3 / 7, 6), "ko", 3)]
    assert [(r.id, r.kind) for r in search.search(names, "ㅋㄹ", 10).collect()] == [(4, "choseong")]
    assert search.search(names, " ", 10).count() == 0


def test_union_edges_and_knn(spark):
    directed = spark.createDataFrame([(1, 2, 1, 0.9), (2, 1, 3, 0.9), (1, 3, 2, 0.8)], "src long, dst long, rank long, score double")
    got = {(r.a_id, r.b_id): (r.a_rank, r.b_rank, r.mutual) for r in vectors.union_edges(directed).collect()}
    assert got == {(1, 2): (1, 3, True), (1, 3): (2, None, False)}
    points = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(99, None)], "id long, v array<double>")
    few, many = (sorted(map(tuple, vectors.knn(points, 3, block_rows=n).collect())) for n in (5, 2048))
    assert few == many and len(few) == 120
    assert graphs.edge_audit(vectors.knn(points, 3), 3).first().asDict() == dict.fromkeys(["bad_sizes", "bad_ranks", "repeated_targets", "loops", "bad_order", "bad_opposites"], 0)
    bad = vectors.validate(spark.createDataFrame([(1, [0.0, 0.0]), (1, [float("nan"), 1.0]), (None, None)], "id long, v array<double>")).first()
    assert (bad.zero_norms, bad.non_finite, bad.empty_vectors, bad.null_ids, bad.repeated_ids) == (1, 1, 1, 1, 1)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30], "a_id long, b_id long")
    got = {r.id: r.component for r in graphs.components(spark.range(62), edges).collect()}
    assert got == {i: 0 if i <= 30 else 31 if i <= 60 else 61 for i in range(62)}


def test_projection(spark):
    rows = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0, 0.0, 1.0]), (1, 9, [0.0, 0.0, 0.0, 0.0, 1.0]), (2, 0, [1.0, 0.0, 0.0, 0.0, 0.0])], "id long, axis_order int, p array<double>")
    got = {(r.id, r.axis_order): r.value for r in projection.preference_space(rows, [0]).collect()}
    assert got == {(1, 0): 0.8, (1, 9): 1.0, (2, 0): 0.0}
    registry = spark.createDataFrame([(0, "a"), (9, "b")], "axis_order int, category string")
    assert {r.id for r in projection.graph_space(rows, registry).collect()} == {1}
    chosen = spark.createDataFrame([(0, "t", 2.0), (4, "t", 1.0), (20, "f", 1.0)], "axis_order int, category string, weight double")
    got = {r.axis_order: r.share for r in projection.balanced_query(chosen).collect()}
    assert got[0] == pytest.approx(1 / 3) and got[4] == pytest.approx(1 / 6) and got[20] == pytest.approx(0.5) and sum(got.values()) == 1
    assert projection.regroup_axes(rows, 1).collect()[0].id == 2


def _line(prompt, tokens):
    return json.dumps({"request": {"prompt": prompt}, "response": {"candidates": [{"logprobsResult": {"topCandidates": [{"candidates": tokens}]}}]}})


def test_responses(spark):
    good = [{"token": t, "logProbability": math.log(0.1)} for t in ("A", " A", "B", "C", "D")] + [{"token": "E", "log_probability": math.log(0.5)}]
    requests = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k3", "p3"), ("k4", "p4")], "key string, prompt string")
    lines = [_line("p1", good), _line("p2", good[:3]), _line("p3", good), _line("p3", good), _line("px", good), "not json"]
    matched = ingest.match_responses(requests, spark.createDataFrame([(x,) for x in lines], "line string"))
    assert sorted((r.key or "", r.problem or "") for r in matched.collect()) == sorted([("k1", ""), ("k2", ""), ("k3", "duplicate"), ("k3", "duplicate"), ("k4", "missing"), ("", "unknown"), ("", "unknown")])
    parsed = {r.key: r for r in ingest.parse_responses(matched.where("problem is null").select("key", "line")).collect()}
    assert [round(x, 6) for x in parsed["k1"].p] == [0.2, 0.1, 0.1, 0.1, 0.5] and parsed["k2"].problem == "missing label"


def test_jsonl_quarantine(spark):
    axis = lambda i: {"axis_order": i, "probabilities": [0.2] * 5}
    record = lambda n, axes, flat=None: json.dumps({"cocktail_id": n, "axes": axes, "raw_probabilities": flat or [0.2] * 10})
    lines = [record(1, [axis(0), axis(1)]), "", "{", record(1, [axis(0), axis(1)]), record(0, []), record(3, [axis(1), axis(0)]), record(4, [axis(0), axis(1)], [0.1] * 10)]
    got = ingest.validate_jsonl(spark.createDataFrame(list(enumerate(lines)), "n long, line string"), 2).collect()
    assert [r.problem for r in sorted(got)] == [None, "blank", "not JSON", "repeated id", "bad id", "wrong axes", "flat values differ"]


def test_cost(spark):
    row = ingest.batch_cost(28896, 1000, 10, "0.15", "0.60", spark).first()
    assert str(row.cost) == "4.507776"


def test_strict_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    (tmp_path / "a.csv").write_text("﻿id,name\n1,x\n2,\n")
    assert sorted(map(tuple, strict.read_csv(spark, f"{tmp_path}/a.csv", schema).collect())) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="header"):
        strict.read_csv(spark, f"{tmp_path}/a.csv", T.StructType(list(reversed(schema.fields))))
    (tmp_path / "b.csv").write_text("id,name\nx,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        strict.read_csv(spark, f"{tmp_path}/b.csv", schema).collect()
    rows = spark.createDataFrame([(1, "x"), (2, None)], schema)
    strict.write_csv_verified(rows, f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)exist"):
        strict.write_csv_verified(rows, f"{tmp_path}/out")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one").write_bytes(b"1")
    (tmp_path / "m" / "two").write_bytes(b"2")
    manifest = spark.createDataFrame([("one", hashlib.sha256(b"other").hexdigest()), ("three", "0")], "name string, sha256 string")
    assert sorted(map(tuple, strict.manifest_check(spark, f"{tmp_path}/m", manifest).collect())) == [("one", "changed"), ("three", "missing"), ("two", "undeclared")]


def test_selection(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["a"])], "id long, features array<string>")
    assert [r.id for r in selection.farthest_first(items, 3).orderBy("pick").collect()] == [1, 3, 4]
    points = spark.createDataFrame([(i, [1.0, i * 0.01]) for i in range(5)] + [(i, [-1.0, i * 0.01]) for i in range(5, 10)], "id long, v array<double>")
    groups = {}
    for r in selection.k_medoids(points, 2).collect():
        groups.setdefault(r.medoid, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_entry_imports_without_llm():
    import __spark_entry__

    assert {"knn_topk", "like_ranking"} <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
