import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text
from marlstone.operators import ingest, ordering, sphere
from marlstone.sources import strict, vector_files


def one(spark, value, kind, *columns):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, " One.  Two! three ", "string", text.sentences(x))[0] == ["One.", "Two!", "three"]
    assert one(spark, "", "string", text.sentences(x))[0] == [""]
    assert one(spark, " a \t b\n", "string", text.collapse(x), text.lookup_key(F.upper(x))) == ("a b", "a b")

    def plain(value, most):
        flat = " ".join(value.split())
        return flat if len(flat) <= most else flat[: most - 1].rsplit(" ", 1)[0].rstrip(" ,;:-").rstrip(".") + "."

    for value in ("short", "a gin drink, with lime; and more of it", "onelongword" * 3, "ends here. And goes on for a while"):
        for most in (8, 12, 20, 60):
            assert one(spark, value, "string", text.shortened(x, most))[0] == plain(value, most)
    ids = {"1": True, "10": True, "01": False, "0": False, "-1": False, "1a": False, "": False, None: False}
    assert {k: one(spark, k, "string", text.is_canonical_id(x))[0] for k in ids} == ids
    assert one(spark, "run.v1-a", "string", text.is_identifier(x), text.is_sha256(x)) == (True, False)
    assert one(spark, "cocktail-17.JPEG", "string", text.image_id(x))[0] == 17 and one(spark, "cocktail-017.png", "string", text.image_id(x))[0] is None
    base = "https://img.example.org/c"
    urls = {f"{base}/1.webp": f"{base}/1-thumb.webp", f"{base}/1.webp?x": f"{base}/1.webp?x", f"{base}/1.png": f"{base}/1.png", "https://other.org/c/1.webp": "https://other.org/c/1.webp"}
    assert {k: one(spark, k, "string", text.thumbnail_url(x, base + "/"))[0] for k in urls} == urls
    late = spark.sql("SELECT timestamp'2026-01-01 15:30:00' AS x").select(text.korean_date(x)).first()[0]
    assert late == "2026-01-02"
    assert one(spark, "[1.5,-2]", "string", text.parse_vector(x), text.vector_literal(text.parse_vector(x))) == ([1.5, -2.0], "[1.5,-2.0]")


def test_hashes(spark):
    assert text.canonical_sha256({"b": 1, "a": "é"}) == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest()
    ids = spark.createDataFrame([(10,), (9,), (100,)], "id long")
    assert text.id_set_sha256(ids) == text.canonical_sha256({"cocktail_ids": ["9", "10", "100"]})
    got = one(spark, [0.1, -2.0], "array<double>", text.vector_hash(F.col("x")))[0]
    assert got == text.canonical_sha256([(0.1).hex(), (-2.0).hex()])


def test_sphere_and_ranks(spark):
    points = sphere.fibonacci_sphere(spark, 50).orderBy("id").collect()
    for i, p in enumerate(points):
        z = 1 - 2 * (i + 0.5) / 50
        assert abs(p.z - z) < 1e-12 and abs(p.x**2 + p.y**2 + p.z**2 - 1) < 1e-12
    assert abs(one(spark, 9.0, "double", sphere.normal_tail(F.col("x")))[0] / (0.5 * math.erfc(9 / math.sqrt(2))) - 1) < 1e-12
    values = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(i, v, -v) for i, v in enumerate(values)], "id long, a double, b double")
    ranks = {r.id: r.rank for r in sphere.with_average_rank(df, "a", "rank").collect()}
    assert ranks == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: 5.0, 5: 1.5}
    ks = sphere.ks_distance(df, "a", F.col("a") / 4).first()[0]
    cdf = lambda v: sum(x <= v for x in values) / 6
    assert abs(ks - max(max(abs(cdf(v) - v / 4), abs(v / 4 - sum(x < v for x in values) / 6)) for v in values)) < 1e-12
    row = ordering.inversions(df, "a", "b").first()
    assert row.comparable == row.inverted == 11 and row.kendall_tau == -1
    assert ordering.inversions(df, "a", "a").first().inverted == 0
    pooled = sphere.mean_pooled(spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0]), (2, [1.0, 0.0]), (2, [-1.0, 0.0])], "owner long, v array<double>")).collect()
    assert len(pooled) == 1 and pooled[0].v == pytest.approx([0.6, 0.8])


def run_of(spark, k=2):
    run = spark.createDataFrame([("run.v1", "a" * 64, 3, k, "b" * 64)], vector_files.RUN)
    near = {1: [2, 3], 2: [1, 3], 3: [1, 2], 10: [1, 2]}
    rows = [("run.v1", str(s), str(t), r + 1, 0.5 - r / 10) for s, ts in near.items() for r, t in enumerate(ts)]
    pairs = sorted({tuple(sorted((s, t))) for s, ts in near.items() for t in ts})
    rank = lambda a, b: near[a].index(b) + 1 if a in near and b in near[a] else None
    edges = [("run.v1", str(a), str(b), 0.5, rank(a, b), rank(b, a)) for a, b in pairs]
    return run, spark.createDataFrame(rows, vector_files.NEIGHBOURS), spark.createDataFrame(edges, vector_files.EDGES)


def test_bundle(spark, tmp_path):
    run, neighbours, edges = run_of(spark)
    vector_files.write_bundle(run, neighbours, edges, f"{tmp_path}/b", 2)
    back = vector_files.read_bundle(spark, f"{tmp_path}/b")
    for want, got in zip((run, neighbours, edges), back):
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        vector_files.write_bundle(run, neighbours, edges, f"{tmp_path}/b", 2)
    vector_files.write_bundle(run, neighbours, edges.limit(3), f"{tmp_path}/c", 2)
    with pytest.raises(ValueError, match="not those"):
        vector_files.read_bundle(spark, f"{tmp_path}/c")
    for bad in (neighbours.where("source_id <> '1' or rank = 1"), neighbours.withColumn("target_id", F.col("source_id")), neighbours.withColumn("cosine", F.lit(1.5)), neighbours.withColumn("source_id", F.lit("01"))):
        with pytest.raises(ValueError):
            vector_files.write_neighbours(bad, f"{tmp_path}/n", 2)
    with pytest.raises(ValueError):
        vector_files.write_edges(edges.union(edges), f"{tmp_path}/e")
    with pytest.raises(ValueError):
        vector_files.write_edges(edges.withColumns({"a_id": F.col("b_id"), "b_id": F.col("a_id")}), f"{tmp_path}/e")


def test_vectors_lines_and_shards(spark, tmp_path):
    vectors = spark.createDataFrame([(1, 'a "quoted", name', [0.123456789012, 1.0]), (2, "b", [-1.0, 0.5])], "id long, name string, v array<double>")
    vector_files.write_vectors(vectors, f"{tmp_path}/v")
    got = {r.id: (r.name, r.v) for r in vector_files.read_vectors(spark, f"{tmp_path}/v").collect()}
    assert got == {1: ('a "quoted", name', [0.12345679, 1.0]), 2: ("b", [-1.0, 0.5])}
    vector_files.write_vectors(vectors.union(vectors), f"{tmp_path}/w")
    with pytest.raises(ValueError):
        vector_files.read_vectors(spark, f"{tmp_path}/w")
    requests = spark.createDataFrame([(f"r{i}", i, "p") for i in range(20)], "key string, axis_order int, prompt string")
    vector_files.write_jsonl(requests, f"{tmp_path}/j")
    assert {r.value for r in spark.read.text(f"{tmp_path}/j").collect()} == {json.dumps({"axis_order": i, "key": f"r{i}", "prompt": "p"}, separators=(",", ":")) for i in range(20)}
    vector_files.write_shards(requests, f"{tmp_path}/s")
    rows = spark.read.text(f"{tmp_path}/s").collect()
    assert len(rows) == 20 and all(json.loads(r.value)["axis_order"] % 8 == r.shard for r in rows)
    wide = ingest.vector_to_wide(vectors, ["x", "y"])
    assert wide.columns == ["id", "x", "y"]
    assert sorted(ingest.wide_to_vector(wide, ["x", "y"]).collect()) == sorted(vectors.select("id", "v").collect())


def test_blank_rows_and_quoted_headers(spark, tmp_path):

    schema = T.StructType([T.StructField("a,b", T.StringType()), T.StructField("c", T.LongType())])
    (tmp_path / "q.csv").write_text('"a,b",c\nx,1\n')
    assert [tuple(r) for r in strict.read_csv(spark, f"{tmp_path}/q.csv", schema).collect()] == [("x", 1)]
    (tmp_path / "r.csv").write_text('"a,b",c\nx,1\n,\n')
    with pytest.raises(ValueError, match="blank"):
        strict.read_csv(spark, f"{tmp_path}/r.csv", schema)


def test_every_files_header_is_checked(spark, tmp_path):
    schema = T.StructType().add("a", "string").add("b", "string")
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="header"):
        strict.read_csv(spark, str(tmp_path), schema).collect()
    (tmp_path / "two.csv").write_text("a,b\n3,4\n")
    assert sorted(map(tuple, strict.read_csv(spark, str(tmp_path), schema).collect())) == [("1", "2"), ("3", "4")]
    (tmp_path / "two.csv").unlink()
    (tmp_path / "one.csv").write_text("\ufeffa,b\n1,2\n", encoding="utf-8")
    assert [tuple(r) for r in strict.read_csv(spark, str(tmp_path), schema).collect()] == [("1", "2")]
