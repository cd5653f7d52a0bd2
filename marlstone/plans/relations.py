"""Named relations that the registered queries build on: how Spark makes them, and their DuckDB definition for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import domain, inverted, sphere, vectors
from ..session import table

TABLES = "region nation customer supplier part orders lineitem events".split()
Builder = Callable[[SparkSession, str], DataFrame]
#: Neighbours of a source.
K = 5
#: Evenly spread points at which the covering radius is measured.
PROBES = 1000

#: name: (Spark, DuckDB); DuckDB definitions may use others with @.
RELATIONS: dict[str, tuple[Builder, str]] = {
    "v": (domain.vectors, "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "pairs": (lambda s, d: vectors.all_pairs(domain.vectors(s, d)), "SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM @v a JOIN @v b ON a.id <> b.id"),
    "knn": (lambda s, d: vectors.knn(domain.vectors(s, d), K), "SELECT src, dst, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM @pairs) WHERE rank <= 5"),
    "c": (domain.coordinates, "SELECT id, label, [v[1] / n, v[2] / n, v[3] / n] AS v, v[1] / n AS x, v[2] / n AS y, v[3] / n AS z FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS n FROM @v) WHERE n > 1e-12"),
    "means": (lambda s, d: sphere.label_sums(domain.coordinates(s, d)), "SELECT label, sum(x) AS x, sum(y) AS y, sum(z) AS z, sqrt(sum(x) * sum(x) + sum(y) * sum(y) + sum(z) * sum(z)) AS n FROM @c GROUP BY label"),
    "cpairs": (lambda s, d: vectors.all_pairs(domain.coordinates(s, d)), "SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM @c a JOIN @c b ON a.id <> b.id"),
    "twins": (lambda s, d: vectors.paired(domain.vectors(s, d), domain.coordinates(s, d)), "SELECT p.src, p.dst, p.score, c.score AS placed FROM @pairs p JOIN @cpairs c ON p.src = c.src AND p.dst = c.dst WHERE p.src < p.dst"),
    "cknn": (lambda s, d: inverted.nearest(domain.coordinates(s, d), K), "SELECT src, dst, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM @cpairs) WHERE rank <= 5"),
    "edges": (lambda s, d: vectors.union_edges(vectors.knn(domain.vectors(s, d), K)), "SELECT least(src, dst) AS a_id, greatest(src, dst) AS b_id, max(score) AS score, max(CASE WHEN src < dst THEN rank END) AS a_rank, max(CASE WHEN src > dst THEN rank END) AS b_rank, max(CASE WHEN src < dst THEN rank END) IS NOT NULL AND max(CASE WHEN src > dst THEN rank END) IS NOT NULL AS mutual FROM @knn GROUP BY 1, 2"),
    "probes": (lambda s, d: sphere.fibonacci_sphere(s, PROBES), f"SELECT id, sqrt(greatest(0.0, 1 - z * z)) * cos(phi) AS x, sqrt(greatest(0.0, 1 - z * z)) * sin(phi) AS y, z FROM (SELECT range AS id, 1 - 2 * (range + 0.5::DOUBLE) / {PROBES} AS z, (range + 0.5::DOUBLE) * pi() * (1 + sqrt(5)) AS phi FROM range({PROBES}))"),
    # Spark's alone: neighbours in one space with their ranks in the other, neighbours among the rows of a label
    "knn_ranked": (lambda s, d: vectors.ranks_of(domain.coordinates(s, d), vectors.knn(domain.vectors(s, d), K).select("src", "dst"), K), ""),
    "cknn_ranked": (lambda s, d: vectors.ranks_of(domain.vectors(s, d), vectors.knn(domain.coordinates(s, d), K).select("src", "dst"), K), ""),
    "lknn": (lambda s, d: vectors.knn(domain.vectors(s, d), K, within="label"), ""),
    "lcknn": (lambda s, d: vectors.knn(domain.coordinates(s, d), K, within="label"), ""),
    "parts": (domain.parts, "SELECT p_partkey AS id, p_name AS name, p_brand AS base_tag, p_type AS glass, p_size AS abv, p_retailprice AS price FROM part"),
    "items": (domain.items, "SELECT p_partkey AS id, p_name AS name, p_brand AS base_tag, p_type AS glass, p_size AS abv, p_retailprice AS price, v AS embedding FROM part LEFT JOIN @v ON p_partkey = @v.id"),
    "likes": (domain.likes, "SELECT o_custkey AS user_id, l_partkey AS item_id, max(o_orderdate) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"),
    "bridge": (domain.bridge, "SELECT l_orderkey AS cocktail_id, l_partkey AS ingredient_id, l_quantity AS amount, l_returnflag AS unit FROM lineitem"),
} | {t: (lambda s, d, t=t: table(s, d, t), "") for t in TABLES}

_NAME = re.compile(r"@(\w+)")
_PCT = re.compile(r"PCT\(([^,]+), ([\d.]+)\)")
#: Numbers with a point are meant as doubles in both dialects, not as decimals.
_POINT = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")
#: count_if has other result types in the two dialects.
_IF = re.compile(r"count_if\(((?:[^()]|\([^()]*\))*)\)")
_AT = re.compile(r"AT\((\w+(?:\.\w+)?), (\d+)\)")


def _common(text: str) -> str:
    return _POINT.sub(r"\1e0", _IF.sub(r"count(CASE WHEN \1 THEN 1 END)", text))


def spark_sql(text: str) -> Builder:
    """A query text over @relations as a callable. PCT(x, q): the exact interpolated quantile; AT(v, i): the i-th element, from 1."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = sorted(set(_NAME.findall(text)))
        plain = _common(_AT.sub(lambda m: f"{m[1]}[{int(m[2]) - 1}]", _PCT.sub(r"percentile(\1, \2)", text)))
        return spark.sql(_NAME.sub(r"{\1}", plain), **{n: RELATIONS[n][0](spark, sf_dir) for n in names})

    return run


def duckdb_sql(text: str) -> str:
    """The same query text for DuckDB, with the relations it needs as common table expressions."""
    needed: dict[str, str] = {}

    def need(name: str) -> None:
        definition = RELATIONS[name][1]
        if name in needed or not definition:
            return
        for other in _NAME.findall(definition):
            need(other)
        needed[name] = _NAME.sub(r"\1", definition)

    for name in _NAME.findall(text):
        need(name)
    body = _common(_AT.sub(r"\1[\2]", _PCT.sub(r"quantile_cont(\1, \2)", _NAME.sub(r"\1", text))))
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in needed.items()) + " " if needed else "") + body
