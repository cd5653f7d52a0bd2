"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import contaminated
from .hard_negatives import hard_negatives
from .html_text import extract_text
from .language_id import identify_languages
from .licences import scan_licences
from .packing import best_fit_pack
from .pieces import piece_digests
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .simhash import simhash_groups
from .suffix_dedup import suffix_array_dedup
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree source/lang/hundred; the first of each hundred ids is that directory's LICENSE."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return scan_licences(docs.select("doc_id", path.alias("path"), "text"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentencepiece": op13_sentencepiece,
}

_COLLOCATIONS = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents)),
f AS (SELECT lang, len(g) AS k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (VALUES (1), (2), (3), (4)) AS t(k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, f, cut, array_to_string(g[1:cut], ' ') AS p1, array_to_string(g[cut + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.f AS a, a.f AS l, b.f AS r, cut, ((2000000::HUGEINT * cuts.f) // (a.f + b.f))::BIGINT AS score FROM cuts JOIN f a ON a.lang = cuts.lang AND a.phrase = p1 JOIN f b ON b.lang = cuts.lang AND b.phrase = p2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
inside AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(g[i:i + m - 1], ' '))) AS sub FROM c, (VALUES (2), (3)) AS t(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND sub = phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT kept.*, n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN n ON n.lang = kept.lang) WHERE rank <= 2000
"""

_HARD_NEGATIVES = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS key FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.key, a.id AS anchor_id, b.id AS other_id, b.key AS other_key, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.key <> b.key AND len(a.q) = len(b.q) WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT key, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY key ORDER BY score DESC, other_id NULLS LAST, other_key) AS place FROM s WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
 SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.key, p.place ORDER BY s.score DESC, s.other_id NULLS LAST, s.other_key) AS rank
 FROM p JOIN s ON s.key = p.key AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score) WHERE rank <= 10
"""

#: DuckDB SQL where SQL can express the operator over whole tables.
ORACLES: dict[str, str] = {"op11_phrase_collocations": _COLLOCATIONS, "op12_hard_negatives": _HARD_NEGATIVES}
