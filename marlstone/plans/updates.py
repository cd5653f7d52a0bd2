"""Queries of stored rows: keyed updates, their verification, exports that skip what is current, query vectors from request rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domain, projection
from ..session import shared_dir, table
from ..sources.keyed_table import KeyedTable, export, verify_update
from .relations import duckdb_sql


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _catalogue(spark: SparkSession, d: str) -> tuple[KeyedTable, DataFrame]:
    """Documents as a keyed table without labels, and the labels as its update table."""
    docs = table(spark, d, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    none = F.lit(None).cast("int")
    stored = KeyedTable(spark, _folder(spark, "catalogue"), "doc_id")
    stored.create(docs.select("doc_id", "lang", "source", none.alias("quality"), none.alias("toxic")).repartitionByRange("doc_id"))
    return stored, table(spark, d, "labels").select("doc_id", "quality", "toxic")


def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    """Documents after the update that their labels make: those of known documents, by key."""
    stored, labels = _catalogue(spark, d)
    known = labels.join(stored.read().select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    stored.update(known, ["quality", "toxic"])
    return stored.read()


def update_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a dry run says of labels and of as many keys that no document has; the table keeps its one version."""
    stored, labels = _catalogue(spark, d)
    strange = labels.select((-1 - F.col("doc_id")).alias("doc_id"), "quality", "toxic")
    plan = stored.update(labels.unionByName(strange), ["quality", "toxic"], dry_run=True)
    row = (plan.rows, plan.repeated_keys, plan.null_keys, plan.unknown_keys, plan.hit_rows, len(stored.versions()))
    return spark.createDataFrame([row], "rows long, repeated_keys long, null_keys long, unknown_keys long, hit_rows long, versions long")


def update_verified(spark: SparkSession, d: str) -> DataFrame:
    """Vectors updated to unit length where the label is even, and what the check after the write finds."""
    v = domain.vectors(spark, d)
    stored = KeyedTable(spark, _folder(spark, "vectors"), "id")
    stored.create(v.select("id", F.transform("v", lambda x: x * 2).alias("v"), "label").repartitionByRange("id"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stored.update(v.where("label % 2 = 0").select("id", F.transform("v", lambda x: x / length).alias("v")), ["v"])
    found = verify_update(stored.read(), v.select("id", F.transform("v", lambda x: x / length).alias("v")), "id", {"v": 64})
    return found.select("name", "rows", "nulls", "wrong_dimensions", "norms_off", F.round("max_drift", 6).alias("max_drift"), "drifted")


def export_run(spark: SparkSession, d: str) -> DataFrame:
    """The second run of an export of documents, between which and the first their labels have come in: valid, invalid, current and generated rows, and the rows exported in all."""
    docs = table(spark, d, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    folder = _folder(spark, "export")
    summarise = lambda rows: rows.select("doc_id", F.length("text").alias("length"), "quality")
    wrong = F.coalesce(F.length("text") < 40, F.lit(True))
    export(docs.withColumn("quality", F.lit(None).cast("int")), folder, "doc_id", summarise, wrong, batches=2)
    second = export(docs.join(labels, "doc_id", "left"), folder, "doc_id", summarise, wrong, batches=2)
    total = KeyedTable(spark, folder, "doc_id").read().count()
    return spark.createDataFrame([(second.valid, second.invalid, second.current, second.generated, total)], "valid long, invalid long, current_rows long, generated long, exported long")


def balanced_query(spark: SparkSession, d: str) -> DataFrame:
    """A query vector for each user from the items they like: an item speaks for the axis of its number modulo 12 in one of 4 categories, a like has weight 1."""
    likes = domain.likes(spark, d)
    axis = F.pmod("item_id", F.lit(12))
    chosen = likes.groupBy(F.col("user_id").alias("request"), axis.alias("axis_order")).agg(F.count("*").cast("double").alias("weight")).withColumn("category", F.col("axis_order") % 4)
    return projection.balanced_queries(chosen).select("request", F.col("axis_order").cast("long").alias("axis"), F.round("share", 9).alias("share"))


def parse_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Event properties by what is wrong with them, the first reason of each row; the accepted ones have none."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    reason = F.when(F.col("props").isNull(), "missing").when(F.try_parse_json("props").isNull(), "not json").when(k.isNull(), "no number k").when(k < 0, "negative").when(F.col("value").isNull(), "no value").otherwise("accepted")
    return table(spark, d, "events").groupBy(reason.alias("reason"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_LABELS = "(SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id)"
_DOCS = "(SELECT doc_id, min(lang) AS lang, min(source) AS source, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_ALL = [
    ("keyed_update", keyed_update, f"SELECT d.doc_id, d.lang, d.source, l.quality::INTEGER AS quality, l.toxic::INTEGER AS toxic FROM {_DOCS} d LEFT JOIN {_LABELS} l ON l.doc_id = d.doc_id"),
    ("update_plan", update_plan, f"WITH u AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT -1 - doc_id FROM labels) GROUP BY doc_id) SELECT sum(n)::BIGINT AS rows, count_if(n > 1)::BIGINT AS repeated_keys, count_if(u.doc_id IS NULL)::BIGINT AS null_keys, count_if(u.doc_id IS NOT NULL AND d.doc_id IS NULL)::BIGINT AS unknown_keys, count_if(d.doc_id IS NOT NULL)::BIGINT AS hit_rows, 1::BIGINT AS versions FROM u LEFT JOIN {_DOCS} d ON d.doc_id = u.doc_id"),
    ("update_verified", update_verified, "WITH x AS (SELECT vec_id, label % 2 = 0 AS hit, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), y AS (SELECT vec_id, hit, v, n, CASE WHEN hit THEN 0.0 ELSE list_max(list_transform(v, lambda e: abs(e * 2 - e / n))) END AS drift FROM x) SELECT 'v' AS name, count(*) AS rows, 0::BIGINT AS nulls, count_if(len(v) <> 64)::BIGINT AS wrong_dimensions, count_if(NOT hit AND abs(2 * n - 1) > 1e-6)::BIGINT AS norms_off, round(max(drift), 6) AS max_drift, count_if(drift > 1e-6)::BIGINT AS drifted FROM y"),
    ("export_run", export_run, f"WITH x AS (SELECT coalesce(length(text) < 40, true) AS wrong, quality FROM {_DOCS} d LEFT JOIN {_LABELS} l ON l.doc_id = d.doc_id) SELECT count_if(NOT wrong)::BIGINT AS valid, count_if(wrong)::BIGINT AS invalid, count_if(NOT wrong AND quality IS NULL)::BIGINT AS current_rows, count_if(NOT wrong AND quality IS NOT NULL)::BIGINT AS generated, count_if(NOT wrong)::BIGINT AS exported FROM x"),
    ("balanced_query", balanced_query, duckdb_sql("SELECT request, axis, round(weight / sum(weight) OVER (PARTITION BY request, axis % 4) / categories, 9) AS share FROM (SELECT user_id AS request, item_id % 12 AS axis, count(*)::DOUBLE AS weight FROM @likes GROUP BY 1, 2) JOIN (SELECT user_id AS request, count(DISTINCT item_id % 12 % 4) AS categories FROM @likes GROUP BY 1) USING (request)")),
    ("parse_reasons", parse_reasons, "SELECT reason, event_type, count(*) AS n, min(event_id) AS first FROM (SELECT event_type, event_id, CASE WHEN props IS NULL THEN 'missing' WHEN NOT json_valid(props) THEN 'not json' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'no number k' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) < 0 THEN 'negative' WHEN value IS NULL THEN 'no value' ELSE 'accepted' END AS reason FROM events) GROUP BY 1, 2"),
]
QUERIES = {name: f for name, f, _ in _ALL}
ORACLES = {name: sql for name, _, sql in _ALL}
