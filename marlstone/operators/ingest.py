"""Ingestion of model responses and records: matching, parsing and quarantine, each as rows and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ["A", "B", "C", "D", "E"]
_CANDIDATES = "array<struct<token:string,logProbability:double,log_probability:double>>"
RESPONSE = f"struct<request:struct<prompt:string>,response:struct<candidates:array<struct<logprobsResult:struct<topCandidates:array<struct<candidates:{_CANDIDATES}>>>>>>,status:string>"


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(key, prompt) and (line) of JSON to one row per request or stray response: key, line, problem (null, duplicate, unknown, missing), matched by the prompt's hash in any order."""
    parsed = responses.select("line", F.from_json("line", RESPONSE).alias("r")).select("line", F.sha2(F.coalesce("r.request.prompt", F.lit("")), 256).alias("hash"))
    asked = requests.select("key", F.sha2("prompt", 256).alias("hash"))
    counted = parsed.join(parsed.groupBy("hash").agg(F.count("*").alias("n")), "hash")
    problem = F.when(F.col("key").isNull(), "unknown").when(F.col("line").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return asked.join(counted, "hash", "full").select("key", "line", problem.alias("problem"))


def parse_responses(matched: DataFrame) -> DataFrame:
    """(key, line) to (key, p, problem): probabilities of the labels from the log probabilities of all spellings of each (blanks trimmed), or why the line is quarantined."""
    rows = matched.select("key", F.from_json("line", RESPONSE).alias("r"))
    tokens = rows.select("key", F.explode_outer("r.response.candidates").alias("c")).select("key", F.explode_outer("c.logprobsResult.topCandidates").alias("t")).select("key", F.explode_outer("t.candidates").alias("x"))
    each = tokens.select("key", F.trim("x.token").alias("label"), F.coalesce("x.logProbability", "x.log_probability").alias("lp")).where(F.col("label").isin(LABELS) & F.col("lp").isNotNull())
    top = each.groupBy("key").agg(F.max("lp").alias("top"))
    mass = each.join(top, "key").groupBy("key", "label").agg(F.sum(F.exp(F.col("lp") - F.col("top"))).alias("m"))
    whole = mass.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "m"))).alias("found"), F.sum("m").alias("total"))
    p = F.transform("found", lambda s: s["m"] / F.col("total"))
    joined = matched.select("key").join(whole, "key", "left")
    problem = F.when(F.col("found").isNull(), "no candidates").when(F.size("found") < len(LABELS), "missing label")
    return joined.select("key", F.when(problem.isNull(), p).alias("p"), problem.alias("problem"))


def validate_jsonl(lines: DataFrame, axes: int) -> DataFrame:
    """(n, line) to (n, id, problem): blank, not JSON, bad id, repeated id, wrong axes, or flat values that differ from the axes'."""
    schema = "struct<cocktail_id:bigint,axes:array<struct<axis_order:int,probabilities:array<double>>>,raw_probabilities:array<double>>"
    rows = lines.select("n", "line", F.from_json("line", schema).alias("r"))
    first = rows.where("r.cocktail_id is not null").groupBy(F.col("r.cocktail_id").alias("known")).agg(F.min("n").alias("first"))
    rows = rows.join(first, F.col("r.cocktail_id") == F.col("known"), "left")
    flat = F.flatten(F.transform("r.axes", lambda a: a["probabilities"]))
    ordered = F.transform("r.axes", lambda a: a["axis_order"]) == F.sequence(F.lit(0), F.lit(axes - 1))
    sums = F.forall("r.axes", lambda a: (F.size(a["probabilities"]) == 5) & (F.abs(F.aggregate(a["probabilities"], F.lit(0.0), lambda s, x: s + x) - 1) <= 1e-9))
    problem = (
        F.when(F.trim("line") == "", "blank").when(F.col("r").isNull() | (F.get_json_object("line", "$").isNull()), "not JSON").when(F.col("r.cocktail_id").isNull() | (F.col("r.cocktail_id") <= 0), "bad id")
        .when(F.col("n") > F.col("first"), "repeated id").when(~F.coalesce(ordered & sums, F.lit(False)), "wrong axes").when(~F.coalesce(flat == F.col("r.raw_probabilities"), F.lit(False)), "flat values differ")
    )
    return rows.select("n", F.col("r.cocktail_id").alias("id"), problem.alias("problem"))


def vector_to_wide(vectors: DataFrame, names: list[str]) -> DataFrame:
    return vectors.select("id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])


def wide_to_vector(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.select("id", F.array(*names).alias("v"))


def batch_cost(requests: int, tokens_in: int, tokens_out: int, price_in: str, price_out: str, spark) -> DataFrame:
    """The cost of a batch in exact decimals; prices are by a million tokens."""
    million = F.lit("1000000").cast("decimal(12,0)")
    part = lambda n, price: F.lit(n).cast("decimal(20,0)") * F.lit(price).cast("decimal(12,6)") / million
    return spark.range(1).select(F.lit(requests).cast("long").alias("requests"), (F.lit(requests).cast("decimal(20,0)") * (part(tokens_in, price_in) + part(tokens_out, price_out))).cast(T.DecimalType(18, 6)).alias("cost"))
