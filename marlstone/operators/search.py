"""Tiered name search: exact, prefix, contained, fuzzy; Korean and English names and leading consonants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul

#: The least fuzzy similarity that counts, by field.
FUZZY = {"ko": 70.0, "en": 78.0}


def _fuzzy(query: str, field: str):
    least = FUZZY[field]

    @F.pandas_udf("double")
    def score(names: pd.Series) -> pd.Series:
        found = {x: hangul.partial_ratio(query, x) for x in names.dropna().unique()}
        return names.map(lambda x: None if x is None or found[x] < least else (found[x] - least) / (100 - least))

    return score


def _field(query: str, name: Column, field: str, tie: int) -> Column:
    """(tier, score, preference, kind, field) of a normalised name, null without a match."""
    size = F.greatest(F.length(name), F.lit(1))
    share = F.lit(float(len(query))) / size
    fuzzy = _fuzzy(query, field)(name) if len(query) >= 3 else F.lit(None).cast("double")
    hit = lambda tier, score, kind: F.struct(F.lit(tier).alias("tier"), score.alias("score"), F.lit(tie).alias("preference"), F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    return F.when(name == query, hit(4, F.lit(1.0), "exact")).when(name.startswith(query), hit(3, share, "prefix")).when(name.contains(query), hit(2, share, "contains")).when(fuzzy.isNotNull(), hit(1, fuzzy, "fuzzy"))


def search(names: DataFrame, keyword: str, limit: int, offset: int = 0) -> DataFrame:
    """(id, name, name_en) to the page of matches: id, name, tier, score, kind, field, total; by tier, score, length of name, id."""
    query, leading = hangul.jamo(hangul.sanitize(keyword)), hangul.sanitize(keyword)
    if not query:
        return names.select("id", "name", F.lit(0).alias("tier"), F.lit(0.0).alias("score"), F.lit("").alias("kind"), F.lit("").alias("field"), F.lit(0).cast("long").alias("total")).where("false")
    known = names.select("id", "name", hangul.jamo_udf("name").alias("ko"), hangul.jamo_udf("name_en").alias("en"), hangul.leads_udf("name").alias("cho"))
    found = [_field(query, F.col("ko"), "ko", 2), _field(query, F.col("en"), "en", 1)]
    if all(c in hangul.LEADS for c in leading.replace(" ", "")):
        bare = leading.replace(" ", "")
        found.append(F.when(F.col("cho").startswith(bare), F.struct(F.lit(3).alias("tier"), (F.lit(float(len(bare))) / F.length("cho")).alias("score"), F.lit(0).alias("preference"), F.lit("choseong").alias("kind"), F.lit("cho").alias("field"))))
    best = known.withColumn("best", F.array_max(F.array_compact(F.array(*found)))).where("best is not null").select("id", "name", "best.tier", "best.score", "best.kind", "best.field")
    total = best.agg(F.count("*").alias("total"))
    return best.orderBy(F.desc("tier"), F.desc("score"), F.length("name"), "id").offset(offset).limit(limit).join(F.broadcast(total))


def first_descriptors(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, text) and a small (category, code, alias, ord) to each text's first descriptor of a category, by place, then order."""
    at = F.instr(F.col("text"), F.col("alias"))
    hits = texts.join(F.broadcast(aliases), F.col("text").contains(F.col("alias"))).select("doc_id", "category", "code", "ord", at.alias("at"))
    return hits.groupBy("doc_id", "category").agg(F.min(F.struct("at", "ord", "code")).alias("first")).select("doc_id", "category", "first.code", F.col("first.at").cast("long").alias("place"))
