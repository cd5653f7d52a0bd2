"""Licence scans with DataFrame functions only.

Lines, pairs of lines, sentences, windows as long as a template and whole licence files are compared with
licence templates by sparse TF-IDF cosine. Windows are left to templates of more than SHORT tokens, as a
few words in any order make no notice; lines, pairs and sentences of more than 4 * SHORT different tokens are
left to windows, as a short notice is too small a part of them. A text can reach the cosine with a template only if it holds one of the template's
anchors, the tokens that the fewest files hold and whose squared weights add up to more than 1 - cosine
squared; a window is cut where an anchor falls on its own place in the template. A file without a licence of its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import licence_texts
from .common import cut

COSINE = 0.8
#: Base names, without an ending, of files that declare the licence of their directory.
FILE_NAMES = ["license", "licence", "copying", "unlicense"]
SHORT = 12
SMALL_ROWS = 100_000
_NOT_TOKEN = "[^\\p{L}\\p{N}.]+"


def _tokens(text: Column) -> Column:
    trimmed = F.transform(F.split(F.lower(text), _NOT_TOKEN), lambda t: F.btrim(t, F.lit(".")))
    return F.filter(trimmed, lambda t: t != "")


class Weights:
    """Unit TF-IDF weights of templates (licence, text), read on the driver: templates are few. Rows without a licence or a token are left out."""

    def __init__(self, templates: DataFrame, texts: DataFrame, cosine: float = COSINE):
        rows = templates.where("licence is not null").select("licence", _tokens(F.coalesce("text", F.lit(""))).alias("tokens")).distinct().collect()
        rows = sorted((r["licence"], list(r["tokens"])) for r in rows if r["tokens"])
        seen = Counter(t for _, tokens in rows for t in set(tokens))
        idf = {t: math.log(1 + len(rows) / n) for t, n in seen.items()}
        self.unknown = math.log(1 + len(rows))
        vocabulary = texts.sparkSession.createDataFrame([(t,) for t in seen], "token string")
        held_by = texts.select(F.explode(F.array_distinct(_tokens(F.lower("text")))).alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").count()
        files = {r["token"]: r["count"] for r in held_by.collect()}  # (at most the templates' tokens)
        self.weights, self.anchors = [], []  # (template, licence, token, w, idf), (token, template, offset, size)
        for i, (licence, tokens) in enumerate(rows):
            count = Counter(tokens)
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in count.items()))
            own = {t: n * idf[t] / norm for t, n in count.items()}
            self.weights += [(i, licence, t, w, idf[t]) for t, w in own.items()]
            held = 0.0
            for t in sorted(own, key=lambda t: (files.get(t, 0), -own[t], t)):
                if held <= 1 - cosine**2:
                    self.anchors += [(t, i, at, len(tokens)) for at, x in enumerate(tokens) if x == t]
                    held += own[t] ** 2

    def may_reach(self, text: Column) -> Column:
        """Of a lower-case text: false only where it holds no anchor."""
        starts: dict[str, list[str]] = {}
        for t in sorted({a[0] for a in self.anchors}):
            starts.setdefault(t[0], []).append(re.escape(t[1:]))
        edge = "[^\\p{L}\\p{N}]"
        choice = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in starts.items())
        return text.rlike(f"(?:^|{edge})(?:{choice})(?:$|{edge})") if starts else F.lit(False)


def best_licences(units: DataFrame, weights: Weights, cosine: float = COSINE) -> DataFrame:
    """(unit, tokens) to (unit, licence, cosine): the closest template of each text at ``cosine`` or more; ties go to the first name. unit must tell texts apart."""
    spark = units.sparkSession
    listed = spark.createDataFrame(weights.weights, "template int, licence string, token string, w double, idf double")
    words = units.select("unit", F.explode_outer("tokens").alias("token")).groupBy("unit", "token").agg(F.count("*").alias("tf"))
    words = cut(words.join(F.broadcast(listed.select("token", "idf").distinct()), "token", "left").select("unit", "token", (F.col("tf") * F.coalesce("idf", F.lit(weights.unknown))).alias("x")))
    norms = words.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = words.join(F.broadcast(listed), "token").groupBy("unit", "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= cosine)
    return scored.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("back"), "licence")).alias("best")).select("unit", "best.licence", (-F.col("best.back")).alias("cosine"))


def _windows(texts: DataFrame, weights: Weights, cosine: float) -> DataFrame:
    """(key, text in lower case) to (key, tokens): runs of a template's length that have one of its anchors where the template has it."""
    anchors = texts.sparkSession.createDataFrame([a for a in weights.anchors if a[3] > SHORT], "token string, template int, offset int, size int")
    listed = texts.select("key", _tokens(F.col("text")).alias("tokens"))
    hits = listed.select("key", F.posexplode("tokens").alias("at", "token")).join(F.broadcast(anchors), "token")
    spans = hits.select("key", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("start"), "size", "template").distinct().groupBy("key").agg(F.collect_list(F.struct("start", "size", "template")).alias("spans"))
    cuts = listed.join(spans, "key").select("key", F.inline(F.transform("spans", lambda x: F.struct(x["template"].alias("template"), F.slice("tokens", x["start"] + 1, x["size"]).alias("tokens")))))
    # the squared cosine is at most the sum of the template's squared weights whose tokens the window has
    squares: dict[int, dict[str, float]] = {}
    for template, _, token, w, _ in weights.weights:
        squares.setdefault(template, {})[token] = w * w
    listed = texts.sparkSession.createDataFrame([(i, list(x), x) for i, x in squares.items()], "template int, own array<string>, squares map<string,double>")
    bound = F.aggregate(F.array_intersect("tokens", "own"), F.lit(0.0), lambda total, t: total + F.col("squares")[t])
    return cuts.join(F.broadcast(listed), "template").where(bound >= cosine**2 - 1e-9).select("key", "tokens")


def scan_licences(files: DataFrame, templates: DataFrame | None = None, cosine: float = COSINE) -> DataFrame:
    """``files`` (doc_id, path, text; more columns are ignored) to one row per row: doc_id, path, own_licence, own_cosine, licence, licence_path.

    own_licence is that of the closest line, pair of lines, sentence or template-sized window of the whole text; of
    equal cosines the first name counts. A licence file has one of FILE_NAMES as base name; its licence is that of its whole text or else its
    own, and where a directory has several, the closest counts, then the first path. licence is own_licence, else that
    of the nearest licence file in the file's directory or above (licence_path), else null. Null and empty texts have
    no licence of their own; a null path has no directory; repeated rows are answered alike; an empty table gives no
    rows. ``templates`` has licence and text, a licence in as many rows as it has texts.
    """
    spark = files.sparkSession
    key = F.concat(*[F.hex(F.xxhash64("doc_id", "path", "text", F.lit(i))) for i in (0, 1)])
    files = files.select("doc_id", "path", "text", key.alias("key"))
    templates = spark.createDataFrame(licence_texts.templates(), "licence string, text string") if templates is None else templates
    weights = Weights(templates, files, cosine)
    # (a generated column: a filter on it is not pushed to where lower-casing would be repeated)
    lowered = files.select("key", F.explode_outer(F.array(F.lower("text"))).alias("text"))
    likely = cut(lowered.where(weights.may_reach(F.col("text"))).dropDuplicates(["key"]))
    split = F.split("text", "\n")
    pairs = F.zip_with(split, F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    sentences = F.split(F.regexp_replace("text", "\n", " "), "(?<=[.!?])\\s+")
    lines = likely.select("key", F.explode(F.array_distinct(F.concat(split, pairs, sentences))).alias("text"))
    lines = lines.where(weights.may_reach(F.col("text"))).select("key", _tokens(F.col("text")).alias("tokens")).where(F.size(F.array_distinct("tokens")) <= 4 * SHORT)
    parts = cut(lines.unionByName(_windows(likely, weights, cosine)).select("key", "tokens", F.concat(*[F.hex(F.xxhash64("tokens", F.lit(i))) for i in (0, 1)]).alias("unit")).distinct())
    # equal lines and windows are scored once
    own = best_licences(parts.select("unit", "tokens").dropDuplicates(["unit"]), weights, cosine)
    found = parts.select("key", "unit").join(_few(own), "unit").groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("back"), "licence")).alias("best"))
    found = cut(found.select("key", F.col("best.licence").alias("own_licence"), (-F.col("best.back")).alias("own_cosine")))
    base = F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), "^([^.]*)", 1)
    named = files.where(base.isin(FILE_NAMES)).select("key", "path").distinct()
    whole = best_licences(likely.join(named.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("unit"), _tokens(F.col("text")).alias("tokens")), weights, cosine)
    declared = named.join(found, "key", "left").join(whole.select(F.col("unit").alias("key"), F.col("licence").alias("file_licence"), F.col("cosine").alias("file_cosine")), "key", "left")
    declared = declared.where(F.coalesce("file_licence", "own_licence").isNotNull())
    declared = declared.select(_parent(F.col("path")).alias("dir"), "path", F.coalesce("file_licence", "own_licence").alias("licence"), F.coalesce("file_cosine", "own_cosine").alias("cosine"))
    declared = cut(declared.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("back"), "path", "licence")).alias("best")).select("dir", "best.path", "best.licence"))
    # every directory with a file, and all above it
    dirs = files.where("path is not null").select(_parent(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = dirs.select("own_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("a")).select("own_dir", "a.depth", "a.dir").distinct()
    nearest = above.join(declared, "dir").groupBy("own_dir").agg(F.max_by(F.struct("path", "licence"), "depth").alias("near"))
    nearest = _few(nearest.select("own_dir", F.col("near.path").alias("near_path"), F.col("near.licence").alias("near_licence")))
    rows = files.withColumn("own_dir", _parent(F.col("path"))).drop("text").join(_few(found), "key", "left").join(nearest, "own_dir", "left")
    return rows.select("doc_id", "path", "own_licence", "own_cosine", F.coalesce("own_licence", "near_licence").alias("licence"), F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("near_path")).alias("licence_path"))


def _parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def _few(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
