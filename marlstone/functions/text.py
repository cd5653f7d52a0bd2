"""Text, identifier, time and hash functions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The forms of identifiers and of image file names.
CANONICAL_ID = "^[1-9][0-9]*$"
IDENTIFIER = "^[a-z0-9][a-z0-9._-]{0,127}$"
SHA256 = "^[0-9a-f]{64}$"
IMAGE_FILE = "(?i)^cocktail-([1-9]\\d*)\\.(?:png|jpe?g|webp)$"
KOREA = "Asia/Seoul"


def sentences(text: Column) -> Column:
    """The sentences of a text, blanks trimmed; the text itself where there is none. Null stays null."""
    found = F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.btrim(s)), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, "\\s+", " "))


def lookup_key(text: Column) -> Column:
    return F.lower(collapse(text))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut after a whole word and closed by a full stop."""
    flat = collapse(text)
    head = F.substring(flat, 1, most - 1)
    kept = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    closed = F.concat(F.regexp_replace(F.regexp_replace(kept, "[ ,;:-]+$", ""), "\\.+$", ""), F.lit("."))
    return F.when(F.length(flat) <= most, flat).otherwise(closed)


def is_canonical_id(text: Column) -> Column:
    return F.coalesce(text.rlike(CANONICAL_ID), F.lit(False))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(IDENTIFIER), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256), F.lit(False))


def image_id(filename: Column) -> Column:
    """The id in an image's file name, or null."""
    found = F.regexp_extract(filename, IMAGE_FILE, 1)
    return F.when(found != "", found.cast("long"))


def thumbnail_url(url: Column, base: str) -> Column:
    """The thumbnail beside an image under ``base``; any other address stays."""
    base = base.rstrip("/") + "/"
    ours = url.startswith(base) & url.endswith(".webp") & ~url.rlike("[?#]")
    return F.when(ours, F.concat(F.regexp_replace(url, "\\.webp$", ""), F.lit("-thumb.webp"))).otherwise(url)


def korean_date(moment: Column) -> Column:
    """The calendar date in Korea of a moment in UTC, as text: the seed of a daily pick."""
    return F.date_format(F.from_utc_timestamp(moment, KOREA), "yyyy-MM-dd")


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` to an array; null where it is no such text."""
    return F.from_json(text, "array<double>")


def canonical_sha256(payload) -> str:
    """The hash of JSON with sorted keys, no blanks and escaped text."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=True, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def vector_hash(v: pd.Series) -> pd.Series:
    """The hash of a vector's exact values, as hexadecimal floating point."""
    return v.map(lambda x: canonical_sha256([float(y).hex() for y in x]))


def id_set_sha256(ids: DataFrame) -> str:
    """The hash of a set of canonical ids (id) in numerical order. It is a hash of one text, so the ids are read in order, a partition at a time."""
    hashed = hashlib.sha256(b'{"cocktail_ids":[')
    for i, row in enumerate(ids.select(F.col("id").cast("long").alias("id")).orderBy("id").toLocalIterator()):
        hashed.update((b"," if i else b"") + b'"%d"' % row["id"])
    hashed.update(b"]}")
    return hashed.hexdigest()
