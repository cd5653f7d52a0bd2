"""Hangul and name normalisation, as Arrow-batched functions where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of Hangul compatibility jamo by leading, vowel and trailing index.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
#: Characters that do not count in a name.
SEPARATORS = re.compile(r"[\s·・\-_/()\[\]]+")
MAX_KEYWORD = 40
_FIRST, _COUNT = 0xAC00, 11172


def sanitize(raw: str | None) -> str:
    """A search keyword: NFC, without control and zero-width characters, white space collapsed, at most 40 characters."""
    text = unicodedata.normalize("NFC", raw or "")
    text = re.sub(r"[\x00-\x1f\x7f​-‍﻿]", "", text)
    return re.sub(r"\s+", " ", text).strip()[:MAX_KEYWORD].strip()


def jamo(text: str | None) -> str:
    """A name in lower case without separators, its syllables taken apart."""
    out = []
    for c in SEPARATORS.sub("", unicodedata.normalize("NFC", text or "").lower()):
        n = ord(c) - _FIRST
        out.append(LEADS[n // 588] + VOWELS[n % 588 // 28] + TAILS[n % 28] if 0 <= n < _COUNT else c)
    return "".join(out)


def leads(text: str | None) -> str:
    """The leading consonants of the syllables; bare leading consonants stay, all else goes."""
    found = []
    for c in unicodedata.normalize("NFC", text or ""):
        n = ord(c) - _FIRST
        if 0 <= n < _COUNT:
            found.append(LEADS[n // 588])
        elif c in LEADS:
            found.append(c)
    return "".join(found)


def partial_ratio(a: str, b: str) -> float:
    """The best indel similarity (0 to 100) of the shorter string with a window of the longer, windows over the edges included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    if not m:
        return 100.0 if not long else 0.0
    best = 0.0
    for start in range(1 - m, len(long)):
        window = long[max(0, start) : start + m]
        if set(window) & set(short):
            best = max(best, 200.0 * _common(short, window) / (m + len(window)))
    return best


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    all_ones = (1 << len(a)) - 1
    row = all_ones
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & all_ones
    return len(a) - row.bit_count()


@F.pandas_udf(T.StringType())
def jamo_udf(names: pd.Series) -> pd.Series:
    return names.map(jamo)


@F.pandas_udf(T.StringType())
def leads_udf(names: pd.Series) -> pd.Series:
    return names.map(leads)
