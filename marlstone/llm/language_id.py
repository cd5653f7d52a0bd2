"""Language identification with error-correcting output codes over character n-grams.

Each language has a codeword. For each of its bits a binary classifier tells the languages with a one
from those with a zero: hashed character n-grams (one to three characters), weighted by the log ratio
of their smoothed frequencies on either side. A text's margins are decoded to the codeword of least
loss, each bit weighted by how well its two sides can be told apart; a text whose two best codewords
lie close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_pandas

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: Steepness of the logistic loss over a margin, the mean log ratio of a text's n-grams.
STEEP = 12.0
#: Under this score a prediction is flagged as ambiguous.
AMBIGUOUS = 0.6
_ODD = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: the exhaustive code up to 5 classes, else 15 bits a class drawn from a fixed seed, no bit constant."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        bits = 2 ** (k - 1) - 1
        return np.array([[1.0 if (b >> (k - 1 - c)) & 1 else -1.0 for b in range(2 ** (k - 1), 2 ** (k - 1) + bits)] for c in range(k)])
    code = np.where(np.random.default_rng(7).random((k, 15 * int(np.ceil(np.log2(k))))) < 0.5, -1.0, 1.0)
    return code[:, np.abs(code.sum(axis=0)) < k]


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The feature numbers of all n-grams of all texts, lower-cased and with a space at both ends, and where each text's begin."""
    padded = [" " + " ".join(t.lower().split()) + " " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
    n, parts = len(points), []
    h = np.zeros(n, np.uint64)
    for k in range(1, max(ORDERS) + 1):
        h[: n - k + 1] = h[: n - k + 1] * np.uint64(_ODD) + points[k - 1 :] + np.uint64(k)
        if k in ORDERS:
            own = h.copy()
            for j in range(1, k):  # an n-gram that would go on into the next text is feature 0
                own[ends - j] = 0
            parts.append((((own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64))
    return np.stack(parts, axis=1).ravel(), np.concatenate(([0], ends[:-1])) * len(parts)


def _runs(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch["text"]):
        if text and any(map(str.isalpha, text)):
            rows.append(i)
            texts.append(text)
            size += len(text)
            if size >= _CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(text, lang) to (lang, feature, c): n-gram counts of all texts of a language, each text at weight 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_numpy()
            for rows, texts in _runs(batch):
                found, starts = _features(texts)
                sizes = np.diff(np.append(starts, len(found)))
                weight = np.repeat(1.0 / sizes, sizes)
                own = langs[rows]
                for lang in set(own):
                    mine = np.repeat(own == lang, sizes)
                    total[lang] = total.get(lang, 0) + np.bincount(found[mine], weight[mine], FEATURES)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "feature": at.astype(np.int32), "c": c[at]})

    return labelled.select("text", "lang").mapInPandas(count, "lang string, feature int, c double").groupBy("lang", "feature").agg(F.sum("c").alias("c"))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords (K x bits), weights of n-grams (bits x FEATURES) and weights of bits. The driver gets FEATURES counts a language."""
    counts = feature_counts(labelled).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), FEATURES))
    table[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), counts["feature"].to_numpy()] = counts["c"].to_numpy()
    share = (table + 1e-5) / (table + 1e-5).sum(axis=1, keepdims=True) if len(langs) else table
    code = codewords(len(langs))
    weights, trust = np.zeros((code.shape[1] if len(langs) else 0, FEATURES), np.float32), []
    for b in range(len(weights)):
        one, zero = (share[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.full(FEATURES, 1 / FEATURES) for s in (1, -1))
        weights[b] = np.log(one / zero)
        middle = (one + zero) / 2
        # (rounded, so that sides which differ by the order of sums alone count as equal)
        trust.append(max(0.0, round(float((one * np.log(one / middle) + zero * np.log(zero / middle)).sum() / 2), 12)))
    return langs, code, weights, np.array(trust)


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of margins (texts x bits): the codeword of least weighted loss and its share of exp(-loss). Bits count alike where none can be told apart; losses that agree to nine places are equal, and the first of them counts."""
    weights = trust / trust.sum() if trust.sum() > 0 else np.full(len(trust), 1 / max(1, len(trust)))
    loss = np.round((np.logaddexp(0, -STEEP * margins[:, None, :] * code[None]) * weights[None, None]).sum(axis=2), 9)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    return loss.argmin(axis=1), share.max(axis=1) / share.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify_languages(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang; more columns are ignored) to (doc_id, held_out, lang_pred, score, ambiguous), one row per row.

    Learns from rows that are not held out and have a text and a lang. Null texts and texts without a letter
    are ``und`` with score 0, and so is every text where nothing can be learned. Equal losses go to the first
    language by name; repeated rows are predicted alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sent = spark.sparkContext.broadcast(train(labelled))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, code, weights, trust = sent.value
        for batch in batches:
            names, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            for rows, texts in _runs(batch) if langs else ():
                found, starts = _features(texts)
                sizes = np.diff(np.append(starts, len(found)))
                margins = np.stack([np.add.reduceat(w[found], starts, dtype=np.float64) / sizes for w in weights], axis=1)
                best, share = decode(margins, code, trust)
                names[rows], score[rows] = np.array(langs, object)[best], share
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": names, "score": score, "ambiguous": (score < AMBIGUOUS)})

    return map_pandas(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), predict, "held_out boolean, lang_pred string, score double, ambiguous boolean", "doc_id")
