"""Quality classification by co-training of two views of a document.

One logistic classifier sees the text (hashed character n-grams and shape), the other the metadata
(source, language, length). Over some rounds each labels the unlabelled documents that it is surest
of for the other to learn from. Both are calibrated on labelled documents that neither learned from,
and the calibrated log odds, weighted by how well each view does there, are added up to score every
document. Learning takes a bounded sample of rows (LABELLED, UNLABELLED); all documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pandas

#: The most labelled and unlabelled rows that are learned from: those of the least hash of doc_id.
LABELLED, UNLABELLED = 4000, 4000
ROUNDS = 4
#: The share of the unlabelled rows that a view may label in a round, of those it is at least SURE of.
SHARE, SURE = 0.1, 0.95
#: Documents that score lower are not kept.
THRESHOLD = 0.5
_HASHED, _META = 512, 64
SYMBOLS = "#*$%&|<>"


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed character n-gram frequencies (one and two characters), and shape: logs and shares of symbols, upper case, digits, line ends, repeated words."""
    out = np.zeros(_HASHED + 8, np.float32)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    pairs = points[:-1] * np.uint32(2654435761) + points[1:]
    buckets = np.concatenate((points % (_HASHED // 2), _HASHED // 2 + (pairs >> np.uint32(7)) % (_HASHED // 2))).astype(np.int64)
    out[:_HASHED] = np.sqrt(np.bincount(buckets, minlength=_HASHED) / len(points))
    n, words = len(text), text.split()
    letters = points[points < 128]
    out[_HASHED:] = (
        np.log1p(n) / 10, sum(map(text.count, SYMBOLS)) / max(1, len(words)), ((letters >= 65) & (letters <= 90)).sum() / n, ((letters >= 48) & (letters <= 57)).sum() / n,
        10 * text.count("\n") / n, len(set(words)) / max(1, len(words)), n / max(1, len(words)) / 10, 1.0,
    )
    return out


def meta_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed indicators of source and language, and of the length's order of magnitude."""
    out = np.zeros(_META + 16, np.float32)
    for name, value in (("source", source), ("lang", lang)):
        out[zlib.crc32(f"{name}={value if isinstance(value, str) else ''}".encode("utf-8", "surrogatepass")) % _META] += 1
    out[_META + min(14, int(np.log2(max(1.0, n_chars))) if n_chars and n_chars == n_chars else 0)] = 1
    out[-1] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A logistic regression by accelerated gradient descent, both classes at equal weight: mean, scale and coefficients."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    v = np.ones(z.shape[1])
    for _ in range(30):  # the largest eigenvalue, a little over
        v = z.T @ (w * (z @ v))
        largest = np.linalg.norm(v)
        v /= largest
    rate = 4 / (1.2 * largest + 4 * ridge)
    b = last = np.zeros(z.shape[1])
    for t in range(steps):
        ahead = b + t / (t + 3) * (b - last)
        grad = z.T @ (w * (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - y)) + ridge * ahead
        last, b = b, ahead - rate * grad
    return mean, scale, b


def logits(model: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, b = model
    return np.clip((x - mean) / scale @ b[:-1] + b[-1], -30, 30)


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> list[tuple]:
    """Of labelled rows in two views and unlabelled rows in the same: for each view its model, its calibration (slope, shift) and weight."""
    keep = np.arange(len(y)) % 4 != 0  # a quarter calibrates
    xs, ys = [v[keep] for v in views], [y[keep].astype(float)] * 2
    left = np.arange(len(pool[0]))
    models = [fit(xs[i], ys[i]) for i in (0, 1)]
    for _ in range(rounds):
        if not len(left):
            break
        given: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in (0, 1):
            p = 1 / (1 + np.exp(-logits(models[i], pool[i][left])))
            room = max(1, int(SHARE * len(pool[0]) / 2))
            high, low = np.argsort(-p, kind="stable")[:room], np.argsort(p, kind="stable")[:room]
            high, low = high[p[high] >= SURE], low[p[low] <= 1 - SURE]
            given[1 - i] = (left[np.concatenate((high, low))], np.concatenate((np.ones(len(high)), np.zeros(len(low)))))
        for i, (rows, labels) in given.items():
            xs[i], ys[i] = np.vstack([xs[i], pool[i][rows]]), np.concatenate((ys[i], labels))
        left = np.setdiff1d(left, np.concatenate([r for r, _ in given.values()]))
        models = [fit(xs[i], ys[i]) for i in (0, 1)]
    out, truth = [], y[~keep].astype(float)
    share = float(np.clip(truth.mean() if len(truth) else 0.5, 0.01, 0.99))
    for i in (0, 1):
        raw = logits(models[i], views[i][~keep])
        slope, shift = _calibrate(raw, truth, share)
        p = np.clip(1 / (1 + np.exp(-(slope * raw + shift))), 1e-6, 1 - 1e-6)
        loss = -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean() if len(truth) else 0.0
        base = -(share * np.log(share) + (1 - share) * np.log(1 - share))
        out.append((models[i], slope, shift, max(0.0, 1 - loss / base)))
    return out


def _calibrate(raw: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the log odds by Newton steps on the logistic loss, held near (1, prior)."""
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((p - y) * raw).sum() + (a - 1) * 0.1, (p - y).sum() + b * 0.1])
        v = p * (1 - p)
        h = np.array([[(v * raw * raw).sum() + 0.1, (v * raw).sum()], [(v * raw).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def score(trained: list[tuple], views: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The combined probability and that of each calibrated view."""
    odds = [slope * logits(model, x) + shift for (model, slope, shift, _), x in zip(trained, views, strict=True)]
    weights = np.array([w for *_, w in trained])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(2, 0.5)
    return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (weights[0] * odds[0] + weights[1] * odds[1], *odds))


def _views(rows: pd.DataFrame) -> list[np.ndarray]:
    text = np.array([text_view(t) for t in rows["text"]], np.float32).reshape(len(rows), -1)
    meta = np.array([meta_view(*x) for x in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)], np.float32).reshape(len(rows), -1)
    return [text, meta]


def classify_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality 0 or 1) to (doc_id, score, text_score, meta_score, kept), one row per row of ``docs``.

    Nulls of any column are values like others (a null text has no n-grams, a null n_chars counts as 0);
    labels without a doc_id, a quality or a document are ignored, and of several labels of a document the
    least counts. Without both classes among the labels every score is 0.5. Repeated rows score alike; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64("doc_id")
    chosen = truth.orderBy(rank, "doc_id").limit(labelled)
    others = docs.select("doc_id").where("doc_id is not null").join(truth, "doc_id", "left_anti").distinct().orderBy(rank, "doc_id").limit(unlabelled).withColumn("quality", F.lit(None).cast("int"))
    # (of several rows of a document the least is learned from)
    least = F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    sample = docs.join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int")).unionByName(others)), "doc_id").groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "row.*")

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, meta = _views(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"].astype("Int64"), "text": list(text), "meta": list(meta)})

    rows = map_pandas(sample, views, "quality long, text array<float>, meta array<float>", "doc_id").toPandas().sort_values("doc_id")
    known = rows["quality"].notna().to_numpy()
    y = rows.loc[known, "quality"].to_numpy(dtype=float)
    trained = None
    if 0 < y.sum() < len(y):
        stacked = [np.stack(rows[c].to_list()).astype(np.float64) for c in ("text", "meta")]
        trained = co_train([v[known] for v in stacked], y, [v[~known] for v in stacked], rounds)
    sent = spark.sparkContext.broadcast(trained)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                both, text, meta = score(sent.value, _views(part)) if sent.value else (np.full(len(part), 0.5),) * 3
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": both, "text_score": text, "meta_score": meta, "kept": both >= THRESHOLD})

    return map_pandas(docs, predict, "score double, text_score double, meta_score double, kept boolean", "doc_id")
