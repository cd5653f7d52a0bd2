"""Quality rules: base text rules, then n-gram perplexity within bands of the language.

The model is an interpolated modified Kneser-Ney model of characters (order 5), one for each
language. Spark counts the n-grams of all documents; lower orders take continuation counts. Its
probabilities are kept as sorted arrays of n-gram hashes with their log probabilities, range-partitioned
files in the shared folder that the workers map into memory; the driver never holds them. A document
whose mean log perplexity lies above the upper or below the lower band of its language is rejected: above is noise,
below is mechanical repetition. The bands are so many robust deviations from the language's median,
both over the distinct texts that pass the base rules, and wider for short texts. Copies count once, in the model as well, so their number does not move the bands. A language of few
texts takes at least the deviation of the others, and every language at least MIN_DEVIATION.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, map_pandas

ORDER = 5
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Robust deviations (1.4826 times the median absolute deviation) that bound the bands; chosen on sf0.1's labels of even ids (README).
LOWER_BAND, UPPER_BAND = 4.5, 3.5
#: The bands of a text of n characters are sqrt(1 + SHORT / n) times as wide: the mean of few characters varies more.
SHORT = 2000
#: A language of fewer distinct sound texts has no deviation of its own to go by.
FEW_TEXTS = 30
#: The least robust deviation of a language, in nats a character (the four of sf0.01 have 0.014 to 0.018), and of one of few texts.
MIN_DEVIATION, FEW_DEVIATION = 0.01, 0.05
#: Statistics of at most so many languages are sent to all executors.
FEW_LANGUAGES = 10_000
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Characters of a chunk of texts, and n-grams of a row group that leaves Python.
_CHUNK, _ROWS = 1 << 20, 1 << 16
#: N-grams of a model file, and bytes of model files that a worker holds where they cannot be mapped.
MODEL_ROWS, MODEL_BYTES = 4_000_000, 512 << 20
#: Bits of the map of repeated texts (2 MB); with more repeated texts than that, more of the others are marked too.
_BITS = 1 << 24
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def base_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > REPEAT_WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        for step, power in ((1, 1), (2, 3), (4, 5)):  # a window of eight words from two of four, from two of two
            h = h[:-step] * np.uint64(pow(_MULTIPLIER, power, 1 << 64)) + h[step:]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            edge[twice] += 1
            edge[twice + REPEAT_WINDOW] -= 1
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat


def _gram_arrays(texts: list[str], langs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, each after order - 1 line feeds; the hash of the n-gram that ends at each text place; the places' texts."""
    import xxhash

    pad = "\n" * (order - 1)
    points = np.frombuffer("".join([pad + t.replace("\0", " ") for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.zeros(max(0, len(points) - order + 1), np.uint64)
    for k in range(order):
        h *= np.uint64(_MULTIPLIER)
        h += points[k : len(points) - order + 1 + k]
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(owner)) + owner * (order - 1)
    salt = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
    h = h[at] * np.uint64(_MULTIPLIER) + salt[owner]
    return points, h ^ (h >> np.uint64(29)), at


def _keys() -> list[Column]:
    """Two 64-bit hashes that together tell texts of a language apart (a null lang is the language of no name)."""
    lang = F.coalesce("lang", F.lit(""))
    return [F.xxhash64(lang, "text").alias("k1"), F.xxhash64("text", lang, F.lit(1)).alias("k2")]


def repeated_bits(docs: DataFrame) -> np.ndarray:
    """A bit map of fixed size: the bit of ``k1`` is set for each text that occurs twice or more (and by chance for some others)."""
    twice = docs.where("text <> ''").select(_keys()[0]).groupBy("k1").count().where("count > 1")
    place = F.col("k1").bitwiseAND(F.lit(_BITS - 1))
    bits = twice.groupBy(F.shiftright(place, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((_BITS >> 15, 1 << 12), np.uint8)
    for part, piece in bits.collect():  # (at most _BITS / 8 bytes in all)
        out[part] = np.frombuffer(piece, np.uint8)
    return out.ravel()


def _marked(bits: np.ndarray, k1: pd.Series) -> np.ndarray:
    place = k1.to_numpy(np.int64) & np.int64(_BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str], list[str]]]:
    """Rows with a text, in runs of about _CHUNK characters: their places in the batch, texts and languages."""
    at, texts, langs, size = [], [], [], 0
    for i, (text, lang) in enumerate(zip(batch["text"], batch["lang"], strict=True)):
        if text:
            at.append(i)
            texts.append(text)
            langs.append(lang if isinstance(lang, str) else "")
            size += len(text)
            if size >= _CHUNK:
                yield np.array(at), texts, langs
                at, texts, langs, size = [], [], [], 0
    if at:
        yield np.array(at), texts, langs


def _packets(docs: DataFrame, sent) -> DataFrame:
    """The texts that the bit map marks, to be brought together: (bucket, packet), a packet a task's distinct texts for one bucket of keys."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packets: dict[int, dict] = {}
            for row in batch[_marked(sent.value, batch["k1"])].itertuples(index=False):
                packets.setdefault(row.k2 % buckets, {})[row.k1, row.k2] = tuple(row)
            yield pd.DataFrame({"bucket": list(packets), "packet": [_closed(list(x.values())) for x in packets.values()]}).astype({"bucket": "int32"})

    packets = docs.where("text <> ''").select("lang", "text", *_keys()).mapInPandas(pack, "bucket int, packet binary")
    return packets.repartition("bucket").sortWithinPartitions("bucket")


def _once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packets by bucket to their texts, each once."""
    seen, bucket = set(), None
    for batch in batches:
        for at, packet in zip(batch["bucket"], batch["packet"], strict=True):
            if at != bucket:
                seen, bucket = set(), at
            rows = _opened(packet)
            fresh = [i for i, key in enumerate(zip(rows["k1"], rows["k2"], strict=True)) if key not in seen]
            seen.update((rows["k1"][i], rows["k2"][i]) for i in fresh)
            yield rows.iloc[fresh][["lang", "text"]]


_PACKET = pa.schema([("lang", pa.string()), ("text", pa.string()), ("k1", pa.int64()), ("k2", pa.int64())])


def _closed(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKET, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKET.types, strict=True)], schema=_PACKET))
    return sink.getvalue().to_pybytes()


def _opened(packet: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(packet) as source:
        return source.read_pandas()


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs`` (text, lang) to (lang, gram, c): each n-gram of characters of a language and its count in all distinct texts.

    Texts of one copy are counted where they are read; those that may have more are brought together first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(repeated_bits(docs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts, langs in _chunks(batch):
                points, h, at = _gram_arrays(texts, langs, order)
                by = np.argsort(h)
                first = np.flatnonzero(np.concatenate(([True], h[by[1:]] != h[by[:-1]])))
                pick, counts = by[first], np.diff(np.append(first, len(h)))
                del h, by
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                for k in range(0, len(pick), _ROWS):
                    part = pick[k : k + _ROWS]
                    grams = np.stack([points[at[part] + i] for i in range(order)], axis=1).view(f"<U{order}").ravel()
                    yield pd.DataFrame({"lang": np.array(langs, object)[np.searchsorted(ends, part, side="right")], "gram": grams.astype(object), "c": counts[k : k + _ROWS]})

    kind = "lang string, gram string, c long"
    alone = docs.where("text <> ''").select("text", "lang", _keys()[0]).mapInPandas(lambda b: count(x[~_marked(sent.value, x["k1"])] for x in b), kind)
    # (one Python function a stage: each takes a worker of its own)
    again = _packets(docs, sent).mapInPandas(lambda b: count(_once(b)), kind)
    return alone.unionByName(again).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c) of the highest order to (lang, gram, logp): interpolated modified Kneser-Ney probabilities. Each language and order has its own discounts."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    ones = None
    for k, level in levels.items():
        n = level.groupBy("lang").agg(F.lit(k).alias("k"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        ones = n if ones is None else ones.unionByName(n)
    discounts = cut(ones.select("lang", "k", *_discounts()))
    few = discounts.count() <= FEW_LANGUAGES
    below = None
    for k in range(1, order + 1):
        own = discounts.where(F.col("k") == k).drop("k")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", F.substring("gram", 1, k - 1))
        grams = levels[k].join(F.broadcast(own) if few else own, "lang").select("lang", "gram", ((F.col("c") - d) / F.sum("c").over(context)).alias("seen"), (F.sum(d).over(context) / F.sum("c").over(context)).alias("spare"), F.count("*").over(context).alias("v"))
        if below is None:
            grams = grams.withColumn("p", F.col("seen") + F.col("spare") / (F.col("v") + 1))
        else:
            grams = grams.withColumn("low", F.substring("gram", 2, k - 1)).join(below, ["lang", "low"]).withColumn("p", F.col("seen") + F.col("spare") * F.col("p"))
        # (cut at each order: a plan of all orders at once would weigh on the driver)
        below = cut(grams.select("lang", F.col("gram").alias("low"), "p"))
    return below.select("lang", F.col("low").alias("gram"), F.log("p").alias("logp"))


def _discounts() -> list[Column]:
    """The three discounts of modified Kneser-Ney, d1 to d3, from the numbers n1 to n4 of n-grams with counts 1 to 4, held within (0, count]."""
    n = {i: F.col(f"n{i}").cast("double") for i in (1, 2, 3, 4)}
    y = F.when(n[1] > 0, n[1] / (n[1] + 2 * n[2])).otherwise(0.5)
    raw = {i: F.when(n[i] > 0, i - (i + 1) * y * F.try_divide(n[i + 1], n[i])).otherwise(i / 2) for i in (1, 2, 3)}
    return [F.least(F.greatest(raw[i], F.lit(0.05)), F.lit(float(i))).alias(f"d{i}") for i in (1, 2, 3)]


def write_model(model: DataFrame, order: int = ORDER, rows: int = MODEL_ROWS) -> list[tuple[int, int, str]]:
    """(lang, gram, logp) to sorted hash arrays in the shared folder, range-partitioned: files of about ``rows`` n-grams. Returns (least hash, number, path) of each, sorted."""
    spark = model.sparkSession
    folder = fresh_path(spark, "kneser-ney")
    folder = folder if ":" in folder else f"file://{folder}"

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                _, h, _ = _gram_arrays(list(batch["gram"]), list(batch["lang"]), order)
                yield pd.DataFrame({"h": h[np.cumsum(batch["gram"].map(len).to_numpy()) - 1].view(np.int64), "logp": batch["logp"].to_numpy(np.float32)})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name, least, n = f"{root}/{uuid.uuid4().hex}", None, 0  # (a task that runs again writes files of new names)
        with store.open_output_stream(f"{name}.h") as keys, store.open_output_stream(f"{name}.p") as values:
            for batch in batches:
                if len(batch):
                    least = int(batch["h"].iloc[0]) if least is None else least
                    n += len(batch)
                    keys.write(batch["h"].to_numpy(np.int64).tobytes())
                    values.write(batch["logp"].to_numpy(np.float32).tobytes())
        yield pd.DataFrame({"least": [least], "n": [n], "path": [name]}) if n else pd.DataFrame({"least": [], "n": [], "path": []}).astype({"least": "int64", "n": "int64", "path": "object"})

    arrays = cut(model.mapInPandas(hashed, "h long, logp float"))
    files = max(1, -(-arrays.count() // rows))
    written = cut(arrays.repartitionByRange(files, "h").sortWithinPartitions("h").mapInPandas(write, "least long, n long, path string"))
    return sorted((r["least"], r["n"], f"{folder.split(':', 1)[0]}:{r['path']}") for r in written.collect())


class _Model:
    """The arrays of write_model: mapped into memory where the shared folder is mounted, so that a machine's workers share their pages; else read by file, MODEL_BYTES at a time."""

    def __init__(self, files: list[tuple[int, int, str]], folder: str):
        self.files, self.least, self.held = files, np.array([f[0] for f in files], np.int64), {}
        self.store = fs.FileSystem.from_uri(folder)[0]

    def _arrays(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.held:
            _, n, path = self.files[i]
            path = path.split(":", 1)[1]
            if isinstance(self.store, fs.LocalFileSystem):
                self.held[i] = np.memmap(f"{path}.h", np.int64, "r"), np.memmap(f"{path}.p", np.float32, "r")
            else:
                while self.held and 12 * (n + sum(self.files[k][1] for k in self.held)) > MODEL_BYTES:
                    del self.held[next(iter(self.held))]
                self.held[i] = tuple(np.frombuffer(self.store.open_input_stream(f"{path}.{x}").read(), t) for x, t in (("h", np.int64), ("p", np.float32)))
        return self.held[i]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The log probabilities of sorted hashes."""
        out = np.empty(len(h), np.float32)
        edges = [0, *np.searchsorted(h, self.least[1:]).tolist(), len(h)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                keys, values = self._arrays(i)
                out[a:b] = values[np.searchsorted(keys, h[a:b])]
        return out


def _score_texts(batch: pd.DataFrame, model: _Model, order: int) -> np.ndarray:
    """The summed log probability of each row's text."""
    total = np.zeros(len(batch))
    for rows, texts, langs in _chunks(batch):
        h = _gram_arrays(texts, langs, order)[1].view(np.int64)
        by = np.argsort(h)
        first = np.flatnonzero(np.concatenate(([True], h[by[1:]] != h[by[:-1]])))
        each = np.empty(len(h), np.float64)
        each[by] = np.repeat(model.look_up(h[by[first]]), np.diff(np.append(first, len(h))))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        total[rows] = np.add.reduceat(each, np.cumsum(lengths) - lengths)
    return total


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored_rows(docs: DataFrame, files: list[tuple[int, int, str]], order: int = ORDER) -> DataFrame:
    """``docs`` (doc_id, text, lang) to doc_id, k1, k2, lang, the base features, n_grams and total, the summed log probability. Texts stay where they are read."""
    folder = fresh_path(docs.sparkSession, "model")
    folder = folder if ":" in folder else f"file://{folder}"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _Model(files, folder)
        for batch in batches:
            out = pd.DataFrame([base_features(t) for t in batch["text"]], columns=_COUNTS, dtype="int64")
            for i, c in enumerate(("doc_id", "k1", "k2")):
                out.insert(i, c, batch[c].to_numpy())
            out.insert(3, "lang", [x if isinstance(x, str) else "" for x in batch["lang"]])
            yield out.assign(n_grams=[len(t) if t else 0 for t in batch["text"]], total=_score_texts(batch, model, order))

    fields = ", ".join(f"{c} long" for c in _COUNTS)
    return map_pandas(docs.select("doc_id", "text", "lang", *_keys()), score, f"k1 long, k2 long, lang string, {fields}, n_grams long, total double", "doc_id")


def _few(by_language: DataFrame) -> DataFrame:
    """Rows by language, sent to all executors where they are few, so that a common language is not dealt to one task."""
    by_language = cut(by_language)
    return F.broadcast(by_language) if by_language.count() <= FEW_LANGUAGES else by_language


def judged_rows(docs: DataFrame, order: int = ORDER, lower: float = LOWER_BAND, upper: float = UPPER_BAND) -> DataFrame:
    """Features, bands and verdict of each row of ``docs``, with the keys k1 and k2 of its text and language."""
    files = write_model(kneser_ney(cut(gram_counts(docs, order)), order), order)
    scored = cut(scored_rows(docs, files, order))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    chars = F.col("n_grams").cast("double")
    wide = F.when(F.col("n_grams") > 0, F.sqrt(1 + F.try_divide(F.lit(float(SHORT)), chars)))
    scored = scored.withColumn("base_failed", failed).withColumn("wide", wide).withColumn("log_perplexity", F.try_divide(-F.col("total"), chars))
    sound = cut(scored.where(~F.col("base_failed")).groupBy("lang", "k1", "k2").agg(F.max("log_perplexity").alias("log_perplexity"), F.max("wide").alias("wide")))
    # (of an even number of texts, the mean of the middle two: with one of them, a pair's other text would lie outside)
    midpoint = (F.percentile_approx("log_perplexity", 0.5, 10000) - F.percentile_approx(-F.col("log_perplexity"), 0.5, 10000)) / 2
    middle = _few(sound.groupBy("lang").agg(midpoint.alias("mid"), F.count("*").alias("texts")))
    off = sound.join(middle, "lang").withColumn("off", F.abs(F.col("log_perplexity") - F.col("mid")) / F.col("wide"))
    robust = 1.4826 * F.percentile_approx("off", 0.5, 10000)
    pooled = off.where(F.col("texts") >= FEW_TEXTS).agg(robust.alias("pooled"))
    spread = off.groupBy("lang", "mid", "texts").agg(robust.alias("own")).crossJoin(F.broadcast(pooled))
    # (greatest skips nulls: no pooled deviation where all languages have few texts)
    least = F.when(F.col("texts") < FEW_TEXTS, F.greatest("pooled", F.lit(FEW_DEVIATION))).otherwise(F.lit(MIN_DEVIATION))
    spread = spread.select("lang", "mid", F.greatest("own", least).alias("dev"))
    judged = scored.join(_few(spread), "lang", "left").withColumn("band_low", F.col("mid") - lower * F.col("dev") * F.col("wide")).withColumn("band_high", F.col("mid") + upper * F.col("dev") * F.col("wide"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return judged.select("doc_id", "k1", "k2", *_COUNTS, "base_failed", kept.alias("kept"), "log_perplexity", "band_low", "band_high")


def quality_rules(docs: DataFrame, order: int = ORDER, lower: float = LOWER_BAND, upper: float = UPPER_BAND) -> DataFrame:
    """``docs`` (doc_id, text, lang; more columns are ignored) to one row per document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    log_perplexity, band_low, band_high. Null and empty texts have no words, fail the base rules and have
    a null log_perplexity; a null lang and an empty one are one language of their own; repeated rows, also
    of a null doc_id, are answered alike; an empty table gives no rows.
    """
    return judged_rows(docs, order, lower, upper).drop("k1", "k2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text and language the rules keep, whatever their doc_id."""
    good = judged_rows(docs).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = _keys()
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(good, ["__k1", "__k2"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
