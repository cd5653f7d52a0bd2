"""Removal of repeated passages: bytes that a string of ``length`` bytes covers which starts anywhere else too.

Every string of ``length`` bytes belongs to one shard: that of the least hash of its 32-byte grams.
Consecutive strings of a text with the same least hash form one segment, so equal strings always
meet in one shard, however texts are dealt out. A shard with one segment only holds no repeat,
unless the least gram leaves the segment's strings and the next string still has the same least
hash: only then can a string repeat within a segment. Equal segments are counted and sorted once. The segments of the other shards go through external
induced sorting with common-prefix values (induced_sort.py), which decides what repeats. A shard
that outgrows its bound is cut again by the least of other hashes, which separates its differing
strings; equal ones are already one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .induced_sort import repeated_starts

LENGTH = 200
GRAM = 32
#: A shard of more bytes than this is cut again by other hashes.
SHARD_BYTES = 2 << 20
#: Shards are sorted together, up to so many bytes at a time.
SORT_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h + np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _segments(joined: np.ndarray, ends: np.ndarray, length: int, seeds: list[int]) -> tuple[np.ndarray, ...]:
    """Of texts joined without separators: start, size, shard hash, content hash of each segment, and whether it may repeat itself."""
    import xxhash

    n = len(joined)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    gram = joined.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4, 8, 16):
        gram = gram[:-step] * _power(step) + gram[step:]
    places = n - length + 1
    breaks = np.zeros(places, bool)
    shard = np.zeros(places, np.uint64)
    leads = np.ones(places, bool)
    for seed in seeds:
        mixed = _mixed(gram, seed)
        least, reach, span = mixed, 1, length - GRAM + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:places], least[span - reach : span - reach + places])
        leads = mixed[:places] == least if seed == seeds[0] else leads
        breaks[1:] |= least[1:] != least[:-1]
        shard = shard * np.uint64(_ODD) + least
    # a string that would cross the end of a text does not count
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(ends - length + 1, np.concatenate(([0], ends[:-1]))), 1)
    np.add.at(edge, ends, -1)
    valid = np.cumsum(edge[:places]) == 0
    first = valid.copy()
    first[1:] &= breaks[1:] | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= breaks[1:] | ~valid[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + length
    leads &= ~last
    led = np.concatenate(([0], np.cumsum(leads)))
    again = led[stop - length + 1] > led[start]
    raw = joined.data
    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))
    return start, stop - start, shard[start], content, again


def _joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about _CHUNK bytes: the first text's place, the bytes, the ends."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _CHUNK):
            size += len(texts[to])
            to += 1
        yield at, np.frombuffer(b"".join(texts[at:to]), np.uint8), np.cumsum(np.fromiter(map(len, texts[at:to]), np.int64, to - at))
        at = to


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _packed(df: DataFrame, once: bool = False) -> DataFrame:
    """``df`` with its text compressed, to be shuffled; ``once``: of rows with one ``key`` in a batch, the first."""

    place = df.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            if once:
                batch = batch.filter(pa.array(~batch.column("key").to_pandas().duplicated().to_numpy()))
            texts = (t.as_py() for t in batch.column(place))
            yield batch.set_column(place, "text", pa.array([None if t is None else pack(_bytes(t)) for t in texts], pa.binary()))

    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in df.schema]
    return df.mapInArrow(of, T.StructType(fields))


def _unpacked(texts: pd.Series) -> list[bytes | None]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [None if t is None else unpack(bytes(t)) if len(t) else b"" for t in texts]


def text_segments(keyed: DataFrame, length: int) -> DataFrame:
    """(key, text) to the segments of each text: key, start, size, shard, content, again, copies. Copies of a text in one batch are cut once."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            copies = batch["key"].map(batch["key"].value_counts()).to_numpy(np.int64)
            first = ~batch["key"].duplicated().to_numpy()
            keys, copies = batch["key"].to_numpy()[first], copies[first]
            texts = [_bytes(t) for t in batch["text"].to_numpy()[first]]
            for at, joined, ends in _joined(texts):
                start, size, shard, content, again = _segments(joined, ends, length, [0])
                owner = np.searchsorted(ends, start, side="right")
                begin = np.concatenate(([0], ends))[owner]
                yield pd.DataFrame({"key": keys[at + owner], "start": (start - begin).astype(np.int32), "size": size.astype(np.int32), "shard": shard.view(np.int64), "content": content.view(np.int64), "again": again, "copies": copies[at + owner]})

    return keyed.mapInPandas(of, "key binary, start int, size int, shard long, content long, again boolean, copies long")


def _cut_again(parts: DataFrame, length: int, seeds: list[int]) -> DataFrame:
    """Segments with their text to the finer segments that more hashes make of them; each keeps its place in the first segment."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, joined, ends in _joined(list(batch["piece"])):
                start, size, shard, content, again = _segments(joined, ends, length, seeds)
                owner = np.searchsorted(ends, start, side="right")
                begin = np.concatenate(([0], ends))[owner]
                raw = joined.tobytes()
                rows = batch.iloc[at + owner]
                yield pd.DataFrame({
                    "first_shard": rows["first_shard"].to_numpy(), "first_content": rows["first_content"].to_numpy(), "at": rows["at"].to_numpy() + (start - begin).astype(np.int32),
                    "n": rows["n"].to_numpy(), "shard": shard.view(np.int64), "content": content.view(np.int64), "again": again, "piece": [raw[s : s + z] for s, z in zip(start.tolist(), size.tolist(), strict=True)],
                })

    return parts.select(_PLACED).mapInPandas(of, _PLACED_TYPES)


_PLACED = ["first_shard", "first_content", "at", "n", "shard", "content", "again", "piece"]
_PLACED_TYPES = "first_shard long, first_content long, at int, n long, shard long, content long, again boolean, piece binary"


def _sort_shards(batches: Iterator[pd.DataFrame], length: int, sort_bytes: int) -> Iterator[pd.DataFrame]:
    """Segments in the order of their shards to the repeated runs in them: shard, content, from, to (bytes)."""

    def flush(rows: list[tuple]) -> pd.DataFrame:
        starts = repeated_starts([r[2] for r in rows], length)
        begins = np.concatenate(([0], np.cumsum([len(r[2]) + 1 for r in rows])))
        owner = np.searchsorted(begins, starts, side="right") - 1
        own = starts - begins[owner]
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (own[1:] > own[:-1] + length))) if len(own) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(own)) - 1 if len(begin) else begin
        which = owner[begin] if len(begin) else np.zeros(0, np.int64)
        return pd.DataFrame({"shard": [rows[i][0] for i in which], "content": [rows[i][1] for i in which], "lo": own[begin], "hi": own[stop] + length if len(begin) else own[begin]}).astype({"shard": "int64", "content": "int64", "lo": "int32", "hi": "int32"})

    rows, size, group = [], 0, []
    for batch in batches:
        for shard, content, again, piece in zip(batch["shard"], batch["content"], batch["again"], batch["piece"], strict=True):
            if group and shard != group[0][0]:
                if len(group) > 1 or group[0][3]:
                    rows += group
                    size += sum(len(r[2]) for r in group)
                group = []
                if size >= sort_bytes:
                    yield flush(rows)
                    rows, size = [], 0
            if not group or content != group[-1][1]:
                group.append((shard, content, piece, again))
            elif piece != group[-1][2]:
                raise ValueError("two segments that differ have one hash")
    if len(group) > 1 or group and group[0][3]:
        rows += group
    if rows:
        yield flush(rows)


def repeated_runs(parts: DataFrame, length: int, shard_bytes: int, sort_bytes: int, seed: int = 1) -> DataFrame:
    """Segments with their text (_PLACED; n: times it occurs; a row may come twice) to runs of repeated bytes: first_shard, first_content, lo, hi (within the first segment)."""
    own = parts.groupBy("first_shard", "first_content", "at", "shard", "content").agg(F.max("n").alias("n"), F.bool_or("again").alias("again"), F.max(F.length("piece")).alias("bytes"))
    judged = cut(own.groupBy("shard", "content").agg(F.sum("n").alias("n"), F.bool_or("again").alias("again"), F.max("bytes").alias("bytes")))
    whole = judged.where("n > 1").select("shard", "content", F.lit(0).alias("lo"), F.col("bytes").alias("hi"))
    hot = cut(judged.groupBy("shard").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"), F.bool_or("again").alias("again")).where(f"bytes > {shard_bytes} and (k > 1 or again)").select("shard"))
    some_hot = seed <= 8 and hot.limit(1).count() > 0  # what eight hashes cannot separate is sorted whole
    cold = parts.join(hot, "shard", "left_anti") if some_hot else parts
    sorted_runs = cold.select("shard", "content", "again", "piece").repartition("shard").sortWithinPartitions("shard", "content").mapInPandas(lambda b: _sort_shards(b, length, sort_bytes), "shard long, content long, lo int, hi int")
    runs = own.join(whole.unionByName(sorted_runs), ["shard", "content"]).select("first_shard", "first_content", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    if some_hot:
        finer = cut(_cut_again(parts.join(hot, "shard", "left_semi"), length, [0, *range(1, seed + 1)]))
        runs = runs.unionByName(repeated_runs(finer, length, shard_bytes, sort_bytes, seed + 1))
    return runs


def _merged(runs: list, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((int(r["lo"]), int(r["hi"])) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, size)) for a, b in out]


def repeated_bytes(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, sort_bytes: int = SORT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``docs`` (text and more) to two tables: the rows with the key of their text (__key), and the repeated byte runs by key (__key, __runs: array of lo, hi)."""
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    only = keyed.select(F.col("__key").alias("key"), "text")
    found = text_segments(only, length)
    shards = cut(found.groupBy("shard").agg(F.sum("copies").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.bool_or("again").alias("again")).where("n > 1 or again").select("shard", (F.col("low") == F.col("high")).alias("alike"), "n").select("shard", F.expr("alike and n > 1").alias("alike")))
    places = cut(found.join(shards, "shard").groupBy("key", "start", "size", "shard", "content", "again", "alike").agg(F.sum("copies").alias("n")))
    open_ = places.where("not alike")
    chosen = open_.groupBy("shard", "content").agg(F.sum("n").alias("n"), F.bool_or("again").alias("again"), F.min(F.struct("key", "start", "size")).alias("at"))
    spans = chosen.groupBy("at.key").agg(F.collect_list(F.struct("shard", "content", "n", "again", F.col("at.start").alias("start"), F.col("at.size").alias("size"))).alias("spans"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw, spans in zip(_unpacked(batch["text"]), batch["spans"], strict=True):
                rows += [(s["shard"], s["content"], 0, s["n"], s["shard"], s["content"], s["again"], raw[s["start"] : s["start"] + s["size"]]) for s in spans]
            yield pd.DataFrame(rows, columns=_PLACED).astype({"at": "int32"})

    texts = _packed(only, once=True).join(spans, "key").select("text", "spans")
    parts = cut(texts.mapInPandas(pieces, _PLACED_TYPES))
    runs = repeated_runs(parts, length, shard_bytes, sort_bytes).select(F.col("first_shard").alias("shard"), F.col("first_content").alias("content"), "lo", "hi").distinct()
    by_text = open_.join(runs, ["shard", "content"]).select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    alike = places.where("alike").select("key", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    # (cut, so that in the join with the texts the rows of a hot key can be dealt out)
    return keyed, cut(by_text.unionByName(alike).distinct().groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("lo", "hi")).alias("__runs")))


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) to one row per row of ``docs``.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text counts as empty; texts shorter
    than ``length`` lose nothing; matches may lie within one text and may overlap, never cross texts;
    repeated rows are texts like any other, so all of their strings repeat; an empty table gives no rows.
    """
    keyed, runs = repeated_bytes(docs, length, shard_bytes, sort_bytes)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, own in zip(batch["key"], _unpacked(batch["text"]), batch["__runs"], strict=True):
                raw = text or b""
                spans = _merged(own, len(raw)) if own is not None else []
                kept, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                rows.append((key, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["__key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # each text is reported once, and its documents take the report
    texts = _packed(keyed.select(F.col("__key").alias("key"), "text"), once=True).join(runs, F.col("key") == F.col("__key"), "left").select("key", "text", "__runs")
    reports = cut(texts.mapInPandas(report, "__key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["__key"]))
    return keyed.select("doc_id", "__key").join(reports, "__key").drop("__key")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of each text (what is left of a split character goes too) and n_chars, where present, counted anew."""
    keyed, runs = repeated_bytes(docs, length)

    docs_columns, place = docs.columns, docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(_unpacked(batch.column(place).to_pandas()), (r.as_py() for r in batch.column(len(docs_columns))), strict=True):
                raw, at, left = text or b"", 0, []
                for lo, hi in _merged(own, len(raw)) if own is not None else []:
                    left.append(raw[at:lo])
                    at = hi
                texts.append(b"".join([*left, raw[at:]]).decode("utf-8", "ignore") if text is not None else None)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(docs_columns))], docs_columns)

    joined = _packed(keyed).join(runs, "__key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__runs")
    out = joined.mapInArrow(kept, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
