"""Phrase collocations by hierarchical pair naming.

Texts become chunks of word numbers. A phrase of k words is the pair of the two phrases of k - 1 words
that overlap in it. Each chunk lists its different pairs of neighbouring names with their counts. The lists are dealt out
by a hash of the pair; where equal pairs of all chunks meet, they are counted, and the frequent ones get a
name (a number) in a table that points to their two parents. The names go back to the chunks that
list them, where neighbouring names form the pairs of the next round. Frequencies of the first and last words of a
phrase follow the parents' pointers, and so does the question whether a longer phrase takes a shorter
one over. What has no name is a break, and runs of breaks shrink to one, so chunks get shorter with each
round. Lists and chunks travel as compressed columns: a row of a shuffle is the part of a chunk's list
that falls into one bucket. A chunk carries the names that form its pairs, not its list: that follows from them.
Tables of a round go once the next one is written.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, written

LONGEST = 4
MINIMUM = 30
SCALE = 2_000_000
#: A longer phrase with so many hundredths of a shorter one's occurrences takes it over.
COVERED = 80
TOP = 2000
#: Words of a chunk (it may end with up to twice as many), and bytes of a text that are split at once.
CHUNK = 2_000_000
WINDOW = 1 << 22
#: The best of a language are taken in so many parts first.
PARTS = 64
_UPPER, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"." * len(_ENDS) + b" ")
_BREAK = b"."
#: Chunks of a task have the task's number above so many bits.
CHUNK_BITS = 20
#: List rows that a task counts at a time, on average: the lists are dealt out by key in so many buckets as that takes.
BUCKET_ROWS = 1 << 20
MAX_BUCKETS = 100_000
_PARTS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_PART_TYPES = "chunk long, lang string, bucket int, n long, data binary"
_FOUND = pa.schema([("chunk", pa.int64()), ("data", pa.binary()), ("lang", pa.string()), ("id", pa.int64()), ("f", pa.int64()), ("phrase", pa.string()), ("left", pa.int64()), ("right", pa.int64())])
_FOUND_TYPES = "chunk long, data binary, lang string, id long, f long, phrase string, left long, right long"


def _planes(values: np.ndarray, steps: bool = True) -> bytes:
    """Whole numbers from 0 on, compressed: their differences (``steps``) or themselves, byte by byte: all first bytes, then all second, as many as the greatest needs."""
    import zstandard

    values = np.asarray(values, np.int64)
    if steps:
        values = np.diff(values, prepend=0)
        values = (values << 1) ^ (values >> 63)
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide, steps]) + zstandard.ZstdCompressor(level=3).compress(raw.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    values = out.reshape(-1).view(np.int64)
    return np.cumsum((values >> 1) ^ -(values & 1)) if data[1] else values


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _head(codes: np.ndarray, skip: int, size: int) -> bytes:
    """What a chunk is but for its list: two numbers and its codes. Codes come as they are, without differences."""
    import zstandard

    raw = np.ascontiguousarray((codes.astype(np.int64) + 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return _joined(np.array([skip, size], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(raw.tobytes()))


def _from_head(data: bytes) -> tuple[np.ndarray, int, int]:
    import zstandard

    numbers, codes = _split(data)
    skip, size = np.frombuffer(numbers, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(codes), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(np.uint32).astype(np.int64) - 1, int(skip), int(size)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places that fall into each, ascending."""
    own = _bucket(hashes, buckets)
    by = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.diff(own[by], prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(by)], strict=True):
        yield int(own[by[lo]]), by[lo:hi]


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _chunk_rows(chunk: int, lang: str | None, head: bytes, size: int, parts: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The row of a chunk's head (bucket -1), then a row for each bucket of its list."""
    yield _rows(_PARTS, chunk=[chunk], lang=[lang], bucket=[-1], n=[size], data=[head])
    for bucket, n, data in parts:
        yield _rows(_PARTS, chunk=[chunk], lang=[lang], bucket=[bucket], n=[n], data=[data])


def _words(text: str) -> Iterator[list[bytes]]:
    """The words of a text in parts of bounded size; the end of a piece is a word of its own, ``.``."""
    raw = text.encode("utf-8").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= WINDOW else raw.find(b" ", at + WINDOW)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(_BREAK, b" . ").split()
        at = end


class _Open:
    """A chunk in the making. ``skip``: so many words at its front belong to the chunk before and only serve as context."""

    def __init__(self, context: list[bytes] = ()):
        self.codes: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts, self.n, self.skip = [], 0, len(context)
        self.add(list(context))

    def add(self, words: list[bytes]) -> None:
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        self.parts.append(codes)
        self.n += len(codes)

    def tail(self, n: int) -> list[bytes]:
        """The last n words, for the next chunk."""
        words = list(self.codes)
        return [words[c] for c in np.concatenate(self.parts[-n - 1 :])[-n:]] if n else []

    def rows(self, chunk: int, lang: str, buckets: int) -> Iterator[pa.RecordBatch]:
        import xxhash

        codes, words = np.concatenate(self.parts), list(self.codes)
        by = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # (frequent words get small numbers)
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by))
        codes, words, breaks = place[codes], [words[i] for i in by.tolist()], self.codes.get(_BREAK, -1)
        breaks = int(place[breaks]) if breaks >= 0 else -1
        counts = np.bincount(codes[self.skip :], minlength=len(words))
        codes[codes == breaks] = -1
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))

        def parts() -> Iterator[tuple[int, int, bytes]]:
            for bucket, at in _dealt(hashes, buckets):
                at = at[at != breaks]
                if len(at):
                    yield bucket, int(counts[at].sum()), _joined(_planes(at), _planes(counts[at]), zlib.compress(b"\n".join(words[i] for i in at.tolist()), 1))

        yield from _chunk_rows(chunk, lang, _head(codes, self.skip, len(words)), len(words), parts())


def word_chunks(docs: DataFrame, buckets: int, longest: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (text, lang) to chunks of one language: a row with the texts as numbers (bucket -1; a break is -1), and the list of the different words with their counts, by buckets of a hash (n: words counted)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << CHUNK_BITS)
        chunks: dict[str, _Open] = {}
        total = 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if not text:
                    continue
                for words in _words(text):
                    for at in range(0, len(words), chunk):
                        some = words[at : at + chunk]
                        chunks.setdefault(lang, _Open()).add(some)
                        total += len(some)
                        if total >= chunk:
                            context = chunks[lang].tail(longest - 1)
                            for x, c in chunks.items():
                                yield from c.rows(next(numbers), x, buckets)
                            chunks, total = {lang: _Open(context)}, 0
                chunks[lang].add([_BREAK]) if lang in chunks else None
        for x, c in chunks.items():
            if c.n > c.skip:
                yield from c.rows(next(numbers), x, buckets)

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(read, _PART_TYPES)


def _named(size: int, parts: list[bytes]) -> np.ndarray:
    """The names of a list of so many places; -1 without one."""
    names = np.full(size, -1, np.int64)
    for part in parts:
        numbers, at, ranks = _split(part)
        step, first = np.frombuffer(numbers, np.int64)
        names[_from_planes(at)] = _from_planes(ranks) * step + first
    return names


def _listed(seq: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of neighbouring names of a sequence (-1 is a break): where there is one, its place in the list, and the list (left, right, bucket), by bucket, then by name.

    So a bucket has places without gaps, and its pairs ascend; and since the list follows from the sequence and the number of buckets, it need not travel with it.
    """
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    a, b, high = seq[:-1][both], seq[1:][both], int(seq.max(initial=0)) + 1
    if high < 1 << 31:
        pairs, own = np.unique(a * high + b, return_inverse=True)
        left, right = np.divmod(pairs, high)
    else:
        pairs, own = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        left, right = pairs[:, 0], pairs[:, 1]
    bucket = _bucket(_mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)), buckets)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return both, place[own.reshape(-1)], left[by], right[by], bucket[by]


def pair_chunks(heads: DataFrame, found: DataFrame, buckets: int, words: bool = True, last: bool = False) -> DataFrame:
    """Chunks (chunk, data; of ``words`` or of pairs) with the names of what stands in their lists (chunk, data; what has none is a break) to chunks of pairs of neighbouring names: a row with the names that form pairs (bucket -1), and the list of the pairs and their counts by buckets."""

    def finish(chunk: int, data: bytes, named: list[bytes]) -> Iterator[pa.RecordBatch]:
        if words:
            codes, skip, size = _from_head(data)
            names = _named(size, named)
            seq = np.append(names, -1)[codes]  # (a break has the code -1)
        else:
            numbers, below = _split(data)
            skip, dealt = np.frombuffer(numbers, np.int64).tolist()
            both, own, left, *_ = _listed(_from_planes(below) - 1, dealt)
            seq = np.full(len(both), -1, np.int64)  # a pair stands where it ends
            seq[both] = _named(len(left), named)[own]
            skip = max(0, skip - 1)
        both, own, left, right, bucket = _listed(seq, buckets)
        if not both.any():
            return
        counts = np.bincount(own[np.flatnonzero(both) + 1 >= skip], minlength=len(left))
        paired = np.append(both, False) | np.insert(both, 0, False)
        kept = paired | np.insert(paired[:-1], 0, False)  # (with one break after each run)
        numbers = np.array([int(kept[:skip].sum()), buckets], np.int64).tobytes()
        head = _joined(numbers, b"" if last else _planes(seq[kept] + 1, False))

        def parts() -> Iterator[tuple[int, int, bytes]]:
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for lo, hi in zip(edges, [*edges[1:], len(bucket)], strict=True):
                n = counts[lo:hi]
                yield int(bucket[lo]), int(n.sum()), _joined(np.array([lo], np.int64).tobytes(), _planes(n, False), _planes(left[lo:hi]), _planes(right[lo:hi], False))

        yield from _chunk_rows(chunk, None, head, len(left), parts())

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, data, named = None, None, []
        for batch in batches:
            for own, part, head in zip(*batch.columns, strict=True):
                if head.as_py():
                    if data is not None:
                        yield from finish(chunk, data, named)
                    chunk, data, named = own.as_py(), part.as_py(), []
                else:
                    named.append(part.as_py())
        if data is not None:
            yield from finish(chunk, data, named)

    rows = heads.select("chunk", "data", F.lit(True).alias("head")).unionByName(found.select("chunk", "data", F.lit(False).alias("head")))
    return rows.repartition("chunk").sortWithinPartitions("chunk", F.desc("head")).select("chunk", "data", "head").mapInArrow(pair, _PART_TYPES)


def _count(parts: DataFrame, minimum: int, words: bool, buckets: int) -> DataFrame:
    """The lists of all chunks, bucket by bucket, to the names of the frequent keys (id, f and the key) and, for each chunk, the places of its list that have a name (data).

    A key has one place in a chunk at most, so no bucket grows with how often a key occurs. Names are numbered
    through the buckets in turn, so their numbers stay small.
    """

    def finish(bucket: int, langs: list, chunks: list, datas: list) -> Iterator[pa.RecordBatch]:
        lists = [_split(d) for d in datas]
        each = [_from_planes(x[1]) for x in lists]
        if words:
            ats = [_from_planes(x[0]) for x in lists]
        else:
            ats = [np.arange(len(n)) + int.from_bytes(x[0], "little") for x, n in zip(lists, each, strict=True)]
        counts = np.concatenate(each)
        if words:
            numbers: defaultdict[tuple, int] = defaultdict(count().__next__)
            own = np.array([numbers[lang, w] for lang, x in zip(langs, lists, strict=True) for w in zlib.decompress(x[2]).split(b"\n")], np.int64)
            keys = list(numbers)
        else:
            keys, own = np.unique(np.stack([np.concatenate([_from_planes(x[i]) for x in lists]) for i in (2, 3)], axis=1), axis=0, return_inverse=True)
            own = own.reshape(-1)
        f = np.zeros(len(keys), np.int64)
        np.add.at(f, own, counts)
        often = np.flatnonzero(f >= minimum)
        if not len(often):
            return
        if words:  # (frequent words get small numbers; pairs are numbered as they are sorted)
            often = often[np.argsort(-f[often], kind="stable")]
        ranks = np.full(len(keys), -1, np.int64)
        ranks[often] = np.arange(len(often))
        numbered = np.array([buckets, bucket], np.int64).tobytes()
        if words:
            key = {"lang": [keys[i][0] for i in often], "phrase": [keys[i][1].decode("utf-8") for i in often]}
        else:
            key = {"left": keys[often, 0], "right": keys[often, 1]}
        yield _rows(_FOUND, id=ranks[often] * buckets + bucket, f=f[often], **key)
        begin = 0
        for chunk, at in zip(chunks, ats, strict=True):
            named = ranks[own[begin : begin + len(at)]]
            begin += len(at)
            if (named >= 0).any():
                yield _rows(_FOUND, chunk=[chunk], data=[_joined(numbered, _planes(at[named >= 0]), _planes(named[named >= 0], not words))])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, langs, chunks, datas = None, [], [], []
        for batch in batches:
            for bucket, *rest in zip(*batch.columns, strict=True):
                if bucket.as_py() != now:
                    if datas:
                        yield from finish(now, langs, chunks, datas)
                    now, langs, chunks, datas = bucket.as_py(), [], [], []
                for to, x in zip((chunks, langs, datas), rest, strict=True):
                    to.append(x.as_py())
        if datas:
            yield from finish(now, langs, chunks, datas)

    rows = parts.where("bucket >= 0").select("bucket", "chunk", "lang", "data")
    return written(rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tally, _FOUND_TYPES), "phrases")


def _buckets(rows: int) -> int:
    return max(8, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, minimum: int = MINIMUM, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """The tables of names by length, from 1 word on, and the words of each language (lang, n).

    A name has id, lang, phrase, f, its parents' ids (left, right) and the frequencies of its first and last 1, 2, ... words (firsts, lasts).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(size // 32)
    parts = written(word_chunks(docs, buckets, longest, chunk), "words")
    words = cut(parts.where("bucket >= 0").groupBy("lang").agg(F.sum("n").alias("n")))
    tables = []
    for k in range(1, longest + 1):
        found = _count(parts, minimum, k == 1, buckets)
        own = found.where("id is not null")
        if k == 1:
            names = own.select("id", "lang", "phrase", "f", F.col("phrase").alias("last"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))
        else:
            first = tables[-1].select(F.col("id").alias("left"), "lang", "phrase", "firsts")
            second = tables[-1].select(F.col("id").alias("right"), "last", "lasts")
            joined = own.select("id", "left", "right", "f").join(first, "left").join(second, "right")
            names = joined.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f", "last", "left", "right", F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"))
        tables.append(cut(names))
        if k < longest:
            listed = parts.where("bucket < 0").agg(F.sum("n")).first()[0] or 0
            heads, named = parts.where("bucket < 0").select("chunk", "data"), found.where("chunk is not null").select("chunk", "data")
            buckets = _buckets(8 * listed if k == 1 else listed)
            before, parts = parts, written(pair_chunks(heads, named, buckets, words=k == 1, last=k + 1 == longest), "pairs")
            dropped(before)
        else:
            dropped(parts)
        dropped(found)  # (what is left of it is in the tables of names and in the next chunks)
    return tables, words


def _wide(c: Column | str) -> Column:
    """Decimals, since products may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _scored(k: int, c: int) -> Column:
    """A phrase of k words cut after c words."""
    left, right = F.get("firsts", F.lit(c - 1)), F.get("lasts", F.lit(k - c - 1))
    score = F.call_function("div", _wide("f") * F.lit(SCALE).cast("decimal(10,0)"), _wide(left) + _wide(right))
    return F.struct(score.alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, longest: int = LONGEST, minimum: int = MINIMUM, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (text, lang; more columns are ignored) to each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``; null and empty texts have no words; repeated rows count again; an empty table
    gives no rows. Equal scores go by frequency, then by the phrase's bytes.
    """
    tables, words = frequent_phrases(docs, longest, minimum, chunk)
    ranked = []
    for k in range(2, longest + 1):
        names = tables[k - 1]

        best = names.select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*(_scored(k, c) for c in range(1, k)))).alias("best"))
        if k < longest:  # (what a phrase two words longer has, one in between has as well)
            longer = tables[k].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            kept = best.join(longer, "id", "left").where(F.coalesce(_wide("longer") * 100 < _wide("a") * COVERED, F.lit(True)))
        else:
            kept = best
        ranked.append(kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
