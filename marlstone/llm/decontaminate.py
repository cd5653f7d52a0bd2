"""Benchmark decontamination with DataFrame functions only.

Windows of a document as long as a benchmark item get a 64-bit SimHash of their word shingles.
Multi-index Hamming blocks find the items: at a distance of up to RADIUS, one of the 8 blocks of 8
bits differs in at most RADIUS // 8 bits, so an item is entered under all block values that near and
a window looks up its own 8. Every pair within the radius is met; the weighted Jaccard similarity of
the shingle multisets then decides. A window of n shingles reaches a similarity s with an item of m only
if s / (1 + s) * (n + m) of its places at least hold a shingle of the item, in whatever order. Places are
counted by sliding over them, and every window with that many gets its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
#: Tables of at most so many rows (of some 16 bytes) are sent to all executors; larger ones are shuffled.
SMALL_ROWS = 500_000
_SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The lower-case words of a text (null: none)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACES), lambda w: w != "")


def shingles(listed: Column, k: int) -> Column:
    """The hashes of all runs of k words, repeats included; fewer words have none. ``listed`` must be a plain column: it is read once a place."""
    n = F.size(listed)
    places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(listed, i, k)))


def simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in over half of the hashes."""
    bit = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two multisets of hashes: the sum of the lesser counts by the sum of the greater."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _near_values(value: Column, bits: int) -> Column:
    """All block values that differ from ``value`` in at most so many bits."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda v: F.bit_count(v.bitwiseXOR(value)) <= bits)


def _entry(block: int):
    return lambda v: F.struct(F.lit(block).alias("block"), v.alias("value"))


def _few(df: DataFrame, limit: int) -> DataFrame:
    """``df``, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= limit else df


def _starts(at: Column, n: Column, m: Column, need: Column) -> Column:
    """Of the sorted places at which a text of n shingles holds one of an item of m: the starts of all windows of m that cover ``need`` of them."""
    last = F.greatest(n - m, F.lit(0))
    spans = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.struct(F.greatest(F.get(at, i + need - 1) - m + 1, F.lit(0)).alias("lo"), F.least(F.get(at, i), last).alias("hi")))
    spans = F.filter(spans, lambda x: x["lo"] <= x["hi"])
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["lo"], x["hi"]))))


def _matches(docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int, small_rows: int) -> DataFrame:
    """(key, doc_id, text) and (item_id, words) to (key, item_id, start, similarity), with shingles of k words."""
    items = cut(items.select("item_id", shingles(F.col("words"), k).alias("item")).withColumn("m", F.size("item")))
    items = cut(items.withColumn("item_fp", simhash(F.col("item"))))
    known = cut(items.select("item_id", "m", F.explode("item").alias("h")).distinct())
    listed = lambda df, *more: df.withColumn("words", words(F.col("text"))).select("key", *more, shingles(F.col("words"), k).alias("own"), F.greatest(F.size("words") - (k - 1), F.lit(0)).alias("n"))
    # the places where documents hold a shingle of an item, and the windows that cover enough of them
    # (outer, as otherwise a filter on the shingles' number is inferred and computes them twice)
    shared = listed(docs).select("key", "n", F.posexplode_outer("own").alias("at", "h")).join(_few(known, small_rows), "h")
    places = shared.groupBy("key", "n", "item_id", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))
    need = F.greatest(F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.least("n", "m")) - F.lit(1e-9)), F.lit(1)).cast("int")
    places = cut(places.withColumn("need", need).where("size(at) >= need"))
    starts = places.select("key", "m", F.explode(_starts(F.col("at"), F.col("n"), F.col("m"), F.col("need"))).alias("start")).distinct()
    starts = cut(starts.groupBy("key").agg(F.collect_list(F.struct("m", "start")).alias("starts")))
    windows_of = F.transform("starts", lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), F.slice("own", x["start"] + 1, x["m"]).alias("window")))
    made = listed(docs.join(_few(starts, small_rows), "key"), "starts").select("key", F.inline_outer(windows_of))
    made = cut(made.withColumn("id", F.concat(*[F.hex(F.xxhash64("m", "window", F.lit(i))) for i in (0, 1)])))
    windows = cut(made.groupBy("id", "m").agg(F.first("window").alias("window")))
    windows = cut(windows.withColumn("fp", simhash(F.col("window"))))
    # multi-index Hamming blocks
    index_values = F.concat(*[F.transform(_near_values(_block(F.col("item_fp"), i), radius // BLOCKS), _entry(i)) for i in range(BLOCKS)])
    index = items.select("item_id", "m", "item_fp", F.inline(index_values))
    probes = windows.select("id", "m", "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("value")) for i in range(BLOCKS)])))
    met = probes.join(index, ["m", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("id", "m", "item_id").distinct()
    judged = met.join(windows.select("id", "window"), "id").join(items.select("item_id", "m", "item"), ["item_id", "m"]).withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item")))
    found = judged.where(F.col("similarity") >= similarity).select("id", "item_id", "similarity")
    return made.select("key", "id", "start").join(found, "id").select("key", "item_id", "start", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Benchmark items found in documents: (doc_id, item_id, start, similarity), the best window of each pair, start in words.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; more columns are ignored, whatever their
    names. Null, empty and blank texts of either side match nothing. Items of fewer words than ``shingle``
    are one shingle and must occur word for word. A document shorter than an item is one window. Of equal
    similarities the first window counts. A null item_id is an id like others. Repeated rows are reported once; of items with one item_id, the
    best; empty tables give no rows.
    """
    docs = docs.select("doc_id", "text", _row_key().alias("key"))
    best = _best(docs, benchmark, shingle, similarity, radius, small_rows)
    if best is None:
        kind = benchmark.schema["item_id"].dataType.simpleString()
        return docs.select("doc_id", F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).where("false")
    ids = docs.select("key", "doc_id").distinct()
    keys = _few(best.select("key").distinct(), small_rows)
    return ids.join(keys, "key", "left_semi").join(best, "key").select("doc_id", "item_id.item_id", (-F.col("best.back")).alias("start"), "best.similarity")


def _row_key() -> Column:
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.hex(F.xxhash64("text", "doc_id")))


def _best(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, small_rows: int = SMALL_ROWS) -> DataFrame | None:
    """(key, doc_id, text) to (key, item_id, best): the best window; None where no item has a word. Ids stand in a struct, so that a null one is joined as well."""
    items = cut(benchmark.select(F.struct("item_id").alias("item_id"), words(F.col("text")).alias("words")).where("size(words) > 0").withColumn("k", F.least(F.size("words"), F.lit(shingle))))
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # at most ``shingle`` values
        part = _matches(docs, items.where(F.col("k") == k), k, similarity, radius, small_rows)
        found = part if found is None else found.unionByName(part)
    return None if found is None else cut(found.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, whatever their doc_id; other rows of the same doc_id stay."""
    best = _best(docs.select("doc_id", "text", _row_key().alias("key")), benchmark)
    if best is None:
        return docs
    dirty = _few(best.select(F.col("key").alias("__key")).distinct(), SMALL_ROWS)
    return docs.withColumn("__key", _row_key()).join(dirty, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
