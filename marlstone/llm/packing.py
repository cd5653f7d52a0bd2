"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous supersteps.

Pieces of the full length are sequences of their own. The others are packed by classes of length, the
longest first. A superstep range-sorts the pieces that are left and the slots of the open gaps
together, from the largest size down, and sweeps that order once: a piece takes its successor, the
smallest slot that holds it and that no larger piece has taken. In that order slots are opening and
pieces closing brackets, so the sweep is a running sum: each partition is summed on its own, the
sums before it are added, and a piece meets its slot at the same depth. Pieces that want the same
slot are thereby dealt out by their rank. A gap wide enough for several of the longest pieces left has
as many slots. Then the gaps are updated and the next superstep follows; what still finds no room
after two of them gets new sequences. Only sums by partition and by superstep reach the driver.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_pandas

END_ID = 2
SEQUENCE = 1024
#: A partition of a sweep has about so many pieces and slots, so long as there are partitions enough.
SORTED_ROWS = 50_000
_ENCODERS: dict = {}


def _encoder(vocabulary: str):
    """The byte-level BPE of a ranks file, loaded once in a worker. The added tokens of the JSON file beside it are split off first."""
    if vocabulary not in _ENCODERS:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(vocabulary.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[vocabulary]


def default_vocabulary() -> str:
    """The ranks file with the same vocabulary and ids as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenised_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """``docs`` (doc_id, text) to pieces (doc_id, piece, start, length, ids_crc32).

    A document's ids are those of its text (null or empty: none) and then id 2. Only documents longer than
    ``sequence`` are cut; all their pieces but the first are full. Repeated rows are separate documents.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = array.array("I", encoder.encode(text, allowed_special="all") if text else [])
                ids.append(END_ID)
                raw, n = memoryview(ids).cast("B"), len(ids)
                start, end, piece = 0, (n - 1) % sequence + 1, 0
                while start < n:
                    rows.append((doc, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    start, end, piece = end, end + sequence, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_pandas(docs.select("doc_id", "text"), encode, "piece int, start long, length long, ids_crc32 long", "doc_id")


def _slots(gaps: DataFrame, longest: int) -> DataFrame:
    """Gaps (seq, room) to slots: one, or as many as there is room for pieces of the longest length."""
    n = F.greatest(F.floor(F.col("room") / longest), F.lit(1)).cast("int")
    return gaps.select("seq", "room", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("slot")).select("seq", "room", "slot", F.floor(F.col("room") / F.col("n")).alias("size"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition: its number, its sum of +1 a slot and -1 a piece, and the least running sum."""
    total = least = 0
    part = None
    for batch in batches:
        steps = np.where(batch["slot"] > 0, 1, -1).cumsum() + total
        total, least = int(steps[-1]) if len(steps) else total, min(least, int(steps.min()) if len(steps) else least)
        part = batch["part"].iloc[0] if len(batch) else part
    if part is not None:
        yield pd.DataFrame({"part": [part], "total": [total], "least": [least]})


def _depths(batches: Iterator[pd.DataFrame], before: dict[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Adds the bracket depth of each row and its place in the order; pieces that find no open slot have a negative depth of their own."""
    part = None
    for batch in batches:
        if len(batch):
            if part is None:
                part = int(batch["part"].iloc[0])
                (total, least), place = before[part], part << 40
            opens = batch["slot"].to_numpy() > 0
            places = np.arange(place, place + len(batch))
            sums = np.where(opens, 1, -1).cumsum() + total
            lows = np.minimum.accumulate(np.minimum(sums, least))
            earlier = np.concatenate(([least], lows[:-1]))
            depth = np.where(opens, sums - lows, np.where(sums < earlier, -1 - places, sums - lows + 1))
            yield batch.drop(columns="part").assign(depth=depth, place=places)
            total, least, place = int(sums[-1]), int(lows[-1]), place + len(batch)


def superstep(left: DataFrame, gaps: DataFrame, longest: int, partitions: int) -> DataFrame:
    """One sweep of pieces (id, length) over gaps (seq, room): (id, slot, room, size, mate, mate_length).

    A row with a slot number above 0 is a slot of the gap ``id``, with the piece that takes it or null; one with
    slot 0 is a piece that found none, with its length as size.
    """
    slots = _slots(gaps, longest).select("size", F.col("seq").alias("id"), "slot", "room")
    rows = slots.unionByName(left.select(F.col("length").alias("size"), "id", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("room")))
    order = [F.col("size").desc(), (F.col("slot") == 0).asc(), F.col("id").asc(), F.col("slot").asc()]
    ordered = cut(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    before, total, least = {}, 0, 0
    for r in sorted(ordered.select("part", "slot").mapInPandas(_sums, "part int, total long, least long").collect()):  # (a row a partition)
        before[r["part"]] = (total, least)
        least = min(least, total + r["least"])
        total += r["total"]
    # (a depth holds a slot and a piece a size at most, whatever the number of rows)
    depth = Window.partitionBy("depth").orderBy("place")
    swept = ordered.mapInPandas(lambda b: _depths(b, before), "size long, id long, slot int, room long, depth long, place long")
    met = swept.withColumns({"mate": F.lead("id").over(depth), "mate_length": F.lead("size").over(depth)})
    return cut(met.where("slot > 0 or depth < 0").select("id", "slot", "room", "size", "mate", "mate_length"))


def _bounds(sequence: int) -> list[tuple[int, int]]:
    """Classes of lengths, the longest first: over .. up to; each halves the one before."""
    top, out = sequence - 1, []
    while top > max(1, sequence // 16):
        low = min(top - 1, (sequence >> (len(out) + 1)))
        out.append((low, top))
        top = low
    return [*out, (0, top)] if top else out


def _state(left: DataFrame) -> tuple[int, int, int]:
    n, total, longest = left.agg(F.count("*"), F.sum("length"), F.max("length")).first()
    return n, total or 0, longest or 0


def place_pieces(pieces: DataFrame, sequence: int = SEQUENCE, rows: int = SORTED_ROWS) -> DataFrame:
    """Pieces (id, length; ids unique and not negative) to their places (id, sequence_id, offset)."""
    most = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark = pieces.sparkSession
    full = F.col("length") == sequence
    places = [pieces.where(full).select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(~full)
    opened, gaps = 0, None
    _, total, _ = _state(rest)

    def more(n: int) -> DataFrame:
        nonlocal opened
        opened += n
        return spark.range(opened - n, opened).select((-F.col("id") - 1).alias("seq"), F.lit(sequence).cast("long").alias("room"))

    gaps = more(-(-total // sequence))
    for low, top in _bounds(sequence):
        left = rest.where(F.col("length").between(low + 1, top))
        n, total, longest = _state(left)
        for turn in range(1_000_000):
            if not n:
                break
            if turn >= 2:  # enough new sequences for all that is left
                gaps = gaps.unionByName(more(-(-n // (sequence // longest))))
            fits = gaps.where(F.col("room") > low)
            out = superstep(left, fits, longest, max(1, min(most, -(-(n + opened) // rows))))
            by_slot = Window.partitionBy("id").orderBy("slot")
            places.append(out.where("mate is not null").select(F.col("mate").alias("id"), F.col("id").alias("sequence_id"), (sequence - F.col("room") + F.sum("mate_length").over(by_slot) - F.col("mate_length")).alias("offset")))
            narrowed = out.where("slot > 0").groupBy(F.col("id").alias("seq")).agg((F.max("room") - F.coalesce(F.sum("mate_length"), F.lit(0))).alias("room")).where("room > 0")
            gaps = cut(narrowed.unionByName(gaps.where(F.col("room") <= low)))
            left = out.where("slot = 0").select("id", F.col("size").alias("length"))
            n, total, longest = _state(left)
    out = places[0]
    for x in places[1:]:
        out = out.unionByName(x)
    return out


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) to the placed pieces, one row each.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    documents of the one id 2; an empty table gives no rows; equal rows are packed separately. The
    pieces of a sequence are gapless from offset 0. The number of supersteps depends on the classes of
    length, not on the number of documents.
    """
    pieces = cut(tokenised_pieces(docs, vocabulary or default_vocabulary(), sequence)).withColumn("id", F.monotonically_increasing_id())
    placed = place_pieces(pieces.select("id", "length"), sequence)
    return pieces.join(placed, "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
