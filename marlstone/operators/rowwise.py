"""Each row with all others at once, for what needs a row's whole order: no pair is shuffled.

The rows lie in the shared folder as files of arrays, in the order of their ids. A task takes a few rows at a time as
sources, reads the others block by block and keeps the scores of its few rows alone, so its memory is bounded by
``HELD_BYTES`` and the ids, and what is written is the rows once. The work grows with the square of the rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from .vectors import PLACES

#: Bytes that a task holds for the sources it looks at together.
HELD_BYTES = 96 << 20
#: Bytes of the rows that are read at a time, and of a file.
BLOCK_BYTES = 2 << 20
FILE_BYTES = 32 << 20
MAX_TASKS = 20_000
#: A score as a whole number and the place of a row share 63 bits: so many rows at most are sorted as such.
_MOST = 1 << 21


@dataclass(frozen=True)
class Rows:
    """Rows in the shared folder, ids ascending: the files' numbers of rows and paths, and the width of a row."""

    root: str
    files: list[tuple[int, str]]
    width: int

    @property
    def n(self) -> int:
        return sum(n for n, _ in self.files)

    def ids(self) -> np.ndarray:
        store = fs.FileSystem.from_uri(self.root)[0]
        return np.concatenate([np.frombuffer(store.open_input_stream(f"{path}.ids").read(), np.int64) for _, path in self.files])

    def between(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """The rows at the places low to high as (place of the first, rows), block by block."""
        store, size, at = fs.FileSystem.from_uri(self.root)[0], 8 * self.width, 0
        step = max(1, BLOCK_BYTES // size)
        for n, path in self.files:
            first, last = max(low, at), min(high, at + n)
            if first < last:
                with store.open_input_file(f"{path}.rows") as file:
                    for place in range(first, last, step):
                        data = file.read_at(size * min(step, last - place), size * (place - at))
                        yield place, np.frombuffer(data).reshape(-1, self.width)
            at += n

    def at(self, low: int, high: int) -> np.ndarray:
        return np.concatenate([v for _, v in self.between(low, high)])


def stored(rows: DataFrame) -> Rows:
    """(id, v) as files in the shared folder; null ids and vectors are left out."""
    known = rows.where("id is not null and v is not null").select("id", "v")
    n, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    root = f"{shared_dir(rows.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    root = root if ":" in root else f"file://{root}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder)
        path, least, held = f"{folder}/{uuid.uuid4().hex}", None, 0  # (a task that runs again writes files of new names)
        with store.open_output_stream(f"{path}.ids") as ids, store.open_output_stream(f"{path}.rows") as values:
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    least = int(own[0]) if least is None else least
                    held += len(own)
                    ids.write(own.tobytes())
                    values.write(batch.column(1).flatten().to_numpy(zero_copy_only=False).tobytes())
        if held:
            yield pa.RecordBatch.from_pydict({"least": [least], "n": [held], "path": [path]})

    files = max(1, math.ceil(n * 8 * width / FILE_BYTES))
    found = cut(known.repartitionByRange(files, "id").sortWithinPartitions("id").mapInArrow(write, "least long, n long, path string"))
    return Rows(root, [(r["n"], r["path"]) for r in sorted(found.collect(), key=lambda r: r["least"])], width)


#: Of a task: takes ids of all rows, and gives what takes (place of the first source, sources) to the task's rows, and what gives the rows that end it.
Look = Callable[[np.ndarray], tuple[Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]]


def each_with_all(rows: DataFrame, table: Rows, look: Look, schema: str, row_bytes: int, tasks: int | None = None) -> DataFrame:
    """What ``look`` makes of every few rows of ``table``; it holds ``row_bytes`` for each pair of a source with another row."""
    n, spark = table.n, rows.sparkSession
    few = max(1, min(HELD_BYTES // max(1, row_bytes * n), math.ceil(n / spark.sparkContext.defaultParallelism)))
    strips = math.ceil(n / few)
    tasks = max(1, min(strips, tasks or 16 * spark.sparkContext.defaultParallelism, MAX_TASKS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = done = None
        for batch in batches:
            for strip in batch.column(0).to_pylist():
                if met is None:
                    met, done = look(table.ids())
                yield from met(strip * few, table.at(strip * few, min(n, strip * few + few)))
        if done:
            yield from done()

    # (the strips of a task lie apart, since the first rows may have more others than the last)
    dealt = spark.range(0, tasks, 1, tasks).select(F.explode(F.sequence(F.col("id"), F.lit(strips - 1).cast("long"), F.lit(tasks).cast("long"))).alias("strip")) if n else spark.createDataFrame([], "strip long")
    return dealt.mapInArrow(work, schema)


def scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosines of unit vectors as whole numbers of the last place that counts, as doubles."""
    found = np.matmul(a, b.T)
    np.clip(found, -1, 1, out=found)
    np.multiply(found, 10.0**PLACES, out=found)
    return np.rint(found, out=found)


def descending(whole: np.ndarray) -> np.ndarray:
    """The places of one row's ``scaled`` cosines from the greatest down, equal ones ascending; those without a value come first, as in SQL's order."""
    none = np.isnan(whole)
    if len(whole) > _MOST:
        return np.argsort(-np.where(none, np.inf, whole), kind="stable")
    key = 10.0**PLACES + 1 - whole
    key[none] = 0
    key = (key.astype(np.int64) << 21) | np.arange(len(whole))
    key.sort()
    return key & ((1 << 21) - 1)
