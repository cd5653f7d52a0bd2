"""A table with a key, kept as immutable Parquet files and numbered versions that name the files they consist of.

An update is a copy-on-write merge: it finds the files that hold a hit key, rewrites these alone, and
becomes visible by creating the file of the next version, which a second writer of the same version
cannot. Until then nothing that a reader sees has changed, so a dry run returns its plan and writes
nothing, and a run that is killed leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Store


class ConflictError(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class UpdatePlan:
    """What an update would do: rows given, keys repeated, null or unknown, rows hit, files rewritten, files left alone."""

    version: int
    rows: int
    repeated_keys: int
    null_keys: int
    unknown_keys: int
    hit_rows: int
    rewritten: list[str] = field(default_factory=list)
    untouched: list[str] = field(default_factory=list)

    @property
    def sound(self) -> bool:
        return not (self.repeated_keys or self.null_keys or self.unknown_keys)


class KeyedTable:
    """``folder`` holds ``data`` (Parquet files) and ``versions`` (JSON: files and schema). The key is one column, unique and not null."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key, self.store = spark, folder.rstrip("/"), key, Store(spark, folder)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _state(self, version: int | None = None) -> tuple[int, list[str], T.StructType]:
        number = max(self.versions(), default=0) if version is None else version
        if not number:
            raise FileNotFoundError(f"no version of a table in {self.folder}")
        state = json.loads(self.store.read(f"versions/{number:08d}.json"))
        return number, state["files"], T.StructType.fromJson(state["schema"])

    def _of(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        _, files, schema = self._state(version)
        return self._of(files, schema)

    def files(self, version: int | None = None) -> list[str]:
        return self._state(version)[1]

    def _written(self, df: DataFrame) -> list[str]:
        """Files of ``df``, moved into ``data`` under names that no other write has."""
        stage = f"data/.stage-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{stage}")
        out = []
        for name in self.store.names(stage):
            if name.startswith("part-"):
                out.append(f"{stage[-12:]}-{name}")
                self.store.rename(f"{stage}/{name}", f"data/{out[-1]}")
        self.store.delete(stage)
        return out

    def _commit(self, version: int, files: list[str], schema: T.StructType, fresh: list[str]) -> int:
        text = json.dumps({"files": sorted(files), "schema": schema.jsonValue()}, sort_keys=True)
        if not self.store.create(f"versions/{version:08d}.json", text):
            for name in fresh:
                self.store.delete(f"data/{name}")
            raise ConflictError(f"version {version} of {self.folder} was made by another writer")
        return version

    def create(self, df: DataFrame) -> int:
        """The first version. Raises where there is one already, or a key is null or repeated."""
        if self.versions():
            raise FileExistsError(f"{self.folder} holds a table")
        self._check_keys(df)
        files = self._written(df)
        schema = self.spark.read.parquet(f"{self.folder}/data/{files[0]}").schema  # (as files have it: all may be null)
        return self._commit(1, files, schema, files)

    def _check_keys(self, df: DataFrame) -> None:
        bad = df.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"a null or repeated key: {bad[0].asDict()}")

    def plan(self, updates: DataFrame) -> UpdatePlan:
        """What ``update`` would do; nothing is written."""
        number, files, schema = self._state()
        keys = updates.groupBy(F.col(self.key).alias("_key")).agg(F.count("*").alias("_n"))
        placed = self._of(files, schema).select(F.col(self.key).alias("_key"), F.lit(True).alias("_known"), F.col("_metadata.file_name").alias("_file") if files else F.lit(None).cast("string").alias("_file"))
        met = keys.join(placed, "_key", "left")
        by_file = met.groupBy("_file").agg(F.count_if(F.col("_known")).alias("hit"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_key").isNull()).alias("nulls"), F.count_if(F.col("_key").isNotNull() & F.col("_known").isNull()).alias("unknown")).collect()  # (a row a file)
        total = lambda c: sum(r[c] for r in by_file)
        hit = sorted(r["_file"] for r in by_file if r["hit"])
        return UpdatePlan(number, total("rows"), total("repeated"), total("nulls"), total("unknown"), total("hit"), hit, sorted(set(files) - set(hit)))

    def update(self, updates: DataFrame, columns: list[str], stamp: Column | None = None, stamp_column: str = "updated_at", dry_run: bool = False) -> UpdatePlan:
        """Assigns ``columns`` of the rows whose key ``updates`` (key, columns) names, and ``stamp`` where given; nothing else changes.

        Raises ValueError where a key is null, repeated or unknown, before anything is written. An empty
        update makes no version. ``dry_run`` returns the plan alone.
        """
        plan = self.plan(updates)
        if dry_run:
            return plan
        if not plan.sound:
            raise ValueError(f"keys repeated {plan.repeated_keys}, null {plan.null_keys}, unknown {plan.unknown_keys}")
        if not plan.hit_rows:
            return plan
        _, _, schema = self._state(plan.version)
        given = updates.select(self.key, F.lit(True).alias("_hit"), *[F.col(c).cast(schema[c].dataType).alias(f"_new_{c}") for c in columns])
        rows = self._of(plan.rewritten, schema).join(given, self.key, "left")
        changed = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
        if stamp is not None:
            changed[stamp_column] = F.when(F.col("_hit"), stamp.cast(schema[stamp_column].dataType)).otherwise(F.col(stamp_column))
        fresh = self._written(rows.withColumns(changed).select(*schema.fieldNames()))
        self._commit(plan.version + 1, plan.untouched + fresh, schema, fresh)
        return plan

    def merge(self, rows: DataFrame) -> int:
        """Replaces the rows whose keys ``rows`` holds and adds the others; the number of the new version. Files without a hit key stay as they are."""
        self._check_keys(rows)
        number, files, schema = self._state()
        plan = self.plan(rows)
        kept = self._of(plan.rewritten, schema).join(rows.select(self.key), self.key, "left_anti")
        fresh = self._written(kept.unionByName(rows.select(*schema.fieldNames())) if plan.rewritten else rows.select(*schema.fieldNames()))
        return self._commit(number + 1, plan.untouched + fresh, schema, fresh)


def verify_update(table: DataFrame, updates: DataFrame, key: str, vectors: dict[str, int], tolerance: float = 1e-6) -> DataFrame:
    """One row for each vector column (name to dimension) of a table after an update: rows, nulls, wrong dimensions, norms off 1, the greatest drift from ``updates``, and the rows that drift more than ``tolerance``."""
    out = None
    for name, dimension in vectors.items():
        both = table.select(key, F.col(name).alias("v")).join(updates.select(key, F.col(name).alias("w")), key)
        drift = F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b)))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        found = both.agg(
            F.lit(name).alias("name"), F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.size("v") != dimension).alias("wrong_dimensions"),
            F.count_if(F.abs(norm - 1) > 1e-6).alias("norms_off"), F.max(drift).alias("max_drift"), F.count_if(F.coalesce(drift > tolerance, F.lit(True))).alias("drifted"),
        )
        out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class ExportSummary:
    valid: int
    invalid: int
    current: int
    generated: int
    versions: int


def export(source: DataFrame, folder: str, key: str, generate, invalid: Column, batches: int = 4, dry_run: bool = False) -> ExportSummary:
    """Keeps in ``folder`` a table (key, fingerprint, generated columns) of ``source``: rows whose content has the recorded fingerprint are skipped, others are generated.

    ``generate`` takes the pending rows (all columns of ``source`` and ``fingerprint``) and returns key and the generated columns.
    Rows for which ``invalid`` is true are counted and left out. Pending rows are worked off in ``batches``, by a hash of the key, each
    committed as a version of its own, so a run that was killed goes on with what is left. A run with nothing pending makes no version.
    """
    spark = source.sparkSession
    table = KeyedTable(spark, folder, key)
    columns = sorted(c for c in source.columns)
    marked = source.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)).withColumn("_invalid", F.coalesce(invalid, F.lit(True)))
    sound = marked.where("not _invalid").drop("_invalid")
    done = table.read().select(key, F.col("fingerprint").alias("_done")) if table.versions() else None
    joined = sound.join(done, key, "left") if done is not None else sound.withColumn("_done", F.lit(None).cast("string"))
    pending = joined.where(~F.col("_done").eqNullSafe(F.col("fingerprint"))).drop("_done")
    part = F.pmod(F.xxhash64(key), F.lit(batches)).alias("part")
    counts = {r["part"]: r["count"] for r in pending.groupBy(part).count().collect()}
    total, bad = marked.agg(F.count_if(~F.col("_invalid")), F.count_if(F.col("_invalid"))).first()
    generated = sum(counts.values())
    made = 0
    for k in sorted(counts) if not dry_run else ():
        rows = pending.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        fresh = generate(rows).join(rows.select(key, "fingerprint"), key)
        table.merge(fresh) if table.versions() else table.create(fresh)
        made += 1
    return ExportSummary(total, bad, total - generated, generated, made)
