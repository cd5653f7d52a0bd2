"""Keyed updates, exports that resume, and publishing of whole folders."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.sources import publish
from marlstone.sources.keyed_table import ConflictError, KeyedTable, export, verify_update


def hashes(folder):
    return {f: hashlib.sha256(open(f"{folder}/data/{f}", "rb").read()).hexdigest() for f in os.listdir(f"{folder}/data") if f.endswith(".parquet") and not f.startswith(".")}


def items(spark, n=40):
    return spark.range(n).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"), F.lit("old").alias("note"), F.lit(None).cast("timestamp").alias("updated_at"))


def test_update_rewrites_only_files_with_hit_keys(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = KeyedTable(spark, folder, "id")
    assert table.create(items(spark).repartitionByRange(5, "id")) == 1
    before, names = hashes(folder), table.files()
    updates = spark.createDataFrame([(3, [0.0, 1.0], "x"), (4, None, None)], "id long, v array<double>, note string")
    plan = table.update(updates, ["v"], stamp=F.lit("2024-01-01").cast("timestamp"), dry_run=True)
    assert plan.sound and plan.hit_rows == 2 and len(plan.rewritten) == 1 and len(plan.untouched) == 4
    assert hashes(folder) == before and table.versions() == [1]  # a dry run leaves no trace
    table.update(updates, ["v"], stamp=F.lit("2024-01-01").cast("timestamp"))
    assert table.versions() == [1, 2] and set(plan.untouched) < set(table.files()) and not set(plan.rewritten) & set(table.files())
    assert {f: h for f, h in hashes(folder).items() if f in before} == before  # files are never changed, only replaced
    rows = {r.id: r for r in table.read().collect()}
    assert len(rows) == 40 and rows[3].v == [0.0, 1.0] and rows[4].v is None and rows[5].v == [1.0, 0.0]
    assert {r.note for r in rows.values()} == {"old"} and [i for i, r in rows.items() if r.updated_at] == [3, 4]
    assert table.read(1).where("v[1] > 0").count() == 0 and sorted(table.files(1)) == sorted(names)
    found = verify_update(table.read(), updates, "id", {"v": 2}).first()
    assert (found["rows"], found.nulls, found.wrong_dimensions, found.norms_off, found.max_drift, found.drifted) == (2, 1, 0, 0, 0.0, 1)


def test_unsound_updates_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = KeyedTable(spark, folder, "id")
    with pytest.raises(FileNotFoundError):
        table.read()
    with pytest.raises(ValueError, match="key"):
        table.create(items(spark).union(items(spark, 1)))
    table.create(items(spark))
    before = hashes(folder)
    for keys in ([1, 1], [None], [99]):
        with pytest.raises(ValueError, match="unknown"):
            table.update(spark.createDataFrame([(k, "y") for k in keys], "id long, note string"), ["note"])
    table.update(spark.createDataFrame([], "id long, note string"), ["note"])
    assert hashes(folder) == before and table.versions() == [1]
    with pytest.raises(FileExistsError):
        table.create(items(spark))


def test_the_second_of_two_writers_fails_and_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    first, second = KeyedTable(spark, folder, "id"), KeyedTable(spark, folder, "id")
    first.create(items(spark))
    change = lambda note: spark.createDataFrame([(1, note)], "id long, note string")
    written = second._written

    def late(df):
        out = written(df)
        first.update(change("first"), ["note"])
        return out

    monkeypatch.setattr(second, "_written", late)
    with pytest.raises(ConflictError):
        second.update(change("second"), ["note"])
    assert first.read().where("id = 1").first().note == "first" and set(hashes(folder)) == set(first.files()) | set(first.files(1))


def test_merge_into_empty_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.create(items(spark).limit(0))
    assert table.read().count() == 0
    table.merge(items(spark, 3))
    table.merge(items(spark, 5).withColumn("note", F.lit("new")))
    assert {(r.id, r.note) for r in table.read().collect()} == {(i, "new") for i in range(5)}


def source(spark, changed=(), n=30):
    text = F.when(F.col("id").isin(list(changed)), "b").otherwise("a")
    return spark.range(n).select("id", F.when(F.col("id") % 10 == 9, None).otherwise(text).alias("text"))


def shout(rows):
    return rows.select("id", F.upper("text").alias("out"))


def test_export_skips_what_is_current(spark, tmp_path):
    folder = str(tmp_path / "e")
    run = lambda s, **more: export(s, folder, "id", shout, F.col("text").isNull(), **more)
    dry = run(source(spark), dry_run=True)
    assert (dry.valid, dry.invalid, dry.current, dry.generated, dry.versions) == (27, 3, 0, 27, 0) and not os.path.exists(folder)
    first = run(source(spark))
    assert (first.valid, first.current, first.generated) == (27, 0, 27) and first.versions > 1
    before = hashes(folder)
    again = run(source(spark))
    assert (again.current, again.generated, again.versions) == (27, 0, 0) and hashes(folder) == before
    changed = run(source(spark, changed=[2, 5], n=31))
    assert (changed.current, changed.generated) == (25, 3)
    rows = {r.id: r.out for r in KeyedTable(spark, folder, "id").read().collect()}
    assert len(rows) == 28 and rows[2] == rows[5] == "B" and rows[30] == rows[0] == "A"


def test_a_killed_export_goes_on(spark, tmp_path):
    folder, seen = str(tmp_path / "e"), []

    def dying(rows):
        seen.append(rows.count())
        if len(seen) == 3:
            raise RuntimeError("killed")
        return shout(rows)

    with pytest.raises(RuntimeError):
        export(source(spark), folder, "id", dying, F.col("text").isNull())
    done = sum(seen[:2])
    assert KeyedTable(spark, folder, "id").read().count() == done > 0
    rest = export(source(spark), folder, "id", shout, F.col("text").isNull())
    assert (rest.current, rest.generated) == (done, 27 - done) and KeyedTable(spark, folder, "id").read().count() == 27


def test_publish_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    manifest = publish.publish(spark, target, {"a": spark.range(5), "b": source(spark)}, {"run_id": "r1"})
    assert manifest["run_id"] == "r1" and {n.split("/")[0] for n in manifest["files"]} == {"a", "b"}
    assert publish.problems(spark, target).count() == 0 and publish.read_published(spark, target, "a").count() == 5
    with pytest.raises(FileExistsError):
        publish.publish(spark, target, {"a": spark.range(5)})
    assert [n for n in os.listdir(tmp_path) if "lock" in n] == [] and len(os.listdir(tmp_path)) == 1
    with pytest.raises(PySparkException):  # a part that fails leaves nothing
        publish.publish(spark, str(tmp_path / "two"), {"a": spark.range(3), "b": spark.range(1).select(F.raise_error(F.lit("no")))})
    assert os.listdir(tmp_path) == ["out"]
    (tmp_path / ".two.lock").write_text("")
    with pytest.raises(FileExistsError, match="another"):
        publish.publish(spark, str(tmp_path / "two"), {"a": spark.range(3)})
    os.remove(next((tmp_path / "out" / "a").glob("part-*")))
    assert {r.problem for r in publish.problems(spark, target).collect()} == {"missing"}
    with pytest.raises(ValueError, match="missing"):
        publish.read_published(spark, target, "a")
