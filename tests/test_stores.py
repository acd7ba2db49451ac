"""Durable tables: versions, conflicts, failures between two steps, readers that are open."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spindrift import stores
from spindrift.operators.chunking import unique_ids
from spindrift.sources import writers
from spindrift.streaming import ingest


def values(df):
    return sorted(r.v for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return stores.Table(spark, str(tmp_path / "root"), "t", "v long")


def rows(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


def test_versions(spark, table):
    assert table.version() == 0 and values(table.read()) == []
    assert table.replace(rows(spark, 1)) == 1
    before = table.read()
    assert table.append(rows(spark, 2, 3)) == 2
    assert table.replace(table.read().where("v > 1")) == 3  # a job reads what it replaces
    assert values(table.read()) == [2, 3] and values(before) == [1] and values(table.read(2)) == [1, 2, 3]
    table.vacuum(1)
    assert values(table.read()) == [2, 3] and table.version() == 3
    with pytest.raises(Exception, match="(?i)does not exist|not.found"):
        before.collect()


def test_conflicts_lose_nothing(spark, table):
    n = table.replace(rows(spark, 1))
    mine = table.read().unionByName(rows(spark, 2))
    table.append(rows(spark, 3))  # another writer
    with pytest.raises(stores.Conflict):
        table.replace(mine, n)
    assert values(table.read()) == [1, 3]


def test_a_failed_job_changes_nothing(spark, table, monkeypatch):
    table.replace(rows(spark, 1))
    bad = rows(spark, 1, 2).select(F.when(F.col("v") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        table.replace(bad)
    assert values(table.read()) == [1] and table.version() == 1
    # a crash after the rows are written and before the version is
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.append(rows(spark, 9))
    monkeypatch.undo()
    assert values(table.read()) == [1] and table.append(rows(spark, 4)) == 2 and values(table.read()) == [1, 4]


def test_many_appends_become_one(spark, table, monkeypatch):
    monkeypatch.setattr(stores.Table, "PARTS", 3)
    for k in range(5):
        table.append(rows(spark, k))
    assert values(table.read()) == list(range(5)) and len(table._parts(table.version())) <= 3


def test_small_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.txt")
    stores.write_text(spark, path, "one")
    stores.write_text(spark, path, "two")
    assert stores.read_text(spark, path) == "two" and [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["a.txt"]
    monkeypatch.setattr(stores, "_put", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        stores.write_text(spark, path, "three")
    assert stores.read_text(spark, path) == "two"


def test_json_overwrite(spark, tmp_path):
    path = str(tmp_path / "j")
    writers.write_json(rows(spark, 1, 2), path)
    bad = rows(spark, 3).select(F.raise_error(F.lit("broken")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        writers.write_json(bad, path)
    assert values(spark.read.json(path)) == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["j"]
    writers.write_json(spark.read.schema("v long").json(path).where("v = 2"), path)  # reads what it overwrites
    assert values(spark.read.json(path)) == [2]


def test_signature(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    rows(spark, *range(20)).repartition(4).write.parquet(path)
    one = stores.signature(spark.read.parquet(path), "x")
    assert one == stores.signature(spark.read.parquet(path), "x") != stores.signature(spark.read.parquet(path), "y")
    monkeypatch.setattr(stores, "NAMED", 2)  # as of many files
    many = stores.signature(spark.read.parquet(path), "x")
    assert many == one
    rows(spark, 1).write.mode("append").parquet(path)
    assert stores.signature(spark.read.parquet(path), "x") != many
    assert stores.signature(rows(spark, 1)) != stores.signature(rows(spark, 1))


def test_sources_that_become_empty(spark, tmp_path):
    table = str(tmp_path / "t")
    files = lambda *f: spark.createDataFrame(f, "source_file string, text string")
    put = lambda f: ingest.replace_sources(spark, table, ingest.chunk_batch(f), f.select("source_file"))
    put(files(("f1", "first text"), ("f2", "second text")))
    put(files(("f1", ""), ("f3", "third")))
    put(files(("f1", "")))
    assert sorted((r.source_file, r.text) for r in spark.read.parquet(table).collect()) == [("f2", "second text"), ("f3", "third")]


def test_ids_until_none_collides(spark):
    given = ["a", "a", "a:dup:2", "a:dup:2:dup:2", "a", "b"]
    df = spark.createDataFrame(list(enumerate(given)), "seq long, chunk_id string")
    out = [r.chunk_id for r in unique_ids(df).orderBy("seq").collect()]
    assert len(set(out)) == len(out) and out[0] == "a" and out[5] == "b" and all(o.startswith(g) for o, g in zip(out, given))
    assert json.dumps(out)
