"""Streams: pages taken up once whatever happens, pushed filters, states of uploads."""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spindrift import stores
from spindrift.operators import uploads as U
from spindrift.sources.readers import PagedSource
from spindrift.streaming import ingest
from spindrift.streaming import uploads as SU


def serve(page, size, where, kinds=None):
    """A list that grows in a file; calls are noted beside it."""
    rows = [r for r in json.loads(Path(where).read_text()) if kinds is None or r["kind"] in kinds]
    with open(f"{where}.calls", "a") as f:
        f.write(f"{page} {kinds}\n")
    return {"items": rows[page * size : (page + 1) * size], "total": len(rows)}


def broken(i):
    if Path("/tmp").joinpath(f"spindrift-broken-{i}").exists():
        raise OSError("away")
    return {"of": str(i)}


def put(path, n):
    path.write_text(json.dumps([{"id": f"k{k}", "kind": "ab"[k % 2], "n": k} for k in range(n)]))


def options(path, **more):
    return {"fetch": f"{__name__}:serve", "size": "4", "filters": json.dumps({"where": str(path)}), **more}


def test_a_list_is_taken_up_once(spark, tmp_path):
    path = tmp_path / "list.json"
    table = stores.Table(spark, str(tmp_path / "root"), "crawled", "id string, item string, detail string, batch long")
    run = lambda: ingest.crawl(spark, options(path), table, str(tmp_path / "checkpoint"), fetch=f"{__name__}:broken").awaitTermination()
    ids = lambda: sorted(r.id for r in table.read().collect())
    put(path, 6)
    run()
    assert ids() == sorted(f"k{k}" for k in range(6)) and {json.loads(r.detail)["of"] for r in table.read().collect()} == {f"k{k}" for k in range(6)}
    run()  # nothing new
    assert len(ids()) == 6
    put(path, 11)  # the second page was read in part
    away = Path("/tmp/spindrift-broken-k9")
    away.touch()
    try:
        with pytest.raises(Exception, match="away"):
            run()
    finally:
        away.unlink()
    assert len(ids()) == 6
    run()  # goes on from the checkpoint
    assert ids() == sorted(f"k{k}" for k in range(11))
    table.replace(table.read().where("batch < 1"))  # as if the batch's rows were lost after it
    assert len(ids()) == 6


def test_filters_are_pushed(spark, tmp_path):
    path = tmp_path / "list.json"
    put(path, 10)
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        given = options(path, columns="id string, kind string, n long", pushed='{"kind": "kinds"}')
        rows = spark.read.format("paged").options(**given).load().where("kind = 'b' AND n > 3").select("id", "n").collect()
        assert sorted(r.n for r in rows) == [5, 7, 9]
        assert {x.partition(" ")[2] for x in Path(f"{path}.calls").read_text().splitlines()} == {"['b']"}
        assert spark.read.format("paged").options(**given).load().where("kind IN ('a', 'b')").count() == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    plain = spark.read.format("paged").options(**options(path)).load()
    assert plain.columns == ["page", "item"] and plain.count() == 10


@pytest.fixture
def rocks(spark):
    spark.conf.set(*SU.PROVIDER)
    yield
    spark.conf.unset(SU.PROVIDER[0])


EVENT = "id string, status string, seq long, progress int, error string, at timestamp"


def minute(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=n)


def run(spark, src, out, checkpoint, **more):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    put = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)
    q = SU.states(stream, **more).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def test_states_as_the_batch_fold(spark, rocks, tmp_path):
    every = [(f"u{k % 7}", ["ocr_complete", "failed", "ready", "processing"][(k * k + k // 3) % 4], k, k, f"e{k}" if k % 3 == 0 else None, minute(k)) for k in range(60)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(2):  # two batches, one after the other
        spark.createDataFrame(every[n * 30 : n * 30 + 30], EVENT).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    run(spark, src, out, str(tmp_path / "c"), late="1 day", stalled=10**12)
    last = {r.id: (r.status, r.progress, r.error) for r in spark.read.schema(SU.OUT + ", n int").parquet(out).orderBy("n").collect()}
    start = spark.createDataFrame([(f"u{k}", "processing", 0, None) for k in range(7)], "id string, status string, progress int, error string")
    want = {r.id: (r.status, r.progress, r.error) for r in U.advanced(start, spark.createDataFrame(every, EVENT)).collect()}
    assert last == want


def test_a_stalled_upload_fails(spark, rocks, tmp_path):
    """By a timer, in a later batch; not if it has gone on before."""
    src, out, c = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    add = lambda *rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
    add(("slow", "processing", 1, 1, None, minute(0)), ("fast", "processing", 1, 1, None, minute(0)))
    run(spark, src, out, c, late="1 minute")
    add(("fast", "ocr_complete", 2, 100, None, minute(30)))
    run(spark, src, out, c, late="1 minute")
    add(("other", "failed", 1, 0, "x", minute(120)))
    run(spark, src, out, c, late="1 minute")
    rows = {(r.id, r.status, r.error) for r in spark.read.parquet(out).collect()}
    assert ("slow", "failed", "stalled") in rows and not any(i == "fast" and s == "failed" for i, s, _ in rows)
