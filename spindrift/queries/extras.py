"""What Spark has built in and the engine puts to use: named x_."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stores import home
from ..streaming.events import windowed
from .base import Registry, read

Q = Registry()


@Q.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def x_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@Q.add("SELECT 'common' AS kind, n_nationkey AS k FROM (SELECT c_nationkey AS n_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def x_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).select(F.lit("common").alias("kind"), "k").unionByName(c.exceptAll(s).distinct().join(s, "k", "left_anti").select(F.lit("customers").alias("kind"), "k"))


@Q.add("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders")
def x_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("moving"), F.rank().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@Q.add("""
SELECT e.event_id, max(p.event_id) AS before FROM events e LEFT JOIN LATERAL (SELECT event_id FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'purchase' AND (v.ts, v.event_id) < (e.ts, e.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) p ON true GROUP BY e.event_id
""")
def x_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the same user before each event: an as-of join of a table
    with itself is a window, without any join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("before"))


@Q.add("SELECT c_custkey, true AS ordered FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def x_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("ordered", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@Q.add("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def x_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@Q.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@Q.add(Q.sql["x_tumbling_windows"])
def x_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream that takes up what is there and ends."""
    path = f"{home(spark)}/windows-{uuid.uuid4().hex}"
    kind = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
    windowed(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
