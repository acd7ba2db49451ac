from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from .base import Registry, read, squeeze

Q = Registry()

LINES = f"lines AS (SELECT doc_id AS doc, i AS seq, {squeeze('l[i + 1]')} AS text FROM (SELECT doc_id, l, unnest(range(len(l)))::INTEGER AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text")).withColumn("text", X.squeeze(F.col("text")))


@Q.add(f"WITH {LINES}, b AS (SELECT *, lag(text) OVER (PARTITION BY doc ORDER BY seq) AS p FROM lines WHERE text <> '') SELECT doc, seq, text FROM b WHERE text IS DISTINCT FROM p")
def f02_consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_repeated_blocks(lines(spark, sf_dir))


@Q.add(f"WITH {LINES} SELECT doc, seq, last_value(CASE WHEN length(text) < 40 THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS heading FROM lines")
def w02_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.carry_headings(lines(spark, sf_dir), {"heading": F.length("text") < 40}).select("doc", "seq", "heading")


#: Line numbers repeat in some orders: the smallest part of each stands for it.
ITEMS = "items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"
ORDERS = ITEMS + """, blocks AS (SELECT l_orderkey AS doc, l_linenumber * 2 AS seq, CASE WHEN l_linenumber % 3 = 1 THEN 'Article ' || l_linenumber || 'a about ' || l_returnflag ELSE 'line ' || l_partkey END AS text FROM items
  UNION ALL SELECT o_orderkey, 1, 'Part ' || o_orderpriority FROM orders)"""


def items(spark: SparkSession, sf_dir: str, *dealt: int | str) -> DataFrame:
    """dealt: into how many parts and by which of the key rows are dealt, once for this and
    for what follows."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return (l.repartition(*dealt) if dealt else l).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = items(spark, sf_dir)  # noqa: E741
    n = F.col("l_linenumber")
    text = F.when(n % 3 == 1, F.concat(F.lit("Article "), n.cast("string"), F.lit("a about "), F.col("l_returnflag"))).otherwise(F.concat(F.lit("line "), F.col("l_partkey").cast("string")))
    a = l.select(F.col("l_orderkey").alias("doc"), (n * 2).alias("seq"), text.alias("text"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("seq"), F.concat(F.lit("Part "), F.col("o_orderpriority")).alias("text"))
    return a.unionByName(o)


@Q.add(f"""
WITH {ORDERS}, b AS (SELECT *, lag(text) OVER w AS p FROM blocks WINDOW w AS (PARTITION BY doc ORDER BY seq)), k AS (SELECT * FROM b WHERE text IS DISTINCT FROM p),
s AS (SELECT *, last_value(CASE WHEN text LIKE 'Part %' THEN text END IGNORE NULLS) OVER w AS part, sum(CASE WHEN text LIKE 'Article %' THEN 1 ELSE 0 END) OVER w AS segment FROM k WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, max(segment) OVER (PARTITION BY doc) AS m FROM s), f AS (SELECT * FROM a WHERE (segment > 0 OR m = 0) AND (text NOT LIKE 'Part %' OR m = 0))
SELECT doc, segment::BIGINT AS segment, nullif(regexp_extract(arg_min(text, seq), '^Article (\\d+a)', 1), '') AS article_number, arg_min(part, seq) AS part, string_agg(text, chr(10) ORDER BY seq) AS text FROM f GROUP BY doc, segment
""")
def c01_article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"part": F.col("text").startswith("Part ")}
    return C.article_chunks(order_blocks(spark, sf_dir), kinds).select("doc", "segment", "article_number", "part", "text")


@Q.add(f"""
WITH {ITEMS}, c AS (SELECT o_orderkey AS id, 'Article 5 on ' || o_orderstatus AS head FROM orders), l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey FROM items)
SELECT id AS chunk_id, CASE WHEN n % 2 = 1 THEN n::VARCHAR END AS number, head || chr(10) || t AS text
FROM (SELECT id, g, min(n) AS n, string_agg(CASE WHEN n % 2 = 1 THEN n || '. part ' || l_partkey ELSE 'more ' || l_partkey END, chr(10) ORDER BY n) AS t FROM (SELECT *, sum(n % 2) OVER (PARTITION BY id ORDER BY n) AS g FROM l) GROUP BY id, g) JOIN c USING (id)
""")
def w04_clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    line = F.when(n % 2 == 1, F.concat(n.cast("string"), F.lit(". part "), p)).otherwise(F.concat(F.lit("more "), p))
    body = items(spark, sf_dir).select("l_orderkey", n.alias("n"), line.alias("line")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    o = read(spark, sf_dir, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat_ws("\n", F.concat(F.lit("Article 5 on "), F.col("o_orderstatus")), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    return C.clause_parts(o.select(F.col("o_orderkey").alias("chunk_id"), text.alias("text"))).select("chunk_id", "number", "text")


@Q.add("WITH n AS (SELECT event_id, user_id::VARCHAR || ':' || event_type AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT event_id AS seq, c || CASE WHEN k > 1 THEN ':dup:' || k ELSE '' END AS chunk_id FROM n")
def w05_dup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("chunk_id"))
    return C.unique_ids(e)


@Q.add("""
WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(0, ceil((length(text) - 1000) / 800.0E0)::INTEGER) AS last FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, unnest(range(last + 1)) AS i FROM d), t AS (SELECT doc_id, i, trim(substring(text, (i * 800 + 1)::INTEGER, 1000)) AS part FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS part_index, part FROM t WHERE part <> ''
""")
def c05_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.sliding_windows(F.col("text"), 1000, 200)).alias("part_index", "part"))


@Q.add()
def c05_overlap_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "source")
    return C.split(d, C.Sizes(1500, 150, 120, 1200)).select("chunk_id", "parent_chunk_id", "part_index", "part_count", "fallback_split", "text")


@Q.add()
def c06_short_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.regexp_replace("text", r"\n", "\n1. ").alias("text"))
    cut = C.split(d, C.Sizes(800, 80, 120, 700)).where(F.size("merged_chunk_ids") > 0)
    return cut.select("chunk_id", "parent_chunk_id", F.array_join("merged_chunk_ids", ",").alias("merged"), F.length("text").alias("text_length"))


@Q.add()
def c08_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.sliding_windows(F.col("text"), 2000, 0)).alias("k", "text"))
    parts = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(":part:"), (F.col("k") + 1).cast("string")).alias("chunk_id"), (F.col("doc_id") * 100000 + F.col("k")).alias("seq"), "text")
    whole = C.split(C.merge_parts(parts), C.Sizes())
    return C.quality_report(whole)


@Q.add("""
SELECT count(*) AS chunks, count(*) - count(DISTINCT source) AS duplicate_ids, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(text) < 50) AS short, count(*) FILTER (length(text) > 3500) AS long, max(length(text)) AS longest FROM documents
""")
def a09_chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quality_report(read(spark, sf_dir, "documents"), id_col="source")


@Q.add(f"WITH {ITEMS} SELECT l_orderkey::VARCHAR AS chunk_id, min(l_linenumber) AS seq, string_agg('p' || l_partkey, chr(10) ORDER BY l_linenumber) AS text FROM items GROUP BY l_orderkey")
def a23_merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    parts = items(spark, sf_dir).select(F.concat(F.col("l_orderkey").cast("string"), F.lit(":part:"), n.cast("string")).alias("chunk_id"), n.alias("seq"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))
    return C.merge_parts(parts)
