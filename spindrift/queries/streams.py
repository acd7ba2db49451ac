"""Streams, served lists and the small operators of a service, over the given tables."""

from __future__ import annotations

import json
import uuid

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import rules as RU
from ..operators import sessions as S
from ..operators import uploads as U
from ..operators import vectors as V
from ..sources import writers as W
from ..stores import Table, home
from ..streaming import ingest
from ..streaming import uploads as SU
from .base import Registry, read
from .chunking import ITEMS, items

Q = Registry()

#: Fixed values of these queries: events as states of uploads.
KINDS = {"view": "ready", "signup": "processing", "click": "ocr_complete", "error": "failed", "purchase": "ready"}
MAY = " OR ".join(f"a = '{k}' AND x IN ({', '.join(repr(v) for v in vs)})" for k, vs in U.STATES.items())
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


@Q.add(f"""
WITH e AS (SELECT user_id, list({KIND_SQL} ORDER BY event_id) AS s, max(event_id) AS seq FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS id, list_reduce(list_concat(['processing'], s), lambda a, x: CASE WHEN {MAY} THEN x ELSE a END) AS status, seq FROM e
""")
def z06_upload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as those of an upload, through a stream that keeps its
    state; the last state that it gives (Z06)."""
    path, kind = f"{home(spark)}/states-{uuid.uuid4().hex}", read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    status = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    events = stream.select(F.col("user_id").alias("id"), status.alias("status"), F.col("event_id").alias("seq"), F.lit(0).alias("progress"), F.col("props").alias("error"), F.col("ts").alias("at"))
    before = spark.conf.get(SU.PROVIDER[0], None)
    spark.conf.set(*SU.PROVIDER)
    try:
        put = lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{path}/out")
        made = SU.states(events, stalled=10**15).writeStream.outputMode("update").foreachBatch(put)
        made.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(SU.PROVIDER[0], before) if before else spark.conf.unset(SU.PROVIDER[0])
    out = spark.read.schema(f"{SU.OUT}, n int").parquet(f"{path}/out")
    return out.groupBy("id").agg(F.max_by("status", F.struct("n", "seq")).alias("status"), F.max("seq").alias("seq"))


def served(page: int, size: int, path: str) -> dict:
    """A page of a table, as a service would give it."""
    rows = pq.read_table(path, columns=["page_id", "url"]).sort_by("page_id")
    return {"items": [{"id": r["page_id"], "url": r["url"]} for r in rows.slice(page * size, size).to_pylist()], "total": rows.num_rows}


def served_detail(page_id: str) -> dict:
    return {"title": f"page {page_id}"}


@Q.add("SELECT page_id::VARCHAR AS id, min(url) AS url, 'page ' || page_id AS title FROM pages GROUP BY page_id")
def z07_paged_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, served in pages of 50, as a stream with offsets, with the detail of each,
    into a table with versions (S06, S07, Z07)."""
    root = f"{home(spark)}/crawl-{uuid.uuid4().hex}"
    table = Table(spark, root, "pages", "id string, item string, detail string, batch long")
    options = {"fetch": f"{__name__}:served", "size": "50", "filters": json.dumps({"path": f"{sf_dir}/pages.parquet"})}
    ingest.crawl(spark, options, table, f"{root}/checkpoint", fetch=f"{__name__}:served_detail").awaitTermination()
    return table.read().select("id", F.get_json_object("item", "$.url").alias("url"), F.get_json_object("detail", "$.title").alias("title"))


@Q.add(f"""
WITH {ITEMS} SELECT l_orderkey || ':article:' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS chunk_id, l_linenumber::VARCHAR AS article_number, 'Tên ' || l_partkey AS article_title,
  'Điều ' || l_linenumber || '. Tên ' || l_partkey || chr(10) || '1. khoản ' || l_partkey || chr(10) || 'dòng' AS text FROM items
""")
def c09_upload_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with a title and articles that fit a chunk each."""
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so many as they are: little is shuffled for what texts cost
    body = items(spark, sf_dir, dealt, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))

    def line(r: Column) -> Column:
        n, p = r["l_linenumber"].cast("string"), r["l_partkey"].cast("string")
        return F.concat(F.lit("Điều "), n, F.lit(". Tên "), p, F.lit("\n1. khoản "), p, F.lit("\n\n  dòng "))

    text = F.concat(F.lit("LUẬT ĐẤT ĐAI\n"), F.array_join(F.transform("x", line), "\n"))
    up = body.select(F.col("l_orderkey").cast("string").alias("upload_id"), F.lit("f.txt").alias("file_name"), text.alias("text"), F.lit("public").alias("workspace"), F.lit(1.0).alias("confidence"))
    return U.chunks(up).select("chunk_id", "article_number", "article_title", "text")


@Q.add("""
SELECT conv_id, turn, trim(coalesce(text, '')) AS case_summary, 'turn=' || turn AS facts, turn % 2 = 0 AS need_clarification, 'a' || conv_id AS missing, CASE WHEN turn % 3 = 0 THEN 'why?' ELSE '' END AS follow_up FROM conversations
""")
def z03_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's JSON, with words around it, says of a case."""
    n = F.col("turn")
    account = F.to_json(F.struct(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("case_summary"), F.create_map(F.lit("turn"), n.cast("string")).alias("facts"), (n % 2 == 0).alias("need_clarification"), F.array(F.concat(F.lit("a"), F.col("conv_id").cast("string")), F.lit(" ")).alias("missing_fields"), F.when(n % 3 == 0, "why?").alias("follow_up_question")))
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", S.memory(F.concat(F.lit("So: "), account, F.lit(" end"))).alias("m"))
    facts = F.array_join(F.transform(F.map_entries("m.facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("conv_id", "turn", "m.case_summary", facts.alias("facts"), "m.need_clarification", F.array_join("m.missing_fields", ",").alias("missing"), F.col("m.follow_up_question").alias("follow_up"))


@Q.add("""
SELECT p_partkey, p_brand AS label, p_type AS issue_type, p_size::VARCHAR AS preferred, CASE WHEN p_partkey % 2 = 0 THEN 'd' || p_size ELSE 'x' || p_size END AS distinguish, round(p_retailprice / 7, 6) AS score FROM part
""")
def p15_match_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as matches; articles to avoid stand in for those to distinguish."""
    size = F.col("p_size").cast("string")
    arr = lambda *c: F.array(*c)
    rule = {"label": F.concat(F.lit(" "), F.col("p_brand")), "issue_type": F.col("p_type"), "display_name": F.col("p_name"), "issue_type_name": F.lit(None).cast("string"), "description": F.lit(" d "), "retrieval_queries": arr(F.lit(" "), F.col("p_name")), "semantic_queries": arr(F.col("p_name")), "preferred_articles": arr(F.concat(size, F.lit(" ")), F.lit("")), "distinguish_from_articles": arr(F.concat(F.lit("d"), size)), "avoid_articles": arr(F.concat(F.lit("x"), size)), "document_title_hints": arr(F.lit("h"))}
    m = RU.match_payload(rule, F.col("p_partkey") % 2 == 0, F.lit(0.9), F.lit("semantic"), F.col("p_retailprice") / 7, F.lit(""))
    x = read(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return x.select("p_partkey", "m.label", "m.issue_type", F.array_join("m.preferred_articles", ",").alias("preferred"), F.array_join("m.distinguish_from_articles", ",").alias("distinguish"), F.col("m.semantic_score").alias("score"))


@Q.add("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) > 1")
def g01_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return K.duplicates(read(spark, sf_dir, "documents"), "source", "lang")


@Q.add("""
WITH f AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '' END AS path, p_size * 100 AS length FROM part)
SELECT p_partkey, path FROM f WHERE p_partkey % 4 < 2 AND length <= 2500
""")
def f17_allowed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of kinds that can be taken up, of a bounded length."""
    k = F.col("p_partkey") % 4
    path = F.concat("p_name", F.when(k == 0, ".PDF").when(k == 1, ".docx").when(k == 2, ".exe").otherwise(""))
    files = read(spark, sf_dir, "part").select("p_partkey", path.alias("path"), (F.col("p_size") * 100).alias("length"))
    return K.scannable(U.allowed(files), 2500).select("p_partkey", "path")


@Q.add("""
SELECT DISTINCT 'u/' || s_nationkey || '/chunks.jsonl' AS item, 'chunks' AS kind FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT DISTINCT 'u/' || s_nationkey || '/embeddings/' || k, 'folder' FROM supplier, (SELECT unnest(['api', 'local']) AS k) WHERE s_suppkey % 2 = 0 AND s_nationkey % 3 = 0 AND (k = 'local' OR s_nationkey % 2 = 0)
""")
def f13_private_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk tables and usable vector folders of private uploads, each once."""
    n = F.col("s_nationkey")
    path = F.concat(F.lit("u/"), n.cast("string"))
    up = read(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "private").otherwise("public").alias("workspace"), F.concat(path, F.lit("/chunks.json")).alias("chunks_path"), F.lit("").alias("api_index"), F.lit(None).cast("string").alias("local_index"))
    every = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("u/"), F.col("n_nationkey").cast("string"), F.lit("/embeddings/")).alias("base"))
    manifests = every.select(F.concat("base", F.lit("api")).alias("folder"), (F.col("k") % 3 == 0).alias("built"), F.when(F.col("k") % 2 == 0, "Hash").otherwise("openai").alias("provider"))
    manifests = manifests.unionByName(every.select(F.concat("base", F.lit("local")).alias("folder"), (F.col("k") % 3 == 0).alias("built"), F.lit("hash").alias("provider")))
    chunks, folders = K.private_sources(up, manifests, "hash")
    return chunks.select(F.col("chunks").alias("item"), F.lit("chunks").alias("kind")).unionByName(folders.select(F.col("folder").alias("item"), F.lit("folder").alias("kind")))


@Q.add("SELECT n_regionkey AS region, count(*) AS manifests, count(DISTINCT n_name[1]) <= 1 AND count(DISTINCT n_nationkey % 2) <= 1 AS compatible FROM nation WHERE n_regionkey = 0 GROUP BY n_regionkey UNION ALL SELECT 9, count(*), true FROM region")
def u05_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether provider, model and dimension of vector tables agree."""
    n = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.substring("n_name", 1, 1).alias("provider"), (F.col("n_nationkey") % 2).alias("model"), F.lit(64).alias("dimension"))
    r = read(spark, sf_dir, "region").select(F.lit("hash").alias("provider"), F.lit(None).cast("string").alias("model"), F.lit(64).alias("dimension"))
    return V.check_manifests(n).select(F.lit(0).alias("region"), "*").unionByName(V.check_manifests(r).select(F.lit(9).alias("region"), "*"))


@Q.add("""
WITH a AS (SELECT conv_id * 1000 + turn AS query, string_split(coalesce(text, ''), ' ') AS d, CASE WHEN turn % 3 = 0 THEN 'away' END AS e FROM conversations WHERE role = 'assistant'),
x AS (SELECT query, list_concat(list_transform(d, lambda w: '{"type":"answer_delta","delta":' || to_json(w) || '}'), [CASE WHEN e IS NULL THEN '{"type":"final","data":{"words":' || len(d) || '}}' ELSE '{"type":"error","error":"away"}' END]) AS v FROM a)
SELECT query, unnest(range(len(v)))::INTEGER AS seq, unnest(v) AS event FROM x
""")
def k17_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as events, a word at a time, then their data or an error."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    a = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), words.alias("w"), F.when(F.col("turn") % 3 == 0, "away").alias("e"))
    return W.answer_events(a, F.col("w"), F.struct(F.size("w").alias("words")), F.col("e"))


@Q.add("""
WITH n AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS a, -1 AS b, -1 AS c, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, n_nationkey, -1, 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, n_regionkey, n_nationkey, c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, depth, row_number() OVER (ORDER BY a, b, c) AS place FROM n
""")
def x33_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one tree, in pre-order."""
    from pyspark.sql import Window

    from ..operators import graph as G

    node = lambda t, i, k, up, p: read(spark, sf_dir, t).select(F.concat(F.lit(i), F.col(k).cast("string")).alias("id"), (F.concat(F.lit(up), F.col(p).cast("string")) if p else F.lit(None).cast("string")).alias("parent_id"), F.lit("t").alias("title"), F.col(k).cast("long").alias("k"))
    nodes = node("region", "r", "r_regionkey", "", None).unionByName(node("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(node("customer", "c", "c_custkey", "n", "c_nationkey"))
    tree = G.flatten_hierarchy(nodes, "k")
    root = F.col("path")[0]["at"]
    sizes = tree.groupBy(root.alias("root")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a few roots
    inside = tree.withColumn("root", root).withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("path")))
    return inside.join(F.broadcast(before), "root").select("id", "depth", (F.col("before") + F.col("i")).alias("place"))
