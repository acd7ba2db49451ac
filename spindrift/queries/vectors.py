from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import rules as RU
from ..operators import vectors as VO
from .base import Registry, read, toks

Q = Registry()

EMBED = f"""
SELECT id, list(v ORDER BY b) AS e FROM (
  SELECT i.id, b.b, coalesce(n, 0) / sqrt(ss)::DOUBLE AS v
  FROM (SELECT id, sum(n * n) AS ss FROM c GROUP BY id) i CROSS JOIN (SELECT unnest(range(64))::INTEGER AS b) b LEFT JOIN c ON c.id = i.id AND c.b = b.b) GROUP BY id
"""


@Q.add(f"""
WITH c AS (SELECT id, b, count(*) AS n FROM (SELECT doc_id AS id, ('0x' || substring(md5(t), 1, 4))::INTEGER % 64 AS b FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents)) GROUP BY ALL),
s AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS l FROM c GROUP BY id)
SELECT c.id, c.b AS bucket, round(c.n / s.l, 6) AS weight FROM c JOIN s USING (id)
""")
def v01_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = VO.hash_embed(read(spark, sf_dir, "documents"), "doc_id", X.tokens(F.col("text")))
    return e.select("id", F.posexplode("embedding").alias("bucket", "w")).where("w <> 0").select("id", "bucket", F.round("w", 6).alias("weight"))


@Q.add("""
SELECT vec_id, i AS place, round(embedding[i + 1]::DOUBLE / n, 6) AS value
FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, unnest(range(64))::INTEGER AS i FROM embeddings)
""")
def v02_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("place", "v"))
    return e.select("vec_id", "place", F.round("v", 6).alias("value"))


@Q.add("""
SELECT a.vec_id, round(list_sum([a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE FOR i IN range(1, 65)])
  / sqrt(list_sum([a.embedding[i]::DOUBLE * a.embedding[i]::DOUBLE FOR i IN range(1, 65)])) / sqrt(list_sum([b.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE FOR i IN range(1, 65)])), 5) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def v03_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


@Q.add("""
WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_sum([q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE FOR i IN range(1, 65)]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
SELECT query, rank::INTEGER AS rank, id, score FROM r WHERE rank <= 10
""")
def v04_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return VO.top_k(e, q, 10)


@Q.add("SELECT label, corpus, id FROM (SELECT label, 'a' AS corpus, vec_id::VARCHAR AS id FROM embeddings UNION ALL SELECT label, 'b', 'b:' || vec_id FROM embeddings)")
def v08_merge_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    m = VO.merge_indexes([("a", e), ("b", e)])
    labels = e.select(F.col("id").cast("string").alias("own"), "label")
    return m.join(labels, F.substring_index("id", ":", -1) == F.col("own")).select("label", "corpus", "id")


RULES = """
WITH c AS (SELECT label, i, avg(x::DOUBLE) AS v FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i),
e AS (SELECT label, list(v ORDER BY i) AS ev FROM c GROUP BY label),
s AS (SELECT q.vec_id AS query, e.label::VARCHAR AS label, round(list_sum([q.embedding[i]::DOUBLE * ev[i] FOR i IN range(1, 65)])
   / sqrt(list_sum([q.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE FOR i IN range(1, 65)])) / sqrt(list_sum([ev[i] * ev[i] FOR i IN range(1, 65)])), 6) AS score FROM embeddings q CROSS JOIN e),
m AS (SELECT query, label, round(score, 4) AS score, round(least(0.99E0, greatest(0.5E0 + label::INTEGER / 25.0E0, score)), 4) AS confidence FROM s WHERE score >= 0.3E0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rank FROM m)
"""


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    entries = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(F.col("label").cast("string").alias("label"), F.transform("s", lambda x: x["v"]).alias("embedding"))
    rules = entries.select("label", (F.col("label").cast("int") / 25.0 + 0.5).alias("confidence"))
    return e.select(F.col("vec_id").alias("query"), "embedding"), entries, rules


@Q.add(RULES + "SELECT query, rank::INTEGER AS rank, label, score, confidence FROM k WHERE rank <= 3")
def r16_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, entries, rules = _rules(spark, sf_dir)
    m = RU.match(q, entries, rules, 0.3).withColumns({"score": F.round("score", 4), "confidence": F.round("confidence", 4)})
    return m


@Q.add(RULES + """
, b AS (SELECT *, max(confidence) OVER (PARTITION BY query) AS best FROM k WHERE rank <= 3)
SELECT query, rank::INTEGER AS rank, label, score, confidence FROM b WHERE best < 0.7E0 OR confidence >= greatest(0.3E0, round(best - 0.08E0, 6))
""")
def f10_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.prune(r16_rule_match(spark, sf_dir), 0.7, 0.3, 0.08)
