from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import sessions as S
from ..operators import tables as T
from ..sources import writers
from ..sources.readers import html_blocks, html_text_closed
from .base import Registry, read, squeeze

Q = Registry()


@Q.add("SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, '' AS signer, array_to_string(string_split(lang || ',' || source, ','), ' | ') AS fields FROM documents")
def k04_csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("fields", F.array("lang", "source"))
    return writers.csv_columns(d, ["doc_id", "source", "signer", "fields"])


@Q.add("SELECT c_custkey, c_name, CASE WHEN c_nationkey < 10 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1 - s_suppkey, s_name, 'new' FROM supplier")
def k09_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    new = c.where("c_nationkey < 10").select("c_custkey", "c_name", F.lit("changed").alias("c_mktsegment"))
    more = read(spark, sf_dir, "supplier").select((F.lit(-1) - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("new").alias("c_mktsegment"))
    return T.upsert(c.select("c_custkey", "c_name", "c_mktsegment"), new.unionByName(more), ["c_custkey"])


@Q.add("SELECT count(*) FILTER (c_nationkey < 10)::BIGINT AS matched, count(*) FILTER (c_nationkey < 10 AND c_mktsegment <> 'BUILDING')::BIGINT AS modified, (SELECT count(*) FROM supplier)::BIGINT AS inserted FROM customer")
def k09_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    new = c.where("c_nationkey < 10").select("c_custkey", F.lit("BUILDING").alias("c_mktsegment"))
    more = read(spark, sf_dir, "supplier").select((F.lit(-1) - F.col("s_suppkey")).alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return T.upsert_counts(c.select("c_custkey", "c_mktsegment"), new.unionByName(more), ["c_custkey"])


@Q.add("SELECT doc_id, source, text FROM documents WHERE lang = 'en' AND source NOT IN (SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, source, upper(lang) FROM documents WHERE lang = 'de'")
def k13_replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return T.replace_groups(d.where("lang = 'en'").select("doc_id", "source", "text"), d.where("lang = 'de'").select("doc_id", "source", F.upper("lang").alias("text")), "source")


@Q.add("SELECT o_custkey AS l_partkey, min_by(o_totalprice, o_orderkey) AS l_orderkey, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def u03_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l_partkey"), F.col("o_totalprice").alias("l_orderkey"), F.col("o_orderkey").alias("seq"))  # noqa: E741
    return T.keep_first(l, ["l_partkey"], "seq")


@Q.add("SELECT 'c' AS corpus, c_custkey::VARCHAR AS id FROM customer UNION ALL SELECT 's', CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN 's:' || s_suppkey ELSE s_suppkey::VARCHAR END FROM supplier")
def u04_corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return T.merge_corpora([("c", c), ("s", s)], "id").select("corpus", "id")


@Q.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j16_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.resume(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@Q.add("SELECT c_custkey, c_name, count(*) OVER ()::BIGINT AS total, count(*) OVER () > 40 AS has_more FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') ORDER BY c_custkey LIMIT 20 OFFSET 20")
def f12_t10_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.search_documents(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "1", ("c_name",), c_mktsegment="BUILDING")
    return T.page(c.select("c_custkey", "c_name"), 2, 20, F.asc("c_custkey"))


@Q.add("""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS documents, count(*) FILTER (n > 0) AS chunked, count(*) FILTER (o_orderstatus = 'F') AS indexed, sum(coalesce(n, 0))::BIGINT AS chunks, max(o_orderdate) AS updated FROM orders LEFT JOIN c ON o_orderkey = l_orderkey
""")
def a10_corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = read(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return T.corpus_status(d, F.coalesce("n", F.lit(0)), F.col("o_orderstatus") == "F", "o_orderdate")


@Q.add("SELECT o_orderkey, CASE WHEN n > 0 AND o_orderstatus = 'F' THEN 'indexed' WHEN n > 0 THEN 'chunked' ELSE 'crawled' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def a20_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    d = read(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.select("o_orderkey", T.document_status(F.coalesce("n", F.lit(0)), F.col("o_orderstatus") == "F").alias("status"))


#: The tables' pages have four entities; the reader knows all of them.
ENTITIES = (("&copy;", "©"), ("&quot;", '"'), ("&middot;", "·"), ("&amp;", "&"))
PLAIN = "x"
for _name, _sign in ENTITIES:
    PLAIN = f"replace({PLAIN}, '{_name}', '{_sign}')"


@Q.add(f"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script\\s*>|<style[^>]*>.*?</style\\s*>|<noscript[^>]*>.*?</noscript\\s*>', chr(1), 'g') AS t FROM pages),
b AS (SELECT page_id, string_split(regexp_replace(t, '(?s)<!--.*?-->|<[!/]?[a-zA-Z][^>]*>', chr(1), 'g'), chr(1)) AS parts FROM a)
SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda x: {squeeze(PLAIN)}), lambda x: x <> ''), chr(10)) AS text FROM b
""")
def x20_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_text_closed(F.col("html")).alias("text"))


@Q.add()
def x21_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.posexplode(html_blocks(F.col("html"))).alias("block_idx", "b"))
    return p.select("page_id", "block_idx", F.col("b.class").alias("class"), F.col("b.text").alias("text"))


TITLE = f"CASE WHEN f IS NULL THEN '{S.UNTITLED}' WHEN length(f) > 60 THEN substring(f, 1, 60) || '...' ELSE f END"


@Q.add(f"SELECT conv_id AS session_id, {TITLE} AS title, n AS n_messages FROM (SELECT conv_id, min_by(t, turn) FILTER (role = 'user' AND t <> '') AS f, count(*)::INTEGER AS n FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id)")
def z01_session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_sessions(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("session_id", "title", "n_messages")


@Q.add(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id AS session_id, string_agg(role || ': ' || {squeeze('text')}, chr(10) ORDER BY turn) AS recent FROM r WHERE k <= 6 GROUP BY conv_id
""")
def z02_recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.fold_sessions(read(spark, sf_dir, "conversations"), "conv_id", "turn")
    return f.select("session_id", S.recent_text(F.col("history")).alias("recent"))


@Q.add("SELECT c_custkey AS session_id, c_nationkey < 5 AS pinned, c_acctbal AS updated_at FROM customer WHERE c_mktsegment <> 'MACHINERY' ORDER BY pinned DESC, updated_at DESC, session_id")
def t11_session_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_nationkey") < 5).alias("pinned"), F.col("c_acctbal").alias("updated_at"), (F.col("c_mktsegment") == "MACHINERY").alias("archived"))
    return S.sorted_sessions(S.visible(c)).drop("archived")


@Q.add("""
SELECT o_orderkey, CASE WHEN o_custkey % 10 <> o_orderkey % 10 THEN 'Answer cites a document not present in retrieved sources: ' || (o_orderkey % 10 + 1) || '/2001/nđ-cp' ELSE '' END AS warnings FROM orders
""")
def x29_citation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c, glue: F.concat((F.col(c) % 10 + 1).cast("string"), F.lit(f"{glue}2001{glue}NĐ-CP"))
    w = S.citation_warnings(F.concat(F.lit("xem "), number("o_orderkey", " / "), F.lit(" và 5/2001.")), F.array(number("o_custkey", "/")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(w, ",").alias("warnings"))


# --- graph ------------------------------------------------------------------


@Q.add("SELECT count(*) AS checks, count(*) FILTER (n > 0) AS found, count(*) FILTER (n = 0) AS missing FROM (SELECT label, relation, a, count(*) FILTER (hinted) AS n FROM (SELECT c.label, c.relation, c.a, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'promo') AS hinted FROM (SELECT n_name AS label, unnest([n_nationkey, n_nationkey + 26]) AS a, unnest(['preferred', 'distinguish']) AS relation FROM nation) c LEFT JOIN part ON p_size = a) GROUP BY ALL)")
def a17_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit_totals(G.audit(*_articles(spark, sf_dir)))


@Q.add("SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS part FROM orders GROUP BY o_custkey UNION ALL SELECT -1 - s_suppkey, 0 FROM supplier")
def g03_graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    c = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("part"), F.col("o_orderkey").alias("seq"))
    old = s.select((F.lit(-1) - F.col("s_suppkey")).alias("id"), F.lit(0.0).alias("part")).unionByName(c.select("id", F.lit(0.0).alias("part")).distinct())
    return G.upsert_nodes(old, c, ["id"], "seq")


def _articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("article_id"), F.col("p_size").cast("string").alias("article_number"), F.col("p_type").alias("document_title"), F.col("p_partkey").alias("chunk_id"))
    k = F.col("n_nationkey")
    i = read(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.array(k.cast("string")).alias("preferred_articles"), F.array((k + 26).cast("string")).alias("distinguish_from_articles"), F.array(F.lit("steel"), F.lit("promo")).alias("document_title_hints"))
    return i, p


EDGES = """
WITH a AS (SELECT p_partkey, p_size, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'promo') AS hinted FROM part),
pe AS (SELECT n_name AS label, p_partkey, 'PREFERRED_ARTICLE' AS relation FROM nation JOIN a ON p_size = n_nationkey WHERE hinted),
e AS (SELECT * FROM pe UNION ALL SELECT n_name, p_partkey, 'DISTINGUISH_FROM' FROM nation JOIN a ON p_size = n_nationkey + 26 WHERE hinted AND n_name IN (SELECT label FROM pe))
"""


@Q.add(EDGES + "SELECT label, p_partkey::VARCHAR AS article_id, relation FROM e")
def g04_issue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.issue_edges(*_articles(spark, sf_dir))


@Q.add(EDGES + """
SELECT n_name AS label, p_partkey AS chunk_id, relation FROM nation LEFT JOIN e ON n_name = e.label LEFT JOIN (SELECT p_partkey AS pk, p_size FROM part) ON pk = p_partkey
ORDER BY CASE relation WHEN 'PREFERRED_ARTICLE' THEN 0 WHEN 'DISTINGUISH_FROM' THEN 1 ELSE 2 END, n_nationkey NULLS LAST, p_size::VARCHAR NULLS LAST, p_partkey NULLS LAST LIMIT 8
""")
def g05_issue_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, articles = _articles(spark, sf_dir)
    wanted = read(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("position"))
    return G.expand_issues(wanted, G.issue_edges(issues, articles), articles).select("label", "chunk_id", "relation")


@Q.add("""
WITH c AS (SELECT l_orderkey AS d, l_linenumber AS n, l_partkey % 7 + 1 AS ref FROM lineitem)
SELECT DISTINCT a.d || ':' || a.n AS source, b.d || ':' || b.n AS target FROM c a JOIN c b ON a.d = b.d AND a.ref = b.n AND a.ref <> a.n
""")
def g06_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("xem Điều "), (F.col("l_partkey") % 7 + 1).cast("string"), F.lit(" và Điều "), n)
    c = read(spark, sf_dir, "lineitem").select(F.concat_ws(":", o, n).alias("article_id"), o.alias("doc_number"), n.alias("article_number"), text.alias("text"))
    return G.reference_edges(c)


@Q.add("""
WITH c AS (SELECT n_name AS label, unnest([n_nationkey, n_nationkey + 26]) AS a, unnest(['preferred', 'distinguish']) AS relation FROM nation),
j AS (SELECT label, relation, a, p_partkey, contains(lower(p_type), 'steel') OR contains(lower(p_type), 'promo') AS hinted FROM c LEFT JOIN part ON p_size = a)
SELECT label, relation, a::VARCHAR AS article, count(p_partkey) AS candidates, count(*) FILTER (hinted) AS matched FROM j GROUP BY ALL
""")
def g08_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.audit(*_articles(spark, sf_dir)).drop("examples")


@Q.add("""
SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2 FROM customer
""")
def x33_flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, key: str, prefix: str, parent: str | None, up: str, title: str) -> DataFrame:
        p = F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return read(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), p.alias("parent_id"), F.col(title).alias("title"))

    nodes = level("region", "r_regionkey", "r", None, "", "r_name").unionByName(level("nation", "n_nationkey", "n", "n_regionkey", "r", "n_name")).unionByName(level("customer", "c_custkey", "c", "c_nationkey", "n", "c_name"))
    return G.flatten_hierarchy(nodes).select("id", "parent_id", "depth")
