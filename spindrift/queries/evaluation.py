from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .base import Registry, fold_eval, read
from .lexical import BM25, planted, r01_bm25_topk

Q = Registry()

#: Every benchmark passage is a case; the documents that hold it are expected.
CASES = f"WITH bm AS ({BM25}10), ex AS (SELECT b.item_id AS query, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query, count(*) AS n FROM ex GROUP BY query), hit AS (SELECT bm.*, ex.doc IS NOT NULL AS hit FROM bm LEFT JOIN ex USING (query, doc) WHERE query IN (SELECT query FROM n))"


def cases_and_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = planted(b, read(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.lit(None).cast("string")
    e = F.struct(none.alias("title_contains"), none.alias("source_contains"), F.col("doc_id").cast("string").alias("article_number"), none.alias("clause_number"))
    cases = found.groupBy(F.col("item_id").alias("case_id")).agg(F.array_sort(F.collect_list(e)).alias("expected"))
    r = r01_bm25_topk(spark, sf_dir)
    results = r.select(F.col("query").alias("case_id"), "rank", F.lit("").alias("title"), F.lit("").alias("source"), F.col("doc").cast("string").alias("article_number"), none.alias("clause_number"))
    return cases, results


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.retrieval_metrics(*cases_and_results(spark, sf_dir))


def _at(k: int, name: str) -> str:
    top = f"count(*) FILTER (hit AND rank <= {k})"
    value = f"round({top} / greatest(1, least({k}, count(rank)))::DOUBLE, 3)" if name == "precision" else f"round({top} / max(n.n)::DOUBLE, 3)"
    return f"{value} AS {name}_at_{k}"


@Q.add(CASES + f" SELECT n.query AS case_id, {_at(3, 'precision')}, {_at(5, 'precision')} FROM n LEFT JOIN hit USING (query) GROUP BY n.query")
def e03_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("case_id", "precision_at_3", "precision_at_5")


@Q.add(CASES + f" SELECT n.query AS case_id, {_at(3, 'recall')}, {_at(5, 'recall')} FROM n LEFT JOIN hit USING (query) GROUP BY n.query")
def e04_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("case_id", "recall_at_3", "recall_at_5")


@Q.add(CASES + " SELECT n.query AS case_id, coalesce(round(1.0E0 / min(rank) FILTER (hit), 3), 0.0E0) AS mrr FROM n LEFT JOIN hit USING (query) GROUP BY n.query")
def e05_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("case_id", "mrr")


@Q.add(
    CASES
    + """ SELECT query AS case_id, n AS expected, count(*) FILTER (hit AND rank <= 5) AS relevant FROM n LEFT JOIN hit USING (query) GROUP BY query, n"""
)
def e09_expected_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, results = cases_and_results(spark, sf_dir)
    g = E.graded(cases, results).where("rank <= 5").groupBy("case_id").agg(F.count_if(F.exists("grades", lambda x: x == 3)).alias("relevant"))
    return cases.select("case_id", F.size("expected").cast("long").alias("expected")).join(g, "case_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


#: Each result takes the expected document that it is, else the first one that is left.
NDCG = (
    CASES.replace("WITH bm", "WITH RECURSIVE bm")
    + """, e AS (SELECT query, list(doc::VARCHAR ORDER BY doc::VARCHAR) AS free, count(*) AS n FROM ex GROUP BY query),
st AS (SELECT query, 0 AS r, free, n, 0.0E0 AS dcg FROM e UNION ALL
  SELECT st.query, r + 1, CASE WHEN list_contains(free, bm.doc::VARCHAR) THEN list_filter(free, lambda x: x <> bm.doc::VARCHAR) WHEN bm.doc IS NOT NULL THEN free[2:] ELSE free END, n,
    dcg + CASE WHEN list_contains(free, bm.doc::VARCHAR) THEN 7.0E0 WHEN bm.doc IS NOT NULL AND len(free) > 0 THEN 1.0E0 ELSE 0.0E0 END / log2(r + 2.0E0)
  FROM st LEFT JOIN bm ON bm.query = st.query AND bm.rank = r + 1 WHERE r < 5)
SELECT query AS case_id, round(least(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 7.0E0 / log2(i + 1.0E0))), 1.0E0), 3) AS ndcg_at_5 FROM st WHERE r = 5"""
)


@Q.add(NDCG)
def e06_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("case_id", "ndcg_at_5")


def _iou(a: str, b: str) -> str:
    t = lambda x: f"list_distinct(list_filter(string_split({fold_eval(x)}, ' '), lambda t: length(t) >= 2))"
    return f"SELECT case_id, round(CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0E0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END, 3) AS iou FROM (SELECT case_id, {t(a)} AS p, {t(b)} AS q FROM t)"


@Q.add("WITH t AS (SELECT conv_id * 100 + c.turn AS case_id, c.text AS a, n.text AS b FROM conversations c JOIN conversations n USING (conv_id) WHERE n.turn = c.turn + 1) " + _iou("a", "b"))
def e07_token_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(n, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), E.token_iou(F.col("text"), F.col("next")).alias("iou"))


@Q.add("SELECT l_orderkey AS case_id, CASE WHEN count(*) <= 1 THEN 0.0E0 ELSE round((count(*) - count(DISTINCT l_returnflag || l_linestatus)) / count(*)::DOUBLE, 3) END AS duplicate_rate FROM lineitem GROUP BY l_orderkey")
def e08_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("i"))
    return g.select("case_id", E.duplicate_rate(F.col("i")).alias("duplicate_rate"))


@Q.add(f"""
WITH t AS (SELECT conv_id, {fold_eval("string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant')")} AS said FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, turn, list_filter(string_split({fold_eval('text')}, ' '), lambda w: length(w) >= 4) AS words FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, len(words) AS n, unnest(words) AS word FROM p),
h AS (SELECT conv_id, turn, count(*) FILTER (contains(said, word)) / max(n)::DOUBLE >= 0.35E0 AS hit FROM w JOIN t USING (conv_id) GROUP BY conv_id, turn),
s AS (SELECT p.conv_id, count(*) AS points, count(*) FILTER (hit) AS matched FROM p LEFT JOIN h ON p.conv_id = h.conv_id AND p.turn = h.turn GROUP BY p.conv_id)
SELECT conv_id, matched::INTEGER AS matched, CASE WHEN matched / points::DOUBLE >= 0.9E0 THEN 5 WHEN matched / points::DOUBLE >= 0.7E0 THEN 4 WHEN matched / points::DOUBLE >= 0.45E0 THEN 3 WHEN matched > 0 THEN 2 ELSE 1 END AS score FROM s
""")
def e10_answer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    x = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(x.alias("x"))
    said = F.array_join(F.transform(F.filter("x", lambda m: m["role"] == "assistant"), lambda m: m["text"]), " ")
    points = F.transform(F.filter("x", lambda m: m["role"] == "user"), lambda m: m["text"])
    return g.select("conv_id", points.alias("p"), E.answer_points(said, points).alias("s")).where(F.size("p") > 0).select("conv_id", "s.matched", "s.score")


@Q.add(f"""
SELECT doc_id, round(len(list_filter(['the', 'die', 'les', 'del'], lambda t: contains(f, t))) / 4.0E0, 3) AS coverage, array_to_string(list_filter(['idiot', 'scum'], lambda t: contains(f, t)), ',') AS forbidden FROM (SELECT doc_id, {fold_eval('text')} AS f FROM documents)
""")
def e11_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, claims = F.array(*map(F.lit, ("the", "die", "les", "del"))), F.array(*map(F.lit, ("idiot", "scum")))
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", E.required_terms(t, terms)["coverage"].alias("coverage"), F.array_join(E.forbidden_claims(t, claims), ",").alias("forbidden"))


@Q.add("""
SELECT o_orderkey, CASE WHEN o_custkey % 5 <> o_orderkey % 5 THEN 2 WHEN o_orderkey % 3 = 0 THEN 3 ELSE 5 END AS score FROM orders
""")
def e13_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 5).cast("string"), (F.col("o_custkey") % 5).cast("string")
    answer = F.concat(F.lit("Theo Điều "), a, F.when(F.col("o_orderkey") % 3 == 0, F.lit(", 7777 ngày")).otherwise(F.lit("")))
    g = E.groundedness(answer, F.concat(F.lit("nội dung "), b), F.array(F.concat(F.lit("article:"), b)), F.lit(1), F.array().cast("array<string>"))
    return read(spark, sf_dir, "orders").select("o_orderkey", g["score"].alias("score"))


@Q.add("SELECT doc_id, round(CASE WHEN quality IS NULL THEN toxic ELSE (quality * 0.2E0 + toxic * 0.15E0 + 5 * 0.2E0) / 0.55E0 END, 2) AS overall FROM labels")
def e14_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {"retrieval_relevance": F.col("quality"), "citation_accuracy": F.col("toxic"), "groundedness": F.lit(5), "answer_correctness": F.lit(None).cast("int")}
    return read(spark, sf_dir, "labels").select("doc_id", E.overall(s).alias("overall"))


@Q.add(CASES + ", m AS (SELECT n.query, coalesce(round(1.0E0 / min(rank) FILTER (hit), 3), 0.0E0) AS mrr, " + _at(5, "recall") + " FROM n LEFT JOIN hit USING (query) GROUP BY n.query) SELECT count(*) AS cases, round(avg(mrr), 2) AS mrr, round(avg(recall_at_5), 2) AS recall_at_5 FROM m")
def e16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(metrics(spark, sf_dir), ["mrr", "recall_at_5"])


@Q.add("SELECT lang, count(*) AS cases, round(avg(quality), 3) AS quality, round(avg(toxic), 3) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a13_category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.category_means(j, "lang", ["quality", "toxic"])


@Q.add("""
WITH j AS (SELECT l.quality::DOUBLE AS b1, l.toxic::DOUBLE AS b2, length(text) / 1000.0E0 AS a1, (doc_id % 2)::DOUBLE AS a2 FROM labels l JOIN documents USING (doc_id)),
w AS (SELECT round(avg(b1), 3) AS b1, round(avg(b2), 3) AS b2, round(avg(a1), 3) AS a1, round(avg(a2), 3) AS a2 FROM j)
SELECT 'quality' AS metric, b1 AS before, a1 AS after, round(a1 - b1, 3) AS delta FROM w UNION ALL SELECT 'toxic', b2, a2, round(a2 - b2, 3) FROM w
""")
def e19_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "case_id")
    after = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), (F.length("text") / 1000.0).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    return E.compare(before, after, ["quality", "toxic"])


@Q.add("SELECT doc_id AS case_id, n_chars AS score FROM documents ORDER BY n_chars, doc_id LIMIT 12")
def t14_lowest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.lowest(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("n_chars").alias("score")), "score")
