from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stores as S
from ..functions import text as X
from ..operators import lexical as L
from ..operators import ranking as R
from .base import Registry, fold, fold_eval, fold_search, identifier_form, read, search_toks, squeeze, toks

Q = Registry()

STOP_SQL = ", ".join(f"'{w}'" for w in X.CONTENT_STOPWORDS)
TF = f"SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY ALL"


@Q.add(TF)
def a01_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.term_frequencies(read(spark, sf_dir, "documents"), "doc_id", X.tokens(F.col("text")))


@Q.add(f"SELECT term, count(*) AS df FROM ({TF}) GROUP BY term")
def a02_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.document_frequencies(a01_term_freq(spark, sf_dir))


@Q.add(f"SELECT count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS avgdl FROM (SELECT len({toks('text')}) AS dl FROM documents)")
def a03_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.corpus_stats(read(spark, sf_dir, "documents").select(F.size(X.tokens(F.col("text"))).alias("dl"))).withColumn("avgdl", F.round("avgdl", 6))


@Q.add(f"SELECT doc_id, len({toks('text')})::BIGINT AS n, array_to_string({toks('text')}, ' ') AS tokens FROM documents")
def x02_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@Q.add(f"SELECT doc_id, {fold('text')} AS folded, {fold_eval('text')} AS evaluated, {fold_search('text')} AS searched FROM documents")
def x03_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.fold(t).alias("folded"), X.fold_eval(t).alias("evaluated"), X.fold_search(t).alias("searched"))


@Q.add(f"SELECT p_partkey, {identifier_form('p_name')} AS name_form, {identifier_form('p_brand')} AS brand_form FROM part")
def x07_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.identifier_form(F.col("p_name")).alias("name_form"), X.identifier_form(F.col("p_brand")).alias("brand_form"))


#: Texts that name documents in all the ways that are told apart.
HARD = (
    "theo 45/2019/QH14 và 100/2015/NĐ-CP", "100 / 2015 / NĐ - CP, 100/2015/nđ-cp", "số 12-2001-TT và 7/1999/QĐ/BTC", "không có số: 45/2019, 2019/QH14, 12345/2019/QH14",
    "Điều 5, dieu 12A; Article 7 của luật 1/2020/L", "", "9/2000/A1B 10/2000/AB1", "3/2010/QH-12/X trước, sau 3/2010/QH-12/X", "điều 5 khoản 2 Điều 5", "articles 5 điều7 điều  8b",
)


def hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "k long, t string")


HARD_SQL = "h(k, t) AS (VALUES " + ", ".join(f"({k}::BIGINT, '{t}')" for k, t in enumerate(HARD)) + ")"
LETTER = "A-Za-z\\x{C0}-\\x{1EF9}"
IDS_SQL = f"list_distinct(list_transform(regexp_extract_all(t, '\\b\\d{{1,4}}\\s*[/-]\\s*\\d{{4}}\\s*[/-]\\s*[{LETTER}]+(?:\\s*[-/]\\s*[{LETTER}0-9]+)*\\b'), lambda x: {identifier_form('x')}))"


@Q.add(f"WITH {HARD_SQL}, p AS (SELECT doc_id, coalesce(text, '') || ' | ' || h.t AS t FROM documents JOIN h ON h.k = doc_id % {len(HARD)}) SELECT doc_id, array_to_string(list_sort({IDS_SQL}), ' ') AS ids, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(t), '(?:điều|\\bdieu|\\barticle)\\s+(\\d+[a-z]?)\\b', 1), lambda x: x))), ' ') AS articles FROM p")
def x08_extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers (X08) and articles (X09) of documents, each with a hard case."""
    d = read(spark, sf_dir, "documents")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" | "), F.array(*map(F.lit, HARD))[(F.col("doc_id") % len(HARD)).cast("int")])
    return d.select("doc_id", F.array_join(F.array_sort(X.identifiers(t)), " ").alias("ids"), F.array_join(F.array_sort(X.article_numbers(t)), " ").alias("articles"))


@Q.add(f"""
WITH b AS (SELECT item_id, list_distinct(list_filter(list_transform({toks('text')}, lambda t: replace(strip_accents(replace(t, 'ß', 'ss')), 'đ', 'd')), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\\p{{N}}+')
  AND t NOT IN ({STOP_SQL}))) AS w FROM benchmark),
q AS (SELECT item_id, len(w) AS n, unnest(w) AS t FROM b),
d AS (SELECT doc_id, replace({fold_search('text')}, 'đ', 'd') AS whole, replace({fold_search("regexp_extract(text, '^[^\\r\\n]*')")}, 'đ', 'd') AS head, replace({fold_search('substring(text, 1, 700)')}, 'đ', 'd') AS early FROM documents),
p AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT p.item_id, p.doc_id, round(sum(CASE WHEN contains(head, q.t) THEN 3.0E0 WHEN contains(early, q.t) THEN 2.0E0 WHEN contains(whole, q.t) THEN 1.0E0 ELSE 0.0E0 END) / (max(q.n) * 3.0E0), 6) AS overlap
FROM p JOIN q USING (item_id) JOIN d USING (doc_id) GROUP BY ALL
""")
def x15_content_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return planted(b, d).select("item_id", "doc_id", F.round(X.content_overlap(F.col("text"), X.content_tokens(F.col("question"))), 6).alias("overlap"))


def planted(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that hold a question verbatim. Questions are a table of bounded size;
    equal five-word starts are looked up first, so that no document meets all, and the
    pairs found, which are few, go to the texts rather than these to them. Of under six words no window is sure to be whole in the text: such questions are
    broadcast and searched in every document."""
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = 4
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
    grams = F.array_distinct(X.let(words, windows))
    q = F.filter(F.split(F.col("question"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the first word may be the end of a longer one in the text: start from the second
    asked = S.looked_up(questions.where(F.size(q) >= n + 2).select("item_id", F.xxhash64(F.slice(q, 2, n)).alias("g")), "asked")
    held = docs.select("doc_id", F.explode(grams).alias("g")).join(asked, "g").select("doc_id", "item_id").distinct()
    long = docs.join(S.looked_up(held, "held"), "doc_id").join(questions.select("item_id", "question"), "item_id")
    long = long.where(F.contains("text", F.col("question")))
    short = questions.where(F.size(q) < n + 2).select("item_id", "question")
    return long.unionByName(docs.join(F.broadcast(short), F.contains("text", F.col("question"))).select(long.columns))


@Q.add(f"""
SELECT doc_id, concat_ws(chr(10), 'title: ' || t, 'title: ' || t, 'source: ' || source, 'type: ' || lang, nullif(text, '')) AS searchable
FROM (SELECT *, nullif(CASE WHEN length(f) <= 250 THEN f ELSE coalesce(nullif(trim(regexp_replace(substring(f, 1, 250), ' [^ ]*$', '')), ''), trim(substring(f, 1, 250))) END, '') AS t
      FROM (SELECT *, {squeeze("regexp_extract(text, '^[^\\r\\n]*')")} AS f FROM documents))
""")
def p04_searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    head = F.regexp_extract(F.col("text"), r"^[^\r\n]*", 0)
    return d.select("doc_id", X.searchable_text(title=head, source=F.col("source"), type=F.col("lang"), text=F.col("text")).alias("searchable"))


TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@Q.add(f"""
SELECT doc_id, CASE WHEN length(text) <= 6000 THEN text WHEN length(cut) < 3000 THEN {TRIM.format('head')} ELSE cut END AS input, length(text) > 6000 AS trimmed, text AS other
FROM (SELECT doc_id, text, head, {TRIM.format("regexp_replace(head, '\\n[^\\n]*$', '')")} AS cut FROM (SELECT doc_id, coalesce(text, '') AS text, substring(coalesce(text, ''), 1, 6000) AS head FROM documents))
""")
def p08_trim_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed for the provider that bounds its input; another one gets the text."""
    cut, other = X.trim_embedding_input(F.col("text")), X.trim_embedding_input(F.col("text"), "sentence-transformers")
    return read(spark, sf_dir, "documents").select("doc_id", cut["text"].alias("input"), cut["trimmed"].alias("trimmed"), other["text"].alias("other"))


@Q.add(f"""
WITH q AS (SELECT conv_id, turn, CASE WHEN length(f) <= 180 THEN f ELSE coalesce(nullif(trim(regexp_replace(substring(f, 1, 180), ' [^ ]*$', '')), ''), trim(substring(f, 1, 180))) END AS question
  FROM (SELECT *, {squeeze('text')} AS f FROM conversations WHERE role = 'user')),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, replace(lower(question), 'ß', 'ss') ORDER BY turn) AS n FROM q WHERE question <> ''),
k AS (SELECT conv_id, question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM u WHERE n = 1)
SELECT conv_id, position::INTEGER AS position, question FROM k WHERE position <= 3
""")
def u02_dedup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return R.distinct_questions(c, "text", ["conv_id"], "turn").select("conv_id", "position", "question")


BM25 = f"""
WITH p AS ({TF}), dl AS (SELECT doc, sum(tf) AS dl FROM p GROUP BY doc),
s AS (SELECT count(*) AS n, avg(len({toks('text')})) AS avgdl FROM documents), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({toks('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query, doc, round(sum(times * ln(1 + (s.n - df + 0.5E0) / (df + 0.5E0)) * (tf * 2.5E0 / (tf + 1.5E0 * (0.25E0 + 0.75E0 * dl / s.avgdl)))), 4) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN dl USING (doc) CROSS JOIN s GROUP BY query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0)
SELECT query, rank::INTEGER AS rank, doc, score FROM r WHERE rank <= """


def index(spark: SparkSession, sf_dir: str, kind: str = "bm25") -> L.Index:
    words = X.tokens if kind == "bm25" else X.search_words
    return L.stored_index(read(spark, sf_dir, "documents"), "doc_id", words(F.col("text")), f"index-{kind}")


@Q.add(BM25 + "10")
def r01_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bm25(index(spark, sf_dir), read(spark, sf_dir, "benchmark"), "item_id", "text", 10)


def fts_sql(text: str) -> str:
    """Full-text search with ``text`` of each passage as its question."""
    return f"""
WITH qs AS (SELECT item_id AS query, list_distinct({search_toks(text)}) AS w FROM benchmark),
q AS (SELECT query, len(w) AS wanted, unnest(w) AS term FROM qs),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({search_toks('text')}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc, sum(tf) AS dl FROM p GROUP BY doc), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len({search_toks('text')})) AS avgdl FROM documents),
sc AS (SELECT query, doc, wanted, count(*) AS matched, sum(greatest(ln((s.n - df + 0.5E0) / (df + 0.5E0)), 1e-6) * (tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * dl / s.avgdl)))) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN dl USING (doc) CROSS JOIN s GROUP BY query, doc, wanted),
e AS (SELECT *, bool_or(matched = wanted) OVER (PARTITION BY query) AS every FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM e WHERE CASE WHEN every THEN matched = wanted ELSE wanted <= 5 END)
SELECT query, rank::INTEGER AS rank, doc, round(score, 4) AS score, CASE WHEN every THEN 'and' ELSE 'or' END AS mode FROM r WHERE rank <= 10
"""


@Q.add(fts_sql("text"))
def r02_fts_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages: all words must match."""
    return L.full_text(index(spark, sf_dir, "fts"), read(spark, sf_dir, "benchmark"), "item_id", "text", 10)


@Q.add(fts_sql("array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') || ' zzunknown' || (item_id % 2)"))
def r02_fts_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of few words, one of which no document has: any word may match."""
    q = read(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit(" zzunknown"), (F.col("item_id") % 2).cast("string")))
    return L.full_text(index(spark, sf_dir, "fts"), q, "item_id", "text", 10)


@Q.add(f"SELECT p_partkey, trim(regexp_replace({fold_search('p_name')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def x17_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))


@Q.add(r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS issued FROM orders
""")
def x28_issued_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.concat(F.lit("Hà Nội, ngày "), F.day(d).cast("string"), F.lit(" tháng "), F.month(d).cast("string"), F.lit(" năm "), F.year(d).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.issued_date(text).alias("issued"))


@Q.add(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({fold_eval('text')}, '\\d+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')))), ',') AS numbers FROM documents
""")
def x13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("text"))), ",").alias("numbers"))


SQ = squeeze("text")


@Q.add(f"""
SELECT doc_id, list_slice(list_filter(list_transform(string_split(regexp_replace({SQ}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' -')), lambda x: length(x) >= 25), 1, 3) AS s FROM documents
""".replace("SELECT doc_id, list_slice", "SELECT doc_id, array_to_string(list_transform(s, lambda x: trim(substring(x, 1, 240))), chr(10)) AS sentences FROM (SELECT doc_id, list_slice").replace("FROM documents", "FROM documents)"))
def x30_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.sentences(F.col("text")), "\n").alias("sentences"))
