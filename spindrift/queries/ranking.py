from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stores as S
from ..functions import text as X
from ..operators import lexical as L
from ..operators import ranking as R
from ..operators import rules as RU
from ..plans import hybrid as H
from .base import Registry, fold, fold_search, identifier_form, rank_toks, read, search_toks, squeeze, toks
from .lexical import BM25, STOP_SQL

WORDS = ", ".join(f"'{w}'" for w in RU.LEGAL_WORDS)

Q = Registry()

HASHED = f"""
hc AS (SELECT 'd' AS kind, doc_id AS id, ('0x' || substring(md5(t), 1, 4))::INTEGER % 64 AS b FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents)
  UNION ALL SELECT 'q', item_id, ('0x' || substring(md5(t), 1, 4))::INTEGER % 64 FROM (SELECT item_id, unnest({toks('text')}) AS t FROM benchmark)),
hn AS (SELECT kind, id, b, count(*)::DOUBLE AS n FROM hc GROUP BY ALL), hl AS (SELECT kind, id, sqrt(sum(n * n)) AS l FROM hn GROUP BY ALL),
hv AS (SELECT kind, id, b, n / l AS v FROM hn JOIN hl USING (kind, id)),
vs AS (SELECT q.id AS query, d.id AS doc, round(sum(q.v * d.v), 6) AS score FROM hv q JOIN hv d ON q.kind = 'q' AND d.kind = 'd' AND q.b = d.b GROUP BY ALL),
vec AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs QUALIFY rank <= 30)
"""
LISTS = f"WITH bm AS ({BM25}30), {HASHED}, lists AS (SELECT query, doc, rank, 1 AS list, 'bm25' AS source FROM bm UNION ALL SELECT query, doc, rank, 2, 'vector' FROM vec)"
FUSED = (
    LISTS
    + """, g AS (SELECT query, doc, round(sum(1.0E0 / (60 + rank)), 12) AS rrf, min(list * 1000 + rank) AS first, array_to_string(list(source ORDER BY list), '+') AS sources FROM lists GROUP BY query, doc),
fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, first, doc) AS rank FROM g)
"""
)


def sources(spark: SparkSession, sf_dir: str) -> H.Sources:
    return H.stored_sources(read(spark, sf_dir, "documents"), H.Columns("doc_id", "text", "item_id", "text", "source"), terms=False)


def ranked_lists(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    return H.lists(sources(spark, sf_dir), read(spark, sf_dir, "benchmark"), H.Columns("doc_id", "text", "item_id", "text"), k)


@Q.add(FUSED + "SELECT query, rank::INTEGER AS rank, doc, round(rrf, 9) AS rrf, sources FROM fused")
def r04_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.fuse(ranked_lists(spark, sf_dir))
    return f.select("query", "rank", "doc", F.round("rrf", 9).alias("rrf"), F.array_join("sources", "+").alias("sources"))


RERANK = (
    FUSED
    + f""", t AS (SELECT doc_id AS doc, list_distinct({rank_toks("source || ' ' || substring(text, 1, 400) || ' ' || text")}) AS tt FROM documents), qt AS (SELECT item_id AS query, list_distinct({rank_toks('text')}) AS qq FROM benchmark),
f AS (SELECT fused.*, rrf / max(rrf) OVER (PARTITION BY query) AS a, CASE WHEN len(qq) = 0 OR len(tt) = 0 THEN 0.0E0 ELSE len(list_intersect(qq, tt))::DOUBLE / len(qq) END AS b, CASE WHEN sources = 'bm25+vector' THEN 1.0E0 ELSE 0.4E0 END AS c
  FROM fused JOIN t USING (doc) JOIN qt USING (query) WHERE rank <= 40),
s AS (SELECT *, round(a * 0.38E0 + b * 0.2E0 + 0 * 0.12E0 + 0 * 0.15E0 + c * 0.05E0 + 0 * 0.1E0, 6) AS rerank FROM f),
rr AS (SELECT query, doc, rank AS fused_rank, rerank, row_number() OVER (PARTITION BY query ORDER BY rerank DESC, rank) AS rank, sources FROM s)
"""
)


def reranked(spark: SparkSession, sf_dir: str, k: int = 12) -> DataFrame:
    return H.rerank(R.fuse(ranked_lists(spark, sf_dir), 40), read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), H.Columns("doc_id", "text", "item_id", "text", "source"), k)


@Q.add(RERANK + "SELECT query, rank::INTEGER AS rank, doc, round(rerank, 4) AS rerank FROM rr WHERE rank <= 12")
def r09_feature_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query", "rank", "doc", F.round("rerank", 4).alias("rerank"))


@Q.add(
    RERANK
    + """, x AS (SELECT *, rerank >= 0.4E0 AS good, count(*) FILTER (rerank >= 0.4E0) OVER (PARTITION BY query) AS n FROM rr WHERE rank <= 12),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY good DESC, rank) AS place FROM x)
SELECT query, place::INTEGER AS rank, doc FROM y WHERE place <= greatest(n, 3) AND place <= 5"""
)
def r11_threshold_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold(reranked(spark, sf_dir), 5, 0.4, 3).select("query", "rank", "doc")


@Q.add(
    RERANK
    + """, p AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY fused_rank DESC) AS n FROM rr WHERE rank <= 12), pin AS (SELECT * FROM p WHERE n <= 3),
x AS (SELECT rr.*, pin.n, coalesce(pin.n IS NOT NULL AND rerank >= 0.25E0, false) AS up FROM rr LEFT JOIN pin USING (query, doc) WHERE rr.rank <= 12),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN up THEN n ELSE 1000000 END, rank) AS place FROM x)
SELECT query, place::INTEGER AS rank, doc, sources || CASE WHEN up THEN '+document' ELSE '' END AS sources FROM y WHERE place <= 5"""
)
def r12_pin_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reranked(spark, sf_dir)
    pins = r.select("query", (-F.col("fused_rank")).alias("position"), "doc")
    return R.promote_pins(r, pins, 5, 3, 0.25).select("query", "rank", "doc", F.array_join("sources", "+").alias("sources"))


@Q.add(
    RERANK
    + """, m AS (SELECT *, round(length(text) / 1000.0E0, 6) AS raw FROM rr JOIN (SELECT doc_id AS doc, text FROM documents) USING (doc) WHERE rank <= 12),
n AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM m WINDOW w AS (PARTITION BY query)),
o AS (SELECT query, doc, CASE WHEN hi = lo THEN 1.0E0 ELSE round((raw - lo) / (hi - lo), 6) END AS rerank, row_number() OVER (PARTITION BY query ORDER BY raw DESC, rank) AS place FROM n)
SELECT query, place::INTEGER AS rank, doc, round(rerank, 4) AS rerank FROM o WHERE place <= 5"""
)
def r10_minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.length("text") / 1000.0).alias("raw"))
    r = reranked(spark, sf_dir).drop("rerank", "fused_rank").join(lengths, "doc")
    return R.model_rerank(r, 5, F.col("raw")).select("query", "rank", "doc", F.round("rerank", 4).alias("rerank"))


@Q.add(
    RERANK
    + """, x AS (SELECT *, count(*) FILTER (rerank >= 0.15E0) OVER (PARTITION BY query) AS n FROM rr WHERE rank <= 12),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank >= 0.15E0 DESC, rank) AS place FROM x)
SELECT query, place::INTEGER AS rank, doc, round(rerank, 4) AS rerank FROM y WHERE place <= greatest(n, 3) AND place <= 5"""
)
def r15_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.search(sources(spark, sf_dir), read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), H.Columns("doc_id", "text", "item_id", "text", "source"), 5)
    return out.select("query", "rank", "doc", F.round("rerank", 4).alias("rerank"))


ACTIVE = f"""
asked AS (SELECT item_id AS query, -1 AS seq, text FROM benchmark UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id IN (SELECT item_id FROM benchmark)),
clip AS (SELECT query, seq, CASE WHEN length(f) <= 180 THEN f ELSE coalesce(nullif(trim(regexp_replace(substring(f, 1, 180), ' [^ ]*$', '')), ''), trim(substring(f, 1, 180))) END AS question
  FROM (SELECT *, {squeeze('text')} AS f FROM asked)),
uniq AS (SELECT *, row_number() OVER (PARTITION BY query, replace(lower(question), 'ß', 'ss') ORDER BY seq) AS n FROM clip WHERE question <> ''),
active AS (SELECT query, question, row_number() OVER (PARTITION BY query ORDER BY seq) AS position FROM uniq WHERE n = 1 QUALIFY position <= 3)"""
MULTI = f"""
WITH {ACTIVE}, asks AS (SELECT question, row_number() OVER (ORDER BY question) AS ask FROM (SELECT DISTINCT question FROM active)),
dt AS (SELECT doc_id AS doc, {toks('text')} AS t FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM dt) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT ask, term, count(*) AS times FROM (SELECT ask, unnest({toks('question')}) AS term FROM asks) GROUP BY ALL),
sc AS (SELECT ask, p.doc, round(sum(times * ln(1 + (st.n - df + 0.5E0) / (df + 0.5E0)) * (tf * 2.5E0 / (tf + 1.5E0 * (0.25E0 + 0.75E0 * len(dt.t) / st.avgdl)))), 4) AS score
  FROM qt JOIN f USING (term) JOIN p USING (term) JOIN dt ON dt.doc = p.doc CROSS JOIN st GROUP BY ask, p.doc),
bm AS (SELECT ask, doc, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 30),
hc AS (SELECT 'd' AS kind, doc AS id, ('0x' || substring(md5(term), 1, 4))::INTEGER % 64 AS b, tf AS n FROM p UNION ALL SELECT 'q', ask, ('0x' || substring(md5(term), 1, 4))::INTEGER % 64, times FROM qt),
hn AS (SELECT kind, id, b, sum(n)::DOUBLE AS n FROM hc GROUP BY ALL), hl AS (SELECT kind, id, sqrt(sum(n * n)) AS l FROM hn GROUP BY ALL), hv AS (SELECT kind, id, b, n / l AS v FROM hn JOIN hl USING (kind, id)),
vs AS (SELECT q.id AS ask, d.id AS doc, round(sum(q.v * d.v), 6) AS score FROM hv q JOIN hv d ON q.kind = 'q' AND d.kind = 'd' AND q.b = d.b GROUP BY ALL),
vec AS (SELECT ask, doc, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc) AS rank FROM vs QUALIFY rank <= 30),
pins AS (SELECT item_id AS query, p AS position, (item_id * p + p)::BIGINT AS doc FROM benchmark, (SELECT unnest([1, 2]) AS p)),
lists AS (SELECT query, doc, position AS rank, 0 AS list, 'document' AS source FROM pins
  UNION ALL SELECT query, doc, rank, position, 'bm25' FROM bm JOIN asks USING (ask) JOIN active USING (question) UNION ALL SELECT query, doc, rank, 3 + position, 'vector' FROM vec JOIN asks USING (ask) JOIN active USING (question)),
g AS (SELECT query, doc, round(sum(1.0E0 / (60 + rank)), 12) AS rrf, min(list * 1000 + rank) AS first, list_distinct(list(source)) AS sources FROM lists GROUP BY query, doc),
fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, first, doc) AS rank FROM g QUALIFY rank <= 40),
t AS (SELECT doc_id AS doc, list_distinct({rank_toks("source || ' ' || substring(text, 1, 400) || ' ' || text")}) AS tt FROM documents),
qq AS (SELECT query, list_distinct(flatten(list({rank_toks('question')}))) AS qq FROM active GROUP BY query),
s AS (SELECT fused.*, round(rrf / max(rrf) OVER (PARTITION BY query) * 0.38E0 + CASE WHEN len(qq) = 0 THEN 0.0E0 ELSE len(list_intersect(qq, tt))::DOUBLE / len(qq) END * 0.2E0
  + CASE WHEN list_has_all(sources, ['bm25', 'vector']) THEN 1.0E0 ELSE 0.4E0 END * 0.05E0 + list_contains(sources, 'document')::INTEGER * 0.1E0, 6) AS rerank FROM fused JOIN t USING (doc) JOIN qq USING (query)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank DESC, rank) AS place FROM s QUALIFY place <= 12),
x AS (SELECT *, count(*) FILTER (rerank >= 0.15E0) OVER (PARTITION BY query) AS n FROM rr),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank >= 0.15E0 DESC, place) AS kept FROM x QUALIFY kept <= greatest(n, 3) AND kept <= 5),
z AS (SELECT y.*, CASE WHEN rerank >= 0.45E0 THEN position END AS pin FROM y LEFT JOIN pins USING (query, doc))
SELECT query, row_number() OVER (PARTITION BY query ORDER BY coalesce(pin, 1000000), kept)::INTEGER AS rank, doc, round(rerank, 4) AS rerank FROM z
"""


@Q.add(MULTI)
def r15_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with what the user of the conversation of its number asks, three
    questions a query at most that differ, two pinned documents, in one fusion (R04a,
    R15, R19)."""
    b, c = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), read(spark, sf_dir, "conversations").where("role = 'user'")
    later = c.join(b.select(F.col("query").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("query"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("question"))
    active = H.active_questions(b.select("query", F.lit(0).cast("long").alias("seq"), F.col("text").alias("question")), later)
    two = F.posexplode(F.transform(F.array(F.lit(1), F.lit(2)), lambda p: (F.col("query") * p + p).cast("long"))).alias("position", "doc")
    columns = H.Columns("doc_id", "text", "query", "question", "source", "position")
    out = H.search(sources(spark, sf_dir), read(spark, sf_dir, "documents"), active, columns, 5, pins=b.select("query", two))
    return out.select("query", "rank", "doc", F.round("rerank", 4).alias("rerank"))


@Q.add(f"""
SELECT c.conv_id, c.turn, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0E0 ELSE len(list_intersect(q, t))::DOUBLE / len(q) END, 6) AS overlap
FROM (SELECT conv_id, turn, list_distinct({rank_toks('text')}) AS q FROM conversations) c JOIN (SELECT conv_id, turn, list_distinct({rank_toks('text')}) AS t FROM conversations) n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
""")
def r06_lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(R.lexical_overlap(F.col("text"), F.col("next")), 6).alias("overlap"))


@Q.add("""
SELECT p_partkey, CASE WHEN p_size = p_partkey % 50 + 1 THEN 1.0E0 WHEN contains(p_size || ' ' || (p_partkey % 7), (p_partkey % 50 + 1)::VARCHAR) THEN 0.6E0 ELSE 0.0E0 END AS score FROM part
""")
def r07_article_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.concat(F.lit("theo Điều "), (F.col("p_partkey") % 50 + 1).cast("string"))
    target = F.concat_ws(" ", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", R.article_match(wanted, F.col("p_size").cast("string"), target).alias("score"))


@Q.add(FUSED + "SELECT query, doc, CASE WHEN sources = 'bm25+vector' THEN 1.0E0 ELSE 0.4E0 END AS coverage FROM fused")
def r08_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(ranked_lists(spark, sf_dir)).select("query", "doc", R.coverage(F.col("sources")).alias("coverage"))


@Q.add("""
SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3, 4, 5) THEN CASE WHEN contains(lower(p_brand), '#1') OR contains(lower(p_brand), '#2') THEN 1.0E0 ELSE 0.55E0 END WHEN p_size IN (40, 41) THEN 0.75E0 ELSE 0.0E0 END AS score FROM part
""")
def r05_issue_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    def issue(articles: list[str], hints: list[str]):  # noqa: ANN202
        return F.struct(F.array(*map(F.lit, articles)).alias("preferred_articles"), F.array(*map(F.lit, hints)).cast("array<string>").alias("document_title_hints"))

    matches = F.array(issue(["1", "2", "3", "4", "5"], ["#1", "#2"]), issue(["40", "41"], []))
    return read(spark, sf_dir, "part").select("p_partkey", R.issue_article(matches, F.col("p_size").cast("string"), F.lit(""), F.col("p_brand")).alias("score"))


@Q.add("""
WITH d AS (SELECT o_orderkey AS seq, o_custkey % 25 AS source, CASE o_orderkey % 3 WHEN 0 THEN 'vbpl_' || (o_custkey % 400 + 1) || '-2001-nd-cp.txt' WHEN 1 THEN (o_custkey % 400 + 1) || ' / 2001/ND-CP' ELSE 'Law ' || (o_custkey % 400 + 1) || '-2001/ND of 1999' END AS hay FROM orders),
f AS (SELECT *, regexp_replace(lower(hay), '[^a-z0-9]+', '', 'g') AS form FROM d), q AS (SELECT p_partkey AS query, (p_partkey % 400 + 1) || '2001nd' AS id FROM part),
h AS (SELECT q.query, f.source, f.seq FROM f JOIN q ON contains(f.form, q.id)), r AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY seq) AS k FROM h)
SELECT query, source, seq FROM r WHERE k <= 4
""")
def r13_pinned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in file names, in numbers with more parts, in titles, and inside longer
    numbers: whatever contains the asked form."""
    n, k = (F.col("o_custkey") % 400 + 1).cast("string"), F.col("o_orderkey") % 3
    hay = F.when(k == 0, F.concat(F.lit("vbpl_"), n, F.lit("-2001-nd-cp.txt"))).when(k == 1, F.concat(n, F.lit(" / 2001/ND-CP"))).otherwise(F.concat(F.lit("Law "), n, F.lit("-2001/ND of 1999")))
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 25).alias("source"), hay.alias("hay"))
    q = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.concat(F.lit("theo "), (F.col("p_partkey") % 400 + 1).cast("string"), F.lit("/2001/ND.")).alias("question"))
    return R.pinned_documents(q, d, "question", F.col("hay"), "source", "seq").select("query", "source", "seq")


@Q.add("""
WITH i AS (SELECT n_nationkey AS query, n_name AS label, unnest([n_nationkey, n_nationkey + 25])::VARCHAR AS a FROM nation),
p AS (SELECT p_partkey, p_size::VARCHAR AS n, CASE WHEN p_partkey % 5 = 0 THEN 'dieu ' || (p_partkey % 60) || ' cua luat' END AS target, lower(p_type || ' ' || p_brand) AS title FROM part),
h AS (SELECT DISTINCT query, label, p_partkey FROM p JOIN i ON n = a OR contains(coalesce(target, ''), a) WHERE contains(title, 'anodized') OR contains(title, '#3')),
r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY p_partkey) AS k FROM h)
SELECT query, label, p_partkey FROM r WHERE k <= 3
""")
def r14_pinned_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred articles by their number, or inside the article that a chunk changes."""
    k = F.col("n_nationkey")
    issues = read(spark, sf_dir, "nation").select(k.alias("query"), F.col("n_name").alias("label"), F.array(k.cast("string"), (k + 25).cast("string")).alias("preferred_articles"), F.array(F.lit("ANODIZED"), F.lit("#3")).alias("hints"))
    target = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Điều "), (F.col("p_partkey") % 60).cast("string"), F.lit(" của luật")))
    chunks = read(spark, sf_dir, "part").withColumns({"article_number": F.col("p_size").cast("string"), "target_article": target})
    return R.pinned_issues(issues, chunks, F.concat_ws(" ", "p_type", "p_brand"), "p_partkey").select("query", "label", "p_partkey")


NAMED = "(({}) % 20 + 1) || '/2001/ND-CP'"
BODY = f"text || ' theo ' || {NAMED.format('doc_id')} || ' theo ' || {NAMED.format('doc_id * 7 + 3')}"
T03 = f"""
WITH docs AS (SELECT doc_id AS doc, concat_ws(' ', source, {NAMED.format('doc_id')}) AS hay, {BODY} AS text FROM documents),
qs AS (SELECT item_id AS query, item_id % 3 > 0 AS named, {NAMED.format('item_id')} AS number, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS words FROM benchmark),
qw AS (SELECT *, list_distinct({search_toks("words || CASE WHEN named THEN ' theo ' || number ELSE '' END")}) AS w FROM qs), q AS (SELECT query, named, len(w) AS wanted, unnest(w) AS term FROM qw),
dw AS (SELECT doc, {search_toks('text')} AS t FROM docs), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM dw) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dw),
sc AS (SELECT query, named, p.doc, wanted, count(*) AS matched, sum(greatest(ln((s.n - df + 0.5E0) / (df + 0.5E0)), 1e-6) * (tf * 2.2E0 / (tf + 1.2E0 * (0.25E0 + 0.75E0 * len(dw.t) / s.avgdl)))) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN dw ON dw.doc = p.doc CROSS JOIN s GROUP BY query, named, p.doc, wanted),
e AS (SELECT *, bool_or(matched = wanted) OVER (PARTITION BY query) AS every FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM e WHERE CASE WHEN every THEN matched = wanted ELSE wanted <= 5 END QUALIFY rank <= CASE WHEN named THEN 200 ELSE 5 END),
cw AS (SELECT query, named, regexp_replace(lower(number), '[^a-z0-9]+', '', 'g') AS form, list_distinct(list_filter(list_transform({toks('words')}, lambda t: replace(strip_accents(replace(t, 'ß', 'ss')), 'đ', 'd')), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\\p{{N}}+') AND t NOT IN ({STOP_SQL}))) AS c FROM qs),
m AS (SELECT r.query, r.named, r.doc, round(score, 4) AS score, rank, contains({identifier_form('hay')}, form) AND r.named AS hit, c,
  replace({fold_search('text')}, 'đ', 'd') AS whole, replace({fold_search("regexp_extract(text, '^[^\\r\\n]*')")}, 'đ', 'd') AS head, replace({fold_search('substring(text, 1, 700)')}, 'đ', 'd') AS early
  FROM r JOIN docs USING (doc) JOIN cw USING (query)),
o AS (SELECT *, bool_or(hit) OVER (PARTITION BY query) AS anyone, list_sum(list_transform(c, lambda t: CASE WHEN contains(head, t) THEN 3.0E0 WHEN contains(early, t) THEN 2.0E0 WHEN contains(whole, t) THEN 1.0E0 ELSE 0.0E0 END)) AS overlap FROM m),
k AS (SELECT query, doc, score, CASE WHEN named THEN row_number() OVER (PARTITION BY query ORDER BY CASE WHEN anyone THEN -coalesce(overlap, 0) ELSE 0 END, CASE WHEN anyone THEN -score ELSE 0 END, rank) ELSE rank END AS rank FROM o WHERE hit OR NOT anyone)
SELECT query, rank::INTEGER AS rank, doc, score FROM k WHERE rank <= 5
"""


@Q.add(T03)
def t03_named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of a passage, of two questions in three with the number of a document:
    they take 200 candidates and answer from that document alone (F03, F04, T03)."""
    number = lambda k: F.concat(((k) % 20 + 1).cast("string"), F.lit("/2001/ND-CP"))
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    d = d.select("doc_id", "source", number(i).alias("doc_number"), F.concat("text", F.lit(" theo "), number(i), F.lit(" theo "), number(i * 7 + 3)).alias("text"))
    b, q = read(spark, sf_dir, "benchmark"), F.col("item_id")
    words = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    asked = b.select("item_id", F.when(q % 3 > 0, F.concat(words, F.lit(" theo "), number(q))).otherwise(words).alias("asked"))
    index = L.stored_index(d, "doc_id", X.search_words(F.col("text")), "index-fts-named")
    hay = F.concat_ws(" ", "source", "doc_number")
    return L.full_text_of_named(index, asked, "item_id", "asked", 5, d, hay, F.col("text"), "doc_id").select("query", "rank", "doc", "score")


@Q.add(f"""
WITH b AS (SELECT item_id AS query, text AS question FROM benchmark), u AS (SELECT query, question, lead(question) OVER (ORDER BY query) AS more FROM b),
p AS (SELECT query, question, CASE WHEN query % 2 = 0 AND more IS NOT NULL THEN [trim(more), 'same for all'] ELSE [] END AS expanded, query % 4 = 0 AS sure FROM u),
src AS (SELECT *, CASE WHEN sure THEN 'rules_high_confidence' WHEN len(expanded) > 0 THEN 'llm_with_rule_hints' ELSE 'llm' END AS rewrite_source FROM p),
rw AS (SELECT s.query, c.turn, c.text AS rewrite, list_filter(string_split({fold('s.question')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({fold('c.text')}, ' '), lambda x: x <> '') AS b FROM src s JOIN conversations c ON c.conv_id = s.query AND c.role = 'assistant' WHERE NOT sure),
sane AS (SELECT query, rewrite, row_number() OVER (PARTITION BY query ORDER BY turn) AS n FROM rw WHERE trim(rewrite) <> '' AND (len(a) = 0 OR list_has_any(b, list_concat(a, [{WORDS}]))) QUALIFY n <= 3),
rows_ AS (SELECT query, 0 AS o, 0 AS seq, question FROM src UNION ALL SELECT query, 1, unnest(range(len(expanded))), unnest(expanded) FROM src UNION ALL SELECT query, 2, n, rewrite FROM sane),
clip AS (SELECT query, o, seq, CASE WHEN length(f) <= 180 THEN f ELSE coalesce(nullif(trim(regexp_replace(substring(f, 1, 180), ' [^ ]*$', '')), ''), trim(substring(f, 1, 180))) END AS question FROM (SELECT *, {squeeze('question')} AS f FROM rows_)),
uniq AS (SELECT *, row_number() OVER (PARTITION BY query, replace(lower(question), 'ß', 'ss') ORDER BY o, seq) AS n FROM clip WHERE question <> '')
SELECT query, row_number() OVER (PARTITION BY query ORDER BY o, seq)::INTEGER AS position, u.question, rewrite_source FROM uniq u JOIN src USING (query) WHERE n = 1 QUALIFY position <= 3
""")
def r18_retrieval_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, what rules add to every second one, and what the assistant of the
    conversation of their number says as rewritings of those whose rules are not sure."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    after = b.select((F.col("query") - 1).alias("query"), F.col("question").alias("more"))
    rules = b.where("query % 2 = 0").join(after, "query").select(F.concat(F.lit("r"), F.col("query").cast("string")).alias("label"), F.array("more", F.lit("same for all"), F.lit(" ")).alias("retrieval_queries"), "query")
    sure = F.when(F.col("query") % 4 == 0, 0.95).otherwise(0.8)
    issues = RU.plan(b.select("query"), rules.select("query", F.lit(1).alias("rank"), "label", sure.alias("confidence")), rules.select("label", "retrieval_queries"))
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("query"), F.col("turn").alias("seq"), F.col("text").alias("rewrite"))
    return H.retrieval_plan(b, issues, lambda open_: said.join(open_.select("query"), "query", "left_semi"))


def length_model():  # noqa: ANN201
    """A stand-in for a model, of which any process can say what it gives."""
    return lambda pairs: [(len(q) * 31 + len(t) * 17) % 1000 / 1000 for q, t in pairs]


@Q.add(
    RERANK
    + """, m AS (SELECT rr.query, rr.doc, rr.rank, ((length(b.text) * 31 + length(d.text) * 17) % 1000) / 1000.0E0 AS raw FROM rr JOIN documents d ON d.doc_id = doc JOIN benchmark b ON b.item_id = query WHERE rank <= 12),
n AS (SELECT *, min(raw) OVER w AS lo, max(raw) OVER w AS hi FROM m WINDOW w AS (PARTITION BY query)),
o AS (SELECT query, doc, CASE WHEN hi = lo THEN 1.0E0 ELSE round((raw - lo) / (hi - lo), 6) END AS rerank, row_number() OVER (PARTITION BY query ORDER BY raw DESC, rank) AS place FROM n)
SELECT query, place::INTEGER AS rank, doc, round(rerank, 4) AS rerank, true AS reranked FROM o WHERE place <= 5"""
)
def r10_model_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all passages scored by a model that is loaded once a worker."""
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    r = d.select(F.col("doc_id").alias("doc"), "text").join(S.looked_up(reranked(spark, sf_dir), "reranked"), "doc").join(b.select(F.col("item_id").alias("query"), F.col("text").alias("question")), "query")
    scored = r.withColumn("raw", R.model_scores(F.col("question"), F.col("text"), length_model))
    return R.rerank_or_keep(scored, 5).select("query", "rank", "doc", F.round("rerank", 4).alias("rerank"), "reranked")


@Q.add(
    RERANK
    + """, x AS (SELECT *, count(*) FILTER (rerank >= 0.15E0) OVER (PARTITION BY query) AS n FROM rr WHERE rank <= 12),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank >= 0.15E0 DESC, rank) AS place FROM x QUALIFY place <= greatest(n, 3) AND place <= 5)
SELECT 'hybrid' AS mode, 'lists' AS stage, count(*) AS rows FROM lists UNION ALL SELECT 'hybrid', 'fused', count(*) FROM fused WHERE rank <= 40
UNION ALL SELECT 'hybrid', 'reranked', count(*) FROM rr WHERE rank <= 15 UNION ALL SELECT 'hybrid', 'kept', count(*) FROM y"""
)
def r20_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of a search gives; their times are measured besides."""
    c = H.Columns("doc_id", "text", "item_id", "text", "source")
    return H.timed(sources(spark, sf_dir), read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), c, 5, ("hybrid",)).select("mode", "stage", "rows")
