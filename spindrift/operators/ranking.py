"""Fusion, reranking, thresholds and pins over ranked lists.

A ranked list is rows (query, list, rank, doc, ...). All operators work on whole
batches of questions; lists are short, as each was cut before it came here.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import legal as G
from ..functions import text as X
from .vectors import blocks_of

#: Most distinct articles that are broadcast at a time to chunks with a target.
MOST_ARTICLES = 10_000
#: Shares of the features in the rerank score.
WEIGHTS = {"rrf": 0.38, "lexical": 0.20, "article": 0.12, "issue": 0.15, "coverage": 0.05, "pinned": 0.10}


def _rank(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query").orderBy(*order))


def distinct_questions(questions: DataFrame, text_col: str, group: list[str], seq: str, most: int = 3, chars: int = 180) -> DataFrame:
    """The first ``most`` questions of a group that differ in case alone from none
    before them, clipped to ``chars`` at a word."""
    q = questions.withColumn("question", X.clip_words(F.col(text_col), chars)).where("question <> ''")
    first = q.withColumn("__n", F.row_number().over(Window.partitionBy(*group, X.casefold(F.col("question"))).orderBy(seq))).where("__n = 1")
    kept = first.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(seq)))
    return kept.where(F.col("__n") <= most).withColumnRenamed("__n", "position")


def fuse(ranked: DataFrame, k: int | None = None, constant: int = 60, source: str = "source") -> DataFrame:
    """Reciprocal rank fusion over rows (query, list, rank, doc, source): (query,
    rank, doc, rrf, sources). The first list that has a document decides ties;
    sources are distinct, in the order of lists."""
    place = F.struct("list", "rank")
    names = F.array_sort(F.collect_list(F.struct(F.col("list"), F.col("rank"), F.coalesce(F.col(source), F.lit("unknown")).alias("s"))))
    g = ranked.groupBy("query", "doc").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("rrf"), F.min(place).alias("first"), names.alias("n"))
    g = g.select("query", "doc", F.round("rrf", 12).alias("rrf"), "first", F.array_distinct(F.transform("n", lambda x: x["s"])).alias("sources"))
    g = g.withColumn("rank", _rank([F.desc("rrf"), F.asc("first"), F.asc("doc")]))
    return (g if k is None else g.where(F.col("rank") <= k)).select("query", "rank", "doc", "rrf", "sources")


def single_list(ranked: DataFrame, k: int, constant: int = 60, source: str = "source") -> DataFrame:
    """One ranked list as fuse() gives several: its own order, and a score by rank."""
    x = ranked.where(F.col("rank") <= k).select("query", "rank", "doc", F.round(F.lit(1.0) / (F.lit(constant) + F.col("rank")), 12).alias("rrf"), F.array(F.coalesce(F.col(source), F.lit("unknown"))).alias("sources"))
    return x


def lexical_overlap(question: Column, item_text: Column) -> Column:
    q = F.array_distinct(X.rank_tokens(question))
    t = F.array_distinct(X.rank_tokens(item_text))
    share = X.let(q, lambda x: F.size(F.array_intersect(x, t)) / F.nullif(F.size(x), F.lit(0)))
    return F.coalesce(share, F.lit(0.0))


def distinct_terms(c: Column) -> Column:
    """Hashes of the words of a text that overlaps count, each once."""
    return F.array_distinct(F.transform(X.rank_tokens(c), lambda t: F.xxhash64(t)))


def terms_overlap(asked: Column, terms: Column) -> Column:
    """lexical_overlap() of words that are hashed already."""
    share = F.size(F.array_intersect(asked, terms)) / F.nullif(F.size(asked), F.lit(0))
    return F.coalesce(share, F.lit(0.0))


def article_match(question: Column, article: Column, target: Column) -> Column:
    return article_match_of(X.article_numbers(question), article, target)


def article_match_of(wanted: Column, article: Column, target: Column) -> Column:
    """wanted: the articles that the questions name."""
    inside = X.let(X.fold(target), lambda t: F.exists(wanted, lambda a: F.contains(t, a)))
    return F.when(F.array_contains(wanted, X.fold(article)), 1.0).when(inside, 0.6).otherwise(0.0)


def issue_article(matches: Column, article: Column, target: Column, title: Column) -> Column:
    """matches: array of structs with preferred_articles and document_title_hints."""
    item = F.struct(X.fold(article).alias("actual"), X.fold(target).alias("goal"), X.fold(title).alias("where"))

    def score(m: Column, i: Column) -> Column:
        actual, goal, where = i["actual"], i["goal"], i["where"]
        preferred = F.transform(F.coalesce(m["preferred_articles"], F.array().cast("array<string>")), X.fold)
        hints = F.filter(F.transform(F.coalesce(m["document_title_hints"], F.array().cast("array<string>")), X.fold), lambda h: h != "")
        hit = F.array_contains(preferred, actual) | F.exists(preferred, lambda a: (a != "") & F.contains(goal, a))
        graded = F.when(F.size(hints) == 0, 0.75).when(F.exists(hints, lambda h: F.contains(where, h)), 1.0).otherwise(0.55)
        return F.when(hit, graded).otherwise(0.0)

    best = X.let(item, lambda i: F.array_max(F.transform(matches, lambda m: score(m, i))))
    return F.when(F.size(matches) > 0, F.coalesce(best, F.lit(0.0))).otherwise(0.0)


def coverage(sources: Column) -> Column:
    both = F.size(F.array_intersect(sources, F.array(F.lit("bm25"), F.lit("vector")))) == 2
    return F.when(both, 1.0).when(F.size(sources) > 0, 0.4).otherwise(0.0)


def feature_rerank(fused: DataFrame, k: int, lexical: Column, article: Column, issue: Column) -> DataFrame:
    """Adds the features and ``rerank``, and ranks anew by it."""
    most = F.coalesce(F.nullif(F.max("rrf").over(Window.partitionBy("query")), F.lit(0.0)), F.lit(1.0))
    x = fused.select(
        "*",
        (F.col("rrf") / most).alias("f_rrf"),
        lexical.alias("f_lexical"),
        article.alias("f_article"),
        issue.alias("f_issue"),
        coverage(F.col("sources")).alias("f_coverage"),
        F.when(F.array_contains("sources", "document"), 1.0).otherwise(0.0).alias("f_pinned"),
    )
    total = sum((F.col(f"f_{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    x = x.withColumn("rerank", F.round(total, 6)).withColumnRenamed("rank", "fused_rank")
    return x.withColumn("rank", _rank([F.desc("rerank"), F.asc("fused_rank")])).where(F.col("rank") <= k)


Scorer = Callable[[list[tuple[str, str]]], list[float]]


def model_scores(question: Column, text: Column, load: Callable[[], Scorer], batch: int = 64) -> Column:
    """Raw scores of pairs by a model that ``load`` gives, which a worker calls once for all
    its pairs; pairs of all questions go to it together, ``batch`` at a time. Null where
    it cannot be loaded, fails, or gives no finite number."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            model = load()
        except Exception:  # noqa: BLE001  whatever it is, the features rank instead
            model = None
        for q, t in batches:
            pairs, out = list(zip(q.to_pylist(), t.to_pylist())), []
            for k in range(0, len(pairs), batch):
                some = [(a or "", b or "") for a, b in pairs[k : k + batch]]
                try:
                    found = [float(x) for x in model(some)] if model else []
                except Exception:  # noqa: BLE001
                    found = []
                out += [x if math.isfinite(x) else None for x in found] if len(found) == len(some) else [None] * len(some)
            yield pa.array(out, pa.float64())

    return run(question, text)


def rerank_or_keep(ranked: DataFrame, k: int, raw: str = "raw") -> DataFrame:
    """model_rerank() of the queries all of whose results have a raw score; the others
    keep the order and the scores that they have, ``reranked`` tells which."""
    whole = F.min(F.col(raw).isNotNull()).over(Window.partitionBy("query"))
    x = ranked.withColumn("reranked", whole)
    by_model = model_rerank(x.where("reranked").drop("rerank", "fused_rank"), k, F.col(raw))
    kept = x.where(~F.col("reranked") & (F.col("rank") <= k))
    return by_model.unionByName(kept, allowMissingColumns=True)


def model_rerank(ranked: DataFrame, k: int, raw: Column) -> DataFrame:
    """By a model's raw score, with its value scaled to 0..1 within the question; one
    where all are equal."""
    w = Window.partitionBy("query")
    x = ranked.withColumn("model_score", F.round(raw, 6))
    low, high = F.min("model_score").over(w), F.max("model_score").over(w)
    x = x.withColumn("rerank", F.when(high == low, 1.0).otherwise(F.round((F.col("model_score") - low) / (high - low), 6))).withColumnRenamed("rank", "fused_rank")
    return x.withColumn("rank", _rank([F.desc("model_score"), F.asc("fused_rank")])).where(F.col("rank") <= k)


def threshold(ranked: DataFrame, k: int, least: float = 0.15, backfill: int = 3, score: str = "rerank") -> DataFrame:
    """Results of at least ``least``, filled up from the best others to ``backfill``,
    then the first k."""
    good = F.coalesce(F.col(score), F.lit(0.0)) >= least
    x = ranked.withColumn("good", good).withColumn("n_good", F.count(F.when(F.col("good"), 1)).over(Window.partitionBy("query")))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("good"), F.asc("rank"))))
    x = x.where((F.col("place") <= F.greatest(F.col("n_good"), F.lit(min(backfill, k)))) & (F.col("place") <= k))
    return x.withColumn("rank", F.col("place")).drop("good", "n_good", "place")


def promote_pins(ranked: DataFrame, pins: DataFrame, k: int, most: int = 3, least: float = 0.45) -> DataFrame:
    """The first ``most`` pins of a question that survived ranking with at least
    ``least`` go before all others, and gain the source ``document``. pins: (query,
    position, doc)."""
    first = pins.withColumn("__p", F.row_number().over(Window.partitionBy("query").orderBy("position"))).where(F.col("__p") <= most).groupBy("query", "doc").agg(F.min("__p").alias("__p"))
    x = ranked.join(first, ["query", "doc"], "left")
    up = F.col("__p").isNotNull() & (F.col("rerank") >= least)
    x = x.withColumn("promoted", up).withColumn("sources", F.when(up, F.array_union("sources", F.array(F.lit("document")))).otherwise(F.col("sources")))
    order = [F.when(F.col("promoted"), F.col("__p")).otherwise(1_000_000), F.col("rank")]
    return x.withColumn("rank", _rank(order)).where(F.col("rank") <= k).drop("__p")


def cap_per_group(rows: DataFrame, group: list[str], seq: str, most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(seq))).where(F.col("__n") <= most).drop("__n")


def pinned_documents(questions: DataFrame, docs: DataFrame, query_text: str, haystack: Column, group: str, seq: str, most: int = 4) -> DataFrame:
    """Chunks whose ``haystack`` contains the form of a document number that a question
    names, ``most`` of each source. A number's form is digits and then letters: where
    it is contained, its digits end a run of digits. So chunks meet numbers by a join on
    the ends of their runs, and no question meets every chunk. Each number is looked up
    once and cut to ``most`` chunks of a source, whoever names it, before it meets its
    questions: the first ``most`` of all numbers of a question are among these."""
    wanted = questions.select("query", F.explode(G.legal_numbers(F.col(query_text))).alias("identifier"))
    numbers = wanted.select("identifier").distinct().withColumn("__run", F.regexp_extract("identifier", r"^\d+", 0))
    named = docs.withColumn("__form", X.identifier_form(haystack))
    ends = lambda run: F.transform(F.sequence(F.lit(5), F.least(F.lit(8), F.length(run))), lambda n: F.right(run, n))
    runs = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("__form", F.lit(r"\d{5,}"), F.lit(0)), ends)))
    met = named.withColumn("__run", F.explode(runs)).join(numbers, "__run").where(F.contains(F.col("__form"), F.col("identifier"))).drop("__run", "__form")
    place = F.dense_rank().over(Window.partitionBy("identifier", group).orderBy(seq))  # which Spark limits before its shuffle
    first = met.withColumn("__n", place).where(F.col("__n") <= most).drop("__n").dropDuplicates(["identifier", group, seq])
    hit = first.join(wanted, "identifier").drop("identifier")
    return cap_per_group(hit.dropDuplicates(["query", group, seq]), ["query", group], seq, most)


def pinned_issues(issues: DataFrame, chunks: DataFrame, title: Column, seq: str, most: int = 3) -> DataFrame:
    """Chunks of an issue's preferred articles, or that change such an article, under a
    title that one of its hints names, ``most`` an issue. issues: (query, label,
    preferred_articles, hints); chunks: article_number and, if any, target_article.
    Articles meet by equality; of the few chunks with a target, each meets the
    articles of the authored rules, in blocks of a checked size."""
    wanted = issues.withColumn("article", F.explode(F.array_distinct(F.transform("preferred_articles", X.fold))))
    c = chunks.withColumns({"__title": X.fold(title), "__article": X.fold(F.col("article_number"))})
    equal = c.join(wanted, F.col("__article") == F.col("article"))
    hit = equal
    if "target_article" in chunks.columns:
        articles = wanted.select("article").where("article <> ''").distinct()
        n = articles.count()
        blocks = blocks_of(articles, "article", -(-n // MOST_ARTICLES)) if n > MOST_ARTICLES else [articles]
        changed = c.withColumn("__target", X.fold(F.col("target_article"))).where("__target <> ''")
        named = reduce(DataFrame.unionByName, [changed.join(F.broadcast(a.withColumnRenamed("article", "__named")), F.contains(F.col("__target"), F.col("__named"))) for a in blocks]).drop("__target")
        hit = equal.unionByName(named.join(wanted, F.col("__named") == F.col("article")).drop("__named"))
    hinted = F.exists(F.transform("hints", X.fold), lambda h: (h != "") & F.contains(F.col("__title"), h))
    once = hit.where(hinted).drop("__title", "__article", "article").dropDuplicates(["query", "label", seq])
    return cap_per_group(once, ["query", "label"], seq, most)
