"""Issue rules: matching by meaning, pruning, expansion of questions, planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import cosine
from .vectors import blocks_of


#: Most entries of rules that are broadcast at a time.
MOST_ENTRIES = 20_000


def clean_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def search_texts(rule: dict[str, Column]) -> Column:
    return F.array_distinct(F.concat(clean_list(F.array(*[X.text_of(rule[k]) for k in ("name", "type", "description")])), clean_list(rule["queries"])))


def rule_entries(rules: DataFrame) -> DataFrame:
    """A row a rule and semantic query: label, text."""
    return rules.select("label", F.explode(clean_list(F.col("semantic_queries"))).alias("text"))


def match(questions: DataFrame, entries: DataFrame, rules: DataFrame, least: float = 0.78, most: int = 3) -> DataFrame:
    """(query, label, score, confidence), the best entry a label, at most ``most``
    labels. Rules are an authored table, which is broadcast in blocks of a checked size;
    a question meets all of them."""
    q, n = questions.select("query", F.col("embedding").alias("qv")), entries.count()
    blocks = blocks_of(entries, "label", -(-n // MOST_ENTRIES)) if n > MOST_ENTRIES else [entries]
    scored = reduce(DataFrame.unionByName, [q.crossJoin(F.broadcast(e.select("label", F.col("embedding").alias("ev")))) for e in blocks])
    scored = scored.select("query", "label", F.round(cosine(F.col("qv"), F.col("ev")), 6).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("query", "label").agg(F.max("score").alias("score"))
    held = best.join(rules.select("label", F.col("confidence").alias("own")), "label", "left")
    held = held.withColumn("confidence", F.least(F.lit(0.99), F.greatest(F.coalesce("own", F.lit(0.9)), F.col("score"))))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("label"))
    return held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "rank", "label", "score", "confidence")


def prune(matches: DataFrame, sure: float = 0.9, least: float = 0.78, gap: float = 0.08) -> DataFrame:
    """Where the best match is sure, weaker ones need to be close to it: to six decimals,
    so that one that is just as far off as the gap stays."""
    best = F.max("confidence").over(Window.partitionBy("query"))
    x = matches.withColumn("best", best)
    return x.where((F.col("best") < sure) | (F.col("confidence") >= F.greatest(F.lit(least), F.round(F.col("best") - gap, 6)))).drop("best")


def plan(questions: DataFrame, matches: DataFrame, rules: DataFrame, sure: float = 0.9) -> DataFrame:
    """(query, high_confidence, labels, expanded): the questions that the matched
    rules add, in the order of matches."""
    m = matches.join(rules.select("label", F.col("retrieval_queries").alias("more")), "label")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label", "more", "confidence")))
    g = m.groupBy("query").agg(ordered.alias("m"))
    g = g.select(
        "query",
        F.transform("m", lambda x: x["label"]).alias("labels"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: clean_list(x["more"])))).alias("expanded"),
        (F.array_max(F.transform("m", lambda x: x["confidence"])) >= sure).alias("sure"),
    )
    none = F.array().cast("array<string>")
    return questions.select("query").join(g, "query", "left").select(
        "query", F.coalesce("sure", F.lit(False)).alias("high_confidence"), F.coalesce("labels", none).alias("labels"), F.coalesce("expanded", none).alias("expanded")
    )


#: Folded words of legal questions that any rewritten question may have.
LEGAL_WORDS = ("luat", "phap", "dieu", "khoan", "hinh", "su", "toi", "thuong", "tich", "trach", "nhiem", "xu", "ly")


def sane_rewrites(rewrites: DataFrame, vocabulary: tuple[str, ...] = LEGAL_WORDS) -> DataFrame:
    """Rewritten questions that share a word with the original or the vocabulary; all
    that say anything, if the original has no word."""
    words = lambda c: F.filter(F.split(X.fold(c), r"(?U)\s+"), lambda w: w != "")
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    original = words(F.col("question"))
    kept = (F.size(original) == 0) | F.arrays_overlap(words(F.col("rewrite")), F.concat(original, known))
    return rewrites.where((X.squeeze(F.col("rewrite")) != "") & kept)


def rewrite_source(mode: Column, high_confidence: Column, has_rules: Column) -> Column:
    """Which questions are searched for: the rules' alone, or a model's as well."""
    return F.when(mode == "none", "rules_only").when(high_confidence, "rules_high_confidence").when(has_rules, "llm_with_rule_hints").otherwise("llm")


def match_payload(rule: dict[str, Column], has_distinguish: Column, confidence: Column, source: Column, score: Column, query: Column) -> Column:
    """What a matched rule is handed on as; ``avoid_articles`` stand in for articles
    to distinguish from where the rule does not state any."""
    strip = lambda c: F.trim(X.text_of(c))
    said = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    trimmed = lambda c: F.transform(said(c), lambda x: F.trim(x))
    return F.struct(
        F.trim(X.falsy_coalesce(rule["label"], rule["issue_type"], F.lit(""))).alias("label"),
        *[strip(rule[k]).alias(k) for k in ("issue_type", "display_name", "issue_type_name", "description")],
        confidence.alias("confidence"),
        said(rule["retrieval_queries"]).alias("retrieval_queries"),
        *[trimmed(rule[k]).alias(k) for k in ("semantic_queries", "preferred_articles")],
        F.when(has_distinguish, trimmed(rule["distinguish_from_articles"])).otherwise(trimmed(rule["avoid_articles"])).alias("distinguish_from_articles"),
        trimmed(rule["document_title_hints"]).alias("document_title_hints"),
        source.alias("match_source"),
        F.round(score, 6).alias("semantic_score"),
        F.nullif(query, F.lit("")).alias("semantic_query"),
    )
