"""Retrieval and answer metrics as columns over batches of cases.

Cases (case_id, expected: array of structs with title_contains, source_contains,
article_number, clause_number) meet results (case_id, rank, title, source,
article_number, clause_number, text) within their case: both lists are short, so
that a case's pairs are graded once and every metric is an aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Weights of the overall score.
OVERALL = {"retrieval_relevance": 0.20, "citation_accuracy": 0.15, "groundedness": 0.20, "answer_correctness": 0.20, "answer_relevance": 0.10, "completeness": 0.10, "no_overclaiming": 0.05}


def grade(identity: Column, article: Column, clause: Column, e: Column) -> Column:
    """3: all that is expected fits; 2: a document and the article; 1: a document and
    no other clause; 0."""
    parts = [X.fold_eval(e["source_contains"]), X.fold_eval(e["title_contains"])]
    inside = [F.contains(identity, p) for p in parts]
    want_article, want_clause = X.fold_eval(e["article_number"]), X.fold_eval(e["clause_number"])
    same_article = (want_article == "") | (want_article == article)
    same_clause = (want_clause == "") | (want_clause == clause)
    full = ((parts[0] == "") | inside[0]) & ((parts[1] == "") | inside[1]) & same_article & same_clause
    some = ((parts[0] == "") & (parts[1] == "")) | ((parts[0] != "") & inside[0]) | ((parts[1] != "") & inside[1])
    return F.when(full, 3).when(some & (want_article != "") & (want_article == article), 2).when(some & same_clause, 1).otherwise(0)


def graded(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, rank, grades: array<int>, one an expected source)."""
    identity = X.fold_eval(F.concat_ws(" ", X.text_of(F.col("source")), X.text_of(F.col("title"))))
    r = results.select("case_id", "rank", identity.alias("i"), X.fold_eval(F.col("article_number")).alias("a"), X.fold_eval(F.col("clause_number")).alias("c"))
    j = r.join(cases.select("case_id", "expected"), "case_id")
    return j.select("case_id", "rank", F.transform("expected", lambda e: grade(F.col("i"), F.col("a"), F.col("c"), e)).alias("grades"))


def _gain(g: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), g) - 1) / F.log2(rank + 1.0)


def ndcg(ranked_grades: Column, n: Column, k: int) -> Column:
    """ranked_grades: array of arrays in rank order. Each result takes the best
    expected source that none before it has taken."""
    free = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(True))
    start = F.struct(free.alias("free"), F.lit(0.0).alias("dcg"), F.lit(0).alias("rank"))

    def step(acc: Column, grades: Column) -> Column:
        open_ = F.zip_with(grades, acc["free"], lambda g, f: F.when(f, g).otherwise(0))
        best = F.array_max(open_)
        at = F.array_position(open_, best)
        left = F.transform(acc["free"], lambda f, i: f & ~((best > 0) & (i + 1 == at)))
        return F.struct(left.alias("free"), (acc["dcg"] + _gain(best, acc["rank"] + 1)).alias("dcg"), (acc["rank"] + 1).alias("rank"))

    dcg = F.aggregate(F.slice(ranked_grades, 1, k), start, step, lambda a: a["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k))), F.lit(0.0), lambda a, i: a + _gain(F.lit(3), i))
    return F.round(F.least(dcg / ideal, F.lit(1.0)), 3)


def retrieval_metrics(cases: DataFrame, results: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """A row a case with expected sources: precision, recall and nDCG at k, reciprocal
    rank, top flags, citation accuracy. Without results they are 0, flags false."""
    g = graded(cases, results).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grades"))), lambda x: x["grades"]).alias("g"))
    x = cases.select("case_id", F.size("expected").alias("n")).where("n > 0").join(g, "case_id", "left")
    x = x.withColumn("g", F.coalesce("g", F.array().cast("array<array<int>>")))
    hits = F.transform("g", lambda r: F.exists(r, lambda y: y == 3))
    first = F.array_position(hits, True)

    def matched(rows: Column) -> Column:
        return F.aggregate(rows, F.array_repeat(F.lit(False), F.col("n")), lambda a, r: F.zip_with(a, r, lambda p, q: p | (q == 3)), lambda a: F.size(F.filter(a, lambda v: v)))

    out = []
    for k in ks:
        top = F.slice(hits, 1, k)
        out.append(F.when(F.size(top) == 0, 0.0).otherwise(F.round(F.size(F.filter(top, lambda h: h)) / F.size(top), 3)).alias(f"precision_at_{k}"))
        out.append(F.round(matched(F.slice("g", 1, k)) / F.col("n"), 3).alias(f"recall_at_{k}"))
    total = matched(F.col("g"))
    accuracy = F.when(total == F.col("n"), 5).when(total > 0, 3).otherwise(1)
    return x.select(
        "case_id", *out, F.when(first > 0, F.round(1.0 / first, 3)).otherwise(0.0).alias("mrr"), ndcg(F.col("g"), F.col("n"), 5).alias("ndcg_at_5"),
        (first == 1).alias("top_1_correct"), first.between(1, 3).alias("top_3_contains_expected"), first.between(1, 5).alias("top_5_contains_expected"), accuracy.alias("citation_accuracy"),
    )


def token_iou(a: Column, b: Column) -> Column:
    p, q = F.array_distinct(X.eval_tokens(a)), F.array_distinct(X.eval_tokens(b))
    return F.when((F.size(p) == 0) | (F.size(q) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)), 3))


def duplicate_rate(identities: Column) -> Column:
    n = F.size(identities)
    return F.when(n <= 1, 0.0).otherwise(F.round((n - F.size(F.array_distinct(F.transform(identities, X.fold_eval)))) / n, 3))


def answer_points(answer: Column, points: Column) -> Column:
    """Struct of matched and missing points and a score from 1 to 5 (null: no points).
    A point is matched if 35 % of its words of four letters are in the answer."""

    def scored(said: Column) -> Column:
        def share_of(words: Column) -> Column:
            return F.size(F.filter(words, lambda w: F.contains(said, w))) / F.nullif(F.size(words), F.lit(0))

        def hit(p: Column) -> Column:
            words = F.filter(F.split(X.fold_eval(p), " "), lambda w: F.length(w) >= 4)
            return F.coalesce(X.let(words, share_of) >= 0.35, F.lit(False))

        def graded_points(flags: Column) -> Column:
            matched = F.size(F.filter(flags, lambda f: f))
            share = matched / F.nullif(F.size(flags), F.lit(0))
            score = F.when(share >= 0.9, 5).when(share >= 0.7, 4).when(share >= 0.45, 3).when(share > 0, 2).when(share == 0, 1)
            missing = F.filter(points, lambda p, i: ~F.get(flags, i))
            return F.struct(matched.alias("matched"), missing.alias("missing"), score.alias("score"))

        return X.let(F.transform(points, hit), graded_points)

    return X.let(X.fold_eval(answer), scored)


def required_terms(text: Column, terms: Column) -> Column:
    missing = X.let(X.fold_eval(text), lambda said: F.filter(terms, lambda t: ~F.contains(said, X.fold_eval(t))))
    return F.struct(missing.alias("missing"), F.round((F.size(terms) - F.size(missing)) / F.nullif(F.size(terms), F.lit(0)), 3).alias("coverage"))


def forbidden_claims(answer: Column, claims: Column) -> Column:
    return X.let(X.fold_eval(answer), lambda said: F.filter(claims, lambda c: F.contains(said, X.fold_eval(c))))


def groundedness(answer: Column, source_text: Column, source_keys: Column, n_sources: Column, terms: Column) -> Column:
    """Struct: score 1 to 5, unsupported citations and numbers. source_keys: citation
    keys of the sources' metadata; a clause may also be in their text."""
    keys = X.citation_keys(answer)
    in_text = X.citation_keys(source_text)
    bad = F.array_sort(X.let(in_text, lambda held: F.filter(keys, lambda k: ~F.array_contains(source_keys, k) & ~(k.startswith("clause:") & F.array_contains(held, k)))))
    cited = F.transform(keys, lambda k: F.substring_index(k, ":", -1))
    extra = F.array_sort(F.array_except(F.array_except(X.numbers(answer), X.numbers(source_text)), cited))
    cover = required_terms(source_text, terms)["coverage"]
    score = (
        F.when(n_sources == 0, 1).when(F.size(bad) > 0, 2).when(F.coalesce(cover == 0, F.lit(False)), 2).when(F.size(extra) > 0, 3)
        .when((F.size(keys) > 0) | (F.size(terms) > 0), 5).when(F.size(source_keys) > 0, 4).otherwise(3)
    )
    return F.struct(score.alias("score"), bad.alias("unsupported_citations"), extra.alias("unsupported_numbers"))


def overall(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that are there."""
    held = {n: w for n, w in OVERALL.items() if n in scores}
    total = sum((F.coalesce(scores[n] * w, F.lit(0.0)) for n, w in held.items()), F.lit(0.0))
    weight = sum((F.when(scores[n].isNotNull(), w).otherwise(0.0) for n, w in held.items()), F.lit(0.0))
    return F.round(total / F.nullif(weight, F.lit(0.0)), 2)


def summary(rows: DataFrame, metrics: list[str], decimals: int = 2) -> DataFrame:
    means = [F.round(F.avg(F.col(m).cast("double")), decimals).alias(m) for m in metrics]
    return rows.agg(F.count("*").alias("cases"), *means)


def category_means(rows: DataFrame, category: str, metrics: list[str], decimals: int = 3) -> DataFrame:
    return rows.groupBy(category).agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(m).cast("double")), decimals).alias(m) for m in metrics])


def compare(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, delta) over the cases that both have."""
    b = before.select("case_id", *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics])
    j = b.join(after.select("case_id", *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics]), "case_id")
    wide = j.agg(*[F.round(F.avg(f"{s}_{m}"), 3).alias(f"{s}_{m}") for m in metrics for s in "ba"])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.col(f"a_{m}").alias("after")) for m in metrics])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.round(F.col("after") - F.col("before"), 3))


def by_phrase(rows: DataFrame, question: Column, phrase: str, metrics: list[str]) -> DataFrame:
    """Means of the cases whose id or question has the phrase, and of the others."""
    return rows.groupBy(F.when(F.contains(F.lower(question), F.lit(phrase.lower())), phrase).otherwise("standard").alias("kind")).agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(m).cast("double")), 3).alias(m) for m in metrics])


def category_counts(rows: DataFrame, category: str) -> DataFrame:
    """(category, n), the most frequent first."""
    return rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(category))


def numeric_means(rows: DataFrame, ignored: tuple[str, ...] = ("question", "answer", "contexts", "ground_truth", "case_id"), decimals: int = 4) -> DataFrame:
    """(metric, mean) of every numeric column that has a value; NaN is none."""
    kinds = [f.name for f in rows.schema if f.name not in ignored and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = rows.agg(*[F.round(F.avg(number(c)), decimals).alias(c) for c in kinds])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("mean")) for c in sorted(kinds)])).alias("r")).select("r.*").where("mean IS NOT NULL")


def problem_cases(rows: DataFrame) -> DataFrame:
    """Cases with a low overall score or groundedness, or incomplete recall. A score
    of zero counts as missing, hence as good, as ``value or default`` has it."""
    of = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(default)))
    return rows.where((of("overall", 5) < 4) | (of("groundedness", 5) <= 3) | (of("recall_at_5", 1) < 1))


def reference_text(points: Column, terms: Column) -> Column:
    """What a case's answer is held against: its points, else its required terms."""
    none = F.array().cast("array<string>")
    lines = lambda c: F.array_join(F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return F.when(F.size(F.coalesce(points, none)) > 0, lines(points)).otherwise(lines(terms))


def judge_rows(results: DataFrame, dataset: DataFrame, contexts: int = 5, chars: int = 1500) -> DataFrame:
    """Rows for a semantic judge: question, answer, the first contexts that say
    anything, and the reference of the case. results: case_id, question, answer,
    sources (structs with text and preview); dataset: id, answer_points,
    required_terms."""
    ref = dataset.select(F.col("id").cast("string").alias("__id"), reference_text(F.col("answer_points"), F.col("required_terms")).alias("ground_truth"))
    said = F.filter(F.transform(F.slice("sources", 1, contexts), lambda s: F.trim(X.text_of(X.falsy_coalesce(s["text"], s["preview"])))), lambda t: t != "")
    j = results.join(ref, F.col("case_id").cast("string") == F.col("__id"), "left")
    return j.select("case_id", F.trim(X.text_of(F.col("question"))).alias("question"), F.trim(X.text_of(F.col("answer"))).alias("answer"), F.transform(said, lambda t: F.substring(t, 1, chars)).alias("contexts"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


def case_rows(scored: DataFrame, errors: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of a run: scored cases, and failed ones with an overall score of one and no
    other score. errors: (case_id, category, question, error)."""
    failed = errors.withColumns({m: F.lit(1.0 if m == "overall" else None).cast("double") for m in metrics})
    good = scored.select("case_id", "category", "question", F.lit(None).cast("string").alias("error"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return good.unionByName(failed.select(*good.columns))


def latency(rows: DataFrame) -> DataFrame:
    """One row: mean and greatest latency of the cases that have one."""
    return rows.agg(F.round(F.avg("latency_ms"), 2).alias("latency_average_ms"), F.max("latency_ms").alias("latency_max_ms"))


def slowest(timings: Column) -> Column:
    """The most milliseconds of a request's queries; zero without any."""
    return F.coalesce(F.array_max(F.transform(timings, lambda t: F.coalesce(t["ms"].cast("long"), F.lit(0).cast("long")))), F.lit(0).cast("long"))


#: Claims that no generated case allows.
FORBIDDEN = ("chắc chắn không bị xử lý", "không cần căn cứ pháp luật", "luôn luôn")


def generated_cases(cases: DataFrame, anchors: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evaluation cases out of a corpus. cases: (id, category, question, doc_hint,
    article); anchors and answers: (query = case id, rank, doc), the best chunks for
    the case's article and for its question; chunks: (doc, document_title, doc_number,
    source_file, article_number, text). A case without an anchor of its article is
    left out."""
    c = chunks.select("doc", X.fold_eval(F.concat_ws(" ", "source_file", "document_title", "doc_number")).alias("__who"), X.fold_eval(F.col("article_number")).alias("__article"), "document_title", "doc_number", "text")
    wanted = cases.select(F.col("id").alias("query"), "category", "question", "doc_hint", "article", X.fold_eval(F.col("doc_hint")).alias("__hint"), X.fold_eval(F.col("article")).alias("__wanted"))
    same = F.contains(F.col("__who"), F.col("__hint")) & (F.col("__article") == F.col("__wanted"))
    met = lambda lists: lists.join(c, "doc").join(wanted, "query").where(same)
    source = met(anchors).groupBy("query").agg(F.min_by(F.struct("doc", "document_title", "doc_number", "text"), "rank").alias("s"))
    rank = met(answers).groupBy("query").agg(F.min("rank").alias("question_rank"))
    x = wanted.join(source, "query").join(rank, "query", "left")
    head = X.falsy_coalesce(F.trim(F.regexp_extract(X.text_of(F.col("s.text")), r"^[^\r\n]*", 0)), F.concat(F.lit("Điều "), F.col("article")))
    first = F.concat(F.lit("Cần đối chiếu "), head, F.lit(" trong "), X.text_of(F.col("s.document_title")), F.lit("."))
    found = F.coalesce(F.col("question_rank").cast("string"), F.lit("not_in_top_30"))
    notes = F.concat(F.lit("Generated from corpus chunk_id="), F.col("s.doc").cast("string"), F.lit(", doc_number="), F.coalesce(F.col("s.doc_number"), F.lit("None")), F.lit(", question_bm25_rank="), found, F.lit("."))
    return x.select(
        F.col("query").alias("id"), "category", "question", F.slice(F.concat(F.array(first), X.sentences(F.col("s.text"))), 1, 4).alias("answer_points"),
        F.array(F.struct(F.col("doc_hint").alias("document_title_contains"), F.col("article").alias("article_number"))).alias("expected_sources"),
        F.array(F.concat(F.lit("Điều "), F.col("article")), F.col("doc_hint")).alias("required_terms"), F.array(*map(F.lit, FORBIDDEN)).alias("forbidden_claims"), notes.alias("notes"),
    )


def lowest(rows: DataFrame, score: str, n: int = 12) -> DataFrame:
    return rows.orderBy(F.asc(score), F.asc("case_id")).limit(n)


def first_relevant(rows: DataFrame, relevant: Column) -> DataFrame:
    return rows.groupBy("query").agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
