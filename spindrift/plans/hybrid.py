"""Hybrid search for batches of questions, as one lazy plan.

Indexes and vectors are tables that are read, not made, by a search. Their lists are
cut to their best before they are fused; texts join only what has survived fusion.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stores as S
from ..functions import text as X
from ..operators import lexical as L
from ..operators import ranking as R
from ..operators import rules as RU
from ..operators import vectors as VO


@dataclass(frozen=True)
class Columns:
    doc: str
    text: str
    query: str
    question: str
    source: str | None = None
    #: Place of a question among those of its query; without it, a query has one.
    position: str | None = None


MODES = ("bm25", "vector", "hybrid")


@dataclass(frozen=True)
class Sources:
    """What is searched: an index and its kind (``bm25`` or ``fts``), vectors, and
    those of further workspaces, whose vectors may be missing; and the distinct terms
    of each document, which spare a rerank its texts."""

    index: L.Index | None = None
    kind: str = "bm25"
    vectors: DataFrame | None = None
    more: tuple[Sources, ...] = ()
    ann: bool = False
    terms: DataFrame | None = None


def body_of(columns: list[str], c: Columns) -> Column:
    """The text of a document whose words the overlap with questions counts."""
    named = ("document_title", "article_number", "clause_number", "target_article", "chapter")
    fields = ([F.col(c.source)] if c.source else []) + [F.col(n) for n in named if n in columns]
    return F.concat_ws(" ", *fields, F.substring(c.text, 1, 400), F.col(c.text))  # the preview's last word may be a part of one


def stored_terms(docs: DataFrame, c: Columns) -> DataFrame:
    """(doc, terms), as stored, or made and stored."""
    key = f"terms-{S.signature(docs, c.doc, c.text, str(c.source), '1')}"
    make = lambda: {"terms": docs.select(F.col(c.doc).alias("doc"), R.distinct_terms(body_of(docs.columns, c)).alias("terms"))}
    return S.kept(docs.sparkSession, key, make)["terms"]


def stored_sources(docs: DataFrame, c: Columns, kind: str = "bm25", terms: bool = True) -> Sources:
    """Index and vectors of a table of files, as stored; terms: those of every document as
    well, which pays where many batches of questions are reranked."""
    t = X.tokens(F.col(c.text)) if kind == "bm25" else X.search_words(F.col(c.text))
    index = L.stored_index(docs, c.doc, t, f"index-{kind}")
    # an index of the same tokens has them counted already
    made = lambda: VO.hash_embed(index.documents, "doc", F.col("terms"), counts=F.col("tfs")) if kind == "bm25" else VO.hash_embed(docs, c.doc, X.tokens(F.col(c.text)))
    vectors, _ = VO.stored_vectors(docs, made, "vectors", provider="hash", model="md5-64", id=c.doc)
    return Sources(index, kind, vectors, terms=stored_terms(docs, c) if terms else None)


def lists(sources: Sources, questions: DataFrame, c: Columns, k: int, mode: str = "hybrid", pins: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(query, list, rank, doc, source): pinned documents first, then one list for each
    index, then one for each table of vectors; the order of lists decides ties. pins:
    (query, position, doc)."""
    if mode not in MODES:
        raise ValueError(f"mode: one of {MODES}")
    out = []
    if pins is not None:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("position"))
        out.append(pins.select("query", F.lit(0).alias("list"), rank.alias("rank"), "doc", F.lit("document").alias("source")))
    every = (sources, *sources.more)
    if mode in ("bm25", "hybrid"):
        for n, s in enumerate(every, 1):
            if s.index is not None:
                found = _lexical(s, docs, questions, c.query, c.question, c, k) if docs is not None else (L.bm25 if s.kind == "bm25" else L.full_text)(s.index, questions, c.query, c.question, k)
                out.append(found.select("query", F.lit(n).alias("list"), "rank", "doc", F.lit("bm25").alias("source")))
    if mode in ("vector", "hybrid"):
        q = VO.hash_embed(questions, c.query, X.tokens(F.col(c.question))).withColumnRenamed("id", "query")
        for n, s in enumerate(every, 1 + len(every)):
            if s.vectors is not None:
                near = (VO.approximate if s.ann else VO.top_k)(s.vectors, q, k, id_col="id")
                out.append(near.select("query", F.lit(n).alias("list"), "rank", F.col("id").alias("doc"), F.lit("vector").alias("source")))
    if not out:
        raise ValueError("no index and no vectors to search")
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def candidates(ranked: DataFrame, k: int) -> DataFrame:
    """Lists fused. Where a question has a single list, its scores are the same and
    its order is kept, as single_list() gives them."""
    return R.fuse(ranked, k)


def rerank(fused: DataFrame, docs: DataFrame, questions: DataFrame, c: Columns, k: int, issues: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Feature rerank of fused lists, by all questions of a query together. docs may
    have article_number, target_article and document_title; issues: (query, matches);
    terms: (doc, terms), taken from the texts of the fused documents if not given. What is
    fused is written and looked up, so that neither terms nor texts are shuffled."""
    has = set(docs.columns)

    def of(name: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast("string")

    fused, n = S.stored(fused, "fused")
    few = F.broadcast if n <= S.FEW else lambda df: df
    wanted = few(fused.select("doc").distinct())
    if terms is None:
        terms = docs.withColumn("doc", F.col(c.doc)).join(wanted, "doc").select("doc", R.distinct_terms(body_of(docs.columns, c)).alias("terms"))
    else:
        terms = terms.join(wanted, "doc")
    x = fused.join(_asked(questions, c), "query").join(terms.select("doc", F.col("terms").alias("__terms")), "doc")
    none = F.array().cast("array<struct<preferred_articles:array<string>,document_title_hints:array<string>>>")
    if issues is not None or has & {"article_number", "target_article"}:
        title = F.concat_ws(" ", of("document_title"), of("doc_number"), of("doc_type"), F.col(c.source) if c.source else F.lit(None).cast("string"), F.substring(c.text, 1, 400))
        d = docs.select(F.col(c.doc).alias("doc"), of("article_number").alias("__article"), of("target_article").alias("__target"), title.alias("__title"))
        x = x.join(d.join(wanted, "doc"), "doc")
    else:
        x = x.withColumns({n: F.lit(None).cast("string") for n in ("__article", "__target", "__title")})
    x = x.join(issues, "query", "left").withColumn("matches", F.coalesce("matches", none)) if issues is not None else x.withColumn("matches", none)
    out = R.feature_rerank(
        x, k,
        R.terms_overlap(F.col("__asked"), F.coalesce("__terms", F.array().cast("array<bigint>"))),
        R.article_match_of(F.col("__articles"), F.col("__article"), F.col("__target")),
        R.issue_article(F.col("matches"), F.col("__article"), F.col("__target"), F.col("__title")),
    )
    return out.drop("__terms", "__article", "__target", "__title", "__asked", "__articles", "matches")


def _asked(questions: DataFrame, c: Columns) -> DataFrame:
    """(query, terms and articles of all its questions)."""
    t = F.col(c.question)
    each = questions.select(F.col(c.query).alias("query"), R.distinct_terms(t).alias("terms"), X.article_numbers(t).alias("articles"))
    if c.position is None:
        return each.select("query", F.col("terms").alias("__asked"), F.col("articles").alias("__articles"))
    all_of = lambda n: F.array_distinct(F.flatten(F.collect_list(n)))  # noqa: E731  a few questions a query
    return each.groupBy("query").agg(all_of("terms").alias("__asked"), all_of("articles").alias("__articles"))


def numbered_questions(active: DataFrame, c: Columns) -> tuple[DataFrame, DataFrame]:
    """(ask, question) of the texts that differ, and (ask, query, position), both
    written: queries that ask the same are searched for once."""
    a = active.select(F.col(c.query).alias("query"), F.col(c.position).cast("int").alias("position"), F.col(c.question).alias("question")).where(F.trim(X.text_of(F.col("question"))) != "")
    texts, _ = S.stored(a.select("question").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    asked, _ = S.stored(a.join(texts, "question").select("ask", "query", "position"), "asked")
    return texts, asked


def fan_out(sources: Sources, docs: DataFrame, active: DataFrame, c: Columns, k: int, mode: str = "hybrid", pins: DataFrame | None = None, most: int = 3) -> DataFrame:
    """As lists(), of queries with up to ``most`` questions each (``c.position``, from 1):
    one list for each index and question, indexes first, then one for each question
    and table of vectors, questions first. Pins come before either kind, once."""
    if mode not in MODES:
        raise ValueError(f"mode: one of {MODES}")
    texts, asked = numbered_questions(active, c)
    every, out = (sources, *sources.more), []
    if pins is not None:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("position"))
        out.append(pins.select("query", F.lit(0).alias("list"), rank.alias("rank"), "doc", F.lit("document").alias("source")))

    def put(found: DataFrame, number: Column, kind: str) -> None:
        ranked = found.select(F.col("query").alias("ask"), "rank", "doc").join(asked, "ask")
        out.append(ranked.select("query", number.cast("int").alias("list"), "rank", "doc", F.lit(kind).alias("source")))

    at = F.col("position") - 1
    if mode in ("bm25", "hybrid"):
        for n, s in enumerate(every):
            if s.index is not None:
                put(_lexical(s, docs, texts, "ask", "question", c, k), 1 + n * most + at, "bm25")
    if mode in ("vector", "hybrid"):
        q = VO.hash_embed(texts, "ask", X.tokens(F.col("question"))).withColumnRenamed("id", "query")
        for n, s in enumerate(every):
            if s.vectors is not None:
                near = (VO.approximate if s.ann else VO.top_k)(s.vectors, q, k, id_col="id")
                put(near.withColumnRenamed("id", "doc"), 1 + len(every) * most + at * len(every) + n, "vector")
    if not out:
        raise ValueError("no index and no vectors to search")
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def _lexical(s: Sources, docs: DataFrame, questions: DataFrame, query: str, question: str, c: Columns, k: int) -> DataFrame:
    if s.kind == "bm25":
        return L.bm25(s.index, questions, query, question, k)
    where = [F.col(n).cast("string") for n in (c.source, "doc_number", "document_title") if n in docs.columns]
    return L.full_text_of_named(s.index, questions, query, question, k, docs, F.concat_ws(" ", *where), F.col(c.text), c.doc)


def search(sources: Sources, docs: DataFrame, questions: DataFrame, c: Columns, k: int = 5, mode: str = "hybrid", pins: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query: lists, fusion, rerank, threshold, pins. With
    ``c.position`` a query has several questions (see active_questions()), whose lists
    are fused."""
    per_list, most, reranked = max(6 * k, 30), max(8 * k, 40), max(3 * k, 12)
    ranked = lists(sources, questions, c, per_list, mode, pins, docs) if c.position is None else fan_out(sources, docs, questions, c, per_list, mode, pins)
    fused = candidates(ranked, most)
    out = R.threshold(rerank(fused, docs, questions, c, reranked, issues, sources.terms), k)
    return R.promote_pins(out, pins, k) if pins is not None else out


def retrieval_plan(questions: DataFrame, issues: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None, mode: str = "auto", most_rewrites: int = 3, most: int = 3) -> DataFrame:
    """(query, position, question, rewrite_source): what is asked for each query: itself,
    then what its matched rules add, then what ``rewrite`` makes of it, those that
    differ, ``most`` in all. Queries are rewritten only if the mode is not ``none`` and
    their rules are not sure. questions: (query, question); issues: as rules.plan()
    gives them; rewrite: from (query, question) to (query, seq, rewrite)."""
    q = questions.select("query", "question").join(issues, "query", "left")
    none = F.array().cast("array<string>")
    q = q.select("query", "question", F.coalesce("expanded", none).alias("expanded"), F.coalesce("high_confidence", F.lit(False)).alias("sure"))
    source = RU.rewrite_source(F.lit("none" if rewrite is None else mode), F.col("sure"), F.size("expanded") > 0)
    planned = q.withColumn("rewrite_source", source)
    rows = planned.select("query", F.lit(0).alias("o"), F.lit(0).cast("long").alias("seq"), "question", "rewrite_source")
    rows = rows.unionByName(planned.select("query", F.lit(1).alias("o"), F.posexplode("expanded").alias("seq", "question"), "rewrite_source"))
    if rewrite is not None and mode != "none":
        open_ = planned.where(F.col("rewrite_source").startswith("llm"))
        made = RU.sane_rewrites(rewrite(open_.select("query", "question")).join(open_.select("query", "question", "rewrite_source"), "query"))
        first = made.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("seq"))).where(F.col("n") <= most_rewrites)
        rows = rows.unionByName(first.select("query", F.lit(2).alias("o"), F.col("n").cast("long").alias("seq"), F.col("rewrite").alias("question"), "rewrite_source"))
    ordered = rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("o", "seq"))).withColumnRenamed("question", "asked")
    return R.distinct_questions(ordered, "asked", ["query"], "n", most).select("query", "position", "question", "rewrite_source")


def active_questions(planned: DataFrame, graph: DataFrame, most: int = 3) -> DataFrame:
    """(query, position, question): a plan's questions, then a graph's, cut together to
    the first ``most`` that differ. Both: (query, seq, question)."""
    both = planned.select("query", F.lit(0).alias("o"), "seq", "question").unionByName(graph.select("query", F.lit(1).alias("o"), "seq", "question"))
    numbered = both.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("o", "seq"))).withColumnRenamed("question", "asked")
    return R.distinct_questions(numbered, "asked", ["query"], "n", most).select("query", "position", "question")


def debug(sources: Sources, docs: DataFrame, questions: DataFrame, c: Columns, k: int = 5) -> dict[str, DataFrame]:
    """The results of each mode, each a query of its own."""
    return {mode: search(sources, docs, questions, c, k, mode) for mode in MODES}


def timed(sources: Sources, docs: DataFrame, questions: DataFrame, c: Columns, k: int = 5, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(mode, stage, rows, ms): what each stage of a search gives and takes, stage by
    stage: every one is written before the next one reads it, so that its time is its
    own. Longer than a search, which leaves all of them to one plan."""
    out = []
    per_list, most, reranked = max(6 * k, 30), max(8 * k, 40), max(3 * k, 12)
    for mode in modes:
        at = None
        stages = {
            "lists": lambda _: lists(sources, questions, c, per_list, mode, docs=docs) if c.position is None else fan_out(sources, docs, questions, c, per_list, mode),  # noqa: B023
            "fused": lambda x: candidates(x, most),
            "reranked": lambda x: rerank(x, docs, questions, c, reranked, None, sources.terms),
            "kept": lambda x: R.threshold(x, k),
        }
        for stage, make in stages.items():
            start = time.perf_counter()
            made, n = S.stored(make(at), "timed")
            out.append((mode, stage, n, int((time.perf_counter() - start) * 1000)))
            if at is not None:
                S.discard(at)
            at = made
        S.discard(at)
    return docs.sparkSession.createDataFrame(out, "mode string, stage string, rows long, ms long")


def context(results: DataFrame, fields: dict[str, Column], text: Column) -> DataFrame:
    """(query, context): numbered blocks of reference, score and text, in rank order.
    fields: document_title, doc_number, source_file, article_number, clause_number,
    target_article, and rerank, rrf or score."""
    f = lambda name: X.falsy_coalesce(fields[name].cast("string")) if name in fields else F.lit(None).cast("string")
    head = F.concat_ws(
        " | ", F.coalesce(f("document_title"), f("doc_number"), f("source_file"), F.lit("")), f("doc_number"), F.concat(F.lit("Điều "), f("article_number")),
        F.concat(F.lit("khoản "), f("clause_number")), F.concat(F.lit("sửa "), f("target_article")),
    )
    label, score = next(((n, fields[key]) for n, key in (("Rerank score", "rerank"), ("RRF score", "rrf"), ("Score", "score")) if key in fields), ("Score", F.lit(0.0)))
    block = F.concat(F.lit("[Nguồn "), F.col("rank").cast("string"), F.lit("] "), head, F.lit(f"\n{label}: "), F.format_string("%.6f", score), F.lit("\nNội dung: "), X.text_of(text))
    g = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))  # at most k rows
    return g.select("query", F.array_join(F.transform("x", lambda r: r["b"]), "\n\n").alias("context"))
