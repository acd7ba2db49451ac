"""Search by several questions, planning, named documents, models, blocks, the vector index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import ann
from spindrift.operators import lexical as L
from spindrift.operators import ranking as R
from spindrift.operators import rules as RU
from spindrift.operators import vectors as V
from spindrift.functions import text as X
from spindrift.plans import hybrid as H

DOCS = [(1, "red apple pie", "a"), (2, "green apple tart", "b"), (3, "blue plum jam", "a"), (4, "yellow plum cake", "c"), (5, "bread and butter", "c")]
C = H.Columns("doc", "text", "query", "question", "source", "position")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "docs")
    spark.createDataFrame(DOCS, "doc long, text string, source string").write.parquet(path)
    return spark.read.parquet(path)


def active(spark, *rows):
    return spark.createDataFrame(rows, "query long, position int, question string")


def test_lists_of_several_questions(spark, docs):
    """One list for each index and question, then for each question and vectors; the
    same question of two queries is asked once."""
    s = H.stored_sources(docs, C)
    two = H.Sources(s.index, s.kind, s.vectors, (H.Sources(s.index, s.kind, s.vectors),))
    q = active(spark, (7, 1, "apple"), (7, 2, "plum"), (8, 1, "plum"), (9, 1, "  "))
    texts, asked = H.numbered_questions(q, C)
    assert texts.count() == 2 and asked.count() == 3
    pins = spark.createDataFrame([(7, 1, 5)], "query long, position int, doc long")
    got = H.fan_out(two, docs, q, C, 5, "hybrid", pins)
    by = {}
    for r in got.orderBy("query", "list", "rank").collect():
        by.setdefault(r.query, {}).setdefault((r.list, r.source), []).append(r.doc)
    assert by[7][0, "document"] == [5]
    assert by[7][1, "bm25"] == by[7][4, "bm25"] and set(by[7][1, "bm25"]) == {1, 2}  # first question: both indexes
    assert set(by[7][2, "bm25"]) == set(by[7][5, "bm25"]) == {3, 4}
    assert {k for k, _ in by[7] if k > 6} == {7, 8, 9, 10} and by[7][7, "vector"] == by[7][8, "vector"] != by[7][9, "vector"]
    assert by[8][1, "bm25"] == by[7][2, "bm25"] and by[8][7, "vector"] == by[7][9, "vector"] and 9 not in by
    for mode, kinds in (("bm25", {"document", "bm25"}), ("vector", {"document", "vector"})):
        assert {r.source for r in H.fan_out(two, docs, q, C, 5, mode, pins).collect()} == kinds


def test_search_of_several_questions(spark, docs):
    s = H.stored_sources(docs, C)
    q = active(spark, (7, 1, "apple"), (7, 2, "plum jam"))
    found = [r.doc for r in H.search(s, docs, q, C, 3).orderBy("rank").collect()]
    assert 3 in found and {1, 2} & set(found)
    without = H.Sources(s.index, s.kind, s.vectors)  # terms taken from the texts
    assert found == [r.doc for r in H.search(without, docs, q, C, 3).orderBy("rank").collect()]
    # features are of all questions together
    x = H.rerank(H.candidates(H.fan_out(s, docs, q, C, 9), 9), docs, q, C, 9).collect()
    overlap = {r.doc: r.f_lexical for r in x}
    assert overlap[3] == pytest.approx(2 / 3) and overlap[1] == pytest.approx(1 / 3)


def test_plan(spark):
    q = spark.createDataFrame([(1, "sure one"), (2, "unsure two"), (3, "no rules three")], "query long, question string")
    issues = spark.createDataFrame([(1, True, ["l"], ["more", "MORE", "other"]), (2, False, ["l"], ["more"])], "query long, high_confidence boolean, labels array<string>, expanded array<string>")
    asked = []

    def rewrite(open_):
        asked.append({r.query for r in open_.collect()})
        return open_.select("query", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(t).alias("rewrite")) for k, t in enumerate(("unsure again", "nothing shared", "luat two", "three words"))])).alias("r")).select("query", "r.*")

    got = {(r.query, r.position): (r.question, r.rewrite_source) for r in H.retrieval_plan(q, issues, rewrite).collect()}
    assert asked == [{2, 3}]  # a sure plan is not rewritten
    assert got == {
        (1, 1): ("sure one", "rules_high_confidence"), (1, 2): ("more", "rules_high_confidence"), (1, 3): ("other", "rules_high_confidence"),
        (2, 1): ("unsure two", "llm_with_rule_hints"), (2, 2): ("more", "llm_with_rule_hints"), (2, 3): ("unsure again", "llm_with_rule_hints"),
        (3, 1): ("no rules three", "llm"), (3, 2): ("luat two", "llm"), (3, 3): ("three words", "llm"),
    }
    plain = H.retrieval_plan(q, issues, rewrite, mode="none").collect()
    assert len(asked) == 1 and {r.rewrite_source for r in plain} == {"rules_only"}


def test_named_documents(spark, tmp_path):
    rows = [(k, f"tax rule {'theo 1/2001/ND and ' * (k % 3 == 0)}{'tax ' * (k % 5)}theo 2/2001/ND", "1/2001/ND" if k in (6, 90) else "9/1999/QD") for k in range(120)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc long, text string, doc_number string").write.parquet(path)
    d = spark.read.parquet(path)
    index = L.stored_index(d, "doc", X.search_words(F.col("text")), "index-named-test")
    q = spark.createDataFrame([(1, "tax theo 1/2001/ND"), (2, "tax theo 2/2001/ND"), (3, "tax rule")], "query long, question string")
    got = {}
    for r in L.full_text_of_named(index, q, "query", "question", 2, d, F.col("doc_number"), F.col("text")).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.doc)
    assert sorted(got[1]) == [6, 90]  # beyond the first two by score
    plain = [[r.doc for r in L.full_text(index, q.where(f"query = {k}"), "query", "question", 2).orderBy("rank").collect()] for k in (2, 3)]
    assert [got[2], got[3]] == plain  # none is of the named document, or none is named


def test_model_hook(spark, tmp_path):
    loads = tmp_path / "loads"

    def load():
        with open(loads, "a") as f:
            f.write("x\n")

        def score(pairs):
            if any("fail" in t for _, t in pairs):
                raise OSError("away")
            return [float("nan") if "odd" in t else float(len(t)) for _, t in pairs]

        return score

    rows = [(q, n, q * 10 + n, f"q{q}", "fail" if (q, n) == (3, 1) else "odd" if (q, n) == (4, 2) else "t" * n, 0.5 / n) for q in range(1, 6) for n in range(1, 5)]
    x = spark.createDataFrame(rows, "query long, rank int, doc long, question string, text string, rerank double").coalesce(1)
    scored = x.withColumn("raw", R.model_scores(F.col("question"), F.col("text"), load, batch=1))
    scored.write.parquet(str(tmp_path / "scored"))
    assert loads.read_text().count("x") == 1
    out = R.rerank_or_keep(spark.read.parquet(str(tmp_path / "scored")), 3).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query"], r["rank"])):
        by.setdefault(r["query"], []).append((r.doc, r.reranked))
    assert by[1] == [(14, True), (13, True), (12, True)] and by[3] == [(31, False), (32, False), (33, False)] and not by[4][0][1]
    broken = x.withColumn("raw", R.model_scores(F.col("question"), F.col("text"), lambda: 1 / 0))
    assert {r.raw for r in broken.collect()} == {None}


def test_blocks(spark, monkeypatch):
    """More questions, rules or articles than travel at once are dealt into blocks."""
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(60, 8)))], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query")
    entries = v.select((F.col("vec_id") % 20).cast("string").alias("label"), "embedding")
    known = entries.select("label").distinct().withColumn("confidence", F.lit(0.5))
    issues = spark.createDataFrame([(1, "l", [str(k) for k in range(30)], ["x"])], "query long, label string, preferred_articles array<string>, hints array<string>")
    chunks = spark.createDataFrame([(k, f"n{k}", f"dieu {k} cua", "x") for k in range(50)], "seq long, article_number string, target_article string, title string")
    run = lambda: (sorted(map(tuple, V.top_k(v, q, 5).collect())), sorted(map(tuple, RU.match(q, entries, known, 0.2).collect())), sorted(r.seq for r in R.pinned_issues(issues, chunks, F.col("title"), "seq", 99).collect()))
    want = run()
    monkeypatch.setattr(V, "MOST", 7)
    monkeypatch.setattr(RU, "MOST_ENTRIES", 6)
    monkeypatch.setattr(R, "MOST_ARTICLES", 4)
    assert run() == want and len(want[0]) == 300 and len(want[2]) > 30


def test_vector_index(spark):
    """Clustered vectors: few codes are met, few vectors scored, recall as promised."""
    rng = np.random.default_rng(6)
    hearts = rng.normal(size=(200, 32))
    v = hearts[rng.integers(0, 200, 12_000)] + 0.15 * rng.normal(size=(12_000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    index = ann.build(df, "vec_id")
    r = ann.recall(index, V.top_k(df, q, 10), q, 10).first()
    assert r.recall >= 0.9 and r.codes_met < 0.05 and r.vectors_scored < 0.05, r
    # one cell, all probed: exact up to codes; no rows; one row
    assert ann.search(ann.build(df.limit(1), "vec_id"), q.limit(3), 5).count() == 3
    assert ann.search(ann.build(df.limit(0), "vec_id"), q.limit(3), 5).count() == 0
    assert ann.search(index, q.limit(0), 5).count() == 0
    cell, code = index.quantiser.code(v[:50])
    assert code.dtype == np.uint8 and code.shape == (50, 8) and cell.max() < len(index.quantiser.centres)
