"""Operators that SQL cannot express, against values worked out by hand."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spindrift.functions import legal as LG
from spindrift.functions import text as X
from spindrift.operators import chunking as C
from spindrift.operators import evaluation as E
from spindrift.operators import graph as G
from spindrift.operators import ranking as R
from spindrift.operators import rules as RU
from spindrift.operators import sessions as S
from spindrift.operators import tables as T
from spindrift.operators import vectors as V
from spindrift.plans import hybrid
from spindrift.sources import readers, writers
from spindrift.streaming import events, ingest


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_text(spark):
    v = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert v(X.fold, "Điều  KHOẢN ß") == "dieu khoan ss"
    assert v(X.fold_search, "Điều") == "đieu"
    # what is searched for ends in letters alone, or in further parts; what is pinned may end in digits
    assert v(X.identifiers, "theo 45/2019/QH14 và 100/2015/NĐ-CP") == ["1002015ndcp"]
    assert v(LG.legal_numbers, "theo 45/2019/QH14 và 100/2015/NĐ-CP") == ["452019qh14", "1002015nd"]
    assert v(X.article_numbers, "Điều 5, dieu 12A; Article 7") == ["5", "12a", "7"]
    assert v(X.citation_keys, "Khoản 2 Điều 134") == ["article:134", "clause:2"]
    assert v(lambda c: X.clip_words(c, 8), "alpha beta gamma") == "alpha"
    assert v(X.issued_date, "Hà Nội, ngày 5 tháng 11 năm 2013") == "2013-11-05"
    assert v(X.document_number, " 45-2019 /QH14. ") == "45/2019/QH14"
    assert v(X.slugify, "Bộ luật  Hình sự (sửa đổi)") == "bo-luat-hinh-su-sua-doi"
    assert v(X.clean_lines, " a \r\n\r\n b  c \r") == "a\nb c"
    assert v(X.uploaded_text, "co-\nop  x\r\n\n\n\ny") == "coop x\n\ny"
    assert v(lambda c: X.sentences(c, 3, 5, 240), "Short. Long enough here! Yes? Another one.") == ["Short.", "Long enough here!", "Another one."]
    assert v(lambda c: F.to_json(X.json_object(c)), 'so: {"a": 1} ok') == '{"a":1}'
    assert v(lambda c: F.to_json(X.json_object(c)), "none") == "{}"
    assert one(spark, X.display_title(F.col("a"), F.col("b"), F.col("c"), F.lit(2)), a="", b="T", c="id") == "T - phần 2"
    assert one(spark, X.parent_context([F.col("a"), F.col("b"), F.col("a")], F.col("n")), a="Luật", b="", n="5") == "Luật\nĐiều 5"


def test_chunks(spark):
    sizes = C.Sizes(60, 10, 12, 50)
    whole = "Điều 5 về việc\n" + "\n".join(f"{k}. khoản số {k} có nội dung dài" for k in range(1, 4)) + "\n4. ngắn"
    pieces = C.split_chunk("d:article:5", whole, sizes)
    assert [p["id"] for p in pieces] == ["d:article:5:clause:1", "d:article:5:clause:2", "d:article:5:clause:3", "d:article:5:clause:4"]
    assert all(p["text"].startswith("Điều 5") and len(p["text"]) <= 60 for p in pieces)
    assert C.split_chunk("x", " a \n\n b ", sizes) == [{"id": "x", "text": "a\nb", "clause": None, "point": None, "cut": False, "merged": []}]
    long = " ".join(f"Sentence number {k} is here." for k in range(40))
    cut = C.split_text(long, 60, 10)
    assert "".join(long.split()) in "".join("".join(cut).split()) or all(f"number {k} " in " ".join(cut) for k in range(40))
    assert list(C.windows("x" * 25, 10, 2)) == ["x" * 10, "x" * 10, "x" * 9]
    short = [{"id": str(k), "text": t, "clause": None, "point": None, "cut": True, "merged": []} for k, t in enumerate(["a" * 5, "b" * 20, "c" * 5, "d" * 45])]
    assert [p["merged"] for p in C.merge_short(short, sizes)] == [["0", "1", "2"], []]
    rows = spark.createDataFrame([(1, "p:1", "a"), (2, "p:1", "b"), (3, "p:1:dup:2", "c")], "seq int, chunk_id string, text string")
    assert sorted(r.chunk_id for r in C.unique_ids(rows).collect()) == ["p:1", "p:1:dup:2", "p:1:dup:2:dup:2"]
    out = C.split(spark.createDataFrame([("c1", whole, "s"), ("c2", "fits", "s"), ("c3", "", "s")], "chunk_id string, text string, source string"), sizes).collect()
    assert {r.chunk_id for r in out} == {p["id"].replace("d:article:5", "c1") for p in pieces} | {"c2"} and {r.source for r in out} == {"s"}


def test_ranking(spark):
    lists = spark.createDataFrame([(1, 1, 1, 10, "bm25"), (1, 1, 2, 20, "bm25"), (1, 2, 1, 20, "vector"), (1, 2, 2, 30, None)], "query int, list int, rank int, doc int, source string")
    fused = R.fuse(lists).orderBy("rank").collect()
    assert [r.doc for r in fused] == [20, 10, 30] and fused[0].sources == ["bm25", "vector"] and fused[2].sources == ["unknown"]
    ranked = spark.createDataFrame([(1, k, k, s, ["bm25"]) for k, s in enumerate([0.9, 0.5, 0.1, 0.05], 1)], "query int, rank int, doc int, rerank double, sources array<string>")
    assert [r.doc for r in R.threshold(ranked, 4).orderBy("rank").collect()] == [1, 2, 3]
    pins = spark.createDataFrame([(1, 1, 4), (1, 2, 2)], "query int, position int, doc int")
    up = R.promote_pins(ranked, pins, 3).orderBy("rank").collect()
    assert [r.doc for r in up] == [2, 1, 3] and up[0].sources == ["bm25", "document"]
    flat = spark.createDataFrame([(1, 1, 5, ["a"]), (1, 2, 6, ["a"])], "query int, rank int, doc int, sources array<string>")
    assert {r.rerank for r in R.model_rerank(flat, 2, F.lit(3.0)).collect()} == {1.0}


def test_few_and_many_questions_agree(spark):
    import random

    rng = random.Random(1)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)], "vec_id long, embedding array<float>").repartition(5)
    q = vectors.where("vec_id < 40").select(F.col("vec_id").alias("query"), "embedding")
    many = {tuple(r) for r in V.top_k(vectors, q, 5).collect()}
    few = {tuple(r) for r in V.top_k(vectors, q.where("query < 20"), 5).collect()}
    assert few <= many and len(many) == 200


def test_metrics(spark):
    e = "struct<title_contains:string,source_contains:string,article_number:string,clause_number:string>"
    cases = spark.createDataFrame([(1, [("luat a", None, "5", None), ("luat b", None, None, "2")]), (2, [("x", None, None, None)]), (3, [])], f"case_id int, expected array<{e}>")
    rows = [(1, 1, "Luật B", "", "9", "1"), (1, 2, "Luật A", "", "5", ""), (1, 3, "Luật B", "", "1", "2")]
    results = spark.createDataFrame(rows, "case_id int, rank int, title string, source string, article_number string, clause_number string")
    got = {r.case_id: r for r in E.retrieval_metrics(cases, results).collect()}
    assert set(got) == {1, 2}
    assert (got[1].precision_at_3, got[1].recall_at_3, got[1].mrr, got[1].citation_accuracy) == (0.667, 1.0, 0.5, 5)
    dcg = 7 / 1.584962500721156 + 7 / 2
    assert got[1].ndcg_at_5 == round(min(1, dcg / (7 + 7 / 1.584962500721156)), 3)
    assert (got[2].precision_at_3, got[2].mrr, got[2].ndcg_at_5, got[2].citation_accuracy, got[2].top_1_correct) == (0.0, 0.0, 0.0, 1, False)
    g = lambda a, t, k, n=1: one(spark, E.groundedness(F.col("a"), F.col("t"), F.array(*map(F.lit, k)).cast("array<string>"), F.lit(n), F.array().cast("array<string>")), a=a, t=t)["score"]
    assert [g("Điều 5", "x", ["article:5"]), g("Điều 6", "x", ["article:5"]), g("khoản 3", "theo khoản 3", []), g("77 ngày", "x", []), g("không", "x", []), g("x", "x", [], 0)] == [5, 2, 5, 3, 3, 1]
    assert one(spark, E.overall({"retrieval_relevance": F.col("a"), "groundedness": F.lit(None).cast("int")}), a=4) == 4.0


def test_graph_and_rules(spark):
    chunks = spark.createDataFrame([("c1", "N1", "5", "Luật Hình sự", "xem Điều 6"), ("c2", "N1", "6", "Luật Hình sự", ""), ("c3", None, "6", "Luật Dân sự", "Điều 5")], "chunk_id string, doc_number string, article_number string, document_title string, text string")
    rows = G.article_rows(chunks, F.coalesce("doc_number", "chunk_id"))
    assert [tuple(r) for r in G.reference_edges(rows).collect()] == [("N1:article:5", "N1:article:6")]
    issues = spark.createDataFrame([("a", ["5"], ["6"], ["hình"]), ("b", ["99"], ["6"], ["hình"])], "label string, preferred_articles array<string>, distinguish_from_articles array<string>, document_title_hints array<string>")
    edges = G.issue_edges(issues, rows)
    assert sorted(map(tuple, edges.collect())) == [("a", "N1:article:5", "PREFERRED_ARTICLE"), ("a", "N1:article:6", "DISTINGUISH_FROM")]
    wanted = spark.createDataFrame([("a", 1), ("b", 2)], "label string, position int")
    found = G.expand_issues(wanted, edges, rows)
    assert [r.chunk_id for r in found.collect()] == ["c1", "c2", None]
    assert [tuple(r) for r in G.pins_of(found, 2, True).collect()] == [("c1", 1.0), ("c2", 0.72)]
    audit = {(r.label, r.relation): (r.candidates, r.matched) for r in G.audit(issues, rows).collect()}
    assert audit == {("a", "preferred"): (1, 1), ("a", "distinguish"): (2, 1), ("b", "preferred"): (0, 0), ("b", "distinguish"): (2, 1)}
    m = spark.createDataFrame([(1, 1, "a", 0.95, 0.95), (1, 2, "b", 0.85, 0.85)], "query int, rank int, label string, score double, confidence double")
    rules = spark.createDataFrame([("a", [" q1 ", "q1", ""]), ("b", ["q2"])], "label string, retrieval_queries array<string>")
    kept = RU.prune(m)
    assert [r.label for r in kept.collect()] == ["a"]
    p = RU.plan(spark.createDataFrame([(1,), (2,)], "query int"), kept, rules).orderBy("query").collect()
    assert (p[0].high_confidence, p[0].expanded, p[1].labels) == (True, ["q1"], [])


def test_tables_and_sessions(spark):
    old = spark.createDataFrame([(5, "a", 1), (6, "b", 2)], "seq long, id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    out = T.upsert_front(old, new, ["id"]).orderBy("seq").collect()
    assert {r.id for r in out[:2]} == {"b", "c"} and out[2].id == "a"
    assert tuple(T.upsert_counts(old.drop("seq"), new, ["id"]).first()) == (1, 1, 1)
    with pytest.raises(Exception, match="unknown value: c"):
        T.checked(new, "id", old, "id").collect()
    merged = one(spark, T.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))), z=1)
    assert merged == {"a": "1", "b": "3"}
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "w " * 50), (1, 2, "assistant", "x")], "c int, t int, role string, text string")
    f = S.fold_sessions(m, "c", "t")
    assert f.first()["title"].endswith("...") and len(f.select(S.recent(F.col("history"), 2).alias("r")).first()["r"]) == 2
    assert one(spark, S.case_state(F.col("s"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit("")), s="sum") == "sum\n- a: 1\n- b: 2"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()] == [1, 2]
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", strict=False).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 3}] trailing')
    assert [r.a for r in readers.json_array(spark, str(tmp_path / "arr.json"), "a int").collect()] == [1, 3]
    (tmp_path / "d" / "chunks").mkdir(parents=True)
    (tmp_path / "d" / "chunks" / "k.chunks.json").write_text(json.dumps([{"chunk_id": "k"}]))
    row = readers.chunk_files(spark, str(tmp_path / "d"), "chunk_id string").first()
    assert row.chunk_id == "k" and row.chunks_file.endswith("k.chunks.json")
    text, blocks = readers.parse_html('<p id=a>one<p class="x">two <b>b</b></p><script>var t="</p>"</script><li>out<ul><li>in</li></ul></li>&amp;')
    assert text == "one\ntwo\nb\nout\nin\n&" and [b["text"] for b in blocks] == ["one", "two b", "out in", "in"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Mot</w:t><w:t> hai</w:t></w:p><w:p/></w:document>')
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "f.docx").write_bytes(buffer.getvalue())
    (tmp_path / "up" / "f.pdf").write_bytes(b"%PDF")
    got = {r.kind: r.text for r in readers.uploaded_files(spark, str(tmp_path / "up")).collect()}
    assert got == {"docx": "Mot hai", "pdf": None}
    spark.dataSource.register(readers.PagedSource)
    paged = spark.read.format("paged").option("pages", "3").option("size", "2").option("fetch", "tests.pages:fetch").load()
    assert sorted(json.loads(r.item)["n"] for r in paged.collect()) == list(range(6))
    df = spark.createDataFrame([(1.5, ["a", "b"]), (float("nan"), None)], "v double, l array<string>")
    assert [tuple(r) for r in writers.csv_columns(df, ["l", "w", "v"]).collect()] == [("a | b", "", "1.5"), ("", "", "NaN")]
    assert writers.finite(df).where("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        writers.write_checked(df, str(tmp_path / "w"), 3)
    assert [json.loads(x) for x in writers.answer_stream(df.select("l"))][0] == {"l": ["a", "b"]}


def test_streams(spark, tmp_path):
    src, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.txt").write_text("one two")
    ingest.ingest(spark, str(src), table, mark).awaitTermination()
    (src / "b.txt").write_text("three")
    ingest.ingest(spark, str(src), table, mark).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["one two", "three"]
    ingest.replace_sources(spark, table, ingest.chunk_batch(spark.createDataFrame([("s", "new")], "source_file string, text string")))
    ingest.replace_sources(spark, table, ingest.chunk_batch(spark.createDataFrame([("s", "newer")], "source_file string, text string")))
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["newer", "one two", "three"]
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "ev").mkdir()
    raw.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "ev"))
    q = events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == raw.count()


def test_search_and_context(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "green"), (3, "yellow")], "doc long, text string")
    q = spark.createDataFrame([(7, "green blue")], "query long, question string")
    c = hybrid.Columns("doc", "text", "query", "question")
    for mode in ("bm25", "vector", "hybrid"):
        assert hybrid.search(hybrid.stored_sources(docs, c), docs, q, c, 2, mode).where("rank = 1").first()["doc"] == 1
    sources = hybrid.stored_sources(docs, c, "fts")
    assert hybrid.search(sources, docs, q, c, 2, "bm25").first()["doc"] == 1
    more = hybrid.Sources(sources.index, "fts", sources.vectors, (hybrid.Sources(sources.index, "fts"),))
    lists = hybrid.lists(more, q, c, 5, "hybrid", q.select("query", F.lit(0).alias("position"), F.lit(3).alias("doc")))
    assert {(r["list"], r["source"]) for r in lists.collect()} == {(0, "document"), (1, "bm25"), (2, "bm25"), (3, "vector")}
    with pytest.raises(ValueError, match="mode"):
        hybrid.lists(sources, q, c, 5, "other")
    assert {m: df.first()["doc"] for m, df in hybrid.debug(hybrid.stored_sources(docs, c), docs, q, c, 2).items()} == dict.fromkeys(hybrid.MODES, 1)
    found = hybrid.search(hybrid.stored_sources(docs, c), docs, q, c, 2).join(docs, "doc")
    fields = {"document_title": F.lit("Luật"), "doc_number": F.lit("1/2"), "article_number": F.lit("5"), "clause_number": F.lit(""), "rerank": F.lit(0.5)}
    assert hybrid.context(found, fields, F.col("text")).first()["context"].startswith("[Nguồn 1] Luật | 1/2 | Điều 5\nRerank score: 0.500000\nNội dung: red")


def test_full_text_asks_whole_questions(spark, tmp_path):
    import duckdb

    from spindrift import queries as library

    docs = [(1, "red green blue white black grey"), (2, "red green blue and nothing else"), (3, "white birds"), (4, "black birds and grey cats"), (5, "unrelated")]
    asked = [(1, "red green blue white"), (2, "white black grey"), (3, "white swans"), (4, "white black grey birds cats swans"), (5, "Grey, grey BIRDS!")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name = "r02_fts_and_or"
    rows = library.queries()[name](spark, str(tmp_path)).collect()
    # 1: the fourth word leaves document 1; 3: any of two terms; 4: six terms and no document has all
    assert {(r["query"], r["doc"], r["mode"]) for r in rows} == {(1, 1, "and"), (2, 1, "and"), (3, 1, "or"), (3, 3, "or"), (5, 4, "and")}
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, rows)) == sorted(c.execute(library.oracle_sql()[name]).fetchall())


def test_planted_short_questions(spark):
    from spindrift.queries.lexical import planted

    docs = [(1, "one two three four fivefold six seven"), (2, "a two three"), (3, "zone two three four five six"), (4, None), (5, "")]
    asked = [(1, "two three"), (2, "one two three four five"), (3, "e"), (4, "one two three four five six"), (5, None), (6, "two three four fivefold")]
    got = planted(spark.createDataFrame(asked, "item_id long, question string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = sorted((d, i) for d, t in docs for i, q in asked if t is not None and q is not None and q in t)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want
