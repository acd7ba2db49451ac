"""Functions over legal documents, corpus, uploads, sessions, jobs, stores, the engine:
against values worked out by hand."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import config, stores
from spindrift.engine import Engine
from spindrift.functions import legal as G
from spindrift.functions import text as X
from spindrift.operators import corpus as K
from spindrift.operators import evaluation as E
from spindrift.operators import graph, jobs, rules
from spindrift.operators import lexical as L
from spindrift.operators import sessions as S
from spindrift.operators import tables as T
from spindrift.operators import uploads as U
from spindrift.operators import vectors as V
from spindrift.plans import hybrid as H
from spindrift.sources import readers, writers


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def each(spark, f, cases):
    for text, want in cases.items():
        assert one(spark, f(F.col("t")), t=text) == want, text


def test_types_and_numbers(spark):
    each(spark, G.detected_type, {"luat/a.txt": "law", "x/Nghi-Dinh/y": "decree", "12_thong-tu-so-3": "circular", "nghi_quyet_1": "resolution", "abc": "other", "": "other", "3-bo-luat-x": "law"})
    for value, ident, want in (("Luật", "", "law"), (" NGHỊ ĐỊNH ", "x", "decree"), ("?", "quyet-dinh-5", "decision"), (None, None, "other")):
        assert one(spark, G.source_type(F.col("v"), F.col("i")), v=value, i=ident) == want
    each(spark, G.number_from_slug, {"45_2019_QH14.txt": "", "12_2015_N_CP_x": "12/2015/NĐ-CP", "7_2001_TT_BTC": "7/2001/TT-BTC", "so_12-QD-TTg": "12-QD/TTG", "": "", "nothing": "", "luat/5_2000_ND-CP.json": "5/2000/ND-CP"})
    each(spark, G.normal_number, {" 45-2019 /QH14. ": "45/2019/QH14", "(1//2)": "1/2", "": ""})
    cases = [
        ("x\nLuật số: 45/2019/QH14 về", "", "45/2019/QH14"), ("Số 12 - 2001 - TT", "", "12/2001/TT"), ("điều của Luật số 5/2000/QH10", "", ""), ("theo 45/2019/QH14", "", ""),
        ("", "luat-so-36-2018-QH14-x", "36/2018/QH14"), ("Nghị định số 1/2020/NĐ-CP", "", "1/2020/NĐ"), ("Số " + "x" * 170 + " 1/2020/ND", "", ""), ("\n" * 100 + "số 1/2020/ND", "", ""),
    ]
    for text, ident, want in cases:
        assert one(spark, G.number_from_text(F.col("t"), F.col("i")), t=text, i=ident) == want, text
    assert one(spark, G.source_title(F.col("a"), F.col("b"), F.lit("decree"), F.col("c")), a="Không rõ văn bản", b="1/2", c="9") == "Nghị định 1/2"
    assert one(spark, G.source_title(F.col("a"), F.col("b"), F.lit("law"), F.col("c")), a=" Luật Đất đai ", b="", c="9") == "Luật Đất đai"
    assert one(spark, G.source_title(F.col("a"), F.col("b"), F.lit("other"), F.col("c")), a="a_b", b="", c="9") == "Văn bản 9"
    assert one(spark, G.source_title(F.col("a"), F.col("b"), F.lit("other"), F.col("c")), a=None, b="", c="") == "Văn bản"
    each(spark, G.slug_title, {"12_bo-luat__hinh-su": "Bo Luat Hinh Su", "": ""})
    each(spark, G.stem, {"a/b.tar.gz": "b.tar", "x": "x", ".env": ".env", "": "", "a.b/c": "c"})
    each(spark, G.safe_stem, {"d/Bản án (1).pdf": "B-n-n-1", "....": "document", "ok_1.docx": "ok_1"})


def test_uploaded_lines(spark):
    v = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert v(G.composed, "Đie\u0302\u0300u") == "Điều" and v(G.composed, None) is None and v(G.composed, "plain") == "plain"
    assert v(G.prepared_lines, "Điều 1. A: 1. một; 2) hai; a) x; b) y\r\n\n z ") == ["Điều 1. A:", "1. một;", "2) hai;", "a) x;", "b) y", "z"]
    assert v(G.title_case, "BỘ LUẬT o'neil 3rd") == "Bộ Luật O'Neil 3Rd"
    assert one(spark, G.detected_title(G.prepared_lines(F.col("t")), F.col("f")), t="ngắn\nLUẬT ĐẤT ĐAI\nx", f="a.txt") == "Luật Đất Đai"
    assert one(spark, G.detected_title(G.prepared_lines(F.col("t")), F.col("f")), t="1234567890", f="d/my-file_x.txt") == "My File X"
    assert v(X.uploaded_text, " co-\nop  x\r\n\n\n\ny \n") == "coop x\n\ny"
    q = spark.range(1).select(G.quality_warning(F.lit(0.69)).alias("a"), G.quality_warning(F.lit(0.7)).alias("b"), G.average_confidence(F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0))).alias("c"), G.average_confidence(F.array().cast("array<double>")).alias("d")).first()
    assert q["a"].startswith("Độ tin cậy OCR thấp") and q["b"] is None and q["c"] == 0.75 and q["d"] == 0.0


def test_references(spark):
    ref = lambda a, c, t: one(spark, G.legal_reference(F.col("a"), F.col("c"), F.col("t")), a=a, c=c, t=t)
    assert ref("5", "2", "8") == "Khoản 2 Điều 5 (sửa đổi Điều 8)" and ref("điều 5", None, " ") == "điều 5" and ref("", "", "") is None
    label = lambda t, n, i, k: one(spark, G.document_label(F.col("t"), F.col("n"), F.col("i"), F.col("k")), t=t, n=n, i=i, k=k)
    assert label("Luật Đất đai", "", "5", "law") == "Luật Đất đai" and label("a_b", "1/2", "5", "law") == "Luật 5"
    assert label("12_2015_N_CP_x", "", "5", "decree") == "Nghị định 12/2015/NĐ-CP" and label("", "", "", "x") == "Văn bản" and label("", "45-QH", "", "law") == "Luật 45-QH"
    assert one(spark, G.citation(F.col("r"), F.col("l")), r=None, l="L") == "L" and one(spark, G.citation(F.col("r"), F.col("l")), r="R", l="L") == "R, L"
    assert one(spark, G.article_query(F.col("a"), F.col("t")), a="5", t="Luật") == "Điều 5 Luật" and one(spark, G.article_query(F.col("a"), F.col("t")), a=None, t="Luật") == "Luật"
    rule = {n: F.col(n) for n in ("display_name", "label", "issue_type_name", "issue_type", "description")}
    assert one(spark, G.rule_text(rule, F.lit("q")), display_name="", label="L", issue_type_name=None, issue_type="T", description="D") == "Vấn đề pháp lý: L.\nLoại: T.\nTình huống: q.\nMô tả: D"
    hints = lambda own, pre, kind: spark.range(1).select(G.title_hints(F.array(*map(F.lit, own)).cast("array<string>"), F.array(*map(F.lit, pre)).cast("array<string>"), F.lit(kind))).first()[0]
    assert hints([], ["134"], "xam_pham_x") == ["Bộ luật Hình sự"] and hints([], ["300"], "xam_pham") == ["Bộ luật", "Luật"] and hints([], [], "bao_hiem_y_te") == ["Luật Bảo hiểm y tế"] and hints(["x", " "], [], "") == ["x"]
    assert one(spark, G.pair_text([F.col("a"), F.col("b"), F.col("c")], 200), a=" T ", b="", c="x" * 300) == "T\n" + "x" * 198
    assert one(spark, G.iso_text(G.iso_time(F.col("t"), F.lit(None).cast("timestamp"))), t="2024-01-02T03:04:05Z") == "2024-01-02T03:04:05+00:00"
    assert one(spark, G.iso_text(G.iso_time(F.col("t"), F.to_timestamp(F.lit("2020-01-01 00:00:00")))), t="no") == "2020-01-01T00:00:00+00:00"


def test_corpus(spark):
    served = {"id": "7", "title": "Luật A", "docNum": "1/2020/QH", "docType": {"name": "Luật", "code": "L"}, "effTo": None, "documentMajors": [{"name": "x"}, {"name": ""}, {"name": "y"}], "positionName": "Chủ tịch", "signerName": "N", "organization": {"name": "QH"}}
    details = spark.createDataFrame([(json.dumps(served),)], "j string").select(F.from_json("j", K.DETAIL).alias("d")).select("d.*")
    m = K.metadata(details)
    r = m.first()
    assert (r.vbpl_id, r.doc_type, r.doc_type_code, r.majors, r.fields, r.signer_title, r.signer, r.organization, r.source_url[-2:]) == ("7", "Luật", "L", ["x", "y"], [], "Chủ tịch", "N", "QH", "/7")
    records = m.withColumns({"text_file": F.lit("t/7.txt"), "chunks_file": F.lit("c/7.json"), "chunk_count": F.lit(2).cast("long")})
    chunks = spark.createDataFrame([("7", "7:1", 0, "old", "Luật A", "một"), ("7", "7:2", 1, "old", "Luật A", "hai"), ("8", "8:1", 0, "", "B", "")], "vbpl_id string, chunk_id string, seq long, doc_type string, document_title string, text string")
    rich = K.enrich(chunks, records).orderBy("seq").collect()
    assert [c.chunk_id for c in rich] == ["7:1", "7:2"] and rich[0].doc_type == "Luật" and rich[0].source_file == "t/7.txt"
    lines = rich[0].metadata_text.split("\n")
    assert lines[0] == "THUỘC TÍNH VĂN BẢN" and lines[1] == "Số hiệu: 1/2020/QH" and "Ngành: x | y" in lines and "Ngày hết hiệu lực: --" in lines and "Cơ quan ban hành: QH" in lines and len(lines) == 13
    small = K.compact(chunks).columns
    assert tuple(small) == K.SEARCHED and len(K.SEARCHED) == 29 and len(K.VECTOR) == 32 and len(K.REBUILT) == 22
    row = K.compact(chunks).where("chunk_id = '8:1'").first()
    assert row.source_file == "vbpl/8" and row.mode == "article" and row.text == ""
    rebuilt = K.records_from_chunks(K.enrich(chunks, records).withColumn("doc_number", F.lit("1")), spark.createDataFrame([("t/7.txt", "abc")], "text_file string, text string")).first()
    assert (rebuilt.vbpl_id, rebuilt.title, rebuilt.chunk_count, rebuilt.text_length) == ("7", "Luật A", 2, 3)
    assert [d.status for d in K.documents(records, True).collect()] == ["indexed"] and K.documents(records, False).first().status == "chunked"
    files = spark.createDataFrame([("12_nghi-dinh-so-5-2001-ND-x.txt", "", "ngày 1 tháng 2 năm 2003", None)], "text_file string, title string, text string, url string")
    d = K.file_documents(files, spark.createDataFrame([], "text_file string, chunk_count long"), True).first()
    assert (d.document_type, d.document_number, d.issued_date, d.status, d.issuing_authority) == ("decree", "5/2001/ND", "2003-02-01", "crawled", "Chính phủ")
    old = spark.createDataFrame([("1", 0)], "vbpl_id string, seq long")
    held = spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], "vbpl_id string, chunk_id string, seq long")
    more = spark.createDataFrame([("1", "a", 0), ("3", "c", 1), ("3", None, 2)], "vbpl_id string, chunk_id string, seq long")
    rec, chk = K.resumed(old, held, more, spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "vbpl_id string, seq long"))
    assert sorted(r.vbpl_id for r in rec.collect()) == ["1", "3"] and sorted(c.chunk_id for c in chk.collect()) == ["a", "b", "c"]
    assert [r.n for r in K.duplicates(more, "vbpl_id").collect()] == [2]
    ids = K.graph_ids(spark.createDataFrame([("v", "d", "5A"), (None, "d", "6"), ("v", "d", "")], "vbpl_id string, doc_number string, article_number string").withColumn("source_file", F.lit("s"))).collect()
    assert [r.article_id for r in ids] == ["v:article:5a", "d:article:6"]


def test_sources_as_shown(spark):
    found = spark.createDataFrame(
        [(1, 1, "c1", "t/7.txt", None, None, None, "T", "5", "text", ["bm25", "vector"], 0.5), (1, 2, "c2", "vbpl/9", None, "Luật", "", "12_2015_N_CP_x", None, "", ["bm25"], 0.0), (1, 3, "c3", None, None, None, None, None, None, None, [], 0.25)],
        "query long, rank int, chunk_id string, source_file string, vbpl_id string, doc_type string, doc_number string, document_title string, article_number string, text string, sources array<string>, rerank double",
    )
    manifest = spark.createDataFrame([("t/7.txt", "7", "Nghị định", "1/2", "M", "u", "2001"), (None, "9", None, None, "Luật B", "v", None)], "text_file string, vbpl_id string, doc_type string, doc_number string, title string, source_url string, issue_date string")
    a, b, c = K.map_sources(found, manifest).orderBy("rank").collect()
    assert (a.document_id, a.document_title, a.document_number, a.document_type, a.retrieval_origin, a.source_url, a.issued_date, a.relevance_score) == ("7", "T", "1/2", "decree", "hybrid", "u", "2001", 0.5)
    assert (b.document_id, b.document_number, b.document_title, b.document_type, b.retrieval_origin) == ("9", "12/2015/NĐ-CP", "Luật 12/2015/NĐ-CP", "law", "bm25")
    assert (c.document_id, c.document_title, c.retrieval_origin, c.chunk_text) == ("c3", "Văn bản c3", "hybrid", "")


def test_uploads(spark):
    long = "Điều 2. Dài\n1. " + "a" * 1000 + "\n2. " + "\n".join("b" * 600 for _ in range(4)) + "\n3. ngắn"
    text = "bỏ\nPhần I\nChương 1\nĐiều 1. Ngắn: 1. một; 2. hai\nTiểu mục 3\n" + long
    ups = spark.createDataFrame([("u1", "d/Tệp A.pdf", text, "public", 0.9), ("u2", "b.txt", "không có điều nào", "private", 0.5)], "upload_id string, file_name string, text string, workspace string, confidence double")
    rows = {r.chunk_id: r for r in U.chunks(ups).collect()}
    assert rows["u1:article:1"].text == "Điều 1. Ngắn:\n1. một;\n2. hai" and rows["u1:article:1"].part == "Phần I" and rows["u1:article:1"].chapter == "Chương 1" and rows["u1:article:1"].subsection is None
    assert rows["u1:article:2:clause:1"].text.startswith("Điều 2. Dài\n1. aaa") and rows["u1:article:2:clause:1"].clause_number == "1" and rows["u1:article:2:clause:1"].subsection == "Tiểu mục 3"
    assert {"u1:article:2:clause:2:part:1", "u1:article:2:clause:2:part:2", "u1:article:2:clause:3"} <= set(rows) and max(r.text_length for r in rows.values()) <= U.MOST
    assert rows["u2:article:1"].text == "không có điều nào" and rows["u2:article:1"].article_number is None and rows["u2:article:1"].document_title == "B"
    assert not any("bỏ" in r.text for r in rows.values()) and rows["u1:article:1"].source_file == "u1_T-p-A.txt"
    ups = ups.withColumn("document_type", F.lit(None).cast("string"))
    corpus = spark.createDataFrame([("old", "u1_T-p-A.txt", "x"), ("stays", "other", "y")], "chunk_id string, source_file string, text string")
    manifest = spark.createDataFrame([("u0", "public", "z", 0)], "id string, workspace string, source_text_file string, seq long")
    kept, items, docs = U.persist(corpus, manifest, ups)
    ids = {r.chunk_id for r in kept.collect()}
    assert "old" not in ids and "stays" in ids and "u1:article:1" in ids and not any(i.startswith("u2") for i in ids)
    assert {r.id for r in items.collect()} == {"u0", "u1", "u2"} and items.orderBy("seq").collect()[-1].id == "u0" and U.processed(items).first().id == "u2"
    assert {r.id: r.quality_warning is None for r in docs.collect()} == {"u1": True, "u2": False}
    less, left = U.removed(kept, items, spark.createDataFrame([("u1",)], "id string"))
    assert {r.chunk_id for r in less.collect()} == {"stays"} and {r.id for r in left.collect()} == {"u0", "u2"}
    states = spark.createDataFrame([("a", "processing", 10, None), ("b", "ready", 100, None)], "id string, status string, progress int, error string")
    ev = spark.createDataFrame([("a", 1, "ocr_complete", 100, None), ("a", 2, "ready", 100, None), ("b", 1, "failed", 0, "x")], "id string, seq int, status string, progress int, error string")
    assert {r.id: r.status for r in U.advanced(states, ev).collect()} == {"a": "ready", "b": "ready"}
    assert [r.path for r in U.allowed(spark.createDataFrame([("a.PDF",), ("b.exe",)], "path string")).collect()] == ["a.PDF"]
    assert U.tracked(states, spark.createDataFrame([("a", "failed")], "id string, status string")).orderBy("id").first().status == "failed"


def test_sessions(spark):
    new = spark.createDataFrame([("s", "user", "  ", "2024-01-01T00:00:00Z", 0), ("s", "user", "q" * 70, "2024-01-01T00:01:00Z", 1), ("s", "assistant", "a", "2024-01-01T00:02:00Z", 2)], "session_id string, role string, content string, timestamp string, seq long")
    first = S.appended(spark.createDataFrame([], S.SESSION), new)
    more = S.appended(first, spark.createDataFrame([("s", "user", "again", "2024-01-02T00:00:00Z", 0), ("t", "assistant", "hi", None, 0)], "session_id string, role string, content string, timestamp string, seq long"))
    rows = {r.session_id: r for r in S.summaries(more).collect()}
    assert rows["s"].title == "q" * 60 + "..." and rows["s"].message_count == 4 and rows["s"].updated_at == "2024-01-02T00:00:00Z" and rows["t"].title == S.UNTITLED
    change = lambda t, p, a: spark.createDataFrame([("s", t, p, a)], "session_id string, title string, pinned boolean, archived boolean")
    done = S.patched(more, change(" new ", True, None))
    assert [r.session_id for r in S.sorted_sessions(S.summaries(done)).collect()][0] == "s" and S.summaries(done).where("session_id = 's'").first().title == "new"
    assert [r.session_id for r in S.visible(S.summaries(S.patched(more, change(None, None, True)))).collect()] == ["t"]
    with pytest.raises(Exception, match="title cannot be empty"):
        S.patched(more, change(" ", None, None)).collect()
    talk = S.conversation(done.where("session_id = 't'"), F.to_timestamp(F.lit("2024-05-05 00:00:00"))).first()
    assert talk.role == "assistant" and str(talk.timestamp) == "2024-05-05 00:00:00" and talk.id.startswith("msg-")
    m = one(spark, S.memory(F.col("t")), t='ok {"case_summary": " x ", "facts": {"a": "1"}, "missing_fields": ["", "b"], "need_clarification": true} end')
    assert (m.case_summary, m.facts, m.missing_fields, m.need_clarification, m.retrieval_query) == ("x", {"a": "1"}, ["b"], True, "")
    assert one(spark, S.memory(F.col("t")), t="none").facts == {}


def test_jobs_and_settings(spark):
    seen = []
    good, bad = jobs.run("crawl", [lambda: 1, lambda: 2], seen.append), jobs.run("x", [lambda: 1 / 0], seen.append)
    assert good["status"] == "completed" and good["progress"] == 100 and bad["status"] == "failed" and "division" in bad["error"]
    assert [j["progress"] for j in seen[:4]] == [5, 50, 95, 100]
    old = spark.createDataFrame([("a", "x", 0), ("b", "x", 1)], "id string, status string, seq long")
    assert [(r.id, r.status) for r in jobs.upsert(old, spark.createDataFrame([("b", "y"), ("c", "z")], "id string, status string")).orderBy("seq").collect()] == [("c", "z"), ("a", "x"), ("b", "y")]
    env = {"A": "kept"}
    config.load('# c\nx = 1\nA_alias="2"\nB-alias=\'3\'\nbad', {"A": ["A_alias"], "B": ["B", "B-alias"], "C": ["none"]}, env)
    assert env == {"A": "kept", "B": "3"}
    assert config.updated("a=1\n# b=2\nc=3", {"c": "4", "d": "5"}) == "a=1\n# b=2\nc=4\n\nd=5\n"
    assert config.setting({"RAG_MODE": "local"}, "EMBEDDING_PROVIDER") == "sentence-transformers" and config.setting({"EMBEDDING_MODEL": "m"}, "EMBEDDING_MODEL") == "m"
    with pytest.raises(ValueError):
        config.mode({"RAG_MODE": "x"})
    assert config.settings({"top_k": 99, "mode": "bm25"}) == {"mode": "bm25", "vector_backend": "faiss", "top_k": 20, "query_rewrite": True} and config.origins(("a",), "b, a,") == ["a", "b"]


def test_rules(spark, tmp_path):
    path = str(tmp_path / "rules.json")
    (tmp_path / "rules.json").write_text(json.dumps([{"label": "L", "avoid_articles": ["9 "], "preferred_articles": [" 5", ""], "confidence": 0.9}, "skip", {"issue_type": "T", "distinguish_from_articles": ["1"], "avoid_articles": ["2"]}]))
    df, digest = readers.rules(spark, path)
    names = [f.name for f in readers.RULE]
    out = df.select(rules.match_payload({n: F.col(n) for n in names}, F.col("states_distinguish"), F.lit(0.9), F.lit("semantic"), F.lit(0.12345678), F.lit("")).alias("m")).select("m.*").collect()
    assert [(r.label, r.preferred_articles, r.distinguish_from_articles, r.semantic_score, r.semantic_query) for r in out] == [("L", ["5"], ["9"], 0.123457, None), ("T", [], ["1"], 0.123457, None)]
    assert len(digest) == 64 and readers.rules(spark, str(tmp_path / "none"))[0].count() == 0
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="array"):
        readers.rules(spark, str(tmp_path / "bad.json"))
    entries = spark.createDataFrame([("L",)], "label string")
    manifest = {"rules_sha256": digest, "embedding_provider": "p", "embedding_model": "m", "count": 1}
    assert K.rules_index(entries, manifest, digest, "p", "m") is not None and K.rules_index(entries, manifest, digest, "q", "m") is None and K.rules_index(entries, manifest | {"count": 2}, digest, "p", "m") is None
    kept = rules.sane_rewrites(spark.createDataFrame([("xin hỏi vay tiền", "vay nợ"), ("xin hỏi", "luật gì"), ("xin hỏi", "abc"), ("", "abc"), ("x", " ")], "question string, rewrite string"))
    assert [r.rewrite for r in kept.collect()] == ["vay nợ", "luật gì", "abc"]
    modes = spark.createDataFrame([("none", True, True), ("llm", True, True), ("llm", False, True), ("llm", False, False)], "m string, h boolean, r boolean").select(rules.rewrite_source(F.col("m"), F.col("h"), F.col("r")))
    assert [r[0] for r in modes.collect()] == ["rules_only", "rules_high_confidence", "llm_with_rule_hints", "llm"]
    planned = spark.createDataFrame([(1, 0, "a"), (1, 1, "A "), (1, 2, "b")], "query long, seq long, question string")
    graphed = spark.createDataFrame([(1, 0, "c"), (1, 1, "d")], "query long, seq long, question string")
    assert [r.question for r in H.active_questions(planned, graphed).orderBy("position").collect()] == ["a", "b", "c"]


def test_evaluation_runs(spark):
    rows = spark.createDataFrame([("a", "x", "Q colloquial", 4.0, 0.0, 1.0), ("b", "x", "Q", 5.0, 3.0, 1.0), ("c", "y", "Q", 5.0, 4.0, 0.5), ("d", "y", "Q", 5.0, 5.0, 1.0)], "case_id string, category string, question string, overall double, groundedness double, recall_at_5 double")
    assert {r.case_id for r in E.problem_cases(rows).collect()} == {"b", "c"}
    assert [tuple(r) for r in E.category_counts(rows, "category").collect()] == [("x", 2), ("y", 2)]
    assert {r.kind: r.overall for r in E.by_phrase(rows, F.col("question"), "colloquial", ["overall"]).collect()} == {"colloquial": 4.0, "standard": 5.0}
    assert {r.metric: r["mean"] for r in E.numeric_means(rows).collect()} == {"overall": 4.75, "groundedness": 3.0, "recall_at_5": 0.875}
    failed = spark.createDataFrame([("e", "x", "Q", "boom")], "case_id string, category string, question string, error string")
    assert {r.case_id: (r.overall, r.error) for r in E.case_rows(rows, failed, ["overall", "groundedness"]).collect()}["e"] == (1.0, "boom")
    results = spark.createDataFrame([("a", " q ", "x", [("", "p" * 9), (" ", ""), ("t", "")])], "case_id string, question string, answer string, sources array<struct<text:string,preview:string>>")
    data = spark.createDataFrame([("a", [" p ", ""], ["t"]), ("b", [], ["u"])], "id string, answer_points array<string>, required_terms array<string>")
    r = E.judge_rows(results, data, 2, 5).first()
    assert (r.question, r.contexts, r.ground_truth) == ("q", ["p" * 5], "p")
    assert [x[0] for x in data.select(E.reference_text(F.col("answer_points"), F.col("required_terms"))).collect()] == ["p", "u"]
    t = spark.createDataFrame([([("a", 5), ("b", None)],), ([],)], "t array<struct<n:string,ms:int>>").select(E.slowest(F.col("t")))
    assert [x[0] for x in t.collect()] == [5, 0]
    assert tuple(E.latency(spark.createDataFrame([(10,), (20,), (None,)], "latency_ms long")).first()) == (15.0, 20)
    chunks = spark.createDataFrame([(1, "Luật Đất đai", "1", "f", "5", "Điều 5. Đầu đề\nMột câu đủ dài để giữ lại ở đây. Ngắn."), (2, "Luật khác", "2", "g", "5", "x")], "doc long, document_title string, doc_number string, source_file string, article_number string, text string")
    cases = spark.createDataFrame([("k", "c", "hỏi", "đất đai", "5"), ("none", "c", "hỏi", "không", "5")], "id string, category string, question string, doc_hint string, article string")
    lists = spark.createDataFrame([("k", 1, 2), ("k", 2, 1)], "query string, rank int, doc long")
    made = E.generated_cases(cases, lists, lists.where("doc = 2"), chunks).collect()
    assert len(made) == 1 and made[0].answer_points[0] == "Cần đối chiếu Điều 5. Đầu đề trong Luật Đất đai." and made[0].required_terms == ["Điều 5", "đất đai"] and "not_in_top_30" in made[0].notes and "chunk_id=1" in made[0].notes


def test_stores_and_indexes(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red green blue"), (2, "green green"), (3, "yellow")], "doc long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    c = H.Columns("doc", "text", "query", "question")
    a, b = H.stored_sources(docs, c), H.stored_sources(docs, c)
    assert a.index.postings.inputFiles() == b.index.postings.inputFiles()  # built once
    fresh = L.build_index(docs, "doc", X.tokens(F.col("text")))
    for name in ("postings", "dictionary", "stats"):
        assert sorted(map(repr, getattr(a.index, name).select(*sorted(getattr(fresh, name).columns)).collect())) == sorted(map(repr, getattr(fresh, name).select(*sorted(getattr(fresh, name).columns)).collect())), name
    spark.createDataFrame([(4, "white")], "doc long, text string").write.mode("append").parquet(path)
    assert H.stored_sources(spark.read.parquet(path), c).index.stats.first().n == 4  # other files, another index
    vectors, manifest = V.stored_vectors(docs, lambda: V.hash_embed(docs, "doc", X.tokens(F.col("text"))), "vv", provider="hash", model="m")
    m = manifest.first()
    assert (m["count"], m.dimension, m.provider) == (3, 64, "hash") and vectors.count() == 3
    assert L.choose_index({"fts": None, "bm25": fresh})[0] == "bm25"
    with pytest.raises(ValueError):
        L.choose_index({})
    made = V.embed(docs, "doc", F.col("text"), lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert made.first().embedding == [1.0, 0.0] and not made.first().trimmed
    ms = spark.createDataFrame([("a", True, "Hash"), ("b", True, "openai"), ("c", False, "hash"), ("d", True, None)], "folder string, built boolean, provider string")
    assert [r.folder for r in V.usable(ms, "hash").collect()] == ["a"] and {r.folder for r in V.usable(ms, None, ("openai",)).collect()} == {"a", "b"}
    ups = spark.createDataFrame([("private", "u/1/chunks.json", None, None), ("private", "u/1/chunks.json", "a/x.index", None), ("public", "p/chunks.json", None, None)], "workspace string, chunks_path string, api_index string, local_index string")
    ch, folders = K.private_sources(ups, spark.createDataFrame([("u/1/embeddings/api", True, "hash"), ("a", True, "hash")], "folder string, built boolean, provider string"), "hash")
    assert [r.chunks for r in ch.collect()] == ["u/1/chunks.jsonl"] and {r.folder for r in folders.collect()} == {"u/1/embeddings/api", "a"}
    meta = spark.createDataFrame([(0, "x"), (1, "y")], "vec_idx long, name string")
    assert [r.name for r in V.rows_of(meta, spark.createDataFrame([(1,), (-1,), (7,)], "vec_idx long")).collect()] == ["y"]
    t = stores.Table(spark, str(tmp_path / "root"), "t", "k long, v string")
    assert t.read().count() == 0
    t.replace(spark.createDataFrame([(1, "a")], "k long, v string"))
    t.replace(t.read().unionByName(t.read()))
    assert t.read().count() == 2


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    exact, near = ({(r.query, r.id) for r in f(df, q, 10).collect()} for f in (V.top_k, V.approximate))
    assert len(exact & near) / len(exact) >= 0.9


def fetch_pages(page, size, kinds=None, states=None):
    rows = [{"id": str(k)} for k in range(5) if not kinds or str(k) in kinds]
    return {"items": rows[page * size : (page + 1) * size], "total": len(rows)}


def fetch_detail(i):
    return {"id": i, "title": f"T{i}"}


def test_readers_and_writers(spark, tmp_path):
    spark.dataSource.register(readers.PagedSource)
    where = f"{__name__}:"
    rows = spark.read.format("paged").option("fetch", where + "fetch_pages").option("size", 2).load()
    assert {r.page for r in rows.collect()} == {0, 1, 2} and rows.count() == 5
    some = spark.read.format("paged").option("fetch", where + "fetch_pages").option("size", 2).option("filters", '{"kinds": ["1", "4"]}').load()
    assert [json.loads(r["item"])["id"] for r in some.collect()] == ["1", "4"]
    d = readers.details(spark.createDataFrame([("1",), ("2",)], "id string"), where + "fetch_detail", K.DETAIL)
    assert sorted(r.detail.title for r in d.collect()) == ["T1", "T2"]

    def gone():
        raise OSError("no network")

    assert readers.category_ids(["b", "a"], lambda: [{"name": "a", "id": "2"}], {"a": "1", "b": "3"}) == {"b": "3", "a": "2"} and readers.category_ids(["a"], gone, {"a": "1"}) == {"a": "1"}
    with pytest.raises(ValueError, match="unknown: z"):
        readers.category_ids(["z"], gone, {})
    p = tmp_path / "x.json"
    p.write_text('{"items": [1]} trailing')
    assert readers.recovered(spark, str(p), None) == {"items": [1]} and json.loads(p.read_text()) == {"items": [1]} and readers.recovered(spark, str(tmp_path / "no"), 5) == 5
    assert readers.dataset(spark, str(tmp_path / "cases.json"), [{"id": "s"}]) == [{"id": "s"}] == json.loads((tmp_path / "cases.json").read_text())
    df = spark.createDataFrame([("1", ["a", "b"])], "vbpl_id string, majors array<string>")
    writers.write_csv(df, str(tmp_path / "csv"))
    text = max((f.read_text(encoding="utf-8") for f in (tmp_path / "csv").glob("*.csv")), key=len)
    assert text.startswith("\ufeffvbpl_id,title,") and len(text.split("\n")[0].split(",")) == 24 and "a | b" in text
    writers.write_corpus(df, df, str(tmp_path / "corpus"), note="n")
    assert json.loads((tmp_path / "corpus" / "manifest.json").read_text()) == {"note": "n", "documents": 1, "chunks": 1}
    writers.write_archive(spark, str(tmp_path / "corpus"), str(tmp_path / "out.zip"))
    import zipfile

    assert any(n.endswith("manifest.json") for n in zipfile.ZipFile(tmp_path / "out.zip").namelist())
    spark.createDataFrame([(1, "a"), (2, "b")], "v long, f string").write.partitionBy("f").parquet(str(tmp_path / "parts"))
    writers.rewrite_existing(spark.createDataFrame([(9, "a"), (9, "new")], "v long, f string"), str(tmp_path / "parts"), "f", str(tmp_path / "bak"))
    assert {(r.v, r.f) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {(9, "a"), (2, "b")} and spark.read.parquet(str(tmp_path / "bak")).count() == 1
    assert K.checksum(spark.read.format("binaryFile").load(str(p))).first().sha256 == __import__("hashlib").sha256(p.read_bytes()).hexdigest()


def test_tables_of_contents(spark):
    tree = [{"id": 1, "title": " A  b ", "children": [{"name": "x", "items": [{"key": "k", "number": 5}]}, "bad"]}, {"provisionId": "p", "type": "T"}]
    rows = graph.toc_nodes(json.dumps(tree))
    assert [(r["id"], r["parent_id"], r["depth"], r["title"], r["article_number"]) for r in rows] == [("1", None, 0, "A b", None), (None, "1", 1, "x", None), ("k", "1", 2, None, "5"), ("p", None, 0, None, None)]
    assert graph.toc_nodes("no") == [] and graph.toc_nodes(None) == []
    out = spark.createDataFrame([(json.dumps(tree),)], "j string").select(F.explode(graph.flatten_toc("j")).alias("n")).select("n.*").collect()
    assert [r.asDict() for r in out] == rows
    chain = spark.createDataFrame([(k, k - 1 if k else None, "t") for k in range(40)], "id long, parent_id long, title string")
    deep = {r.id: r.depth for r in graph.flatten_hierarchy(chain).collect()}
    assert deep == {k: k for k in range(40)}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), answer=lambda q, c: "theo 9/9999/ABC" if "[Nguồn 1]" in c else "?")
    rows = [("c1", "f1", "1", "1/2020/QH", "Luật", "Luật Một", "5", "vay tiền trả lãi"), ("c2", "f2", "2", "2/2020/QH", "Luật", "Luật Hai", "6", "đất đai nhà ở")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, vbpl_id string, doc_number string, doc_type string, document_title string, article_number string, text string")
    e.chunks.replace(T.complete(chunks, e.chunks.schema))
    e.records.replace(T.complete(spark.createDataFrame([("1", "Luật Một", 3), ("2", "Luật Hai", 0)], "vbpl_id string, title string, chunk_count long"), e.records.schema))
    out = e.ask("vay tiền", "s1", "2024-01-01T00:00:00+00:00", {"top_k": 1})
    assert out["sources"][0]["document_title"] == "Luật Một" and out["warnings"] == ["Answer cites a document not present in retrieved sources: 9/9999/abc"]
    assert e.list_sessions().first().title == "vay tiền" and e.conversation("s1").count() == 2
    e.change_session("s1", title="mới", archived=True)
    assert e.list_sessions().first().title == "mới"
    e.delete_session("s1")
    assert e.list_sessions().count() == 0
    assert {m: df.count() > 0 for m, df in e.debug(spark.createDataFrame([(0, "đất đai")], "query long, question string")).items()} == dict.fromkeys(H.MODES, True)
    page = e.documents(1, 1)
    assert page.first().total == 2 and page.first().has_more and e.document("2").first().status == "crawled" and e.documents(text="một").count() == 1
    s = e.status().first()
    assert (s.documents, s.chunked, s.chunks) == (2, 1, 3)
    assert e.run_job("index", [lambda: e.build()])["status"] == "completed" and e.list_jobs().first().status == "completed"
    files = spark.createDataFrame([("u1", "a.docx", "public", "Điều 1. Một: 1. x", 0.9), ("u2", "b.pdf", "private", None, None), ("u3", "c.docx", "public", "mờ", 0.2)], "id string, file_name string, workspace string, text string, confidence double")
    e.upload(files)
    e.review(spark.createDataFrame([("u1", "Điều 1. Một: 1. sửa", "law")], "id string, text string, document_type string"))
    e.embed(["u1", "u2", "u3"])
    assert {r.id: r.status for r in e.uploads.read().collect()} == {"u1": "ready", "u2": "failed", "u3": "ocr_complete"} and [r.id for r in e.processed().collect()] == ["u1"]
    assert e.chunks.read().where("text LIKE '%sửa%'").count() == 1
    e.delete_processed(["u1"])
    assert e.chunks.read().count() == 2 and e.processed().count() == 0


def test_entry_passes_over_removed_modules_alone(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def missing(name):
        def load(asked, *more):
            raise ModuleNotFoundError(f"no {name}", name=name)

        return load

    monkeypatch.setattr(importlib, "import_module", missing("spindrift.llm"))
    assert entry._found("spindrift.llm") is None and entry._found("corpus_pipeline") is None
    monkeypatch.setattr(importlib, "import_module", missing("some_library"))
    for name in ("spindrift.llm", "corpus_pipeline"):
        with pytest.raises(ModuleNotFoundError):
            entry._found(name)
