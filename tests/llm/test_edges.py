"""Every query over tables with nulls, empties, repeats and clashes, and empty ones."""

from __future__ import annotations

import pytest

from spindrift import llm
from tests.llm.conftest import EDGE, PAGES

NAMES = sorted(llm.queries())
BY_DOCUMENT = [n for n in NAMES if not n.startswith(("op3", "op4", "op8", "op11", "op12"))]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_a_row(spark, edge, name):
    rows = llm.queries()[name](spark, edge).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in EDGE)


def test_one_row_a_page(spark, edge):
    rows = llm.queries()["op3_warc_transactions"](spark, edge).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in rows) == sorted((p[0] is None, p[0] or 0) for p in PAGES)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    rows = llm.queries()[name](spark, empty).collect()
    assert [r["conv_id"] for r in rows] == [-1] if name.startswith("op4") else rows == []


def test_pipeline_edges(spark, edge, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()
    rows = corpus_pipeline.run(spark, edge).collect()
    assert rows


def inner_names():
    """Every name that the sources give a column, and some more."""
    import re
    from pathlib import Path

    source = "".join(p.read_text() for p in Path(llm.__file__).parent.glob("*.py"))
    found = {m for m in re.findall(r'"([A-Za-z_]\w*)"', source)} | {"linked", "d", "r", "__s", "__row", "__all", "__found", "__hits", "__of", "__lines", "__cut", "__host", "__fp", "__q", "a.b", "x y"}
    own = {"doc_id", "text", "lang", "source", "n_chars"}
    return sorted(n for n in found if n.lower() not in own)


def test_stages_keep_clashing_columns(spark, edge):
    """Columns of any name pass through every stage and change nothing."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    plain = spark.read.parquet(f"{edge}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    lower = {}
    for n in inner_names():
        lower.setdefault(n.lower(), n)
    names = sorted(lower.values())
    assert len(names) > 100
    more = plain.select("*", *[F.lit(f"x {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(map(repr, stage(spark, plain, edge).collect()))
        out = stage(spark, more, edge)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert sorted(repr(r) for r in out.select(*plain.columns).collect()) == want, name
        assert all(r[n] == f"x {n}" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1]
    places = lambda df: sorted((r["doc_id"] or 0, r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert places(last(spark, more, edge)) == places(last(spark, plain, edge))


def test_shared_folder():
    """As the session has it; none is made up on a cluster."""
    from types import SimpleNamespace

    from spindrift.llm.common import shared_dir

    made = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(made("spark://x:1", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(made("local[4]")).endswith("checkpoints")
    for master in ("spark://x:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(made(master))
