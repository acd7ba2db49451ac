"""WARC transactions, chat formatting, toxicity and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spindrift.llm import chat, quality, simhash, toxicity, warc
from tests.llm.test_documents import brute_print, grouped

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small", [True, False])
def test_op3(spark, edge, small):
    folder = SMALL if small else edge
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    want = []
    for r in rows:
        b, low = (r.html or "").encode(), first.get(r.html or "")
        kind = ("response", None) if low is None or low == r.page_id else ("revisit", low)
        want.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *kind))
    got = warc.op3_warc_transactions(spark, folder).collect()
    assert grouped(r[:5] for r in got) == grouped(want)
    assert all(r.request_id for r in got) and len({r.capture_id for r in got}) == len(rows)


def test_op3_archives(spark, edge, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.read.parquet(f"{edge}/pages.parquet"), path, least=5)
    records = warc.read_archives(spark, path).collect()
    ids = {r.record_id for r in records}
    assert len(ids) == len(records) and all(r.refers_to in ids for r in records if r.kind == "revisit")
    assert all(r.concurrent_to in ids for r in records if r.kind in ("request", "metadata"))
    assert sum(r.kind == "response" and r.payload_bytes == 0 for r in records) == 2  # below ``least``
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


@pytest.mark.parametrize("small", [True, False])
def test_op4(spark, edge, small):
    folder = SMALL if small else edge
    held = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        held[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    held[-1] = [(True, 0, "user", chat.ADDED), (True, 1, "assistant", chat.ADDED)]
    want = []
    for c, turns in held.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        want.append((c, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest()))
    assert grouped(r[:5] for r in chat.op4_chat_formatting(spark, folder).collect()) == grouped(want)


def test_op4_escapes():
    rng = np.random.default_rng(6)
    pieces = [*chat.CONTROLS, "\\", "<", "[", "s>", "/", "INST]", "|", "a", "\n"]
    for _ in range(500):
        t = "".join(rng.choice(pieces, rng.integers(0, 10)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)
        assert chat.unescape(chat.escape_line(t)) == t


def test_op4_language():
    run = lambda s, **v: chat.compile_template(s, {"one": 1})(v)[0]
    assert run("{% for x in xs %}{{ loop.index }}{{ x['a'] }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": "b"}]) == "11,2b"
    assert run("{% if a == 1 and b %}x{% elif a > 5 %}y{% else %}z{% endif %}", a=7, b=0) == "y"
    assert run("{{ 'a' if c else 'b' }}{{ m.k.z }}{{ q[0] }}{# no #}", c=False, m={"k": {"z": 3}}, q=["t"]) == "b3t"
    assert run("a  {%- set y = 'p' + 'q' -%}  {{ y | upper }}") == "aPQ"
    assert chat.fold_body(chat.parse("{% if one == 1 %}a{{ 'b' + 'c' }}{% else %}d{% endif %}e"), {"one": 1}) == [("text", "abce")]
    text, spans = chat.compile_template("x{% generation %}{{ a }}{% endgeneration %}y")({"a": "ä🙂"})
    assert [text[a:b] for a, b in spans] == ["ä🙂"]
    for bad in ("{{ a() }}", "{{ a.b.__class__() }}", "{% include 'x' %}", "{{ a | nofilter }}", "{% if a %}", "{{ 1 $ 2 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert run("{{ '}}' }}{{ \"%}\" }}{% if 'b' not in 'ac' %}x{% endif %}") == "}}%}x"
    # folded or not, an expression has the same value and fails in the same way
    for e in ("none | upper", "3 | string", "none | length", "'ab' | length", "1 + 2", "none == 1", "'a' in 'ab'", "'a' | escape | upper", "not none", "1 if 0 else 'x'"):
        name = {"none": "n", "3": "t", "1": "o", "'ab'": "w", "'a'": "l"}
        first = re.match(r"'\w+'|\w+", e.removeprefix("not "))[0]
        slow = e.replace(first, name[first], 1)
        assert run("{{ %s }}" % e) == run("{{ %s }}" % slow, n=None, t=3, o=1, w="ab", l="a"), e
    for bad in ("{{ 'a' + 1 }}", "{{ x + 1 }}", "{{ 3 | length }}", "{{ 'a' < 1 }}", "{{ 1 in 2 }}"):
        render = chat.compile_template(bad)
        with pytest.raises(chat.TemplateError):
            render({"x": "a"})
    assert run("{% if false %}{{ 'a' + 1 }}{% endif %}ok") == "ok"
    assert run("{{ a.__class__ }}|{{ 'x'.upper }}", a=[1]) == "|"


def test_op5_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert len(rows) == 10000
    labels = [(r.doc_id, r.toxic, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[i].score, y, q) for i, y, q in labels if rows[i].held_out]
    right = lambda some: np.mean([(s >= 0.5) == (y == 1) for s, y, _ in some])

    def auc(some):
        pos, neg = (np.array([s for s, y, _ in some if y == k]) for k in (1, 0))
        return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()

    assert right(held) > 0.98
    # a text labelled as of low quality may have nothing left of what was toxic in it
    whole = [h for h in held if h[2] == 1]
    assert auc(whole) > 0.99 and right(whole) > 0.98
    assert auc(held) > 0.95


def test_op5_label_model():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(float)
    votes = np.stack([np.where(y == 1, rng.random(4000) < 0.6, rng.random(4000) < 0.05) for _ in range(4)], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, [0]]], axis=1)  # a voter that repeats another
    m = toxicity.LabelModel(5, 0.2).fit(votes, y)
    assert np.abs(m.hit[:4] - 0.6).max() < 0.06 and np.abs(m.miss[:4] - 0.05).max() < 0.03
    assert m.weight[0] < 0.7 and m.weight[4] < 0.7 and m.weight[1] > 0.9


def test_op5_label_model_unlabelled():
    """Few labels, a tenth of them wrong: the texts without a label decide, and the
    label's own accuracy is found. Equal to a plain loop over texts."""
    rng = np.random.default_rng(1)
    n = 20000
    y = rng.random(n) < 0.2
    votes = np.stack([np.where(y, rng.random(n) < h, rng.random(n) < 0.03) for h in (0.7, 0.5, 0.6, 0.4, 0.5, 0.6)], axis=1).astype(float)
    said = np.where(rng.random(n) < 0.1, ~y, y).astype(float)
    said[1000:] = np.nan
    m = toxicity.LabelModel(6, 0.1).fit(votes, said)
    assert np.abs(m.hit - [0.7, 0.5, 0.6, 0.4, 0.5, 0.6]).max() < 0.05 and abs(m.prior - 0.2) < 0.02
    assert 0.8 < m.label[0] < 0.97 and 0.05 < m.label[1] < 0.15
    p = m.posterior(votes)
    assert ((p >= 0.5) == y).mean() > 0.95
    # as counted patterns
    found, counts = np.unique(np.column_stack([votes, np.nan_to_num(said, nan=2)]), axis=0, return_counts=True)
    label = np.where(found[:, 6] == 2, np.nan, found[:, 6])
    c = toxicity.LabelModel(6, 0.1).fit(found[:, :6], label, counts)
    assert np.allclose(c.hit, m.hit, atol=1e-3) and np.allclose(c.miss, m.miss, atol=1e-3)
    # a posterior, spelled out
    for k in range(50):
        odds = math.log(m.prior / (1 - m.prior))
        for j in range(6):
            odds += m.weight[j] * math.log(m.hit[j] / m.miss[j] if votes[k, j] else (1 - m.hit[j]) / (1 - m.miss[j]))
        assert abs(1 / (1 + math.exp(-odds)) - p[k]) < 1e-9


def test_op5_terms_and_classifier(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 12)) + f" x{k}" for k in range(300)]
    rows = [(t + (" vile" if k % 3 == 0 else ""), int(k % 3 == 0)) for k, t in enumerate(clean)]
    names, speaks = toxicity.mine(spark.createDataFrame(rows, "text string, y int"))
    assert names == ["w:vile"] and speaks == [0.0]
    lexicon = toxicity.Lexicon(names, speaks)
    assert lexicon.read("So Vile, vile!") == (3, 1, [0], [2]) and lexicon.read("") == (0, 0, [], [])
    read = [lexicon.read(t) for t, _ in rows]
    m = toxicity.train([(r[0], r[2], r[3]) for r in read], np.array([y for _, y in rows], float), 1)
    assert all((m.score(r[0], r[2], r[3]) >= 0.5) == bool(y) for r, (_, y) in zip(read, rows))
    # the slope of the loss is zero where training ends, by differences
    def loss(a, b, c):
        x = np.array([c + sum(a * (1 + math.log(n)) + b * 10 * math.sqrt(n / r[0]) for n in r[3]) for r in read])
        t = np.array([y for _, y in rows])
        w = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
        return (w * np.where(t == 1, np.log1p(np.exp(-x)), np.log1p(np.exp(x)))).sum() + 0.15 * (a * a + b * b)
    at = (m.presence[0], m.share[0], m.bias)
    for k in range(3):
        up, down = list(at), list(at)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs(loss(*up) - loss(*down)) / 2e-4 < 1e-2


def test_stages_against_brute_force(spark):
    """Each stage of the pipeline on what the one before has kept."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality.keep_good(spark, docs, SMALL)
    verdict = {r.doc_id: r.kept for r in quality.op9_quality_rules(spark, SMALL).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    lines = c.STAGES[1][1](spark, kept, SMALL)
    before = {r.doc_id: r.text for r in kept.collect()}
    rows = lines.collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r.n_chars == len(r.text)
        assert set(r.text.split("\n")) <= set(before[r.doc_id].split("\n"))
    unique = c.STAGES[2][1](spark, lines, SMALL).collect()
    rows.sort(key=lambda r: r.doc_id)
    prints, sets = [brute_print(r.text) for r in rows], [set(simhash.shingle_set(r.text.encode()).tolist()) for r in rows]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    links = np.array([(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)])
    label = simhash.merge(np.arange(len(rows)), *links.T)
    assert {r.doc_id for r in unique} == {rows[k].doc_id for k in np.unique(label)}
    twice = simhash.keep_first(spark, lines.unionByName(lines), SMALL)
    assert sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in unique)
    whole = c.run(spark, SMALL).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in unique}
