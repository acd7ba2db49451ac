"""Operators over embeddings and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from spindrift.llm import centroids, substring, whitening
from tests.llm.conftest import VECTORS

SMALL = "/root/testdata/sf0.001"


def vectors_of(spark, where):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module", params=["edge", "small"])
def folder(request, edge):
    return edge if request.param == "edge" else SMALL


# --- centroids -------------------------------------------------------------------


def plain_lloyd(rows):
    """rows: (id, integers). In Python integers, every vector against every centroid."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [list(x) for _, x in sorted(rows, key=key)[:16]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(cs)), key=lambda k: (far(x, cs[k]), k))
    for _ in range(3):
        held = [[] for _ in cs]
        for _, x in rows:
            held[near(x)].append(x)
        cs = [[sum(col) // len(own) for col in zip(*own)] if own else c for own, c in zip(held, cs)]
    found = [(i, near(x), far(x, cs[near(x)])) for i, x in rows]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found]


def test_op11(spark, folder):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors_of(spark, folder) if finite(v) and len(v) == 64]
    got = [tuple(r) for r in centroids.op11_dual_tree_lloyd(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_lloyd(rows)))


def test_op11_sql(spark):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
        assert sorted(c.execute(centroids.OP11_SQL).fetchall()) == sorted(map(tuple, centroids.op11_dual_tree_lloyd(spark, SMALL).collect()))


@pytest.mark.parametrize("spread", [0, 3, 40, 1 << 24])
def test_cover_tree(spread):
    rng = np.random.default_rng(spread)
    heart = rng.integers(-200, 200, (7, 5))
    points = np.unique(heart[rng.integers(0, 7, 300)] + rng.integers(-spread, spread + 1, (300, 5)), axis=0)
    t = centroids.CoverTree(points)
    assert sorted(t.order.tolist()) == list(range(len(points)))
    x = points[t.order].astype(float)
    for v in range(len(t.low)):
        inside = np.linalg.norm(x[t.low[v] : t.high[v]] - x[t.low[v]], axis=1)
        assert inside.max() <= t.radius[v] + 1e-6
        if t.count[v]:
            own = range(t.first[v], t.first[v] + t.count[v])
            assert [t.low[w] for w in own] == [t.low[v], *[t.high[w] for w in own][:-1]] and t.high[own[-1]] == t.high[v]
            assert t.low[own[0]] == t.low[v]  # a centre is its own child
        else:
            assert t.high[v] == t.low[v] + 1


def test_dual_tree_prunes_and_is_exact():
    """Clustered vectors take far fewer distances than all pairs; ties go to the smaller
    number, equal centroids to the first."""
    rng = np.random.default_rng(5)
    heart = rng.integers(-5000, 5000, (12, 16))
    rows = heart[rng.integers(0, 12, 4000)] + rng.integers(-30, 31, (4000, 16))
    start = np.concatenate([heart, heart[:2], heart[:2] + 1])
    block = centroids.Block(centroids.tree_rows(list(range(4000)), rows), 16)
    (low, high, of), _, taken = centroids.assign(block, start)
    order = np.argsort(low)
    cluster = np.repeat(of[order], (high - low)[order])[block.place]
    far = ((rows[:, None, :] - start[None]) ** 2).sum(axis=2)
    assert cluster.tolist() == far.argmin(axis=1).tolist()
    assert taken < 0.2 * far.size, taken
    tied = centroids.Block(centroids.tree_rows([0, 1], np.array([[0, 0], [0, 0]])), 2)
    assert centroids.assign(tied, np.array([[5, 0], [0, 5], [0, -5]]))[0].tolist() == [[0], [1], [0]]


def test_op11_large_components(spark):
    """Too large for exact products in doubles, but not for longs; then too large."""
    rng = np.random.default_rng(2)
    rows = [(k, [int(x) for x in rng.integers(-(1 << 26), 1 << 26, 64)]) for k in range(40)]
    found, _ = centroids.cluster(spark.createDataFrame(rows, "id long, x array<long>"))
    assert sorted(map(tuple, found.collect())) == sorted(r[:3] for r in plain_lloyd(rows))
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1 << 40] * 64)], "id long, x array<long>"))


# --- whitening -------------------------------------------------------------------


def test_op12(spark, folder):
    given = [(i, v) for i, v in vectors_of(spark, folder) if finite(v)]
    dim = max(len(v) for _, v in given)
    x = [[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in given]
    n, s = len(x), [sum(col) for col in zip(*x)]
    got = whitening.op12_embedding_whitening(spark, folder).collect()
    deviation = lambda row: sum((n * a - b) ** 2 for a, b in zip(row, s))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, deviation(row)) for (i, _), row in zip(given, x))
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    k = int((e > e[0] * whitening.RANK).sum())  # what cannot be scaled is left out
    assert (k == 8 or folder != SMALL) and len(got) == k * n and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    assert all(abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-4 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    for c in range(1, k + 1):
        mine = sorted((round(r.deviation), abs(r.whitened)) for r in got if r.component == c)
        want = sorted((deviation(row), abs(float(z))) for row, z in zip(x, y @ u[:, c - 1] / np.sqrt(e[c - 1])))
        assert np.allclose([m[1] for m in mine], [w[1] for w in want], atol=1e-6)


@pytest.mark.parametrize("bits", [3, 11, 12, 13, 30, 62])
def test_exact_products(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits), 1 << bits, (200, 5))
    x[0] = [-(1 << bits), (1 << bits) - 1, 0, -1, 1]
    assert (sum(part.astype(np.int64).astype(object) << (whitening.LIMB * k) for k, part in enumerate(whitening.limbs(x))) == x).all()
    big = x.astype(object)
    assert (whitening.gram(x) == big.T @ big).all()
    for value in (0, -1, 1 << 100, -(1 << 100) - 7, int(big[0, 0]) ** 2 * 10**9):
        assert whitening.undigits(whitening.digits(value)) == value


def test_op12_without_variance(spark):
    one = lambda rows: whitening.whiten(spark.createDataFrame(rows, "id long, x array<long>")).collect()
    assert one([(1, [5, 6])]) == [] and one([(1, [5, 6]), (2, [5, 6])]) == [] and one([]) == []
    line = one([(k, [k, 3 * k, 0]) for k in range(9)])  # one direction alone
    assert all(len(r.z) == 1 for r in line) and sum(r.z[0] ** 2 for r in line) / 9 == pytest.approx(1)
    far = one([(k, [k << 40, -k << 40]) for k in range(5)])  # squares beyond longs
    assert sorted(int(r.deviation) for r in far) == sorted(2 * (5 * (k << 40) - (10 << 40)) ** 2 for k in range(5))


# --- repeated passages -----------------------------------------------------------


def plain_repeats(rows, length=50):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if i is not None and i < least.get(key, i + 1):
                least[key] = i
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - length + 1):
            if i is not None and least[tuple(w[s : s + length])] < i:
                gone.update(range(s, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts_of(spark, where):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]


def test_op13(spark, folder):
    got = substring.op13_substring_dedup(spark, folder).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_repeats(texts_of(spark, folder))))


def planted():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 400))
    own = lambda n: [word() for _ in range(n)]
    a, b, short = own(80), own(120), own(49)
    docs = [own(30) + a + own(40), own(10) + a[:60] + own(9), own(20) + a + b, b[40:] + own(5), short + own(60), own(3) + short + own(60)]
    # of one seed the first occurrence has less of it than a later one
    left, seed, right = own(34), own(16), own(34)
    docs += [own(40) + seed + own(40), own(40) + left + seed + right + own(20), own(11) + left + seed + right + own(3), left[10:] + seed + right + own(2), own(9) + left + seed + right[:5]]
    # one word, or few, over and over, within a text and across texts
    docs += [["x"] * 300, ["x"] * 75 + own(3), ["x", "y"] * 200, own(2) + ["x", "y"] * 40, ["x"] * 49, ["x"] * 50]
    docs += [a, a, b[:50], own(5) + b[:49], own(700) + a + own(1200) + b + own(30)]
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    rows += [(3, rows[2][1]), (3, rows[3][1]), (None, rows[0][1]), (-4, "  " + "\n".join(a)), (500, rows[0][1] + " "), (501, "\n".join(docs[0])), (502, rows[0][1]), (503, rows[0][1]), (503, rows[0][1])]
    near = [list(docs[-1]) for _ in range(12)]
    for k, d in enumerate(near):
        d[k * 97 % len(d)] = f"new{k}"
    return rows + [(900 - k, " ".join(d)) for k, d in enumerate(near)]


@pytest.mark.parametrize("length,seed", [(50, 16), (50, 50), (20, 5), (8, 1)])
def test_planted_repeats(spark, length, seed, monkeypatch):
    rows = planted()
    for size in (512, 64):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = substring.drop_repeats(docs, length=length, seed=seed, size=size).select("doc_id", "__kept.*").collect()
        mine = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
        assert sorted(map(repr, mine)) == sorted(map(repr, plain_repeats(rows, length)))
        monkeypatch.setattr(substring, "FEW_ROWS", 0)  # the second time by shuffled joins


def test_op13_sql(spark, folder):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if folder == SMALL else '/*.parquet'}'")
        got = substring.op13_substring_dedup(spark, folder).collect()
        assert sorted(map(repr, c.execute(substring.OP13_SQL).fetchall())) == sorted(map(repr, map(tuple, got)))


def test_anchors_are_shared():
    """Equal windows have one anchor at one place, whatever surrounds them."""
    rng = random.Random(8)
    window = [str(rng.randint(0, 3)).encode() for _ in range(50)]
    seen = []
    for _ in range(20):
        around = [[str(rng.randint(0, 3)).encode() for _ in range(rng.randint(0, 60))] for _ in range(2)]
        h, at = substring.anchors(around[0] + window + around[1])
        seen.append({(x, p - len(around[0])) for x, p in zip(h.tolist(), at.tolist()) if 0 <= p - len(around[0]) <= 34})
    assert set.intersection(*seen)


def test_vectors_are_the_edge_cases():
    assert any(v is None for _, v, _ in VECTORS) and any(i is None for i, _, _ in VECTORS)


def test_windows_are_looked_up_once(spark, monkeypatch):
    """A window that has several anchors inside, of several first texts, is one row."""
    rng = random.Random(4)
    parts = [[f"w{rng.randint(0, 10**6)}" for _ in range(40)] for _ in range(8)]
    docs = [sum(parts[k : k + 2], []) for k in range(7)]
    docs += [sum([x if rng.random() < 0.5 else x[:20] + [f"n{k}"] + x[21:] for x in parts], []) for k in range(10)]
    rows, looked_up = [(k, " ".join(d)) for k, d in enumerate(docs)], []

    def seen(df, name):
        out = materialise(df, name)
        if name == "extended":
            looked_up.extend(map(tuple, out.where("a IS NOT NULL").select("id", "h", "start").collect()))
        return out

    materialise = substring.materialise
    monkeypatch.setattr(substring, "materialise", seen)
    got = substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__kept.*").collect()
    mine = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, plain_repeats(rows, 50)))
    assert looked_up and len(set(looked_up)) == len(looked_up)


def test_stretches():
    w = np.array([3, 4, 9, 53, 54, 103, 104, 300])
    lo, hi = substring.stretches(w, 50)
    assert lo.tolist() == [3, 3, 3, 3, 54, 54, 54, 300] and hi.tolist() == [53, 53, 53, 53, 104, 104, 104, 300]
    assert [x.tolist() for x in substring.stretches(w[:0], 50)] == [[], []]


def test_shared_changes_are_looked_up_at_their_ends(spark, monkeypatch):
    """Near copies that share their changes: a few rows a change, not one a window."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    kinds = [base[:at] + [f"n{at}"] + base[at + 1 :] for at in (120, 180, 240)]
    rows, written = [(0, " ".join(base))] + [(1 + k, " ".join([f"own{k}"] + kinds[k % 3])) for k in range(60)], {}

    def seen(df, name):
        written[name] = materialise(df, name)
        return written[name]

    materialise = substring.materialise
    monkeypatch.setattr(substring, "materialise", seen)
    monkeypatch.setattr(substring, "discard", lambda *_: None)
    got = substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "__kept.*").collect()
    mine = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, plain_repeats(rows, 50)))
    windows, least = written["extended"].where("a IS NOT NULL"), written["windows"]
    single = windows.join(least, ["a", "b"]).where("id > least").count()
    spans, _ = substring.looked_up(windows, least)
    assert 0 < 5 * spans.count() < single
