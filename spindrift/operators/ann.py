"""Approximate vector search: cells of a coarse quantiser, product-quantised residuals,
exact scores of the best candidates.

The quantisers are fitted on a sample of at most ``SAMPLE`` vectors, those with the
smallest hashes of their ids; every vector is then assigned to its cell and coded, and
the codes are stored sorted by cell, so that a search skips the row groups of cells that
no question probes. How many cells a question probes is tuned on the sample: as few as
hold ``TARGET`` of the nearest neighbours there. Where vectors are clustered that is a
few; vectors without any structure share no cells with their neighbours, and most cells
are probed, at the price of their codes, which are a sixteenth of the vectors or less.

Codes do not tell near copies apart. Where more rows than there are candidates may be as
near to a question as its k-th best, by the error of the codes, the question is crowded,
and answered by exact search.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import stores as S
from ..functions.vector import dot
from .vectors import first_own, merged, top_k

#: Vectors that the quantisers are fitted on, and of these such that probes are tuned with.
SAMPLE, ASKED = 16_384, 256
#: Dimensions of a part of a vector that one byte codes, rounds of fitting.
PART, ROUNDS = 4, 8
#: Most cells; vectors of the sample a cell has at least, on average.
MOST_CELLS, A_CELL = 4096, 32
TARGET, NEIGHBOURS = 0.95, 10
#: Most questions of a batch; questions and codes that meet at a time.
MOST, BLOCK, ROWS = 20_000, 256, 8192


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray  # cell, dimension
    books: np.ndarray  # part, code, dimension of the part
    probes: int
    #: Standard error of a score by codes, measured on the sample.
    error: float = 0.0

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes of vectors."""
        cell = nearest(x, self.centres)
        rest = padded(x - self.centres[cell], self.books.shape[0])
        return cell, np.stack([nearest(part, book) for part, book in zip(np.split(rest, self.books.shape[0], axis=1), self.books)], axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[c] for book, c in zip(self.books, code.T)], axis=1)
        return self.centres[cell] + rest[:, : self.centres.shape[1]]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[k : k + ROWS] @ centres.T - half).argmax(axis=1) for k in range(0, max(len(x), 1), ROWS)])


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, parts * PART - x.shape[1])))


def fitted(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k of the vectors; an empty centre moves to a vector that is
    far from its own."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[far[: len(centres)]] if len(far) >= len(centres) else centres)
    return centres


def fit(sample: np.ndarray, cells: int | None = None, seed: int = 7) -> Quantiser:
    """cells: as many as there are vectors of the sample for, if not given."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    parts = -(-dim // PART)
    k = max(1, min(cells or MOST_CELLS, n // A_CELL, MOST_CELLS))
    centres = fitted(sample, k, rng)
    own = nearest(sample, centres)
    rest = padded(sample - centres[own], parts)
    books = np.stack([fitted(part, min(256, n), rng) for part in np.split(rest, parts, axis=1)])
    asked = rng.permutation(n)[:ASKED]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :NEIGHBOURS]
    order = np.argsort(-(sample[asked] @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # the place of each cell among those of a question
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).reshape(-1))
    probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]) + 1 if len(needed) else 1
    made = Quantiser(centres, books, probes)
    return Quantiser(centres, books, probes, float((sample[asked] @ (sample - made.decoded(*made.code(sample))).T).std()))


@dataclass(frozen=True)
class Cells:
    quantiser: Quantiser
    codes: DataFrame  # cell, id, code
    vectors: DataFrame  # id, v


def _coded(quantiser: Quantiser):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                cell, code = quantiser.code(x)
                codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.array(np.arange(len(x) + 1) * code.shape[1], pa.int32()).buffers()[1], pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), codes], ["cell", "id", "code"])

    return run


def build(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, name: str = "cells") -> Cells:
    """The index of ``vectors`` (all of one length, none null): as stored, if it is of
    these files, else fitted, coded and stored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    key = f"{name}-{S.signature(vectors, id_col, vec_col, str(cells), '2')}"

    def make() -> dict[str, DataFrame]:
        rows = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded
        if not rows:
            q = Quantiser(np.zeros((0, 0)), np.zeros((0, 1, PART)), 1)
        else:
            q = fit(np.array([r["v"] for r in rows], np.float64), cells)
        codes = v.mapInArrow(_coded(q), "cell int, id long, code binary")
        # by range, so that a large cell is several files; sorted, so that others are skipped
        codes = codes.repartitionByRange("cell", "id").sortWithinPartitions("cell")
        fitted_ = spark.createDataFrame([(bytearray(pickle.dumps((q.centres, q.books, q.probes, q.error))),)], "quantiser binary")
        return {"codes": codes, "quantiser": fitted_, "vectors": v}

    held = S.kept(spark, key, make)
    return Cells(Quantiser(*pickle.loads(held["quantiser"].first()[0])), held["codes"], held["vectors"])  # noqa: S301  written above


def _scan(names: np.ndarray, asked: np.ndarray, q: Quantiser, probed: np.ndarray, k: int, own: bool):  # noqa: ANN202
    """(query, id, score, met): a task's best k candidates of each question by its codes,
    and as id null the number of codes it has met."""
    parts = q.books.shape[0]
    base = asked @ q.centres.T
    split = np.stack(np.split(padded(asked, parts), parts, axis=1))  # part, question, dimension
    blocks = [slice(a, a + BLOCK) for a in range(0, len(names), BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(blocks)
        met = np.zeros(len(names), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                some = whole.slice(start, ROWS)
                cells, ids = some.column(0).to_numpy(), some.column(1).to_numpy()
                codes = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint8).reshape(len(ids), parts)
                present, of = np.unique(cells, return_inverse=True)
                met += probed[:, present] @ np.bincount(of)
                for n, block in enumerate(blocks):
                    table = np.einsum("pqd,pcd->pqc", split[:, block], q.books)  # part, question, code
                    scores = np.full((table.shape[1], len(ids)), -np.inf)
                    for k_, cell in enumerate(present.tolist()):
                        who, rows = np.flatnonzero(probed[block, cell]), np.flatnonzero(of == k_)
                        if len(who):
                            scores[np.ix_(who, rows)] = base[block][who, cell][:, None] + sum(table[p][np.ix_(who, codes[rows, p])] for p in range(parts))
                    best[n] = merged(best[n], first_own(scores, names[block], ids) if own else scores, ids, k)
        for block, found in zip(blocks, best):
            if found is not None:
                s, i = found
                who, at = np.nonzero(np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(names[block][who]), pa.array(i[who, at]), pa.array(s[who, at]), pa.nulls(len(who), pa.int64())], ["query", "id", "score", "met"])
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64()), pa.array(met[some])], ["query", "id", "score", "met"])

    return run


def candidates(index: Cells, questions: DataFrame, many: int, probes: int | None = None, vec_col: str = "embedding", query_col: str = "query", own: bool = False) -> DataFrame:
    """(query, id, score, met): the ``many`` best of each question and task by codes;
    rows without an id say how many codes a task has met for a question."""
    rows = questions.select(F.col(query_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"at most {MOST} questions a batch; split the questions")
    form, q = "query long, id long, score double, met long", index.quantiser
    if not rows or not len(q.centres):
        return questions.sparkSession.createDataFrame([], form)
    names, asked = np.array([r["q"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)
    order = np.argsort(-(asked @ q.centres.T), axis=1)[:, : probes or q.probes]
    probed = np.zeros((len(names), len(q.centres)), bool)
    np.put_along_axis(probed, order, True, axis=1)
    wanted = np.flatnonzero(probed.any(axis=0)).tolist()
    codes = index.codes if len(wanted) == len(q.centres) else index.codes.where(F.col("cell").isin(wanted))
    return codes.select("cell", "id", "code").mapInArrow(_scan(names, asked, q, probed, many, own), form)


def search(index: Cells, questions: DataFrame, k: int, many: int | None = None, probes: int | None = None, vec_col: str = "embedding", query_col: str = "query", own: bool = False) -> DataFrame:
    """(query, rank, id, score): of the ``many`` best by codes (20 k, 100 at least) those
    with the greatest inner products; crowded questions (see above) by exact search. Ties
    go to the smaller id; own: questions are rows of the table, by their ids, and each of
    them goes before those that tie with it."""
    n = max(many or max(20 * k, 100), k)
    found = candidates(index, questions, n, probes, vec_col, query_col, own).where(F.col("id").isNotNull())
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    few = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("query", "id", F.col("score").alias("coded"))
    q = questions.select(F.col(query_col).cast("long").alias("query"), F.col(vec_col).cast("array<double>").alias("qv"))
    scored = few.join(index.vectors, "id").join(q, "query").select("query", "id", "coded", F.round(dot(F.col("qv"), F.col("v")), 6).alias("score"))
    scored, _ = S.stored(scored, "scored")
    at = Window.partitionBy("query").orderBy(F.desc("score"), *([F.col("id") != F.col("query")] if own else []), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(at))
    each = ranked.groupBy("query").agg(F.count("*").alias("n"), F.min("coded").alias("least"), F.min(F.when(F.col("rank") <= k, F.col("score"))).alias("kth"))
    crowded, some = S.stored(each.where((F.col("n") >= n) & (F.col("least") + F.lit(index.quantiser.error) > F.col("kth"))).select("query"), "crowded")
    out = ranked.where(F.col("rank") <= k).select("query", "rank", "id", "score")
    if not some:
        return out
    exact = top_k(index.vectors, q.join(F.broadcast(crowded), "query"), k, "id", "v", "query", vec_of="qv", own=own)  # at most MOST
    return out.join(F.broadcast(crowded), "query", "left_anti").unionByName(exact)


def recall(index: Cells, exact: DataFrame, questions: DataFrame, k: int, probes: int | None = None, vec_col: str = "embedding", query_col: str = "query") -> DataFrame:
    """One row: the share of ``exact`` (query, id: the k best of each question) that a
    search finds, of all codes those that a question meets, of all vectors those whose
    exact scores are taken."""
    found = search(index, questions, k, None, probes, vec_col, query_col)
    met = candidates(index, questions, 1, probes, vec_col, query_col).where(F.col("id").isNull()).agg(F.sum("met").alias("met"))
    n = index.codes.agg(F.count("*").alias("n"))
    asked = questions.agg(F.count("*").alias("q"))
    hits = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    scored = F.least(F.lit(max(20 * k, 100)).cast("double"), F.col("n").cast("double")) / F.col("n")
    return hits.crossJoin(met).crossJoin(n).crossJoin(asked).select("recall", (F.col("met") / F.col("n") / F.col("q")).alias("codes_met"), scored.alias("vectors_scored"), F.lit(index.quantiser.probes).alias("probes"), F.lit(len(index.quantiser.centres)).alias("cells"))
