"""Exact vector search, and vector tables; ann.py has approximate search.

Questions are a bounded batch; the corpus is not. Below ``FEW`` questions they are
broadcast and scored in the JVM; above, Arrow batches of vectors meet the matrix of
questions in NumPy. Either way each task keeps its best k a question, so that what
is shuffled for the final ranking is k rows a question and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import stores as S
from ..functions import text as X
from ..functions.vector import dot, normalize

FEW = 32
#: Most questions of a batch, and bytes of their vectors; questions that meet a batch
#: of vectors at a time, and vectors of such a batch.
MOST, MOST_BYTES, BLOCK, ROWS = 20_000, 256_000_000, 512, 2048


def top_k(
    vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query", decimals: int = 6, vec_of: str | None = None, own: bool = False
) -> DataFrame:
    """(query, rank, id, score) by inner product; ties go to the smaller id. vec_of: the
    questions' column of vectors, if not ``vec_col``; own: questions are rows of the
    table, by their ids, and each of them goes before those that tie with it."""
    if vec_of is not None:
        questions = questions.select(query_col, F.col(vec_of).alias(vec_col))
    n, size = questions.agg(F.count("*"), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    parts = max(-(-n // MOST), -(-n * size * 8 // MOST_BYTES), 1)
    if parts > 1:  # one scan of the vectors a block of questions
        blocks = blocks_of(questions, query_col, parts)
        return reduce(DataFrame.unionByName, [top_k(vectors, q, k, id_col, vec_col, query_col, decimals, None, own) for q in blocks])
    scored = _by_columns(vectors, questions, id_col, vec_col, query_col) if n <= FEW else _by_matrix(vectors, questions, k, id_col, vec_col, query_col, decimals, own)
    scored = scored.withColumn("score", F.round("score", decimals))
    w = Window.partitionBy("query").orderBy(F.desc("score"), *([F.col("id") != F.col("query")] if own else []), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def blocks_of(rows: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """Rows in so many parts, and half as many again as these may be uneven."""
    parts = parts + -(-parts // 2)
    return [rows.where(F.pmod(F.xxhash64(key, F.lit(parts)), F.lit(parts)) == i) for i in range(parts)]


def _by_columns(vectors: DataFrame, questions: DataFrame, id_col: str, vec_col: str, query_col: str) -> DataFrame:
    q = questions.select(F.col(query_col).alias("query"), F.col(vec_col).alias("qv"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return v.crossJoin(F.broadcast(q)).select("query", "id", dot(F.col("qv"), F.col("v")).alias("score"))  # at most FEW questions


def _by_matrix(vectors: DataFrame, questions: DataFrame, k: int, id_col: str, vec_col: str, query_col: str, decimals: int, own: bool = False) -> DataFrame:
    rows = questions.select(query_col, vec_col).collect()  # at most MOST, checked above
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(names) // BLOCK)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):  # BLOCK questions x ROWS vectors at a time
                b = whole.slice(start, ROWS)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1).T
                for n in range(len(best)):
                    scores = np.round(matrix[n * BLOCK : (n + 1) * BLOCK] @ v, decimals)
                    best[n] = merged(best[n], first_own(scores, names[n * BLOCK : (n + 1) * BLOCK], ids) if own else scores, ids, k)
        for n, found in enumerate(best):
            if found is not None:
                s, i = found
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[n * BLOCK : (n + 1) * BLOCK], s.shape[1])), pa.array(i.ravel()), pa.array(s.ravel())], ["query", "id", "score"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "query long, id long, score double")


def first_own(scores: np.ndarray, names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores by question and row, those of a question's own row raised by less than they
    are rounded to, so that it goes before its equals."""
    return np.where(names[:, None] == ids, scores + 1e-9, scores)


def merged(best: tuple[np.ndarray, np.ndarray] | None, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores a row, and their ids, of those so far and new ones; ties go
    to smaller ids. Only what reaches the k-th best score is sorted."""
    i = np.broadcast_to(ids, s.shape)
    if best is not None:
        s, i = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], i], axis=1)
    if s.shape[1] > 4 * k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
        width = int((s >= least[:, None]).sum(axis=1).max())
        at = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
        s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _hashed(tokens: pa.Array, counts: pa.Array, sizes: pa.Array) -> pa.Array:
    """counts: how often each token comes; null: as often as it is listed."""
    size = sizes[0].as_py() if len(sizes) else 0
    out = np.zeros((len(tokens), size))
    for start in range(0, len(tokens), ROWS):
        some, times = tokens.slice(start, ROWS), counts.slice(start, ROWS)
        words = some.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % size for t in words.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False))
        weights = None if times.null_count else times.flatten().to_numpy(zero_copy_only=False)
        out[start : start + ROWS] = np.bincount(row * size + bucket[words.indices.to_numpy(zero_copy_only=False)], weights, len(some) * size).reshape(-1, size)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(length == 0, 1, length)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * size, pa.int32()), pa.array(out.ravel()))


def hash_embed(docs: DataFrame, id_col: str, terms, size: int = 64, counts: Column | None = None) -> DataFrame:  # noqa: ANN001
    """A deterministic stand-in for an embedding service: unit vectors of hashed
    token counts, (id, embedding), a row a document with any token. Nothing is
    shuffled. counts: of terms that are listed once each, how often they come."""
    n = F.lit(None).cast("array<long>") if counts is None else counts
    some = docs.select(F.col(id_col).alias("id"), terms.alias("t"), n.alias("n")).where(F.size("t") > 0)
    return some.select("id", _hashed(F.col("t"), F.col("n"), F.lit(size)).alias("embedding"))


def embed(docs: DataFrame, id_col: str, text: Column, model: Callable[[list[str]], list[list[float]]], provider: str = "openai", limit: int = 6000, batch: int = 100) -> DataFrame:
    """(id, embedding, embedding_text, trimmed) by a model that takes texts, ``batch``
    at a time; inputs are trimmed as the provider asks for."""
    cut = X.trim_embedding_input(text, provider, limit)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[float]] = []
        for k in range(0, len(texts), batch):
            out += model([x or "" for x in texts.slice(k, batch).to_pylist()])
        m = np.array(out, np.float64).reshape(len(texts), -1)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return pa.array(list(m / np.where(length == 0, 1, length)), pa.list_(pa.float64()))

    made = docs.select(F.col(id_col).alias("id"), cut.alias("c"))
    return made.select("id", run(F.col("c.text")).alias("embedding"), F.col("c.text").alias("embedding_text"), F.col("c.trimmed").alias("trimmed"))


def stored_vectors(docs: DataFrame, make: Callable[[], DataFrame], name: str, **manifest: str | int) -> tuple[DataFrame, DataFrame]:
    """The vector table of ``docs`` and its one-row manifest (provider, model,
    dimension, count and whatever else is given): as stored, if it is of these files
    and settings, else made and stored."""
    key = f"{name}-{S.signature(docs, *[f'{k}={v}' for k, v in sorted(manifest.items())])}"

    def build() -> dict[str, DataFrame]:
        vectors = S.kept(docs.sparkSession, f"{key}-vectors", lambda: {"vectors": make()})["vectors"]
        one = vectors.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
        return {"manifest": one.withColumns({k: F.lit(v) for k, v in manifest.items()})}

    held = S.kept(docs.sparkSession, key, build)
    return S.kept(docs.sparkSession, f"{key}-vectors", dict)["vectors"], held["manifest"]


def usable(manifests: DataFrame, provider: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Manifests of built indexes with a provider, the asked one if any; a provider
    that needs a key is left out unless ``keys`` has it."""
    p = F.lower(X.falsy_coalesce(F.col("provider"), F.lit("")))
    ok = (p != "") & F.coalesce(F.col("built"), F.lit(False))
    if provider:
        ok = ok & (p == provider.lower())
    if "openai" not in keys:
        ok = ok & (p != "openai")
    return manifests.where(ok)


def rows_of(metadata: DataFrame, places: DataFrame, place: str = "vec_idx") -> DataFrame:
    """Metadata of vectors by their places; places below zero have none."""
    return places.where(F.col(place) >= 0).join(metadata, place)


def approximate(
    vectors: DataFrame, questions: DataFrame, k: int, candidates: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query", own: bool = False
) -> DataFrame:
    """As top_k(), but by the stored index of ``vectors`` (see ann.py): of each question
    the ``candidates`` (20 k, 100 at least) that are best by their codes are compared."""
    from . import ann

    return ann.search(ann.build(vectors, id_col, vec_col), questions, k, candidates, None, vec_col, query_col, own)


def merge_indexes(indexes: list[tuple[str, DataFrame]], id_col: str = "id") -> DataFrame:
    """Vector tables as one, renormalised. An id that an earlier table has gets its
    table's name before it."""
    out = None
    for n, (name, df) in enumerate(indexes):
        x = df.select(F.lit(n).alias("part"), F.lit(name).alias("corpus"), F.col(id_col).cast("string").alias("id"), normalize(F.col("embedding")).alias("embedding"))
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy("id").orderBy("part")
    seen = out.withColumn("n", F.row_number().over(w))
    return seen.select("corpus", F.when(F.col("n") > 1, F.concat_ws(":", "corpus", "id")).otherwise(F.col("id")).alias("id"), "embedding")


def check_manifests(manifests: DataFrame) -> DataFrame:
    """One row: whether provider, model and dimension agree in all manifests."""
    same = [(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) <= 1) for c in ("provider", "model", "dimension")]
    return manifests.agg(F.count("*").alias("manifests"), (same[0] & same[1] & same[2]).alias("compatible"))
