"""Embedding whitening with exact moments: digit-slice products.

Entries become integers, and these are split into limbs of ``LIMB`` bits, the highest
with the sign. Products of limbs, summed over at most ``ROWS`` rows, stay below 2^53, so
that a matrix product in doubles is exact in whatever order it adds. A task takes its
rows in such blocks, recombines the limbs of its sums as big integers, and gives them on
as digits of 32 bits in longs, which add up by (row, column) of the moments without
carrying. The driver gets d (d + 3) / 2 numbers, however many vectors there are, makes
n M - S S' of them exactly, and decomposes its quotient by n^2.

Whitened values come from the exact n x - S. Their covariance is taken over all rows
again, means first.

Defined results: vectors that are null or hold a null or non-finite entry take no part;
shorter vectors count as filled up with zeros to the longest, which makes empty ones all
zeros. Components whose eigenvalue is below ``RANK`` times the largest cannot be scaled to
unit variance and are not returned: of a single vector, or of equal ones, there is none.
Repeated rows come back as often as they came, null ids as well. An empty table gives an
empty result. Further columns are not read. Entries whose integers, times the number of
vectors, do not fit a long raise an error, as does a deviation that does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import whole
from .common import materialise, quoted, table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Bits of a limb, and rows of a block: 12 + 12 + 15 bits.
LIMB, ROWS = 12, 1 << 15
#: Digits of 32 bits of a sum: products of longs over 2^64 rows.
DIGITS = 6
#: Least share of the largest eigenvalue.
RANK = 1e-10


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum of [k] * 2^(LIMB k) is x; all but the last are not negative."""
    out, most = [], int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    while most >= 1 << (LIMB - 1):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, most = x >> LIMB, most >> LIMB
    return [*out, x.astype(np.float64)]


def gram(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of x, as big integers."""
    dim = x.shape[1]
    total = np.zeros((dim, dim), object)
    for k in range(0, len(x), ROWS):
        parts = limbs(x[k : k + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def digits(value: int) -> list[int]:
    """Of 32 bits, the last with the sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def undigits(found: list[int]) -> int:
    return sum(int(d) << (32 * k) for k, d in enumerate(found))


def _filled(vectors: pa.Array, dim: int) -> np.ndarray:
    """A matrix of lists of longs, filled up to dim columns with the integer of zero."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.full((len(vectors), dim), SHIFT, np.int64)
    out[np.arange(dim) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


NAMES = ["i", "j", *(f"d{k}" for k in range(DIGITS))]


def _moment_batches(dim: int):  # noqa: ANN202
    """(i, j, digits) of a task's sums of x_i x_j, i <= j, as j = -1 of x_i, and as i = -1
    the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, n = np.zeros((dim, dim), object), np.zeros(dim, object), 0
        for given in batches:
            for k in range(0, given.num_rows, ROWS):
                x = _filled(given.column(0).slice(k, ROWS), dim)
                held += gram(x)
                ones = np.ones(len(x))
                sums += sum((ones @ part).astype(np.int64).astype(object) << (LIMB * i) for i, part in enumerate(limbs(x)))
                n += len(x)
        if n:
            i, j = np.triu_indices(dim)
            rows = [(a, b, *digits(held[a, b])) for a, b in zip(i.tolist(), j.tolist())] + [(a, -1, *digits(sums[a])) for a in range(dim)] + [(-1, -1, *digits(n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], NAMES)

    return run


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums, and sums of products of ``vectors`` (x), exact."""
    given = vectors.select("x").mapInArrow(_moment_batches(dim), ", ".join(f"{c} long" for c in NAMES))
    n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in given.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in NAMES[2:]]).collect():
        value = undigits([r[c] for c in NAMES[2:]])
        if r["i"] < 0:
            n = value
        elif r["j"] < 0:
            sums[r["i"]] = value
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = value
    return n, sums, products


def axes(n: int, sums: np.ndarray, products: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as columns) of the covariance by falling eigenvalue, those that
    have any variance; the eigenvalues; the trace."""
    exact = n * products - np.outer(sums, sums)  # n^2 times the covariance
    v = np.array([[x / (n * n) for x in row] for row in exact.tolist()], np.float64).reshape(len(sums), -1)
    if not v.size:
        return np.empty((0, 0)), np.empty(0), 0.0
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values > max(values[0], 0) * RANK).sum()) if values[0] > 0 else 0
    k = min(k, most)
    return vectors[:, :k], values[:k], sum(exact[i, i] for i in range(len(sums))) / (n * n)


def _white_batches(n: int, sums: np.ndarray, vectors: np.ndarray, values: np.ndarray):  # noqa: ANN202
    dim = len(sums)
    bound = max(map(abs, sums.tolist()), default=0)
    s = np.array(sums.tolist(), np.int64) if bound < 1 << 63 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            x = _filled(given.column(1), dim)
            if s is None or int(np.abs(x).max(initial=0)) * n + bound >= 1 << 63:
                raise ArithmeticError("entries times the number of vectors do not fit a long")
            d = n * x - s
            size = int(np.abs(d).max(initial=0))
            wide = d if size * size * dim < 1 << 63 else d.astype(object)
            deviation = (wide * wide).sum(axis=1)
            z = (d / n) @ vectors / np.sqrt(values)
            lists = pa.ListArray.from_arrays(np.arange(len(z) + 1) * z.shape[1], z.reshape(-1))
            yield pa.RecordBatch.from_arrays([given.column(0), pa.array(map(str, deviation.tolist()), pa.string()), lists], ["id", "deviation", "z"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(id, deviation decimal, z array, n, explained array, identity_error) of every
    row of ``vectors`` (id, x), x an array of longs of a bounded width; no row if no
    component has any variance."""
    dim = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums, products = moments(vectors, dim) if dim else (0, np.zeros(0, object), np.zeros((0, 0), object))
    along, values, trace = axes(n, sums, products, components) if n else (np.empty((0, 0)), np.empty(0), 0.0)
    k = len(values)
    rows = vectors.select("id", "x") if k else vectors.select("id", "x").limit(0)
    white = rows.mapInArrow(_white_batches(n, sums, along, values), "id long, deviation string, z array<double>")
    white = materialise(white.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "z"), "whitened")
    error = None
    if k:
        means = white.agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(k)]).first()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        centred = [F.col("z")[i] - F.lit(means[i]) for i in range(k)]
        second = white.agg(*[(F.sum(centred[i] * centred[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(second[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(e) / trace) for e in values]).cast("array<double>")
    return white.select("*", F.lit(n).cast("long").alias("n"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col(quoted("embedding"))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    white = whiten(e.where(whole(v)).select(F.col("vec_id").cast("long").alias("id"), x.alias("x")))
    each = white.select("*", F.posexplode("z").alias("at", "whitened"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
