"""Helpers shared by the training-data operators: table access, the shared work
folder, durable materialisation and small Column idioms."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the
    session has it. Only where it is unset and all runs in one local process, as in
    tests, a temporary folder is set; on a cluster none is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/spindrift-checkpoints"
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. This cuts
    the lineage durably: a lost executor rereads files, it recomputes nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete what materialise() has written, once all that needs it is written too."""
    for df in written:
        path = getattr(df, "written_to", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on between tasks,
    and what they keep for themselves counts as their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``. A plain reference
    would be inlined into lambdas and evaluated again for every element."""
    return F.transform(F.array(value), body)[0]


def detached(key: Column) -> Column:
    """The same string key as a new expression, so that a join brings its own
    exchange, which adaptive execution can split when a key is hot."""
    return F.concat(key, F.lit(""))


def nested(df: DataFrame, *more: Column) -> DataFrame:
    """The row as one struct ``d``, so that no column of it clashes with ``more``."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("d"), *more)


def unnested(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a nested row again, those in ``new`` replaced."""
    return df.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Elements of a block of ``running``.
BLOCK = 128


def running(values: Column, kind: str, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of each element and all before it. An accumulator that is an
    array would be copied for every element; here blocks are, then one total each."""

    def scan(block: Column) -> Column:
        empty = F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
        step = lambda a, x: let(op(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["all"], F.array(y)).alias("all")))
        return F.aggregate(block, empty, step, lambda a: a["all"])

    def joined(blocks: Column) -> Column:
        totals = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
        before = lambda t, i: F.when(i == 0, start.cast(kind)).otherwise(F.get(t, i - 1))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: let(before(t, i), lambda c: F.transform(b, lambda x: op(c, x))))))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return let(F.transform(starts, lambda i: scan(F.slice(v, i, BLOCK))), joined)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast(f"array<{kind}>")).when(F.size(v) <= BLOCK, scan(v)).otherwise(cut(v)))
