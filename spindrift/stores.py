"""Durable tables between jobs: where they are kept, and how they are read again.

What several jobs read is written once, to the folder that driver and executors share
(spark.checkpoint.dir, else the warehouse). A table that is derived from files is kept
under a signature of these files, their lengths and times, so that it is built once
and built anew when they change.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def home(spark: SparkSession) -> str:
    """The shared folder; the warehouse is one by its definition."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.globStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole or not at all; one that is there before is
    replaced in one step, so that a reader has the old or the new one."""
    part, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    _put(fs, part, text)
    fs_package = spark._jvm.org.apache.hadoop.fs
    how = getattr(fs_package, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(fs_package, "Options$Rename"), 1)
    options[0] = how
    target, _ = _path(spark, path)
    context = fs_package.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(target), options)


def _put(fs, path, text: str) -> None:  # noqa: ANN001
    out = fs.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Give the folder ``new`` the name ``path``; what had it goes after that. If this ends
    in between, the old folder is still there under ``path`` and ``__old``."""
    source, fs = _path(spark, new)
    target, _ = _path(spark, path)
    aside, _ = _path(spark, f"{path.rstrip('/')}__old")
    if fs.exists(target):
        fs.delete(aside, True)
        if not fs.rename(target, aside):
            raise OSError(f"{path} cannot be moved")
    if not fs.rename(source, target):
        raise OSError(f"{new} cannot take the name {path}")
    fs.delete(aside, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written and read again, and its number of rows."""
    spark = df.sparkSession
    path, schema = f"{home(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out, out.count()


#: Most rows of a table that is broadcast.
FEW = 200_000


def looked_up(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and marked for broadcast if its rows are few, as counted: so a
    table of texts that it is joined with stays where it is."""
    out, n = stored(df, name)
    return F.broadcast(out) if n <= FEW else out


def discard(*written: DataFrame) -> None:
    """Delete what stored() has written, once nothing reads it any more."""
    for df in written:
        remove(df.sparkSession, df.written_to)


#: Most files that a signature names; of more, their folders are listed.
NAMED = 1000


def signature(df: DataFrame, *more: str) -> str:
    """Of the files that a table is read from, with their lengths and times; of a table
    that is not read from files, one that no other has. Files are listed by Spark, in
    parallel where they are many, and what is known of them is summed by a job."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if not files:
        return hashlib.sha256(json.dumps([uuid.uuid4().hex, more]).encode()).hexdigest()[:24]
    paths = files if len(files) <= NAMED else sorted({f.rpartition("/")[0] for f in files})
    seen = spark.read.format("binaryFile").load(paths)
    one = F.xxhash64("path", "length", "modificationTime")
    total = seen.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(F.shiftrightunsigned(one, 20)).alias("s")).first()
    return hashlib.sha256(json.dumps([list(total), len(files), more]).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of ``name`` as they were written, or as ``make`` gives them, which
    are written then. A file that is written last says that they are whole."""
    base = f"{home(spark)}/{name}"
    done = read_text(spark, f"{base}.done")
    if done is None or not exists(spark, json.loads(done)["path"]):
        made, path = make(), f"{base}-{uuid.uuid4().hex}"
        for key, df in made.items():
            df.write.parquet(f"{path}/{key}")
        done = json.dumps({"path": path, "schemas": {k: df.schema.jsonValue() for k, df in made.items()}})
        write_text(spark, f"{base}.done", done)
    held = json.loads(done)
    return {k: spark.read.schema(T.StructType.fromJson(s)).parquet(f"{held['path']}/{k}") for k, s in held["schemas"].items()}


class Conflict(RuntimeError):
    """Another writer has committed a version since this one began."""


class Table:
    """A named table in numbered versions. Rows are written beside those that are there;
    a small file of the next number, written last, names the parts that the version
    has. So a job that fails leaves the version before it whole, a writer whose
    number has been taken meanwhile fails and loses nothing, and readers of an older
    version still find its parts until ``vacuum()`` takes them away."""

    #: Versions that a writer leaves; parts of appends after which they become one.
    KEEP, PARTS = 8, 64

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str) -> None:
        self.spark, self.base, self.schema = spark, f"{root.rstrip('/')}/{name}", T._parse_datatype_string(schema)

    def _versions(self) -> list[int]:
        p, fs = _path(self.spark, f"{self.base}/log/*.json")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.globStatus(p) or ())

    def _parts(self, version: int) -> list[str]:
        return json.loads(read_text(self.spark, f"{self.base}/log/{version:012d}.json"))

    def _commit(self, version: int, parts: list[str]) -> None:
        part, fs = _path(self.spark, f"{self.base}/log/{version:012d}.{uuid.uuid4().hex}")
        target, _ = _path(self.spark, f"{self.base}/log/{version:012d}.json")
        _put(fs, part, json.dumps(parts))
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise Conflict(f"{self.base}: version {version} is there already")

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.select(*[c.name for c in self.schema]).to(self.schema).write.parquet(f"{self.base}/{name}")
        return name

    def version(self) -> int:
        """The number of the latest version; 0 before any."""
        return max(self._versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        parts = self._parts(n) if n else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{p}" for p in parts])

    def replace(self, df: DataFrame, since: int | None = None) -> int:
        """A version with the rows of ``df`` alone; since: the version that they are
        made from, if that is not the latest one now."""
        n = self.version() if since is None else since
        name = self._write(df)
        try:
            self._commit(n + 1, [name])
        except Conflict:
            remove(self.spark, f"{self.base}/{name}")
            raise
        self.vacuum(self.KEEP)
        return n + 1

    def append(self, df: DataFrame) -> int:
        """A version with the rows of ``df`` besides those there are, which are not
        written again. Of two writers that append at once both rows stay."""
        name = self._write(df)
        while True:
            n = self.version()
            parts = self._parts(n) if n else []
            try:
                self._commit(n + 1, [*parts, name])
                break
            except Conflict:
                continue
        if len(parts) >= self.PARTS:
            return self.replace(self.read(n + 1), n + 1)
        return n + 1

    def vacuum(self, keep: int) -> None:
        """Versions but the last ``keep`` go, with the parts that none of these has."""
        versions = self._versions()
        old, left = versions[:-keep], versions[-keep:]
        used = {p for v in left for p in self._parts(v)}
        for v in old:
            for p in set(self._parts(v)) - used:
                remove(self.spark, f"{self.base}/{p}")
            remove(self.spark, f"{self.base}/log/{v:012d}.json")
