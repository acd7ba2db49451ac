"""Sinks. Each commits by Spark's protocol: a failed write leaves nothing behind."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stores import remove, stored, swap, write_text


#: Columns of exported records, in order.
CSV_COLUMNS = (
    "vbpl_id", "title", "doc_number", "doc_type", "agency_name", "issue_date", "effective_from", "effective_to", "effective_status", "majors", "fields", "signer_title", "signer",
    "organization", "public_date", "updated_date", "source_url", "text_length", "chunk_count", "toc_count", "chunks_file", "text_file", "html_file", "toc_file",
)


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in order, those missing empty, lists joined by `` | ``."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if c not in kinds:
            return F.lit("").alias(c)
        value = F.array_join(c, " | ") if kinds[c].startswith("array<string") else F.col(c).cast("string")
        return F.coalesce(value, F.lit("")).alias(c)

    return df.select(*map(one, columns))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, bom: bool = True) -> None:
    """Records as CSV; a byte order mark begins each file, as the header's first name
    has it. No rows give no lines."""
    columns = columns or list(CSV_COLUMNS)
    out = csv_columns(df, columns)
    if bom:
        out = out.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_json(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    """Lines of JSON. What is overwritten stays whole until all of the new is written
    beside it, and the job may read it; then the one takes the other's name."""
    target = path if append else f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    w = finite(df).write.mode("append")
    try:
        (w.partitionBy(*by) if by else w).json(target)
    except Exception:
        if not append:
            remove(df.sparkSession, target)
        raise
    if not append:
        swap(df.sparkSession, target, path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON has."""
    bad = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(bad) if bad else df


def rewrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Of a partitioned table, just the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rewrite_existing(df: DataFrame, path: str, by: str, backup: str | None = None) -> None:
    """As rewrite_partitions(), of partitions that the table has; with a copy of what
    they were, if asked for."""
    old = df.sparkSession.read.parquet(path)
    have = df.join(old.select(by).distinct(), by, "left_semi")
    if backup:
        old.join(df.select(by).distinct(), by, "left_semi").write.mode("overwrite").partitionBy(by).parquet(backup)
    staged, _ = stored(have, "rewritten")
    rewrite_partitions(staged, path, by)


def write_corpus(documents: DataFrame, chunks: DataFrame, path: str, **about: str) -> None:
    """A corpus whole: documents and chunks as lines of JSON, and a manifest of their
    numbers, which is written last."""
    write_json(documents, f"{path}/documents")
    write_json(chunks, f"{path}/all_chunks")
    spark = documents.sparkSession
    counts = {"documents": spark.read.text(f"{path}/documents").count(), "chunks": spark.read.text(f"{path}/all_chunks").count()}
    write_text(spark, f"{path}/manifest.json", json.dumps(about | counts, ensure_ascii=False, indent=2))


def write_archive(spark: SparkSession, folder: str, target: str) -> None:
    """The files below a folder as one zip file, put together on the driver one file
    at a time: for exports, not for data at large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").orderBy("path")
    with tempfile.TemporaryDirectory() as d:
        with zipfile.ZipFile(f"{d}/out.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for r in files.toLocalIterator():
                z.writestr(r["path"].partition(folder.partition("://")[2] or folder)[2].lstrip("/") or r["path"].rpartition("/")[2], bytes(r["content"]))
        p = spark._jvm.org.apache.hadoop.fs.Path
        p(target).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(p(f"file://{d}/out.zip"), p(target))


def write_postings(df: DataFrame, table: str, buckets: int = 64) -> None:
    """Bucketed and sorted by term: questions then meet them without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def write_checked(df: DataFrame, path: str, expected: int) -> None:
    """Writes, then holds the number of rows against what is expected."""
    df.write.mode("overwrite").parquet(path)
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{path}: {found} rows, {expected} expected")


def manifest(df: DataFrame, **fields: str | int) -> DataFrame:
    return df.agg(F.count("*").alias("count")).withColumns({k: F.lit(v) for k, v in fields.items()})


def answer_events(answers: DataFrame, deltas: Column, data: Column, error: Column) -> DataFrame:
    """(query, seq, event): an answer as the lines of JSON that a client reads as it comes:
    a delta for each piece of it, then all of its data, or the error that ended it.
    Sorted by query and seq, and written a file a query or read a query at a time."""
    a = answers.select("query", F.coalesce(deltas, F.array().cast("array<string>")).alias("d"), data.alias("data"), error.alias("e"))
    piece = F.transform("d", lambda x: F.to_json(F.struct(F.lit("answer_delta").alias("type"), x.alias("delta"))))
    last = F.when(F.col("e").isNull(), F.to_json(F.struct(F.lit("final").alias("type"), F.col("data")))).otherwise(F.to_json(F.struct(F.lit("error").alias("type"), F.col("e").alias("error"))))
    return a.select("query", F.posexplode(F.concat(piece, F.array(last))).alias("seq", "event"))


def answer_stream(df: DataFrame):  # noqa: ANN201
    """Lines of JSON, one row at a time through the driver, for an answer that is read
    as it comes; tables are written by the writers above."""
    for row in df.toJSON().toLocalIterator():
        yield row + "\n"
