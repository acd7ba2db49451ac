"""Incremental ingestion: files that arrive become chunks in keyed tables.

Each micro-batch replaces the chunks of the sources that it has, so that a batch
that is run again after a failure leaves the same table. Tables are partitioned by
a hash of the source, and a batch rewrites the partitions it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.chunking import Sizes, split
from ..operators.tables import keep_first, resume
from ..sources.readers import PagedSource, details
from ..stores import Conflict, Table, discard, exists, remove, stored

#: Parts that a new table is dealt into; a part is what a batch rewrites, so a table
#: that grows large wants more of them.
PARTS = 256


def chunk_batch(files: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(source_file, text) to chunks with ids of source and part."""
    whole = files.select(F.col("source_file").alias("chunk_id"), "source_file", X.uploaded_text(F.col("text")).alias("text"))
    return split(whole, sizes).withColumn("part", part_of(F.col("source_file")))


def part_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def replace_sources(spark: SparkSession, table: str, new: DataFrame, sources: DataFrame | None = None) -> None:
    """``table`` with the chunks of ``sources`` (source_file; those of ``new`` if not given)
    replaced by ``new``, in the partitions that these are in alone. A source without a
    chunk in ``new`` loses those it had, a partition that becomes empty goes."""
    new = stored(new, "batch")[0]
    asked = stored((sources if sources is not None else new).select("source_file").distinct().withColumn("part", part_of(F.col("source_file"))), "sources")[0]
    rows = new
    if exists(spark, table):
        old = spark.read.schema(new.schema).parquet(table).join(asked.select("part").distinct(), "part", "left_semi").join(asked.select("source_file"), "source_file", "left_anti")
        rows = stored(old.select(*new.columns).unionByName(new), "rewritten")[0]  # the table cannot be read and overwritten at once
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
    emptied = asked.select("part").distinct().join(rows.select("part").distinct(), "part", "left_anti")
    for r in emptied.collect():  # at most PARTS
        remove(spark, f"{table.rstrip('/')}/part={r['part']}")
    discard(*([new, asked] if rows is new else [new, asked, rows]))


def crawl(spark: SparkSession, options: dict[str, str], table: Table, checkpoint: str, key: str = "id", fetch: str | None = None) -> StreamingQuery:
    """A list that is served in pages (see readers.PagedSource) into ``table`` (``key``,
    item, detail, batch); ends when what is there has been taken up, and goes on from
    its checkpoint when started again. fetch: names what takes a key and returns a
    dict, the item's detail. A batch that is run again after a failure replaces its
    own rows, and of a key that comes again the first row stays."""
    spark.dataSource.register(PagedSource)
    items = spark.readStream.format("paged").options(**options).load()

    def batch(df: DataFrame, number: int) -> None:
        rows = df.select(F.get_json_object("item", f"$.{key}").alias(key), "item", "page").where(F.col(key).isNotNull())
        first = keep_first(rows, [key], "page").drop("page")
        named = details(first, fetch, "map<string,string>", key).select(key, F.to_json("detail").alias("detail")) if fetch else first.select(key, F.lit(None).cast("string").alias("detail"))
        while True:
            n = table.version()
            held = table.read(n)
            if held.where(F.col("batch") == number).isEmpty():
                new, _ = stored(resume(first, held, key).join(named, key, "left").withColumn("batch", F.lit(number).cast("long")), "crawled")
                table.append(new)
                discard(new)
                return
            try:
                table.replace(held.where(F.col("batch") != number), n)
            except Conflict:
                continue

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, sizes: Sizes = Sizes()) -> StreamingQuery:
    """Text files under ``folder``, each a document, into ``table``; ends when what
    is there has been taken up, and takes up what is new when started again."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    named = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))

    def batch(df: DataFrame, _: int) -> None:
        replace_sources(df.sparkSession, table, chunk_batch(df, sizes), df.select("source_file"))

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
