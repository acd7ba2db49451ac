"""Keyed tables: upserts, deletes, first-seen dedup, corpus merges, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: New rows of a manifest whose places are counted in one task.
FEW = 10_000


def keep_first(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of every key, by order (dropDuplicates has no order)."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), seq).alias("r")).select(*key, "r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row: matched, modified, inserted."""
    others = [c for c in new.columns if c not in key]
    o = old.select(*key, F.struct(*others).alias("__o"))
    j = new.select(*key, F.struct(*others).alias("__n")).join(o, key, "left")
    return j.agg(F.count("__o").alias("matched"), F.count_if(F.col("__o").isNotNull() & ~F.col("__o").eqNullSafe(F.col("__n"))).alias("modified"), F.count_if(F.col("__o").isNull()).alias("inserted"))


def upsert_front(old: DataFrame, new: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """As upsert, the new rows before all others by ``seq``."""
    low = old.agg(F.coalesce(F.min(seq), F.lit(0)).alias("__low"))
    placed = new.withColumn("__o", F.monotonically_increasing_id())
    # places of a few new rows are next to one another; those of many need only be in order
    if new.limit(FEW + 1).count() <= FEW:
        placed = placed.withColumn("__o", F.row_number().over(Window.orderBy("__o")) - 1)
    placed = placed.crossJoin(low)  # one row
    placed = placed.withColumn(seq, (F.col("__low") - 1 - F.col("__o")).cast("long"))
    return upsert(old, placed.drop("__o", "__low"), key)


def complete(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with the columns of a schema; what they lack is null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that ``new`` has are replaced."""
    return upsert(old, new, [group])


def resume(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is listed and not done yet."""
    return listed.join(done.select(key).distinct(), key, "left_anti")


def merge_corpora(parts: list[tuple[str, DataFrame]], id_col: str) -> DataFrame:
    """Tables as one; an id that an earlier one has gets its table's name before it,
    in every column of the row that holds it."""
    out = None
    for n, (name, df) in enumerate(parts):
        x = df.withColumns({"corpus": F.lit(name), "__p": F.lit(n)})
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    seen = F.row_number().over(Window.partitionBy(id_col).orderBy("__p"))
    return out.withColumn("__n", seen).withColumn(id_col, F.when(F.col("__n") > 1, F.concat_ws(":", "corpus", F.col(id_col).cast("string"))).otherwise(F.col(id_col).cast("string"))).drop("__n", "__p")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page (from 1, of 1 to 100 rows) with the total and whether more follow."""
    size, number = max(1, min(100, size)), max(1, number)
    total = rows.count()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(number * size < total)})


def search_documents(rows: DataFrame, text: str | None = None, within: tuple[str, ...] = (), **equal: str | None) -> DataFrame:
    """Rows with these values, and with ``text`` in one of ``within`` in any case."""
    for name, value in equal.items():
        if value:
            rows = rows.where(F.col(name) == value)
    if text and within:
        hit = None
        for c in within:
            one = F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
            hit = one if hit is None else hit | one
        rows = rows.where(hit)
    return rows


def corpus_status(docs: DataFrame, chunks: Column, indexed: Column, updated: str) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.count_if(chunks > 0).alias("chunked"), F.count_if(indexed).alias("indexed"), F.sum(chunks).cast("long").alias("chunks"), F.max(updated).alias("updated"))


def document_status(chunks: Column, any_index: Column) -> Column:
    return F.when((chunks > 0) & any_index, "indexed").when(chunks > 0, "chunked").otherwise("crawled")


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both; the new ones win."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def checked(rows: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    """Rows whose ``column`` is in ``allowed.name``; any other value is an error."""
    known = allowed.select(F.col(name).alias("__k")).distinct()
    j = rows.join(known, F.col(column) == F.col("__k"), "left")
    ok = F.when(F.col("__k").isNotNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast(dict(rows.dtypes)[column]))
    return j.withColumn(column, ok).drop("__k")
