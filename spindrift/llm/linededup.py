"""Line dedup by site-relative frequency.

Of each host, the pages that hold a line are divided by all its pages, and lines
above the ratio are boilerplate and dropped. Exact copies of a page are one page in
both numbers, else a page that is copied often enough would lose every line of its
own; they lose the same lines all the same.

Lines are counted once a page, within the page: what is shuffled to count them is
(host, line hash, text hash), each once a task. What is found is small, as a host has
at most its mean number of lines a page, divided by the ratio, of such lines. If the
whole table of them is below ``BROADCAST_ROWS`` rows, as counted, it is broadcast by
host; else the hashes of each text's lines are joined to it and the hits come back to
the pages with that text.

Defined results: a null text stays null and holds no line, but counts as a page; an
empty text stays empty. White space around a line does not tell lines apart; lines of
white space alone are never dropped. A null host is a host. Lines on fewer than
``MIN_PAGES`` pages stay. An empty table gives an empty result. Further columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, nested, quoted, table, unnested

RATIO = 0.05
MIN_PAGES = 3
BROADCAST_ROWS = 100_000
SPACES = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    """A hash of a line; null for one of white space alone."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare != "", F.xxhash64(bare))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_lines(text), _key), lambda k: k.isNotNull()))


def _host(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), c.cast("string")), F.lit("none"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n, pages) of lines on more than ``ratio`` of the host's pages."""
    t = F.col(quoted(text))
    slim = pages.select(_host(F.col(quoted(host))).alias("host"), F.struct(t.isNull(), F.xxhash64(t)).alias("page"), t.alias("text"))
    totals = slim.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = slim.select("host", "page", F.explode(_keys(F.col("text"))).alias("key")).distinct()
    counted = held.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counted.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    return found.select("host", "key", "n", "pages")


def _cut(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int, broadcast_rows: int) -> DataFrame:
    """The rows as ``d`` beside ``cut``: text, total and dropped (lines)."""
    t = F.col(quoted(text))
    found = materialise(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    rows = nested(pages, _host(F.col(quoted(host))).alias("host"), t.alias("text"))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        marked = rows.join(F.broadcast(found.groupBy("host").agg(F.collect_list("key").alias("hits"))), "host", "left")
    else:
        # by text and not by row, since copies hold the same lines
        rows = rows.withColumn("page", F.xxhash64("text"))
        lines = rows.select("host", "page", F.explode(_keys(F.col("text"))).alias("key")).distinct()
        hits = lines.join(found.select("host", "key"), ["host", "key"]).groupBy("host", "page").agg(F.collect_list("key").alias("hits"))
        marked = rows.join(hits, ["host", "page"], "left")
    none = F.array().cast("array<bigint>")
    own = F.array_intersect(_keys(F.col("text")), F.coalesce("hits", none))

    def cut(given: Column, hits: Column) -> Column:
        left = F.filter(given, lambda x: let(_key(x), lambda k: k.isNull() | ~F.array_contains(hits, k)))
        return let(left, lambda y: F.struct(F.array_join(y, "\n").alias("text"), (F.size(given) - F.size(y)).cast("long").alias("dropped"), F.size(given).cast("long").alias("total")))

    lines = _lines(F.col("text"))
    kept = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("dropped"), F.size(lines).cast("long").alias("total"))
    return marked.select("d", F.when(F.col("hits").isNull(), kept).otherwise(let(own, lambda h: F.when(F.size(h) == 0, kept).otherwise(let(lines, lambda g: cut(g, h))))).alias("cut"))


def drop_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS, counts: str = "__lines") -> DataFrame:
    """``pages`` with ``text`` less its boilerplate, and a struct named ``counts`` of
    ``total`` and ``dropped`` (lines)."""
    done = _cut(pages, host, text, ratio, min_pages, broadcast_rows)
    columns = [c for c in pages.columns if c != counts]
    both = unnested(done.withColumn("d", F.col("d").withField(quoted(text), F.col("cut.text"))).select(F.col("d").withField(quoted(counts), F.struct("cut.total", "cut.dropped")).alias("d")), [*columns, counts])
    return both


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_lines(docs, "source", "text")
    return out.select("doc_id", "source", F.col("__lines.total").alias("n_lines"), F.col("__lines.dropped").alias("n_dropped"), "text")


OP2_SQL = f"""
WITH pages AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), bare AS (
  SELECT *, list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) AS keys FROM pages
), once AS (
  SELECT source, text, any_value(keys) AS keys FROM bare GROUP BY source, text
), totals AS (
  SELECT source, count(*) AS pages FROM once GROUP BY source
), held AS (
  SELECT source, unnest(list_distinct(list_filter(keys, lambda x: x <> ''))) AS key FROM once
), counted AS (
  SELECT source, key, count(*) AS n FROM held GROUP BY source, key HAVING count(*) >= {MIN_PAGES}
), boiler AS (
  SELECT c.source, list(c.key) AS keys FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n > t.pages * {RATIO}::DOUBLE GROUP BY c.source
), cut AS (
  SELECT b.doc_id, b.source, b.text, b.lines,
         [b.lines[i] FOR i IN range(1, len(b.lines) + 1) IF NOT list_contains(coalesce(o.keys, []), b.keys[i])] AS kept
  FROM bare b LEFT JOIN boiler o ON b.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, source, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM cut
"""


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boilerplate lines go, ``n_chars`` follows."""
    done = _cut(docs, "source", "text", RATIO, MIN_PAGES, BROADCAST_ROWS)
    n = F.when(F.col("cut.dropped") > 0, F.length("cut.text").cast("long")).otherwise(F.col("d").getField("n_chars")) if "n_chars" in docs.columns else F.lit(0)
    return unnested(done, docs.columns, text=F.col("cut.text"), n_chars=n)
