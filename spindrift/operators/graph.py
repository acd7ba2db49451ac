"""A property graph as node and edge tables; traversals are joins."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..stores import discard, stored


def last_by(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row a key: the last in order, whole."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("r")).select(*key, "r.*")


def upsert_nodes(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``old`` with the last of ``new`` for every key."""
    latest = last_by(new, key, seq).drop(seq)
    return old.join(latest.select(*key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def article_rows(chunks: DataFrame, doc: Column) -> DataFrame:
    """Chunks of articles with document_id and article_id."""
    c = chunks.where(X.text_of(F.col("article_number")) != "")
    return c.withColumn("document_id", doc).withColumn("article_id", F.concat(doc, F.lit(":article:"), F.lower("article_number")))


def issue_edges(issues: DataFrame, articles: DataFrame) -> DataFrame:
    """(label, article_id, relation): PREFERRED_ARTICLE, and DISTINGUISH_FROM for the
    issues that have a preferred one. issues: label, preferred_articles,
    distinguish_from_articles, document_title_hints."""
    a = articles.select("article_id", F.lower("article_number").alias("n"), F.lower(X.text_of(F.col("document_title"))).alias("title")).distinct()

    def edges(column: str, relation: str) -> DataFrame:
        i = issues.select("label", "document_title_hints", F.explode(F.array_distinct(F.transform(column, lambda x: F.lower(F.trim(x))))).alias("n"))
        hinted = F.exists("document_title_hints", lambda h: F.contains(F.col("title"), F.lower(h)))
        return i.join(a, "n").where(hinted).select("label", "article_id", F.lit(relation).alias("relation")).distinct()

    preferred = edges("preferred_articles", "PREFERRED_ARTICLE")
    other = edges("distinguish_from_articles", "DISTINGUISH_FROM").join(preferred.select("label").distinct(), "label", "left_semi")
    return preferred.unionByName(other)


def reference_edges(chunks: DataFrame) -> DataFrame:
    """(source, target) articles that chunks name, within one document number."""
    named = chunks.where(F.col("doc_number").isNotNull()).select(F.col("article_id").alias("source"), "doc_number", F.explode(X.article_references(F.col("text"), F.col("article_number"))).alias("n"))
    targets = chunks.select(F.col("article_id").alias("target"), "doc_number", F.lower("article_number").alias("n")).distinct()
    return named.join(targets, ["doc_number", "n"]).select("source", "target").distinct()


def expand_issues(wanted: DataFrame, edges: DataFrame, articles: DataFrame, most: int = 8) -> DataFrame:
    """Chunks reached from issues (label, position), preferred articles first, at
    most ``most`` in all; an issue without any has one row of nulls."""
    x = wanted.join(edges, "label", "left").join(articles.select("article_id", "article_number", "chunk_id"), "article_id", "left")
    order = [F.when(F.col("relation") == "PREFERRED_ARTICLE", 0).when(F.col("relation") == "DISTINGUISH_FROM", 1).otherwise(2), F.asc_nulls_last("position"), F.asc_nulls_last("article_number"), F.asc_nulls_last("chunk_id")]
    return x.orderBy(*order).limit(most)


def pins_of(expanded: DataFrame, most: int = 1, distinguish: bool = False) -> DataFrame:
    """Distinct chunks to pin: score 1.0 for preferred articles, else 0.72."""
    x = expanded.where(F.col("chunk_id").isNotNull())
    x = x if distinguish else x.where("relation = 'PREFERRED_ARTICLE'")
    g = x.groupBy("chunk_id").agg(F.min(F.struct(F.when(F.col("relation") == "PREFERRED_ARTICLE", 0).otherwise(1).alias("o"), "position")).alias("f"))
    w = Window.orderBy("f", "chunk_id")  # what was expanded is a handful of rows
    return g.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("chunk_id", F.when(F.col("f.o") == 0, 1.0).otherwise(0.72).alias("score"))


def audit(rules: DataFrame, chunks: DataFrame, examples: int = 3) -> DataFrame:
    """(label, relation, article, candidates, matched, examples): how many chunks a
    rule's article has, and how many under a title that it hints at."""
    kinds = [("preferred_articles", "preferred"), ("distinguish_from_articles", "distinguish")]
    checks = None
    for column, relation in kinds:
        x = rules.select("label", "document_title_hints", F.lit(relation).alias("relation"), F.explode(F.transform(column, X.fold)).alias("article"))
        checks = x if checks is None else checks.unionByName(x)
    c = chunks.select("chunk_id", X.fold(F.col("article_number")).alias("article"), X.fold(F.col("document_title")).alias("title")).where("article <> ''")
    hinted = (F.size("document_title_hints") == 0) | F.exists("document_title_hints", lambda h: F.contains(F.col("title"), X.fold(h)))
    j = checks.join(c, "article", "left")
    hit = F.col("chunk_id").isNotNull() & hinted
    return j.groupBy("label", "relation", "article").agg(
        F.count("chunk_id").alias("candidates"), F.count(F.when(hit, 1)).alias("matched"), F.slice(F.array_sort(F.collect_set(F.when(hit, F.col("chunk_id")))), 1, examples).alias("examples")
    )


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: how many articles of rules were looked for, found, and missing."""
    return audited.agg(F.count("*").alias("checks"), F.count_if(F.col("matched") > 0).alias("found"), F.count_if(F.col("matched") == 0).alias("missing"))


def flatten_hierarchy(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """Nodes (id, parent_id, title) of trees with depth and path, however deep: level by
    level, each written before the next is joined to it; one table is left. In order of
    ``path`` each node is before its children, and siblings are by ``order`` and id."""
    step = F.struct((F.col(order) if order else F.lit(0)).alias("at"), F.col("id").alias("id"))
    columns = ["id", "parent_id", "title"]
    level = nodes.where("parent_id IS NULL").select(*columns, F.lit(0).alias("depth"), F.array(step).alias("path"))
    levels: list[DataFrame] = []
    while True:
        level, written = stored(level, "level")
        levels.append(level)
        if not written:
            break
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("p"))
        level = nodes.join(up, "parent_id").select(*columns, F.lit(len(levels)).alias("depth"), F.concat("p", F.array(step)).alias("path"))
    out, _ = stored(reduce(DataFrame.unionByName, levels), "hierarchy")
    discard(*levels)
    return out


#: What a node of a table of contents may name its parts.
NODE_ID, NODE_TITLE, NODE_TYPE, NODE_NUMBER = ("id", "provisionId", "key"), ("title", "name", "label", "text"), ("type", "provisionType", "nodeType"), ("articleNumber", "number")
NODE_CHILDREN = ("children", "childrens", "items", "provisions")
TOC = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "depth" else T.StringType()) for n in ("id", "parent_id", "depth", "title", "type", "article_number")]))


@F.arrow_udf(TOC)
def flatten_toc(trees: pa.Array) -> pa.Array:
    """JSON tables of contents to their nodes, each before its children; a child of a
    node without an id belongs to the nearest one above that has one."""
    kind = pa.list_(pa.struct([(n, pa.int32() if n == "depth" else pa.string()) for n in ("id", "parent_id", "depth", "title", "type", "article_number")]))
    return pa.array([toc_nodes(x) for x in trees.to_pylist()], kind)


def toc_nodes(tree: str | None) -> list[dict]:
    try:
        top = json.loads(tree or "[]")
    except ValueError:
        return []
    first = lambda node, keys: next((node[k] for k in keys if node.get(k)), None)
    text = lambda x: None if x is None else str(x)
    out: list[dict] = []
    todo = [(top, 0, None)]
    while todo:
        nodes, depth, parent = todo.pop()
        for k, node in enumerate(nodes if isinstance(nodes, list) else []):
            if not isinstance(node, dict):
                continue
            own, title = text(first(node, NODE_ID)), first(node, NODE_TITLE)
            out.append({"id": own, "parent_id": parent, "depth": depth, "title": " ".join(str(title).split()) if title else None, "type": text(first(node, NODE_TYPE)), "article_number": text(first(node, NODE_NUMBER))})
            if below := first(node, NODE_CHILDREN):
                todo += [(nodes[k + 1 :], depth, parent), (below, depth + 1, own or parent)]
                break
    return out
