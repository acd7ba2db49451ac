"""Structure-aware chunking.

Where rows decide by their order alone, chunking is window functions over blocks:
consecutive duplicates, headings carried forward, article segments. What is greedy
(packing paragraphs, merging short siblings) runs as a Python generator over one
document at a time, and only over documents that do not fit in one chunk as they
are: ``split`` passes the others by, in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..stores import stored

ARTICLE = r"(?iu)^\s*(?:điều|dieu|article)\s+(\d+[a-z]?)\b"
CLAUSE = r"^\s*(\d+[a-z]?)\s*[.)]\s+"
POINT = r"^\s*([a-zđ])\s*[.)]\s+"


@dataclass(frozen=True)
class Sizes:
    """The sizes of chunks in characters."""

    most: int = 3500
    overlap: int = 350
    short: int = 120
    merged: int = 2500


# --- order alone: windows ---------------------------------------------------


def drop_repeated_blocks(blocks: DataFrame, doc: str = "doc", seq: str = "seq", text: str = "text") -> DataFrame:
    """Blocks without empty ones and without those equal to the one before."""
    b = blocks.withColumn(text, X.squeeze(F.col(text))).where(F.col(text) != "")
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(seq))
    return b.withColumn("__before", before).where(~F.col(text).eqNullSafe(F.col("__before"))).drop("__before")


def carry_headings(blocks: DataFrame, kinds: dict[str, Column], doc: str = "doc", seq: str = "seq", text: str = "text") -> DataFrame:
    """A column a kind: the last heading of the kind at or before the block."""
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumns({name: F.last(F.when(test, F.col(text)), ignorenulls=True).over(w) for name, test in kinds.items()})


def segments(blocks: DataFrame, starts: Column, doc: str = "doc", seq: str = "seq") -> DataFrame:
    """``segment``: how many starts there have been, 0 before the first."""
    w = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def article_chunks(blocks: DataFrame, kinds: dict[str, Column], doc: str = "doc", seq: str = "seq", text: str = "text") -> DataFrame:
    """(doc, segment, article_number, headings.., text, text_length): blocks from one
    article heading to the next; what precedes the first is dropped. A document
    without any article is one chunk, segment 0."""
    b = carry_headings(drop_repeated_blocks(blocks, doc, seq, text), kinds, doc, seq, text)
    b = segments(b, F.col(text).rlike(ARTICLE), doc, seq)
    any_article = F.max("segment").over(Window.partitionBy(doc))
    b = b.withColumn("__any", any_article).where((F.col("segment") > 0) | (F.col("__any") == 0))
    is_kind = None
    for test in kinds.values():
        is_kind = test if is_kind is None else is_kind | test
    body = b if is_kind is None else b.where(~is_kind | (F.col("__any") == 0))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "\n")
    g = body.groupBy(doc, "segment").agg(lines.alias("text"), *[F.min_by(k, seq).alias(k) for k in kinds], F.min_by(text, seq).alias("__head"))
    number = F.nullif(F.lower(F.regexp_extract("__head", ARTICLE, 1)), F.lit(""))
    return g.select(doc, "segment", number.alias("article_number"), *kinds, "text", F.length("text").alias("text_length"))


def clause_parts(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, part, number, text): a part from each numbered line to the next, with the
    article heading before each."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    x = chunks.select(key, F.posexplode(lines).alias("line_no", "line"))
    headed = F.first("line").over(Window.partitionBy(key).orderBy("line_no"))
    x = x.withColumn("head", F.when(headed.rlike(ARTICLE), headed)).where((F.col("line_no") > 0) | F.col("head").isNull())
    x = segments(x, F.col("line").rlike(CLAUSE), key, "line_no")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    g = x.groupBy(key, "segment").agg(body.alias("body"), F.min("head").alias("head"), F.min_by("line", "line_no").alias("first"))
    return g.select(key, F.col("segment").alias("part"), F.nullif(F.regexp_extract("first", CLAUSE, 1), F.lit("")).alias("number"), F.concat_ws("\n", "head", "body").alias("text"))


def unique_ids(chunks: DataFrame, id_col: str = "chunk_id", seq: str = "seq", mark: str = "dup") -> DataFrame:
    """Later rows of an id get ``:dup:n``; where that is the id of another row, or ends up
    so, the later of these is marked again, until all ids differ. Each pass is over
    written rows, and there are as many as marks one upon another."""
    while True:
        n = F.row_number().over(Window.partitionBy(id_col).orderBy(seq))
        marked = chunks.withColumn("__n", n).withColumn(id_col, F.when(F.col("__n") > 1, F.concat(F.col(id_col), F.lit(f":{mark}:"), F.col("__n").cast("string"))).otherwise(F.col(id_col))).drop("__n")
        chunks, _ = stored(marked, "unique-ids")
        if chunks.groupBy(id_col).count().where("count > 1").isEmpty():
            return chunks


def merge_parts(chunks: DataFrame, id_col: str = "chunk_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """``:part:n`` rows back into their base chunk, texts joined in order, other
    columns from the first row."""
    base = F.regexp_replace(id_col, r":part:\d+$", "")
    others = [c for c in chunks.columns if c not in (id_col, text)]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text]), "\n")
    return chunks.groupBy(base.alias(id_col)).agg(*[F.min_by(c, seq).alias(c) for c in others], joined.alias(text)).select(*chunks.columns)


def sliding_windows(c: Column, most: int, overlap: int) -> Column:
    """Windows of a text that overlap; none begins after one that reaches the end."""
    step = max(1, most - max(0, overlap))
    n = F.length(c)
    last = F.greatest(F.lit(0), F.ceil((n - most) / step).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(c, i * step + 1, F.lit(most))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(cut, lambda x: x != ""))


def rechunk(records: DataFrame, sizes: Sizes = Sizes(), reported: int = 5500, searchable: Callable[[Column], Column] | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Records with ``:part:n`` rows merged, split again and given unique ids, and one
    row of statistics: counts and longest lengths before and after, and how many are
    over ``reported`` as they are searched (which limits nothing)."""
    shown = searchable or (lambda t: t)
    merged = merge_parts(records, seq=seq)
    out = unique_ids(split(merged, sizes), seq=seq)
    n = lambda df, name: df.agg(F.count("*").alias(f"{name}_count"), F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long").alias(f"{name}_longest"))
    after = out.agg(
        F.count("*").alias("output_count"), F.coalesce(F.max(F.length("text")), F.lit(0)).cast("long").alias("output_longest"), F.count("parent_chunk_id").alias("split_children"),
        F.coalesce(F.max(F.length(shown(F.col("text")))), F.lit(0)).cast("long").alias("searchable_longest"), F.count_if(F.length(shown(F.col("text"))) > reported).alias("searchable_over"),
        F.count_if(F.coalesce(F.size("merged_chunk_ids"), F.lit(0)) > 0).alias("merged_short"),
    )
    return out, n(records, "input").crossJoin(n(merged, "merged")).crossJoin(after)  # one row each


def quality_report(chunks: DataFrame, most: int = 3500, id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    n = F.length(X.text_of(F.col(text)))
    return chunks.agg(
        F.count("*").alias("chunks"),
        (F.count("*") - F.count_distinct(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("duplicate_ids"),
        F.count_if(F.trim(X.text_of(F.col(text))) == "").alias("empty"),
        F.count_if(n < 50).alias("short"),
        F.count_if(n > most).alias("long"),
        F.max(n).cast("long").alias("longest"),
    )


# --- greedy: one document at a time -----------------------------------------


def tail_of(text: str, overlap: int) -> str:
    """The last ``overlap`` characters, from the first line that begins in them."""
    tail = text[-overlap:].strip() if overlap > 0 else ""
    return tail.partition("\n")[2].strip() if "\n" in tail else tail


def windows(text: str, most: int, overlap: int) -> Iterator[str]:
    step, start = max(1, most - max(0, overlap)), 0
    while start < len(text):
        part = text[start : start + most].strip()
        if part:
            yield part
        if start + most >= len(text):
            return
        start += step


def pack(units: list[str], glue: str, most: int, overlap: int, oversize: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Units joined by ``glue`` as long as they fit; a new piece begins with the end
    of the one before. A unit over ``most`` goes through ``oversize`` alone."""
    held = ""
    for unit in filter(None, map(str.strip, units)):
        grown = f"{held}{glue}{unit}" if held else unit
        if held and glue == " " and len(grown) > most:  # sentences: the next piece may exceed the limit by its overlap
            yield held
            prefix = tail_of(held, overlap)
            held = f"{prefix}{glue}{unit}".strip()
        elif len(unit) > most:
            if held:
                yield held
                held = ""
            yield from oversize(unit)
        elif held and len(grown) > most:
            yield held
            prefix = tail_of(held, overlap)
            held = f"{prefix}{glue}{unit}".strip()
            if len(held) > most:
                yield from oversize(held)
                held = ""
        else:
            held = grown
    if held:
        yield held


def split_text(text: str, most: int, overlap: int) -> list[str]:
    """By lines, then sentences, then windows."""

    def sentences(unit: str) -> Iterator[str]:
        return pack(re.split(r"(?<=[.;:!?])\s+", unit), " ", most, overlap, lambda s: windows(s, most, overlap))

    return list(pack(text.splitlines(), "\n", most, overlap, sentences))


_RE = {k: re.compile(p.replace("(?iu)", ""), re.I) for k, p in (("article", ARTICLE), ("clause", CLAUSE), ("point", POINT))}


def _parts(text: str, level: str) -> list[tuple[str | None, str]]:
    """(number, text) of clauses or points. Clauses repeat the article's heading;
    points repeat all that precedes the first of them."""
    lines = [x for x in text.splitlines() if x.strip()]
    heads: list[str] = []
    if level == "clause" and lines and _RE["article"].match(lines[0]):
        heads, lines = lines[:1], lines[1:]
    found: list[tuple[str | None, list[str]]] = []
    for line in lines:
        m = _RE[level].match(line)
        if m:
            found.append((m[1], [*heads, line]))
        elif found:
            found[-1][1].append(line)
        elif level == "clause":
            found.append((None, [*heads, line]))
        else:
            heads.append(line)
    return [(n, "\n".join(x).strip()) for n, x in found]


Piece = dict


def split_chunk(chunk_id: str, text: str, sizes: Sizes = Sizes(), measure: Callable[[str], int] = len) -> list[Piece]:
    """Pieces of one chunk: id, clause and point numbers, text, and whether it was
    cut by size. Ids hang on the whole chunk's, so that those of points can repeat
    between clauses: unique_ids() settles that. ``measure``: the length that must not
    be over ``sizes.most``, such as that of what is made of a piece to be searched."""
    lines = [" ".join(x.split()) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    text = "\n".join(x for x in lines if x)
    if not text:
        return []
    base = re.sub(r":part:\d+$", "", chunk_id)

    def piece(i: str, t: str, clause: str | None, point: str | None, cut: bool = False) -> Piece:
        return {"id": i, "text": t, "clause": clause, "point": point, "cut": cut, "merged": []}

    fits = lambda t: max(len(t), measure(t)) <= sizes.most
    if fits(text):
        return [piece(chunk_id, text, None, None)]

    def by_size(t: str, clause: str | None, point: str | None, overlap: int) -> Iterator[Piece]:
        for k, x in enumerate(split_text(t, sizes.most, overlap), 1):
            if len(x) <= sizes.most:
                yield piece(f"{base}:part:{k}", x, clause, point, True)
                continue
            again = split_text(x, sizes.most, overlap // 2)
            if len(again) == 1 and len(again[0]) >= len(x):
                yield piece(f"{base}:part:{k}", x, clause, point, True)
            else:
                yield from by_size(x, clause, point, overlap // 2)

    def by_structure(t: str, level: str, clause: str | None) -> Iterator[Piece]:
        seen: dict[str, int] = {}
        for k, (number, x) in enumerate(_parts(t, level), 1):
            name = number if number is not None else str(k)
            seen[name] = seen.get(name, 0) + 1
            name += f":repeat:{seen[name]}" if seen[name] > 1 else ""
            own = (number, None) if level == "clause" else (clause, number)
            if fits(x):
                yield piece(f"{base}:{level}:{name}", x, *own)
            elif level == "clause" and len(_parts(x, "point")) > 1:
                yield from by_structure(x, "point", number)
            else:
                yield from by_size(x, *own, sizes.overlap)

    found = list(by_structure(text, "clause", None) if len(_parts(text, "clause")) > 1 else by_size(text, None, None, sizes.overlap))
    return merge_short(found, sizes)


def merge_short(found: list[Piece], sizes: Sizes = Sizes()) -> list[Piece]:
    """A short piece joins the one before it, else the one after, if both fit."""
    limit = min(sizes.most, sizes.merged)

    def join(a: Piece, b: Piece) -> Piece | None:
        t = f"{a['text']}\n{b['text']}"
        return {**a, "text": t, "merged": [*(a["merged"] or [a["id"]]), *(b["merged"] or [b["id"]])]} if len(t) <= limit else None

    out: list[Piece] = []
    todo = found[::-1]
    while todo:
        p = todo.pop()
        if len(p["text"]) < sizes.short:
            if out and (both := join(out[-1], p)):
                out[-1] = both
                continue
            if todo and (both := join(p, todo[-1])):
                todo.pop()
                out.append(both)
                continue
        out.append(p)
    return out


#: Characters of pieces after which a worker hands on what it has cut.
HANDED = 4_000_000


def _cut(rows: DataFrame, sizes: Sizes, measure: Callable[[str], int] = len) -> DataFrame:
    """(d, k, n, s): each row's struct ``d`` with a piece ``s`` of its text, the k-th of n, or
    none if it has no text. A worker has one text and the pieces that it has not handed on,
    not those of a batch."""
    names = ("chunk_id", "text", "clause_number", "point_number")
    kind = pa.struct([(n, pa.string()) for n in names] + [("fallback_split", pa.bool_()), ("merged_chunk_ids", pa.list_(pa.string()))])
    form = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("fallback_split", T.BooleanType()), T.StructField("merged_chunk_ids", T.ArrayType(T.StringType()))])

    def handed(given: pa.RecordBatch, held: list[tuple[int, int, int, dict]]) -> pa.RecordBatch:
        at, k, n, s = zip(*held) if held else ((), (), (), ())
        return pa.RecordBatch.from_arrays([given.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(s, kind)], ["d", "k", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for at, (i, t) in enumerate(zip(b.column(1), b.column(2))):
                if not t.is_valid:
                    held.append((at, None, None, None))
                    continue
                found = split_chunk(i.as_py() or "", t.as_py() or "", sizes, measure)
                for k, p in enumerate(found, 1):
                    held.append((at, k, len(found), {"chunk_id": p["id"], "text": p["text"], "clause_number": p["clause"], "point_number": p["point"], "fallback_split": p["cut"], "merged_chunk_ids": p["merged"]}))
                    size += len(p["text"])
                    if size > HANDED:
                        yield handed(b, held)
                        held, size = [], 0
            yield handed(b, held)

    return rows.mapInArrow(run, T.StructType([rows.schema["d"], T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("s", form)]))


def split(chunks: DataFrame, sizes: Sizes = Sizes(), id_col: str = "chunk_id", text: str = "text", length: Callable[[Column], Column] = F.length, measure: Callable[[str], int] = len, once: bool = False) -> DataFrame:
    """Chunks of at most ``sizes.most`` characters, other columns repeated, with
    parent_chunk_id, part_index, part_count and what split_chunk() says. ``length``
    and ``measure``: a length of one's own, in the JVM for all and in Python for what
    is too long. ``once``: for chunks that cost much to make, all go by the workers, those
    that fit as they are, so that they are made once; else these pass the workers by."""
    flat = chunks.withColumn(text, X.clean_lines(F.col(text))).where(F.col(text) != "")
    fits = F.greatest(F.length(text), length(F.col(text))) <= sizes.most
    others = [c for c in chunks.columns if c not in (id_col, text)]
    s = F.col("s")
    d = F.col("d")
    long = flat.select(F.struct(id_col, *others, F.when(fits, F.col(text)).alias("__whole")).alias("d"), F.col(id_col).cast("string").alias("i"), F.when(~fits, F.col(text)).alias("t"))
    cut = _cut(long if once else long.where(F.col("t").isNotNull()), sizes, measure)
    cut = cut.select(
        F.coalesce(s["chunk_id"], d[id_col]).alias(id_col), F.coalesce(s["text"], d["__whole"]).alias(text), *[d[c].alias(c) for c in others], F.when(s.isNotNull(), d[id_col]).alias("parent_chunk_id"), F.col("k").alias("part_index"), F.col("n").alias("part_count"),
        s["clause_number"].alias("clause_number"), s["point_number"].alias("point_number"), s["fallback_split"].alias("fallback_split"), s["merged_chunk_ids"].alias("merged_chunk_ids"),
    )
    if once:
        return cut
    whole = flat.where(fits).select(id_col, text, *others)
    return whole.unionByName(cut, allowMissingColumns=True)
