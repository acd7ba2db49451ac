"""Uploads: reviewed text to chunks, states, and the tables that keep them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal as G
from ..functions import text as X
from . import chunking as C
from . import tables as T

#: Headings of uploaded legal texts, and the most characters of a chunk.
ARTICLE = r"(?iu)^Điều\s+(\d+[A-Za-z]?)\.\s*(.*)$"
CLAUSE = r"^(\d+)[.)]\s+"
HEADINGS = {"part": r"(?iu)^Phần\s+", "chapter": r"(?iu)^Chương\s+", "section": r"(?iu)^Mục\s+", "subsection": r"(?iu)^Tiểu mục\s+"}
#: Any of these headings; how a line begins that may be one, or an article's.
HEADING = "|".join(HEADINGS.values())
MARKED = r"(?iu)^(?:Điều|Phần|Chương|Mục|Tiểu)\s"
MOST = 1800
#: States of an upload, in the order that they may follow one another.
STATES = {"processing": ("ocr_complete", "failed"), "ocr_complete": ("ready", "failed"), "ready": ("ocr_complete",), "failed": ("processing",)}


def packed(paragraphs: Column, most: int) -> Column:
    """Paragraphs joined as long as they fit; one that is longer is a piece by itself."""
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        full = (a["held"] != "") & (F.length(a["held"]) + F.length(p) + 1 > most)
        joined = F.when(a["held"] == "", p).otherwise(F.concat(a["held"], F.lit("\n"), p))
        return F.struct(F.when(full, p).otherwise(joined).alias("held"), F.when(full, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))


def runs(items: Column, starts: Column) -> Column:
    """Slices of an array, from each of the positions in ``starts`` to the next."""
    return X.let(starts, lambda all_: F.transform(all_, lambda s, i: F.slice(items, s + 1, F.coalesce(F.get(all_, i + 1), F.size(items)) - s)))


def headings_before(marks: Column, kind: str) -> Column:
    """For each article in ``marks`` (line, kind) the last heading of ``kind`` before it: as
    many of these precede an article as its place among both is behind that among articles."""
    both = F.filter(marks, lambda m: m["kind"].isin("article", kind))
    at = F.filter(F.transform(both, lambda m, i: F.when(m["kind"] == "article", i)), lambda i: i.isNotNull())
    own = F.filter(marks, lambda m: m["kind"] == kind)
    return X.let(own, lambda h: F.transform(at, lambda i, j: F.get(h, i - j - 1)["line"]))


def cut_sections(lines: Column) -> Column:
    """(segment, lines, headings..) of a text's lines, in time that grows as they do: lines
    from one article to the next under the headings that precede it; lines before the first
    article go. A text without any article is one section, 0."""
    kind = lambda x: reduce(lambda c, k: c.when(x.rlike(k[1]), k[0]), HEADINGS.items(), F.when(x.rlike(ARTICLE), "article"))
    none = [F.lit(None).cast("string").alias(k) for k in HEADINGS]
    row = lambda segment, held, *above: F.struct(segment.alias("segment"), held.alias("lines"), *above)

    def articles(own: Column, marks: Column) -> Column:
        cut = runs(own, F.transform(F.filter(marks, lambda m: m["kind"] == "article"), lambda m: m["at"]))
        under = F.arrays_zip(cut.alias("run"), *[headings_before(marks, k).alias(k) for k in HEADINGS])
        plain = lambda run: F.filter(run, lambda x: ~x.rlike(HEADING))
        headed = F.transform(under, lambda u, i: row(i + 1, plain(u["run"]), *[u[k].alias(k) for k in HEADINGS]))
        bare = F.transform(cut, lambda run, i: row(i + 1, run, *none))
        return F.when(F.exists(marks, lambda m: m["kind"] != "article"), headed).otherwise(bare)

    def cut(own: Column) -> Column:
        seen = F.transform(own, lambda x, i: F.when(x.rlike(MARKED), F.struct(i.alias("at"), x.alias("line"), kind(x).alias("kind"))))
        some = X.let(F.filter(seen, lambda m: m["kind"].isNotNull()), lambda marks: F.when(F.exists(marks, lambda m: m["kind"] == "article"), articles(own, marks)).otherwise(F.array(row(F.lit(0), own, *none))))
        return F.when(F.size(own) > 0, some)

    return X.let(lines, cut)


def sections(uploads: DataFrame) -> DataFrame:
    """Uploads, a row for each section of their text in its place, with the title that the
    text has. A text is cut in its row: nothing is shuffled."""
    u = uploads.withColumn("text", X.uploaded_text(G.composed(F.col("text"))))
    u = u.withColumn("lines", G.prepared_lines(F.col("text")))
    others = [c for c in uploads.columns if c != "text"]
    return u.select(*others, G.detected_title(F.col("lines"), F.col("file_name")).alias("document_title"), F.explode(cut_sections(F.col("lines"))).alias("s")).select(*others, "document_title", "s.*")


def chunks(uploads: DataFrame, most: int = MOST, id_col: str = "upload_id") -> DataFrame:
    """Chunks of reviewed uploads (upload_id, file_name, text, workspace, confidence):
    whole articles, else their clauses under the article's heading, else pieces of
    whole lines; what is still too long is split as any chunk is."""
    u = uploads.select(id_col, "file_name", "text", "workspace", "confidence")
    n = F.greatest(F.col("segment"), F.lit(1))
    base = F.concat(F.col(id_col), F.lit(":article:"), n.cast("string"))
    size = F.length(F.array_join("lines", "\n"))

    def found(df: DataFrame) -> DataFrame:
        return sections(df).withColumn("head", F.when(F.col("segment") > 0, F.get("lines", 0)))

    clean = F.regexp_replace(F.array_join("lines", "\n"), r"(?U)[\s&&[^\n]]{2,}|[\s&&[^ \n]]", " ")  # lines have none at their ends
    fits = found(u).where(size <= most).select("*", base.alias("chunk_id"), clean.alias("text"), F.lit(None).cast("string").alias("__clause"))
    # a section can only be longer if its text is; composed, that has three times its signs at most
    x = found(u.where(F.length("text") * 3 > most)).where(size > most).withColumn("lines", F.when(F.col("head").isNull() | (F.size("lines") == 1), F.col("lines")).otherwise(F.slice("lines", 2, F.size("lines"))))
    starts = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | x.rlike(CLAUSE), i)), lambda i: i.isNotNull())
    g = x.select("*", F.posexplode(runs(F.col("lines"), starts)).alias("c", "clause"))
    g = g.withColumn("__clause", F.nullif(F.regexp_extract(F.get("clause", 0), CLAUSE, 1), F.lit("")))
    body = F.array_join("clause", "\n")
    g = g.withColumn("body", F.when(F.col("head").isNotNull() & ~body.startswith(F.col("head")), F.concat("head", F.lit("\n"), body)).otherwise(body))
    parts = F.filter(F.transform(F.split("body", "\n"), lambda p: F.trim(p)), lambda p: p != "")
    g = g.select("*", F.posexplode(F.when(F.length("body") <= most, F.array("body")).otherwise(packed(parts, most))).alias("p", "text"))
    part = F.when(F.length("body") > most, F.concat(F.lit(":part:"), (F.col("p") + 1).cast("string"))).otherwise("")
    cut = g.select("*", F.concat(base, F.lit(":clause:"), (F.col("c") + 1).cast("string"), part).alias("chunk_id"))
    # a chunk that is split again keeps its clause where its pieces have none
    out = fits.unionByName(C.split(cut.select(*fits.columns), C.Sizes(most=most), once=True), allowMissingColumns=True)
    number, named = F.regexp_extract("head", ARTICLE, 1), F.trim(F.regexp_extract("head", ARTICLE, 2))
    source = F.concat(F.col(id_col), F.lit("_"), G.safe_stem(F.col("file_name")), F.lit(".txt"))
    return out.select(
        "chunk_id", source.alias("source_file"), F.lit("upload_legal").alias("mode"), F.nullif(number, F.lit("")).alias("article_number"), F.nullif(named, F.lit("")).alias("article_title"),
        F.coalesce("clause_number", "__clause").alias("clause_number"), "point_number", "text", F.length("text").alias("text_length"), "document_title", *HEADINGS, id_col, "workspace", F.col("confidence").alias("ocr_confidence"),
        "parent_chunk_id", "part_index", "part_count",
    )


def document_rows(uploads: DataFrame, made: DataFrame, id_col: str = "upload_id") -> DataFrame:
    """What is kept of each reviewed upload: its text, type, warning and chunk count."""
    n = made.groupBy(id_col).agg(F.count("*").alias("chunk_count"))
    stem = F.concat(F.col(id_col), F.lit("_"), G.safe_stem(F.col("file_name")))
    x = uploads.join(n, id_col, "left")
    return x.select(
        F.col(id_col).alias("id"), "file_name", F.when(F.col("workspace") == "public", "public").otherwise("private").alias("workspace"), X.falsy_coalesce(F.col("document_type"), F.lit("other")).alias("document_type"),
        X.uploaded_text(G.composed(F.col("text"))).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), G.quality_warning(F.col("confidence")).alias("quality_warning"),
        F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), F.concat(stem, F.lit(".txt")).alias("source_text_file"), F.concat(stem, F.lit(".json")).alias("source_json_file"),
    )


def persist(corpus: DataFrame, manifest: DataFrame, uploads: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus chunks, manifest and documents after uploads are taken up. Public ones
    replace what the corpus has of their files; private ones stay apart and are in the
    manifest alone. New items go before all others."""
    made = chunks(uploads, most)
    docs = document_rows(uploads, made)
    public = made.where("workspace = 'public'")
    kept = T.replace_groups(corpus, public.select(*[c for c in public.columns if c in corpus.columns]), "source_file")
    items = docs.select("id", "file_name", "workspace", "document_type", "confidence", "quality_warning", "chunk_count", "source_text_file")
    return kept, T.upsert_front(manifest, items, ["id"]), docs


def processed(manifest: DataFrame) -> DataFrame:
    """Processed uploads, the latest id first."""
    return manifest.orderBy(F.desc("id"))


def removed(corpus: DataFrame, manifest: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus and manifest without uploads (id); chunks of public ones go with their
    file. A path outside the uploads never comes up: files are named by their ids."""
    gone = manifest.join(ids, "id", "left_semi").where("workspace = 'public'").select(F.col("source_text_file").alias("source_file"))
    return T.delete(corpus, gone, ["source_file"]), T.delete(manifest, ids, ["id"])


def advanced(states: DataFrame, events: DataFrame) -> DataFrame:
    """Uploads after events (id, status, seq, progress, error): each follows the state
    before it if it may; one that may not is passed over."""
    e = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "progress", "error"))).alias("__e"))
    may = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    start = F.struct(F.col("status").alias("status"), F.col("progress").cast("int").alias("progress"), F.col("error").alias("error"))
    step = lambda a, x: F.when(F.array_contains(may[a["status"]], x["status"]), F.struct(x["status"].alias("status"), x["progress"].cast("int").alias("progress"), x["error"].alias("error"))).otherwise(a)
    j = states.join(e, "id", "left")
    j = j.withColumn("__s", F.when(F.col("__e").isNull(), start).otherwise(F.aggregate("__e", start, step)))
    return j.withColumns({"status": F.col("__s.status"), "progress": F.col("__s.progress"), "error": F.substring("__s.error", 1, 2000)}).drop("__e", "__s")


def may_embed(confidence: Column, forced: Column) -> Column:
    """A scan of low confidence is searched only if that is asked for."""
    return G.quality_warning(confidence).isNull() | forced


def allowed(files: DataFrame, kinds: tuple[str, ...] = ("pdf", "docx", "png", "jpg", "jpeg")) -> DataFrame:
    """Files of the kinds that can be taken up."""
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds))


def tracked(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Tracked entries with the state of the results that have their id."""
    r = results.select("id", F.col("status").alias("__s"))
    return entries.join(r, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")
