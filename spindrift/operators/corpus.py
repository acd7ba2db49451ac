"""From crawled records to chunks and what an API shows of them: flattening details,
enriching chunks, compacting metadata, rebuilding records, listing documents, mapping
results to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal as G
from ..functions import text as X

NAMED = "struct<name:string,code:string>"
#: What a document's detail looks like, as served.
DETAIL = (
    f"id string, title string, docNum string, docType {NAMED}, agencyName string, issueDate string, effFrom string, effTo string, publicDate string, updatedDate string, "
    f"effStatus {NAMED}, documentMajors array<{NAMED}>, documentFields array<{NAMED}>, documentIssues array<{NAMED}>, signerTitle string, positionName string, signerPosition string, "
    f"signer string, signerName string, organization {NAMED}, hasContent boolean, isOld boolean"
)
#: Fixed value: where a document is shown.
DETAIL_URL = "https://vbpl.vn/van-ban/chi-tiet/"
#: Columns that chunks take over from their document.
FROM_DOCUMENT = (
    "doc_type", "doc_type_code", "effective_status", "effective_status_code", "agency_name", "issue_date", "effective_from", "effective_to", "majors", "fields",
    "signer_title", "signer", "source_url",
)
#: What is kept of a chunk in each store, in order.
REBUILT = (
    "chunk_id", "source_file", "vbpl_id", "doc_number", "doc_type", "effective_status", "agency_name", "issue_date", "effective_from", "effective_to", "majors", "fields",
    "source_url", "mode", "article_number", "clause_number", "point_number", "document_title", "chapter", "part", "target_article", "text",
)
MERGED = ("parent_chunk_id", "parent_context_text", "merged_short_chunk", "merged_chunk_ids", "merged_clause_numbers", "merged_point_numbers")
SEARCHED = (*REBUILT[:-3], "section", "part", *MERGED, "target_article", "text")
VECTOR = (*REBUILT[:-2], "section", *MERGED, "target_article", "text", "searchable_text", "embedding_text", "embedding_input_trimmed")


def metadata(details: DataFrame) -> DataFrame:
    """Details as served (see DETAIL) to one flat record each."""
    names = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{NAMED}>")), lambda x: x["name"]), lambda n: X.text_of(n) != "")
    return details.select(
        F.col("id").alias("vbpl_id"), "title", F.col("docNum").alias("doc_number"), F.col("docType.name").alias("doc_type"), F.col("docType.code").alias("doc_type_code"),
        F.col("agencyName").alias("agency_name"), F.col("issueDate").alias("issue_date"), F.col("effFrom").alias("effective_from"), F.col("effTo").alias("effective_to"),
        F.col("publicDate").alias("public_date"), F.col("updatedDate").alias("updated_date"), F.col("effStatus.name").alias("effective_status"), F.col("effStatus.code").alias("effective_status_code"),
        names("documentMajors").alias("majors"), names("documentFields").alias("fields"), names("documentIssues").alias("issues"),
        X.falsy_coalesce(F.col("signerTitle"), F.col("positionName"), F.col("signerPosition")).alias("signer_title"), X.falsy_coalesce(F.col("signer"), F.col("signerName")).alias("signer"),
        F.col("organization.name").alias("organization"), F.col("hasContent").alias("has_content"), F.col("isOld").alias("is_old"),
        F.concat(F.lit(DETAIL_URL), F.col("id")).alias("source_url"),
    )


def enrich(chunks: DataFrame, records: DataFrame, key: str = "vbpl_id") -> DataFrame:
    """Chunks with the columns of their document, its property text, and its files
    (text_file, chunks_file of ``records``). The join is left to the optimiser: it
    broadcasts the records if their size allows."""
    none = F.array().cast("array<string>")
    r = records.select(
        key, *[F.coalesce(F.col(c), none).alias(c) if c in ("majors", "fields") else F.col(c) for c in FROM_DOCUMENT],
        G.property_text({c: F.col(c) for c in [*{n for _, n in G.PROPERTIES}, "organization"]}).alias("metadata_text"),
        F.col("text_file").alias("source_file"), "text_file", "chunks_file",
    )
    return chunks.select(*[c for c in chunks.columns if c == key or c not in r.columns]).join(r, key)


def source_file(columns: set[str]) -> Column:
    """The file of a chunk: its own, its text's, else one named by an id."""
    of = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    named = F.concat(F.lit("vbpl/"), X.falsy_coalesce(of("vbpl_id"), of("doc_number"), of("chunk_id")))
    return X.falsy_coalesce(of("source_file"), of("text_file"), named)


def compact(chunks: DataFrame, keep: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Chunks with these columns alone; what a chunk lacks is null."""
    have = set(chunks.columns)

    def one(c: str) -> Column:
        if c == "source_file":
            return source_file(have).alias(c)
        value = F.col(c) if c in have else F.lit(None).cast("string")
        value = value.cast("string") if c == "vbpl_id" else X.falsy_coalesce(value, F.lit("article")) if c == "mode" else X.text_of(value) if c == "text" else value
        return value.alias(c)

    return chunks.select(*map(one, keep))


def preview(text: Column, n: int = 400) -> Column:
    return F.substring(X.text_of(text), 1, n)


def records_from_chunks(chunks: DataFrame, texts: DataFrame, seq: str = "seq") -> DataFrame:
    """Records of documents rebuilt from their chunk files: the first chunk's columns,
    the number of chunks, and the length of the text. texts: (text_file, text)."""
    first = ["document_title", "doc_number", *[c for c in FROM_DOCUMENT], "text_file"]
    g = chunks.where(X.text_of(F.col("vbpl_id").cast("string")) != "").groupBy(F.col("vbpl_id").cast("string").alias("vbpl_id"), "chunks_file")
    rows = g.agg(F.min_by(F.struct(*first), seq).alias("f"), F.count("*").alias("chunk_count")).select("vbpl_id", "f.*", "chunk_count", "chunks_file").withColumnRenamed("document_title", "title")
    lengths = texts.select("text_file", F.length("text").cast("long").alias("text_length"))
    return rows.join(lengths, "text_file", "left").withColumn("text_length", F.coalesce("text_length", F.lit(0).cast("long")))


def resumed(records: DataFrame, chunks: DataFrame, more: DataFrame, from_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and chunks of an interrupted crawl, each id once, in the order of their
    sources: what was listed, then what chunk files add. ``more`` and ``from_files``:
    chunks and records of the files. All have ``seq``."""

    def first(parts: list[DataFrame], key: str) -> DataFrame:
        both = None
        for n, p in enumerate(parts):
            p = p.withColumn("__part", F.lit(n))
            both = p if both is None else both.unionByName(p, allowMissingColumns=True)
        w = Window.partitionBy(key).orderBy("__part", "seq")
        return both.where(X.text_of(F.col(key).cast("string")) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__part")

    listed = chunks.select(F.col("vbpl_id")).where("vbpl_id IS NOT NULL").distinct()
    added = from_files.join(listed, "vbpl_id", "left_anti")
    return first([records, added], "vbpl_id"), first([chunks, more], "chunk_id")


def documents(records: DataFrame, indexed: bool) -> DataFrame:
    """Records as the catalog shows them, in order of their ids."""
    n = F.coalesce(F.col("chunk_count").cast("long"), F.lit(0).cast("long"))
    text = lambda c, other: X.falsy_coalesce(F.col(c), F.lit(other))
    updated = X.falsy_coalesce(F.col("updated_date"), F.col("issue_date"))
    return records.select(
        F.col("vbpl_id").alias("id"), X.falsy_coalesce(F.col("title"), F.col("doc_number"), F.col("vbpl_id")).alias("title"), text("doc_number", "Chua ro").alias("document_number"),
        text("doc_type", "law").alias("document_type"), F.col("issue_date").alias("issued_date"), F.col("effective_from").alias("effective_date"),
        text("agency_name", "Co quan nha nuoc").alias("issuing_authority"), X.text_of(F.col("source_url")).alias("source_url"),
        F.when((n > 0) & F.lit(indexed), "indexed").when(n > 0, "chunked").otherwise("crawled").alias("status"), n.alias("chunk_count"), updated.alias("last_updated"),
    ).orderBy("id")


def file_documents(files: DataFrame, counts: DataFrame, indexed: bool) -> DataFrame:
    """Documents that have no record: type, number, date and title out of their text
    and slug. files: (text_file, title, text, url); counts: (text_file, chunk_count)."""
    slug = G.stem(F.col("text_file"))
    n = F.coalesce(F.col("chunk_count"), F.lit(0).cast("long"))
    x = files.join(counts, "text_file", "left").withColumn("document_type", G.detected_type(slug))
    return x.select(
        slug.alias("id"), X.falsy_coalesce(F.trim("title"), G.slug_title(slug)).alias("title"), X.falsy_coalesce(G.number_from_text(F.col("text"), slug), F.lit("Chưa rõ")).alias("document_number"),
        "document_type", X.text_of(X.issued_date(F.col("text"))).alias("issued_date"), G.issuing_authority(F.col("document_type")).alias("issuing_authority"), X.text_of(F.col("url")).alias("source_url"),
        F.when((n > 0) & F.lit(indexed), "indexed").when(n > 0, "chunked").otherwise("crawled").alias("status"), n.alias("chunk_count"), preview(F.col("text"), 500).alias("preview"),
    ).orderBy("id")


def map_sources(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """Results as an API shows them. Their document is looked up by text file, then by
    id. results: chunk_id, source_file, vbpl_id, doc_type, doc_number, document_title,
    article_number, clause_number, point_number, parent_chunk_id, target_article, text,
    preview, source_url, issue_date, sources, rerank, rrf, score; manifest: text_file,
    vbpl_id, doc_type, doc_number, title, source_url, issue_date."""
    kinds = dict(results.dtypes)
    of = lambda c: F.col(c) if c in kinds else F.lit(None).cast("array<string>" if c == "sources" else "string")
    m = F.struct(*[F.col(c).cast("string").alias(c) for c in ("doc_type", "doc_number", "title", "source_url", "issue_date")])
    named = F.regexp_extract(of("source_file"), r"^vbpl/(\d+)$", 1)
    x = results.withColumn("__id", X.falsy_coalesce(of("vbpl_id").cast("string"), named))
    by_file = manifest.where(X.text_of(F.col("text_file")) != "").groupBy("text_file").agg(F.max_by(m, "vbpl_id").alias("__f"))
    by_id = manifest.where(X.text_of(F.col("vbpl_id").cast("string")) != "").groupBy(F.col("vbpl_id").cast("string").alias("__vid")).agg(F.max_by(m, "text_file").alias("__v"))
    x = x.join(by_file, of("source_file") == F.col("text_file"), "left").join(by_id, F.col("__id") == F.col("__vid"), "left").withColumn("__m", F.coalesce("__f", "__v"))
    kind = G.source_type(X.falsy_coalesce(F.col("__m.doc_type"), of("doc_type")), X.text_of(of("source_file")))
    number = X.falsy_coalesce(F.trim(X.falsy_coalesce(F.col("__m.doc_number"), of("doc_number"))), G.number_from_slug(of("source_file")), G.number_from_slug(of("document_title")))
    number = X.text_of(number)
    title = G.source_title(X.falsy_coalesce(of("document_title"), F.col("__m.title")), number, kind, X.falsy_coalesce(F.col("__id"), of("chunk_id").cast("string")))
    scores = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("rerank", "rrf", "score") if c in kinds]
    sources = F.coalesce(of("sources"), F.array().cast("array<string>"))
    keep = [c for c in ("query", "rank") if c in kinds]
    return x.select(
        *keep, of("chunk_id").cast("string").alias("id"), X.falsy_coalesce(F.col("__id"), G.stem(of("source_file")), of("chunk_id").cast("string"), F.lit("unknown")).alias("document_id"),
        title.alias("document_title"), number.alias("document_number"), *[of(c).alias(c) for c in ("article_number", "clause_number", "point_number", "parent_chunk_id", "target_article")],
        X.text_of(X.falsy_coalesce(of("text"), of("preview"))).alias("chunk_text"), F.coalesce(*scores, F.lit(0.0)).alias("relevance_score"),
        F.when(F.size(sources) == 1, F.get(sources, 0)).otherwise("hybrid").alias("retrieval_origin"),
        X.falsy_coalesce(of("source_url"), F.col("__m.source_url")).alias("source_url"), X.falsy_coalesce(of("issue_date"), F.col("__m.issue_date")).alias("issued_date"), kind.alias("document_type"),
    )


def private_sources(uploads: DataFrame, manifests: DataFrame, provider: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Chunk tables and vector folders of private uploads, each once. uploads:
    workspace, chunks_path, api_index, local_index; manifests: folder, built, provider."""
    from .vectors import usable

    mine = uploads.where("workspace = 'private'")
    chunks = mine.where(F.trim(X.text_of(F.col("chunks_path"))) != "").select(F.regexp_replace("chunks_path", r"\.json$", ".jsonl").alias("chunks")).distinct()
    base = F.regexp_replace("chunks_path", r"/[^/]*$", "")
    pick = lambda kind: F.coalesce(F.regexp_replace(F.nullif(F.trim(F.col(f"{kind}_index")), F.lit("")), r"/[^/]*$", ""), F.concat(base, F.lit(f"/embeddings/{kind}")))
    folders = mine.select(F.explode(F.array(pick("api"), pick("local"))).alias("folder")).where("folder IS NOT NULL").distinct()
    return chunks, folders.join(usable(manifests, provider, keys).select("folder"), "folder", "left_semi")


def graph_ids(chunks: DataFrame) -> DataFrame:
    """Chunks of articles with the ids of their document and article."""
    doc = X.falsy_coalesce(F.col("vbpl_id").cast("string"), F.col("doc_number"), F.col("source_file"))
    return chunks.where(X.text_of(F.col("article_number")) != "").withColumn("document_id", doc).withColumn("article_id", F.concat("document_id", F.lit(":article:"), F.lower("article_number")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has: none where a uniqueness constraint holds."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scannable(files: DataFrame, most: int | None = None) -> DataFrame:
    """Files (path, length) that are looked through for pins: all, unless a greatest
    length is given."""
    return files if most is None else files.where(F.col("length") <= most)


def checksum(files: DataFrame) -> DataFrame:
    """(path, sha256) of files read as binaryFile."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def rules_index(entries: DataFrame, manifest: dict, rules_sha256: str, provider: str, model: str) -> DataFrame | None:
    """Stored entries of a rule index, unless its manifest is of other rules, another
    provider or model, or another number of entries."""
    wanted = {"rules_sha256": rules_sha256, "embedding_provider": provider, "embedding_model": model}
    if any(manifest.get(k) != v for k, v in wanted.items()):
        return None
    n = entries.count()
    return entries if n and n == manifest.get("count", n) else None


