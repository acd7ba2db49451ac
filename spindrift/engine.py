"""One object for what a service does: ask, debug, sessions, catalog, jobs, uploads.

Its tables lie under a root folder (see ``stores.Table``). Questions come in batches;
models that write answers or rewrite questions are given as functions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import corpus as K
from .operators import jobs as J
from .operators import sessions as S
from .operators import tables as T
from .operators import uploads as U
from .plans import hybrid as H
from .stores import Conflict, Table, discard, stored

CHUNKS = (
    "chunk_id string, source_file string, vbpl_id string, doc_number string, doc_type string, document_title string, article_number string, clause_number string, point_number string, "
    "chapter string, section string, part string, target_article string, issue_date string, source_url string, text string"
)
RECORDS = "vbpl_id string, title string, doc_number string, doc_type string, agency_name string, issue_date string, effective_from string, updated_date string, source_url string, text_file string, chunk_count long"
MANIFEST = "id string, file_name string, workspace string, document_type string, confidence double, quality_warning string, chunk_count long, source_text_file string, seq long"
UPLOADS = "id string, file_name string, workspace string, document_type string, status string, progress int, error string, text string, confidence double"
PER_LIST = {"ask": lambda k: max(6 * k, 30), "debug": lambda k: max(2 * k, 8)}


class Engine:
    def __init__(self, spark: SparkSession, root: str, env: Mapping[str, str] | None = None, answer: Callable[[str, str], str] | None = None) -> None:
        self.spark, self.env, self.answer = spark, dict(env or {}), answer
        self.chunks, self.records = Table(spark, root, "chunks", CHUNKS), Table(spark, root, "records", RECORDS)
        self.sessions, self.jobs = Table(spark, root, "sessions", S.SESSION), Table(spark, root, "jobs", J.SCHEMA + ", seq long")
        self.manifest, self.uploads = Table(spark, root, "manifest", MANIFEST), Table(spark, root, "uploads", UPLOADS)

    @staticmethod
    def _update(table: Table, change: Callable[[DataFrame], DataFrame]) -> None:
        """What ``change`` makes of the latest rows, and again of later ones if another
        writer has been faster, so that no update is lost."""
        while True:
            n = table.version()
            try:
                table.replace(change(table.read(n)), n)
                return
            except Conflict:
                continue

    # --- questions -----------------------------------------------------------

    def _columns(self) -> H.Columns:
        return H.Columns("chunk_id", "text", "query", "question", "source_file")

    def build(self, kind: str = "bm25") -> H.Sources:
        """Index and vectors of the chunks as they are now, built if they are new."""
        return H.stored_sources(self.chunks.read(), self._columns(), kind)

    def search(self, questions: DataFrame, settings: Mapping | None = None, pins: DataFrame | None = None) -> DataFrame:
        """questions: (query, question), or (query, position, question) as a plan gives
        them; pins: (query, position, doc). The best chunks of each query, with their
        columns."""
        s = config.settings(settings)
        chunks, c = self.chunks.read(), self._columns()
        if "position" in questions.columns:
            c = replace(c, position="position")
        found = H.search(self.build(), chunks, questions, c, s["top_k"], s["mode"], pins)
        return found.withColumnRenamed("doc", "chunk_id").join(chunks, "chunk_id")

    def sources(self, questions: DataFrame, settings: Mapping | None = None) -> DataFrame:
        """As an API shows what was found."""
        return self._sources(self.search(questions, settings))

    def _sources(self, found: DataFrame) -> DataFrame:
        return K.map_sources(found, self.records.read().select("text_file", "vbpl_id", "doc_type", "doc_number", "title", "source_url", "issue_date"))

    def contexts(self, questions: DataFrame, settings: Mapping | None = None) -> DataFrame:
        return self._contexts(self.search(questions, settings))

    def _contexts(self, found: DataFrame) -> DataFrame:
        fields = {c: F.col(c) for c in ("document_title", "doc_number", "source_file", "article_number", "clause_number", "target_article", "rerank")}
        return H.context(found, fields, F.col("text"))

    def ask(self, question: str, session: str, at: str, settings: Mapping | None = None) -> dict:
        """One question: sources, the context, what the given model makes of it with
        its warnings, and both messages in the session."""
        q = self.spark.createDataFrame([(0, question)], "query long, question string")
        found, _ = stored(self.search(q, settings), "found")  # searched for once, read twice
        sources = [r.asDict() for r in self._sources(found).orderBy("rank").collect()]
        row = self._contexts(found).first()
        discard(found)
        said = self.answer(question, row["context"] if row else "") if self.answer else ""
        numbers = F.array(*[F.lit(s["document_number"]) for s in sources if s["document_number"]]).cast("array<string>")
        warnings = self.spark.range(1).select(S.citation_warnings(F.lit(said), numbers)).first()[0]
        new = [(session, "user", question, at, 0), (session, "assistant", said, at, 1)]
        said_rows = self.spark.createDataFrame(new, "session_id string, role string, content string, timestamp string, seq long")
        self._update(self.sessions, lambda rows: S.appended(rows, said_rows))
        return {"answer": said, "sources": sources, "warnings": warnings}

    def debug(self, questions: DataFrame, k: int = 5) -> dict[str, DataFrame]:
        return H.debug(self.build(), self.chunks.read(), questions, self._columns(), k)

    # --- sessions --------------------------------------------------------------

    def list_sessions(self) -> DataFrame:
        return S.sorted_sessions(S.summaries(self.sessions.read()))

    def change_session(self, session: str, title: str | None = None, pinned: bool | None = None, archived: bool | None = None) -> None:
        change = self.spark.createDataFrame([(session, title, pinned, archived)], "session_id string, title string, pinned boolean, archived boolean")
        self._update(self.sessions, lambda rows: S.patched(rows, change))

    def delete_session(self, session: str) -> None:
        self._update(self.sessions, lambda rows: rows.where(F.col("session_id") != session))

    def conversation(self, session: str) -> DataFrame:
        return S.conversation(self.sessions.read().where(F.col("session_id") == session), F.to_timestamp("updated_at")).orderBy("position")

    # --- catalog and jobs --------------------------------------------------------

    def documents(self, page: int = 1, size: int = 20, text: str | None = None, status: str | None = None, kind: str | None = None, indexed: bool = True) -> DataFrame:
        rows = T.search_documents(K.documents(self.records.read(), indexed), text, ("title", "document_number"), status=status, document_type=kind)
        return T.page(rows, page, size, F.asc("id"))

    def document(self, document_id: str) -> DataFrame:
        return K.documents(self.records.read(), True).where(F.col("id") == document_id)

    def status(self, indexed: bool = True) -> DataFrame:
        n = F.coalesce("chunk_count", F.lit(0))
        return T.corpus_status(self.records.read(), n, (n > 0) & F.lit(indexed), "updated_date")

    def list_jobs(self) -> DataFrame:
        return self.jobs.read().orderBy("seq")

    def run_job(self, kind: str, steps: list[Callable[[], object]]) -> dict:
        """Steps such as a crawl or the building of an index, as a job of the table."""
        report = lambda job: self._update(self.jobs, lambda rows: J.upsert(rows, self.spark.createDataFrame([tuple(job.values())], J.SCHEMA)))
        return J.run(kind, steps, report)

    # --- uploads -------------------------------------------------------------------

    def upload(self, files: DataFrame) -> None:
        """Files as read (id, file_name, workspace, text, confidence): without a text
        they have failed, else they await review."""
        ok = F.col("text").isNotNull()
        state = files.select(
            "id", "file_name", "workspace", F.lit("other").alias("document_type"), F.when(ok, "ocr_complete").otherwise("failed").alias("status"), F.lit(100).alias("progress"),
            F.when(~ok, "no text could be read").alias("error"), "text", "confidence",
        )
        self._update(self.uploads, lambda rows: T.upsert(rows, state, ["id"]))

    def review(self, changes: DataFrame) -> None:
        """New texts or types of uploads (id, text, document_type)."""
        c = changes.select("id", F.col("text").alias("__t"), F.col("document_type").alias("__d"))
        new = {"text": F.coalesce("__t", "text"), "document_type": F.coalesce("__d", "document_type")}
        self._update(self.uploads, lambda rows: rows.join(c, "id", "left").withColumns(new))

    def embed(self, ids: list[str], force: bool = False) -> None:
        """Reviewed uploads into the corpus (if public) and the manifest."""
        up = self.uploads.read()
        ready = up.where(F.col("id").isin(*ids) & (F.trim(F.coalesce("text", F.lit(""))) != "") & U.may_embed(F.col("confidence"), F.lit(force)))
        rows = ready.select(F.col("id").alias("upload_id"), "file_name", "text", "workspace", "document_type", "confidence")
        chunks, manifest, _ = U.persist(self.chunks.read(), self.manifest.read(), rows)
        self.chunks.replace(T.complete(chunks, self.chunks.schema))
        self.manifest.replace(manifest)
        done = ready.select("id", F.lit("ready").alias("status"), F.lit(0).alias("seq"), F.lit(100).alias("progress"), F.lit(None).cast("string").alias("error"))
        self._update(self.uploads, lambda rows: U.advanced(rows, done))

    def processed(self) -> DataFrame:
        return U.processed(self.manifest.read())

    def delete_processed(self, ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        chunks, manifest = U.removed(self.chunks.read(), self.manifest.read(), gone)
        self.chunks.replace(chunks)
        self.manifest.replace(manifest)
        self._update(self.uploads, lambda rows: T.delete(rows, gone, ["id"]))
