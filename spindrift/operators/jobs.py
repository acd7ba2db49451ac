"""Jobs: steps that run one after another, with progress and errors kept as rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, type string, status string, progress int, started_at string, completed_at string, error string"


def now() -> str:
    return datetime.now(UTC).isoformat()


def run(kind: str, steps: list[Callable[[], object]], report: Callable[[dict], None] = lambda job: None) -> dict:
    """Runs the steps; ``report`` gets the job as it begins, after every step and as it
    ends. A step that fails ends it, with the first 2000 characters of the error."""
    job = {"id": f"job-{uuid.uuid4().hex[:12]}", "type": kind, "status": "running", "progress": 5, "started_at": now(), "completed_at": None, "error": None}
    report(dict(job))
    try:
        for n, step in enumerate(steps, 1):
            step()
            job["progress"] = min(95, n * 100 // max(1, len(steps)))
            report(dict(job))
        job |= {"status": "completed", "progress": 100}
    except Exception as e:  # noqa: BLE001  what a step raises is what the job reports
        job |= {"status": "failed", "error": str(e).strip()[:2000]}
    job["completed_at"] = now()
    report(dict(job))
    return job


def upsert(jobs: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Jobs with ``new`` in the place of those with their id, others before all."""
    n = new.drop(seq) if seq in new.columns else new
    places = jobs.select("id", F.col(seq).alias("__at"))
    low = jobs.agg(F.coalesce(F.min(seq), F.lit(0)).alias("__low"))
    j = n.join(places, "id", "left").crossJoin(low)  # one row
    fresh = F.row_number().over(Window.partitionBy(F.col("__at").isNull()).orderBy(F.desc("id")))  # a handful of new jobs
    j = j.withColumn(seq, F.coalesce("__at", F.col("__low") - fresh).cast("long")).drop("__at", "__low")
    return jobs.join(n.select("id"), "id", "left_anti").unionByName(j.select(*jobs.columns))
