"""Input checks, job states and their expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATES, TERMINAL

#: The cap on an upload, and the marker that a PDF starts with.
MAX_BYTES = 50 * 1024 * 1024
PDF_MARK = "%PDF-"


def validation_reason(name: Column, size: Column, head: Column, readable: Column, encrypted: Column, page: Column, pages: Column, paths: Column, words: Column, cap: int = MAX_BYTES) -> Column:
    """The first rule that an input breaks, or null.  Negative pages are rejected too."""
    return (
        F.when(~F.lower(name).endswith(".pdf"), "unsupported_format")
        .when(size > cap, "file_too_large")
        .when(F.substring(head, 1, 5) != PDF_MARK, "unsupported_format")
        .when(~readable, "unreadable")
        .when(encrypted, "unreadable")
        .when((page >= pages) | (page < 0), "unreadable")
        .when((paths == 0) & (words == 0), "raster_or_empty")
    )


def first_rejection(checks: DataFrame) -> DataFrame:
    """``checks``: comparison_id, role (old or new), reason.  (comparison_id, role, reason) of the first rejected role."""
    bad = checks.where(F.col("reason").isNotNull())
    order = F.when(F.col("role") == "old", 0).otherwise(1)
    return bad.groupBy("comparison_id").agg(F.min_by(F.struct("role", "reason"), order).alias("r")).select("comparison_id", "r.*")


def expired(jobs: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """``jobs``: job_id, state (null: unreadable), expires_at, newest_file.  The jobs that a sweep at ``now`` removes: finished
    ones past their expiry, and unreadable ones whose newest file is older than the time to live."""
    old = F.when(F.col("state").isNull(), F.col("newest_file") < now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).otherwise(
        F.col("state").isin(TERMINAL) & (F.col("expires_at") < now)
    )
    return jobs.where(old)


def keep_set(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    return jobs.join(gone.select("job_id"), "job_id", "left_anti")


def stage_timings(marks: DataFrame) -> DataFrame:
    """``marks``: job_id, stage, ms.  A map of stage to milliseconds per job, three decimals."""
    per = marks.groupBy("job_id", "stage").agg(F.round(F.sum("ms"), 3).alias("ms"))
    return per.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("timings"), F.round(F.sum("ms"), 3).alias("total_ms"))


def error_envelope(code: Column, message: Column, comparison: Column) -> Column:
    return F.struct(F.struct(code.alias("code"), message.alias("message"), comparison.alias("comparison_id")).alias("error"))


#: The states that a job passes through in order, and those that end it early, by the state that they may follow.
PROGRESS = STATES[: STATES.index("done") + 1]
ENDS = {"rejected": "extracting", "declined": "registering"}


def follows(before: str | None, state: str | None) -> bool:
    """Whether a job in ``before`` (None: new) may go on to ``state``: the next one in order, failed from any that is not final, rejected
    while it is extracted and declined while it is registered."""
    if before in TERMINAL:
        return False
    if state == "failed":
        return before is not None
    if state in ENDS:
        return before == ENDS[state]
    return state in PROGRESS and PROGRESS.index(state) == (PROGRESS.index(before) + 1 if before else 0)
