"""Intake and the task log: content-hash deduplication, status fold, top-k and summaries.  State is an append-only event table; the newest event of a task is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("pending", "processing", "completed", "failed")
MAX_ATTEMPTS = 3
HISTORY = 100


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def new_tasks(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files: (file_path, file_hash, created_at).  One task per content not known yet, of its first file by (created_at, file_path).

    known: (file_hash, file_path).  A path has one task for ever: a file whose
    path is known, or comes twice with other content, is no new task.
    """
    order = F.struct("created_at", "file_path", "file_hash")
    first = F.min_by(F.struct("file_path", "created_at"), order)
    fresh = files.groupBy("file_hash").agg(first.alias("f"), F.count("*").alias("copies"))
    fresh = fresh.select("file_hash", F.col("f.file_path").alias("file_path"), F.col("f.created_at").alias("created_at"), "copies")
    if known is not None:
        fresh = fresh.join(known.select("file_hash").distinct(), "file_hash", "left_anti").join(known.select("file_path").distinct(), "file_path", "left_anti")
    one = fresh.groupBy("file_path").agg(F.min_by(F.struct("file_hash", "created_at", "copies"), order).alias("t"))
    return one.select("t.file_hash", "file_path", "t.created_at", "t.copies")


def fold_events(events: DataFrame) -> DataFrame:
    """(task_id, status, attempts, last_error, updated_at) from TASK_EVENT rows: attempts counts failures, the error is that of the newest event."""
    return events.groupBy("task_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.count_if(F.col("status") == "failed").cast("int").alias("attempts"),
        F.max_by("error", "seq").alias("last_error"),
        F.max_by("at", "seq").alias("updated_at"),
    )


def state_of(events: DataFrame, firsts: tuple[str, ...] = ()) -> DataFrame:
    """(task_id, seq, status, attempts, last_error, updated_at, and the least of each of firsts) of some of the tasks' events."""
    failed = (F.col("status") == "failed").cast("long").alias("attempts")
    return merged(events.select("task_id", "seq", "status", failed, F.col("error").alias("last_error"), F.col("at").alias("updated_at"), *firsts), firsts)


def merged(states: DataFrame, firsts: tuple[str, ...] = ()) -> DataFrame:
    """States of parts of the events, one a task: the newest part has the status, failures add up.  Parts may come in any order and be merged before."""
    newest = [F.max_by(c, "seq").alias(c) for c in ("status", "last_error", "updated_at")]
    out = states.groupBy("task_id").agg(F.max("seq").alias("seq"), newest[0], F.sum("attempts").alias("attempts"), *newest[1:], *(F.min(c).alias(c) for c in firsts))
    return out.select("task_id", "seq", "status", "attempts", "last_error", "updated_at", *firsts)


def status_summary(tasks: DataFrame, status: str = "status") -> DataFrame:
    """(status, n) for the four statuses, zeros too, and "total"."""
    session = tasks.sparkSession
    every = session.createDataFrame([(s,) for s in (*STATUSES, "total")], T.StructType([T.StructField("status", T.StringType())]))
    counts = tasks.rollup(F.col(status).alias("status")).agg(F.count("*").alias("n"), F.count(status).alias("known"), F.grouping_id().alias("all"))
    counts = counts.select(F.when(F.col("all") == 1, "total").otherwise(F.col("status")).alias("status"), F.when(F.col("all") == 1, F.col("known")).otherwise(F.col("n")).alias("n"))
    return F.broadcast(every).join(counts.where("status is not null"), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def next_pending(tasks: DataFrame, n: int = 1) -> DataFrame:
    return tasks.where((F.col("status") == "pending") & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("created_at", "id").limit(n)


def resumable(tasks: DataFrame) -> DataFrame:
    s = F.col("status")
    return tasks.where((s == "pending") | ((s == "failed") & (F.col("attempts") < MAX_ATTEMPTS))).orderBy("created_at", "id")


def recent_failures(tasks: DataFrame, n: int = 5) -> DataFrame:
    return tasks.where(F.col("status") == "failed").orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(n).select("id", "file_path", "last_error", "updated_at")


def by_hash(tasks: DataFrame, file_hash: str) -> DataFrame:
    return tasks.where(F.col("file_hash") == file_hash).limit(1)


def progress(events: DataFrame) -> DataFrame:
    """Counters over PROGRESS_EVENT rows, in one row."""
    return events.agg(
        F.count_if(F.col("status") == "completed").alias("total_processed"),
        F.count_if(F.col("status") == "failed").alias("total_failed"),
        F.max_by("file_path", "seq").alias("last_file"),
        F.max("at").alias("last_updated"),
    )


def history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The newest `keep` events; a top-k, not a window over one partition."""
    return events.orderBy(F.col("seq").desc()).limit(keep)


def latest_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: a partial aggregate, no sort."""
    rest = [c for c in events.columns if c != key]
    newest = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(key, "r.*").select(*events.columns)
