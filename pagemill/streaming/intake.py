"""Watching a folder: the file source as a stream, content-hash deduplication, and task events per micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill import schemas
from pagemill.functions import text as X
from pagemill.operators import tasks
from pagemill.sources.files import EXTENSIONS


#: Failed files that a micro-batch takes again at most.
RETRIES = 1000
EVENT = "task_id string, file_hash string, file_path string, status string, error string, seq long, at timestamp, batch long"


def watch(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), archive: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of accepted files.  The first micro-batches are the backfill; finished files move to archive if given."""
    reader = spark.readStream.format("binaryFile").schema(schemas.RAW_FILE).option("maxFilesPerTrigger", files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).where(X.accepts_path(F.col("path"), EXTENSIONS, skip))


def first_of_content(files: DataFrame, horizon: str | None = None) -> DataFrame:
    """(file_path, file_hash, created_at), each content once: for ever, or within a bounded horizon of event time."""
    out = files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("created_at"))
    if horizon:
        return out.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["file_hash"])
    return out.dropDuplicates(["file_hash"])


def run(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None], once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Each micro-batch goes through process(batch, number); once: what is there now, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def settled(process: Callable[[DataFrame, int], None], delay_seconds: float) -> Callable[[DataFrame, int], None]:
    """process, begun once the newest file of the micro-batch is delay_seconds old: a file that is still being written has that long to grow, and none is lost."""

    def wait(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("modificationTime").cast("double")).first()[0]  # the content is not read for this
        if newest is not None:
            time.sleep(max(0.0, min(delay_seconds, newest + delay_seconds - time.time())))
        process(batch, number)

    return wait


def fresh(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Files of a micro-batch whose content and path are new: tasks.new_tasks() with the rows' content."""
    first = tasks.new_tasks(batch.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("created_at")), known)
    return batch.join(first.select(F.col("file_path").alias("path"), "file_hash"), "path")


class TaskLog:
    """The tasks' events, log-structured: a delta folder a micro-batch and status, folded from time to time into a snapshot with a row a task.

    A micro-batch that runs again replaces its own deltas.  A snapshot counts
    once its writer has committed it (_SUCCESS); then its deltas, and all
    snapshots but the one before, which a reader may still hold, are dropped.
    So what a micro-batch reads is one snapshot and at most `every` batches'
    deltas, however long the log; and no state is held in memory.
    """

    FIRSTS = ("file_hash", "file_path", "created_at", "batch")

    def __init__(self, spark: SparkSession, path: str, every: int = 20) -> None:
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.schema = tasks.state_of(self._deltas([]), self.FIRSTS).schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str, done: bool = False) -> list[str]:
        """Names in a folder; with done those that were committed."""
        fs, p = self._fs(f"{self.path}/{folder}")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if not done or self._fs(f"{self.path}/{folder}/{n}/_SUCCESS")[0].exists(self._fs(f"{self.path}/{folder}/{n}/_SUCCESS")[1])]

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _deltas(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], EVENT).withColumn("created_at", F.col("at"))
        return self.spark.read.schema(EVENT).parquet(*(f"{self.path}/delta/{n}" for n in names)).withColumn("created_at", F.col("at"))

    def _parts(self, before: int | None = None) -> tuple[DataFrame, int, list[str]]:
        """(states of the snapshot and of the deltas behind it, the snapshot's batch, the deltas); with before, of earlier batches only."""
        kept = self._names("state", done=True)
        version = int(kept[-1]) if kept else -1
        names = [n for n in self._names("delta") if version < int(n[:9]) and (before is None or int(n[:9]) < before)]
        states = tasks.state_of(self._deltas(names), self.FIRSTS)
        if kept:
            states = states.union(self.spark.read.schema(self.schema).parquet(f"{self.path}/state/{kept[-1]}"))
        return states, version, names

    def compact(self, upto: int) -> bool:
        """Folds all events of batches up to `upto`, which have ended, into a new snapshot, if `every` of them have gathered."""
        states, version, names = self._parts(upto + 1)
        if upto - version < self.every or not names:
            return False
        tasks.merged(states, self.FIRSTS).write.mode("overwrite").parquet(f"{self.path}/state/{upto:09d}")
        for n in names:
            self._drop(f"{self.path}/delta/{n}")
        for n in self._names("state")[:-2]:
            self._drop(f"{self.path}/state/{n}")
        return True

    def known(self, before: int) -> DataFrame:
        """(file_hash, file_path) of the tasks of earlier batches."""
        return self._parts(before)[0].where(F.col("batch") < before).select("file_hash", "file_path").distinct()

    def retryable(self, before: int) -> DataFrame:
        """(path, file_hash) of tasks that failed in earlier batches, fewer than three times, the oldest first, as many as a batch may take again."""
        states = tasks.merged(self._parts(before)[0], self.FIRSTS)
        again = states.where((F.col("status") == "failed") & (F.col("attempts") < tasks.MAX_ATTEMPTS))
        return again.orderBy("created_at", "task_id").limit(RETRIES).select(F.col("file_path").alias("path"), "file_hash")

    def add(self, files: DataFrame, number: int, status: str, error: Column | None = None) -> None:
        """files: (path, file_hash)."""
        order = tasks.STATUSES.index(status)
        rows = files.select(F.col("file_hash").alias("task_id"), "file_hash", F.col("path").alias("file_path"), F.lit(status).alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error"), (F.lit(number).cast("long") * 10 + order).alias("seq"), F.current_timestamp().alias("at"), F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/{number:09d}-{status}")

    def delta(self, number: int, status: str) -> DataFrame:
        """(path, file_hash) of a batch's events of a status."""
        return self._deltas([f"{number:09d}-{status}"]).select(F.col("file_path").alias("path"), "file_hash")

    def tasks(self) -> DataFrame:
        """The tasks' state: task_id, id, file_hash, file_path, status, attempts, last_error, created_at, updated_at."""
        return tasks.merged(self._parts()[0], self.FIRSTS).withColumn("id", F.col("task_id")).drop("seq", "batch")


def to_task_table(path: str) -> Callable[[DataFrame, int], None]:
    """A process that writes pending tasks; a micro-batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("*", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
