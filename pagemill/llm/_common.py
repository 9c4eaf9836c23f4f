"""Shared tables, row numbers and connected components for the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
FILES = 1 << 17
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_pagemill_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="pagemill-")
            spark._pagemill_root = root
            atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed at exit unless drop_path() removes it first."""
    path = f"{shared_root(spark)}/pagemill-{uuid.uuid4().hex[:12]}-{name}"
    if not _made:
        atexit.register(_drop_all)
    _made.append((spark, path))
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)


def drop_path(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def _drop_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has ended: the cluster's folder keeps what is left
            return


def written(df: DataFrame, name: str, partition_by: str | None = None, **options) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd").options(**options)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _reads_parquet(df: DataFrame) -> bool:
    """Whether df's rows are rows of Parquet files, one for one but for filters."""
    if "_metadata" in {c.lower() for c in df.columns}:
        return False
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number that is unique, and the same at each reading, whatever executors there are.

    A row of a Parquet file is known by its file's place among the sorted paths
    and its own within the file; the paths' places are sent to all tasks, at
    most FILES of them.  Rows of any other kind, and of more files, are numbered
    once and written, and what was written is returned.
    """
    if not _reads_parquet(df) or len(df.inputFiles()) > FILES:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")[0]
    path, place = spare_name(df, "file_path"), spare_name(df, "file_place")
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(name))
    places = rows.select(path).distinct().withColumn(place, F.row_number().over(Window.orderBy(path)).cast("long"))
    places, _ = written(places, "files")
    return rows.join(F.broadcast(places), path).withColumn(name, F.shiftleft(F.col(place), 36) + F.col(name)).drop(path, place)


def spare_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """docs without the rows whose number, in the column row that numbered() added, is in gone (row_id), and without that column.

    Texts that stay for sure don't move: only rows that a bounded bit set lets
    through are joined.
    """
    gone, _ = written(gone.select("row_id"), "gone")
    words = filter_words(gone.count())
    bits, _ = written(bit_words(gone, "row_id", words), "filter")
    flag, key = spare_name(docs, "row_flag"), spare_name(docs, "row_gone")
    marked = may_hold(docs, row, bits, words, flag)
    suspects = marked.where(F.col(flag)).join(gone.select(F.col("row_id").alias(key)), F.col(row) == F.col(key), "left_anti")
    return marked.where(~F.col(flag)).union(suspects).drop(row, flag)


def joined_rows(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df joined to ids by their long column key, ids holding each once; rows of df that have no match for sure don't move."""
    ids, _ = written(ids, "ids")
    words = filter_words(ids.count())
    bits, _ = written(bit_words(ids, key, words), "filter")
    flag = spare_name(df, "row_flag")
    return may_hold(df, key, bits, words, flag).where(F.col(flag)).drop(flag).join(ids, key)


# Memory of Python workers, which live on from task to task.


def release() -> None:
    """Gives what a task has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable) -> Callable:
    """run (batches -> batches), after which the worker's memory is given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


# A set of 64-bit keys as words of bits: of bounded size whatever the number of keys, with false positives only.


def filter_words(keys: int) -> int:
    """Words for so many keys: 16 bits a key, a power of two between LEAST_WORDS and MOST_WORDS (16 MB; fuller sets let more through)."""
    words = LEAST_WORDS
    while words < MOST_WORDS and words * 4 < keys:
        words *= 2
    return words


def bit_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word long, bits long): at most `words` rows; the bit of each key is set.  words is a power of two."""
    slot = F.xxhash64(F.col(key), F.lit(7))
    return keys.groupBy(F.pmod(F.shiftright(slot, 6), F.lit(words)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, 7), 64) as int))")).alias("bits"))


def may_hold(df: DataFrame, key: str, bits: DataFrame, words: int, flag: str) -> DataFrame:
    """Adds flag: whether the key may be in the set behind bit_words().  The broadcast is bounded by `words` rows of 16 bytes."""
    word, held = spare_name(df, "bits_word"), spare_name(df, "bits_held")
    small = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(held)))
    slot = F.xxhash64(F.col(key), F.lit(7))
    hit = F.coalesce(F.getbit(F.col(held), F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False))
    return df.withColumn(word, F.pmod(F.shiftright(slot, 6), F.lit(words))).join(small, word, "left").withColumn(flag, hit).drop(word, held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable.  edges: (u, v), longs, none equal; either order.

    Large-star and small-star rounds, each written to the shared folder; a
    node's links are never gathered in one task (minima are pre-aggregated, the
    joins are ones that adaptive execution can split).  Null ends are ignored.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = written(e, "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small, new = written(small, "edges")
        drop_path(spark, path)
        path = new
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = small
        if now == seen:
            break
        seen = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
