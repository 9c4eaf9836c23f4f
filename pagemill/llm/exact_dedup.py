"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Records (digest, smallest identifier, count) are flushed as runs: each memtable
becomes a run sorted by digest, with a filter of its digests, and compaction
merges the runs of a full level into one run of the next level, keeping the
smallest identifier.  A memtable's digests that pass a run's filter are looked
up in the run; what it holds are hits, and the bytes behind hits are compared
before any row counts as a copy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm._common import bit_words, drop_path, filter_words, may_hold, numbered, spare_name, without_rows, written

#: Digests of a memtable: some 10 GB of them, which all tasks write at once.
MEMTABLE_ROWS = 1 << 27
#: Memtables of a small table, so that filters and compaction are at work there too.
LEAST_MEMTABLES = 4
SPACE = r"[\x20\x09-\x0D]+"
KEEPER = T.StructType([T.StructField("no_id", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("row", T.LongType())])
RUN = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keeper", KEEPER), T.StructField("n", T.LongType())])


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _keeper(doc_id: Column, row: Column) -> Column:
    """Ordered so that its minimum is the smallest id, null ids last, then the first row."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), row.alias("row"))


@dataclass(frozen=True)
class Run:
    """A sorted run of digests, and its filter: a bit set of `words` words."""

    path: str
    filter_path: str
    words: int


class MergeIndex:
    """Levels of sorted digest runs with filters.  A level of `fanout` runs is compacted into one run of the next.

    A new memtable is looked up in every run: digests that pass a run's filter
    are merged with the run, and those it holds are hits.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[Run]] = []
        self.found: list[str] = []

    def _read(self, run: Run) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(run.path)

    def _run(self, records: DataFrame) -> Run:
        merged = records.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.sum("n").alias("n"))
        kept, path = written(merged.sortWithinPartitions("digest"), "run")
        words = filter_words(kept.count())
        return Run(path, written(bit_words(kept, "digest", words), "filter")[1], words)

    def _drop(self, *runs: Run) -> None:
        drop_path(self.spark, *(p for r in runs for p in (r.path, r.filter_path)))

    def _looked_up(self, new: Run, old: Run) -> DataFrame:
        bits = self.spark.read.schema("word long, bits long").parquet(old.filter_path)
        maybe = may_hold(self._read(new).select("digest"), "digest", bits, old.words, "maybe").where("maybe").select("digest")
        return maybe.join(self._read(old).select("digest"), "digest", "left_semi")

    def flush(self, records: DataFrame) -> None:
        """records: digest, keeper, n; one memtable."""
        new = self._run(records)
        hits = [self._read(new).where("n > 1").select("digest"), *(self._looked_up(new, run) for level in self.levels for run in level)]
        self.found.append(written(reduce(DataFrame.union, hits).distinct(), "hits")[1])
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(new)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            self._compact(k)
            k += 1

    def _compact(self, k: int) -> None:
        runs, self.levels[k] = self.levels[k], []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(self._run(reduce(DataFrame.union, map(self._read, runs))))
        self._drop(*runs)

    def hits(self) -> DataFrame:
        """(digest): every digest that came more than once."""
        schema = T.StructType(RUN.fields[:1])
        return reduce(DataFrame.union, (self.spark.read.schema(schema).parquet(p) for p in self.found)).distinct() if self.found else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        """One record per digest over all levels."""
        runs = [self._read(r) for level in self.levels for r in level] or [self.spark.createDataFrame([], RUN)]
        return runs[0] if len(runs) == 1 else reduce(DataFrame.union, runs).groupBy("digest").agg(F.min("keeper").alias("keeper"), F.sum("n").alias("n"))

    def drop(self) -> None:
        self._drop(*(r for level in self.levels for r in level))
        drop_path(self.spark, *self.found)
        self.levels, self.found = [], []


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memtables: int | None = None, fanout: int = 4, digest=None, row: str | None = None) -> DataFrame:
    """One row per row of docs: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after white-space normalisation; of
    equal texts the row with the smallest id stays, null ids last, and of equal
    ids the first row: repeated rows are copies of one another.  Null texts
    count as empty, and empty texts as equal.  Only the two named columns are
    read, so others may have any name.  An empty table gives an empty result.

    row: a column of numbers as numbered() gives them, if docs has one.
    memtables: as many as hold MEMTABLE_ROWS rows each, unless given, and
    LEAST_MEMTABLES at least.
    digest (text column -> binary column; SHA-256 unless given) may collide:
    rows that share a digest but not their bytes end in groups of their own.
    The copies of a hot text are combined before each shuffle; the last join is
    one that adaptive execution can split.
    """
    spark = docs.sparkSession
    digest = digest or (lambda t: F.unhex(F.sha2(t.cast("binary"), 256)))
    own = numbered(docs, row := spare_name(docs, "row_no")) if row is None else docs
    own = own.select(F.col(row).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("text"))
    log, _ = written(own.select("row_id", "doc_id", digest(F.col("text")).alias("digest"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "log")
    index = MergeIndex(spark, fanout)
    memtables = memtables or max(LEAST_MEMTABLES, -(-log.count() // MEMTABLE_ROWS))
    for k in range(memtables):
        batch = log.where(F.pmod(F.xxhash64("row_id"), F.lit(memtables)) == k)
        index.flush(batch.select("digest", _keeper(F.col("doc_id"), F.col("row_id")).alias("keeper"), F.lit(1).cast("long").alias("n")))
    hits, hits_path = written(index.hits(), "hits")
    words = filter_words(hits.count())
    # Verification: the bytes of every text whose digest may be a hit, equal ones combined in each map task first.
    bits, bits_path = written(bit_words(hits, "digest", words), "filter")
    suspects = may_hold(own.select("row_id", "doc_id", digest(F.col("text")).alias("digest"), "text"), "digest", bits, words, "hit").where("hit")
    texts = suspects.groupBy("digest", "text").agg(F.min(_keeper(F.col("doc_id"), F.col("row_id"))).alias("keeper"), F.count("*").alias("n"))
    proof, _ = written(texts.select("digest", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.xxhash64("text").alias("mark"), "keeper", "n"), "verified")
    index.drop()
    drop_path(spark, bits_path, hits_path)
    groups = proof.where("n > 1").select(F.col("text_sha256").alias("__sha"), F.col("digest").alias("__digest"), "keeper", "n")
    out = log.join(groups, (F.col("digest") == F.col("__digest")) & (F.col("text_sha256") == F.col("__sha")), "left")
    return out.select(
        "row_id",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("keeper.row") == F.col("row_id"))).alias("kept"),
        "text_sha256",
    )


def dedup_report(docs: DataFrame) -> DataFrame:
    """exact_groups() in the columns doc_id, keep_id, group_size, kept, text_sha256; its rules for nulls, empty and long texts, ties, repeated rows, empty tables and other columns hold."""
    return exact_groups(docs).drop("row_id")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without its exact copies, in its own columns, whatever their names.

    Null texts count as empty, and empty ones as copies of one another; texts
    of any length are compared whole.  Of equal texts the row of the smallest id
    stays, null ids last, and one of rows that are alike.  An empty table stays
    empty.
    """
    own = numbered(docs, row := spare_name(docs, "row_no"))
    return without_rows(own, exact_groups(own, doc_id, text, row=row).where("not kept"), row)
