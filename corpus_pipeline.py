"""From documents to training sequences: language ID, exact dedup, near dedup, decontamination, packing.

Each stage works on all that its predecessor kept, written as Parquet and read
again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, exact_dedup, langid, packing, simhash
from pagemill.llm._common import drop_path, new_path, numbered, spare_name, without_rows
from pagemill.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is accepted; the dictionaries come from labelled rows of docs.

    Null texts, and those without a letter, go; repeated rows are judged alike,
    whole texts are read, columns of any name and null ids stay, and an empty
    table stays empty.
    """
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, by the rules of exact_dedup.drop_exact_copies(): null is empty, the smallest id stays, null ids last."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, similarity 0.8, by the rules of simhash.drop_near_copies() for nulls, ties and repeated rows."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten words in a row of a benchmark item, or a shorter item as a whole.

    Null and word-less texts stay, very long ones are searched whole, repeated
    rows are judged one by one, null ids stay null; an empty table stays empty,
    and further columns of any name are kept.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = numbered(docs, row := spare_name(docs, "row_no"))
    return without_rows(own, decontam.decontaminate(own, bench, row=row).where("n_hit > 0"), row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens, by the rules of packing.pack_documents(): null texts are empty, long ones are cut, each row is a document."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: compression, tokenizer and packing cannot be expressed; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
