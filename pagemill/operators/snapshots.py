"""Run-to-run comparison of rendered notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.render import line_diff


def note_metrics(notes: DataFrame, name: str = "image", markdown: str = "markdown", pages: DataFrame | None = None) -> DataFrame:
    """(image, chars, lines, table_rows) of notes; with pages (image, tables, blocks, confidence) external_tables, ocr_blocks and the confidence to four places too."""
    md = F.coalesce(F.col(markdown), F.lit(""))
    m = notes.select(
        F.col(name).alias("image"),
        F.length(md).cast("long").alias("chars"),
        (X.occurrences(md, F.lit("\n")) + 1).alias("lines"),
        X.occurrences(md, F.lit("| --- |")).alias("table_rows"),
    )
    if pages is None:
        return m
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = pages.select("image", F.greatest(count("tables"), F.lit(0)).cast("long").alias("external_tables"), F.greatest(count("blocks"), F.lit(0)).cast("long").alias("ocr_blocks"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"))
    return m.join(own, "image", "left")


def compare(old: DataFrame, new: DataFrame, name: str = "image", markdown: str = "markdown", ignore: Column | None = None) -> DataFrame:
    """(image, state): added, removed, changed or unchanged; lines that begin with "date:" don't count."""
    a, b = old.select(F.col(name).alias("image"), F.col(markdown).alias("old")), new.select(F.col(name).alias("image"), F.col(markdown).alias("new"))
    j = a.join(b, "image", "full")
    same = X.stable_lines(F.col("old")) == X.stable_lines(F.col("new"))
    return j.withColumn("state", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "unchanged").otherwise("changed"))


def summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("state").agg(F.count("*").alias("n"))


def diffs(compared: DataFrame) -> DataFrame:
    return compared.where("state = 'changed'").select("image", line_diff(F.col("old"), F.col("new")).alias("diff"))


def listing(items: DataFrame) -> DataFrame:
    """(snapshot, n, errors) of ITEM rows."""
    return items.groupBy("snapshot").agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
