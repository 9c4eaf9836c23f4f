"""Scores of rendered or recognised tables, consistency with the source, and the verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import stats as S
from pagemill.functions import text as X


def pipe_rows(md: Column) -> Column:
    """array<array<string>>: cells of lines that begin with a pipe, separator rows left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(md, F.lit("")), "\r\n|\n|\r"), X.stripped), lambda x: x.startswith("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), X.stripped))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]*$")))


def table_structure(rows: Column) -> Column:
    """Structure score of rows of cells; 0 without rows or columns."""
    counts = F.transform(rows, lambda r: F.size(r).cast("double"))
    n = F.size(rows)
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.greatest(n, F.lit(1))
    dev = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(n, F.lit(1)))
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: X.stripped(c) != "")))
    score = S.has_structure(filled / F.greatest(total, F.lit(1.0)), S.spread(mean, dev), n, F.array_max(counts))
    return F.when((n > 0) & (F.array_max(counts) >= 1), score).otherwise(F.lit(0.0))


def markdown_structure(md: Column) -> Column:
    """The score of its pipe rows; without any, 0.55 for 40 signs or more, else 0."""
    rows = pipe_rows(md)
    plain = F.when(F.length(X.compact(F.coalesce(md, F.lit("")))) >= 40, 0.55).otherwise(0.0)
    return F.when(F.size(rows) > 0, table_structure(rows)).otherwise(plain)


def consistency(source: DataFrame, made: DataFrame, key: str, source_text: str, made_text: str) -> DataFrame:
    """(key, n_ocr, n_vlm, hit, fabricate): numbers of the source kept in, and numbers invented by, what was made; as multisets, unrounded.  Each side is read once."""
    side = lambda df, text, n: df.select(key, F.transform(X.numeric_tokens(F.col(text)), lambda t: F.struct(F.lit(n).alias("side"), t.alias("t"))).alias("ts"))
    return _kept_numbers(side(source, source_text, 0).union(side(made, made_text, 1)), key)


def consistency_of(pairs: DataFrame, key: str, source_text: str, made_text: str) -> DataFrame:
    """consistency() of rows that have both texts."""
    side = lambda text, n: F.transform(X.numeric_tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.struct(F.lit(n).alias("side"), t.alias("t")))
    return _kept_numbers(pairs.select(key, F.concat(side(source_text, 0), side(made_text, 1)).alias("ts")), key)


def _kept_numbers(tokens: DataFrame, key: str) -> DataFrame:
    """tokens: (key, ts: array of (side, t))."""
    flat = tokens.select(key, F.explode_outer("ts").alias("x")).select(key, "x.side", "x.t")
    both = flat.groupBy(key, "t").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    g = both.groupBy(key).agg(F.sum("a").alias("n_ocr"), F.sum("b").alias("n_vlm"), F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("new"))
    none = F.col("n_ocr") == 0
    hit = F.when(none, 0.0).otherwise(F.col("kept") / F.greatest("n_ocr", F.lit(1)))
    fab = F.when(none, F.when(F.col("n_vlm") > 0, 1.0).otherwise(0.0)).when(F.col("n_vlm") > 0, F.col("new") / F.greatest("n_vlm", F.lit(1))).otherwise(0.0)
    return g.select(key, "n_ocr", "n_vlm", hit.alias("hit"), fab.alias("fabricate"))


def rebuild_verdict(metrics: DataFrame, struct: str = "struct", allow: bool = True, hit_min: float = 0.9, fabricate_max: float = 0.05, struct_min: float = 0.5) -> DataFrame:
    """adds reasons (in order) and adopt: allowed and without a reason."""
    text = lambda pattern, col, limit: F.format_string(pattern, F.col(col).cast("double"), F.lit(limit))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("hit") < hit_min, text("hit %.2f < %.2f (dropped content)", "hit", hit_min)),
            F.when(F.col("fabricate") > fabricate_max, text("fabricate %.2f > %.2f (invented numbers)", "fabricate", fabricate_max)),
            F.when(F.col(struct) < struct_min, text("structure %.2f < %.2f", struct, struct_min)),
        )
    )
    return metrics.withColumn("reasons", reasons).withColumn("adopt", F.lit(allow) & (F.size("reasons") == 0))


def adopt_verdict(base: Column, enhanced: Column, enabled: bool = True, base_max: float = 0.55, margin: float = 0.30, least: float = 0.90) -> Column:
    """adopt where the gate is on and all thresholds hold, else compare."""
    return F.when(F.lit(enabled) & (base < base_max) & (enhanced - base >= margin) & (enhanced >= least), "adopt").otherwise("compare")


def drop_body_duplicates(tables: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """tables (page_id, table_id, ...) but those of three cells or more of which 60 % stand in the page's body texts.

    cells: (page_id, table_id, cell); blocks: content blocks.
    """
    body = blocks.where(F.col("type") == "text").select("page_id", X.compact(F.col("text")).alias("cell")).where(F.col("cell") != "").distinct().withColumn("hit", F.lit(1))
    c = cells.select("page_id", "table_id", X.compact(F.col("cell")).alias("cell")).where(F.col("cell") != "")
    bad = c.join(body, ["page_id", "cell"], "left").groupBy("page_id", "table_id").agg(F.count("*").alias("n"), F.count("hit").alias("k")).where((F.col("n") >= 3) & (F.col("k") / F.col("n") >= 0.6))
    return tables.join(bad.select("page_id", "table_id"), ["page_id", "table_id"], "left_anti")


def correction_candidates(blocks: DataFrame, page_max: float = 0.85, block_max: float = 0.95) -> DataFrame:
    """Text blocks worth correcting: page_confidence and confidence below the limits, and signs of recognition errors."""
    ok = (F.coalesce("page_confidence", F.lit(1.0)) < page_max) & (F.col("type") == "text") & (F.coalesce("confidence", F.lit(0.0)) < block_max)
    return blocks.where(ok & X.has_ocr_errors(F.coalesce("text", F.lit(""))))


def corrected_confidence(blocks: DataFrame) -> DataFrame:
    """(page_id, confidence): 1.1 times the mean of all blocks, 1 at most."""
    return blocks.groupBy("page_id").agg(F.least(F.lit(1.0), F.avg(F.coalesce("confidence", F.lit(0.0))) * 1.1).alias("confidence"))


def table_confidence(cells: DataFrame) -> DataFrame:
    """(page_id, confidence): the mean, a missing one counting 0.5."""
    return cells.groupBy("page_id").agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
