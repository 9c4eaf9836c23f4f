"""From page records to notes: noise, titles, tables, links, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import gates, geometry, layout, linking, recognize, render
from pagemill.sources.files import blocks_of, exists
from pagemill.sources.sinks import publish
from pagemill.streaming import intake


def layout_pages(pages: DataFrame, enhanced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(partitioned blocks, rendered pages) of PAGE records."""
    parted = geometry.partition_blocks(geometry.with_metrics(blocks_of(pages)))
    return parted, layout.render_pages(parted.where("reason is null"), pages, enhanced)


def note_pages(pages: DataFrame, titles: DataFrame | None, run_date: Column, enhanced: DataFrame | None = None, correct=None) -> DataFrame:
    """(page_id, file_name, markdown) of PAGE records; titles: those of the vault, to link to."""
    if correct is not None:
        blocks = blocks_of(pages)
        fixed = recognize.apply_corrections(blocks, recognize.correct(gates.correction_candidates(blocks), correct))
        confidence = gates.corrected_confidence(fixed).withColumnRenamed("confidence", "__c")
        again = fixed.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "type", "text", "confidence", "bbox", "corrected"))), lambda b: b).alias("blocks"))
        low = F.coalesce("confidence", F.lit(1.0)) < 0.85
        pages = pages.drop("blocks").join(again, "page_id", "left").join(confidence, "page_id", "left").withColumn("confidence", F.when(low, F.coalesce("__c", "confidence")).otherwise(F.col("confidence"))).drop("__c")
    parted, rendered = layout_pages(pages, enhanced)
    links = None
    if titles is not None:
        text = F.array_join(F.transform(F.col("blocks"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
        docs = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"))
        found = linking.score(linking.top_per_target(linking.link_candidates(docs, titles)), docs)
        links = linking.link_comments(found.where(linking.category(F.col("adjusted")) != "low")).withColumnRenamed("doc_id", "page_id")
    tables = pages.select("page_id", F.posexplode("tables").alias("table_id", "t")).select("page_id", "table_id", "t.html", "t.cells", "t.engine", "t.confidence")
    cells = tables.select("page_id", "table_id", F.explode(F.when(F.size("cells") > 0, F.col("cells")).otherwise(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)))).alias("cell"))
    kept = gates.drop_body_duplicates(tables, cells, parted.where("reason is null"))
    return render.notes(pages.select("page_id", "source_path", "confidence"), rendered, geometry.page_numbers(parted), render.filtered_notes(parted.where("reason is not null")), render.tables_section(kept), links, run_date)


def pages_of(recognized: DataFrame) -> DataFrame:
    """PAGE records of recognize.recognize()'s rows."""
    block = lambda b: F.struct(b["block_id"].alias("block_id"), b["type"].alias("type"), b["text"].alias("text"), b["confidence"].alias("confidence"), b["bbox"].alias("bbox"), F.lit(False).alias("corrected"))
    tables = F.array().cast("array<struct<html:string,cells:array<string>,bbox:array<int>,confidence:double,engine:string>>")
    return recognized.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("source_path"), "confidence", "engine_used", F.lit("mixed").alias("content_type"), F.transform("blocks", block).alias("blocks"), tables.alias("tables"))


def recognized_once(files: DataFrame, engines: dict, path: str) -> DataFrame:
    """Recognises files (path, content) and keeps the records under path, which all that follows reads; records that are there, and were committed, are taken as they are."""
    spark = files.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        recognize.recognize(files.withColumn("engine", F.lit(geometry.DEFAULT_ENGINE)), engines).write.mode("overwrite").parquet(path)
    return spark.read.schema(recognize.RECOGNIZED).parquet(path)


def notes_of(files: DataFrame, folder: str, engines: dict, titles: DataFrame | None, run_date: Column, cache: str) -> DataFrame:
    """Recognises files (path, content) into cache, lays their pages out and publishes the notes; returns the records kept there."""
    pages = recognized_once(files, engines, cache)
    publish(note_pages(pages_of(pages), titles, run_date), folder).agg(F.sum("bytes")).collect()  # one row
    return pages


def stream_notes(files: DataFrame, checkpoint: str, folder: str, engines: dict, titles: DataFrame | None, run_date: Column, once: bool = False, log: str | None = None, delay_seconds: float = 0.0):
    """Files of a watched folder to notes: each micro-batch waits until its files have settled; new contents, and failed ones that may be tried again, are recognised once each, laid out and published, and the tasks' events logged under `log` (beside the checkpoint unless given)."""
    spark = files.sparkSession
    events = intake.TaskLog(spark, log or checkpoint.rstrip("/") + "-tasks")

    def process(batch: DataFrame, number: int) -> None:
        events.compact(number - 1)
        # Contents are hashed here; from now on the batch's own events say which files are new.
        events.add(intake.fresh(batch, events.known(number)), number, "pending")
        fresh = events.delta(number, "pending")
        again = [(r["path"], r["file_hash"]) for r in events.retryable(number).collect() if exists(spark, r["path"])]  # RETRIES at most
        events.add(fresh.union(spark.createDataFrame(again, "path string, file_hash string")), number, "processing")
        tried = events.delta(number, "processing")
        contents = batch.join(fresh, "path").select("path", "content")
        if again:
            contents = contents.union(spark.read.format("binaryFile").load([p for p, _ in again]).select("path", "content"))
        try:
            said = notes_of(contents, folder, engines, titles, run_date, f"{events.path}/pages/{number:09d}")
        except Exception as e:
            events.add(tried, number, "failed", F.lit(f"{type(e).__name__}: {e}"[:1000]))
            raise
        both = tried.join(said.select("path", "error"), "path")
        events.add(both.where("error is null"), number, "completed")
        events.add(both.where("error is not null"), number, "failed", F.col("error"))

    return intake.run(files, checkpoint, intake.settled(process, delay_seconds), once=once)
