"""Folders of images, note vaults, page records, snapshot manifests, JSON logs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import text as X

EXTENSIONS = ("png", "jpg", "jpeg", "heic", "bmp", "tiff")


def scan_images(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """RAW_FILE rows of a folder (not its subfolders), accepted suffixes of any case, skip patterns applied; content is read only where it is used."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(X.accepts_path(F.col("path"), extensions, skip))


LISTED = ("png", "jpg", "jpeg", "bmp", "tiff")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of a folder's images in the order of their names; no HEIC."""
    return scan_images(spark, folder, extensions=LISTED).select("path").orderBy(X.base_name(F.col("path")))


def normal_path(path: str) -> str:
    """Absolute, with forward slashes and without . and .. parts."""
    return os.path.abspath(os.path.expanduser(path)).replace(os.sep, "/")


def hashed(files: DataFrame) -> DataFrame:
    """(file_path, file_hash, created_at): the content goes no further."""
    return files.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("created_at"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images; what cannot be decoded is dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")


def front_matter_title(content: Column) -> Column:
    """The title line of the first 500 signs, without quotes; null without one."""
    found = X.stripped(F.regexp_extract(F.substring(content, 1, 500), "title:[ \t]*[\"']?([^\"'\r\n]+)", 1))
    return F.when(found != "", found)


def vault_titles(spark: SparkSession, root: str) -> DataFrame:
    """(title): stems and front-matter titles of all notes under root, hidden folders left out, each once."""
    notes = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return titles_of(notes.select(F.url_decode("p").alias("path"), F.col("value").alias("content")))


def titles_of(notes: DataFrame) -> DataFrame:
    """The same of notes (path, content)."""
    seen = notes.where(~F.col("path").rlike(r"/\.[^/]+/"))
    return seen.select(X.stem(F.col("path")).alias("title")).union(seen.select(front_matter_title(F.col("content")))).where("title is not null").distinct()


def wiki_titles(spark: SparkSession, root: str) -> DataFrame:
    """(title): the stems of all notes under root, hidden folders too, as often as they occur."""
    notes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return notes.select(X.stem(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("title"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """PAGE records from JSON lines."""
    return spark.read.schema(schemas.PAGE).json(path)


def blocks_of(pages: DataFrame) -> DataFrame:
    """One row per block; block_id is its place in the page."""
    return pages.select("page_id", F.col("confidence").alias("page_confidence"), F.posexplode("blocks").alias("block_id", "b")).select("page_id", "page_confidence", F.col("block_id").cast("long"), "b.type", "b.text", "b.confidence", "b.bbox", F.coalesce("b.corrected", F.lit(False)).alias("corrected"))


def cached(files: DataFrame, cache: DataFrame, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """(files with a cached record, files without)."""
    keys = cache.select(key).distinct()
    return files.join(keys, key, "left_semi"), files.join(keys, key, "left_anti")


def refreshed(spark: SparkSession, files: DataFrame, cache: str, recognise: Callable[[DataFrame], DataFrame], use: bool = True, key: str = "image") -> DataFrame:
    """(key, record, cached) of files: from the JSON lines under cache where they are, else from recognise(files) (key, record), whose records are added there.

    With use false all are recognised anew; of several records of a key that of
    the newest file counts.
    """
    schema = f"{key} string, record string"
    read = lambda path: spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    missing = cached(files, read(cache), key)[1] if use and exists(spark, cache) else files
    run = f"{cache.rstrip('/')}/run-{uuid.uuid4().hex}"
    recognise(missing).select(key, "record").write.json(run)
    newest = read(cache).groupBy(key).agg(F.max_by("record", F.col("_metadata.file_modification_time")).alias("record"))
    made = read(run).select(key).distinct().withColumn("__made", F.lit(True))
    return files.select(key).join(newest, key).join(made, key, "left").select(key, "record", F.col("__made").isNull().alias("cached"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_manifests(spark: SparkSession, archive: str) -> DataFrame:
    """Items of archive/*/manifest.json, with their snapshot; the cache folder has none."""
    m = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").schema("items array<struct<image:string,chars:long,lines:long,table_rows:long,external_tables:long,ocr_blocks:long,confidence:double,cached:boolean,error:string>>").json(archive)
    return m.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.json$", 1).alias("snapshot"), F.inline("items"))


def snapshots(spark: SparkSession, archive: str) -> list[str]:
    """Names of the archive's snapshots, in order: folders with a manifest, the cache left out."""
    found = read_manifest_files(spark, archive).select("snapshot").distinct().collect()
    return sorted(r["snapshot"] for r in found if r["snapshot"] != "_cache")


def read_manifest_files(spark: SparkSession, archive: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").load(archive)
    return files.select(F.regexp_extract("path", r"([^/]+)/manifest\.json$", 1).alias("snapshot"), F.col("content").cast("string").alias("manifest"))


def read_snapshot_rows(spark: SparkSession, archive: str, table: str = "items") -> DataFrame:
    """ITEM rows (or notes) of all snapshots that sinks.write_snapshot_rows() wrote; one that is chosen by its name is read alone."""
    kind = schemas.ITEM.split(", ", 1)[1] if table == "items" else "image string, markdown string"
    return spark.read.schema(kind + ", snapshot string").parquet(f"{archive.rstrip('/')}/{table}")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """LOG rows from JSON lines; keys beyond the fixed ones are in extra."""
    fixed = ("timestamp", "level", "module", "message", "file", "exception")
    m = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).where("m is not null")
    return m.select(*(F.col("m")[k].alias(k) for k in fixed), F.map_filter("m", lambda k, v: ~k.isin(*fixed)).alias("extra"))
