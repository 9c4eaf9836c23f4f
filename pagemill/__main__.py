"""Command line: watch a folder or read given files into notes, show the task table, and archive, compare and list snapshots.

The recogniser is named in the settings as ocr.recognizer, "module:factory", or
by --recognizer; none is bundled, and without one nothing is read.
"""

from __future__ import annotations

import argparse
import importlib
import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import geometry, recognize, snapshots
from pagemill.plans import pipeline
from pagemill.sources import config, files, logs, sinks
from pagemill.streaming import intake

RECORD = "path string, blocks array<struct<block_id:long,type:string,text:string,confidence:double,bbox:array<struct<x:double,y:double>>>>, confidence double, engine_used string, error string"


def engines_of(settings: dict) -> dict:
    name = ((settings or {}).get("ocr") or {}).get("recognizer")
    if not name:
        raise ValueError("name a recogniser as ocr.recognizer (module:factory)")
    module, _, factory = name.partition(":")
    return {geometry.DEFAULT_ENGINE: getattr(importlib.import_module(module), factory)}


def session() -> SparkSession:
    return SparkSession.builder.appName("pagemill").getOrCreate()


def given_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def run_pages(args: argparse.Namespace) -> int:
    settings_map = config.read(args.config)
    settings = config.load(settings_map)
    log_map = settings_map.get("logging") or {}
    log = logs.set_up(log_map.get("file"), log_map.get("level", "INFO"))
    spark = session()
    vault = settings.vault_root.rstrip("/")
    folder, state = f"{vault}/{settings.audit_folder}", f"{vault}/.pagemill"
    events = intake.TaskLog(spark, f"{state}/tasks")
    if args.status:
        print(sinks.status_report(events.tasks()))
        return 0
    today = F.lit(datetime.now(timezone.utc).date())
    titles = files.vault_titles(spark, vault)
    engines = engines_of(settings_map)
    if args.once:
        log.info("reading files", extra={"files": len(args.once)})
        said = pipeline.notes_of(given_files(spark, args.once), folder, engines, titles, today, f"{state}/pages/once-{uuid.uuid4().hex}")
        failed = [(r["path"], r["error"]) for r in said.where("error is not null").select("path", "error").limit(20).collect()]
        for path, error in failed:
            log.error("reading failed", extra={"path": path, "error": error})
        return 1 if failed else 0
    raw = intake.watch(spark, f"{vault}/{settings.raw_folder}", settings.skip_patterns)
    query = pipeline.stream_notes(raw, f"{state}/checkpoint", folder, engines, titles, today, log=f"{state}/tasks", delay_seconds=settings.watch_delay_seconds, once=args.drain)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    return 0


# Snapshots.


def rendered(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, pages) of cached recogniser records (image, path, record)."""
    pages = pipeline.pages_of(records.select("image", F.from_json("record", RECORD).alias("r")).select("image", "r.*"))
    named = pages.withColumn("image", X.stem(F.col("source_path")))
    notes = pipeline.note_pages(pages, None, F.current_date()).join(named.select("page_id", "image"), "page_id")
    return notes.select("image", "markdown"), named.select("image", "tables", "blocks", "confidence")


def snapshot_run(args: argparse.Namespace) -> int:
    spark = session()
    images = given_files(spark, args.images) if args.images else files.scan_images(spark, args.input_dir, extensions=files.LISTED).select("path", "content")
    images = images.withColumn("image", X.stem(F.col("path")))
    if images.select("path").isEmpty():
        print("no images found", file=sys.stderr)
        return 1
    engines = engines_of(config.read(args.config) if args.config else {})

    def recognise(missing: DataFrame) -> DataFrame:
        said = recognize.recognize(missing.withColumn("engine", F.lit(geometry.DEFAULT_ENGINE)), engines)
        return said.select(X.stem(F.col("path")).alias("image"), F.to_json(F.struct("path", "blocks", "confidence", "engine_used", "error")).alias("record"))

    records = files.refreshed(spark, images, f"{args.archive}/_cache", recognise, use=args.use_cache)
    error = F.get_json_object("record", "$.error")
    good = records.where(error.isNull())
    notes, pages = rendered(good)
    metrics = snapshots.note_metrics(notes, pages=pages).join(good.select("image", "cached"), "image")
    now = datetime.now(timezone.utc)
    name = args.name or now.strftime("%Y-%m-%d_%H%M%S")
    made = sinks.write_snapshot(notes, args.archive, name, metrics, args.input_dir or "", now.isoformat(timespec="seconds"), records.where(error.isNotNull()).select("image", error.alias("error")))
    print(f"snapshot {name}: {made['image_count']} images")
    names = files.snapshots(spark, args.archive)
    return compare(spark, args.archive, names[-2], names[-1]) if len(names) > 1 else 0


def notes_in(spark: SparkSession, archive: str, name: str) -> DataFrame:
    notes = spark.read.option("pathGlobFilter", "*.md").text(f"{archive}/{name}", wholetext=True)
    return notes.select(X.stem(F.url_decode("_metadata.file_path")).alias("image"), F.col("value").alias("markdown"))


def compare(spark: SparkSession, archive: str, old: str, new: str) -> int:
    """Prints the counts by state and the changed notes' diffs; 0 whether or not something changed."""
    both = snapshots.compare(notes_in(spark, archive, old), notes_in(spark, archive, new))
    counts = {r["state"]: r["n"] for r in snapshots.summary(both).collect()}
    print(f"{old} -> {new}: " + ", ".join(f"{s} {counts.get(s, 0)}" for s in ("added", "removed", "changed", "unchanged")))
    for r in snapshots.diffs(both).orderBy("image").toLocalIterator():
        print(f"--- {r['image']}\n{r['diff']}")
    return 0


def snapshot_compare(args: argparse.Namespace) -> int:
    spark = session()
    names = files.snapshots(spark, args.archive)
    old, new = args.old or (names[-2] if len(names) > 1 else None), args.new or (names[-1] if len(names) > 1 else None)
    if old not in names or new not in names:
        print(f"two snapshots are needed; there are: {', '.join(names) or 'none'}", file=sys.stderr)
        return 1
    return compare(spark, args.archive, old, new)


def snapshot_list(args: argparse.Namespace) -> int:
    spark = session()
    items = snapshots.listing(files.read_manifests(spark, args.archive))
    for r in items.orderBy("snapshot").toLocalIterator():
        print(f"{r['snapshot']}  images={r['n']} errors={r['errors']}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="watch the raw folder, or read --once files, into notes")
    run.add_argument("--config", default="config.yaml")
    run.add_argument("--once", nargs="+", help="read these files and stop")
    run.add_argument("--drain", action="store_true", help="read what the raw folder holds now and stop")
    run.add_argument("--status", action="store_true", help="show the task table")
    run.set_defaults(do=run_pages)
    snap = sub.add_parser("snapshot", help="archive and compare rendered notes").add_subparsers(dest="action", required=True)
    for name, do in (("run", snapshot_run), ("compare", snapshot_compare), ("list", snapshot_list)):
        s = snap.add_parser(name)
        s.add_argument("--archive", required=True)
        s.set_defaults(do=do)
        if name == "run":
            s.add_argument("--input-dir")
            s.add_argument("--images", nargs="*")
            s.add_argument("--use-cache", action="store_true")
            s.add_argument("--config")
            s.add_argument("--name")
        elif name == "compare":
            s.add_argument("--old")
            s.add_argument("--new")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.do(args)
    except (OSError, ValueError) as e:
        print(f"pagemill: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
