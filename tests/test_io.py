"""Sources, sinks, streams, images and settings."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import __main__ as cli
from pagemill.operators import images, recognize, snapshots
from pagemill.operators.geometry import DEFAULT_ENGINE
from pagemill.plans import pipeline
from pagemill.sources import config, files, logs, sinks
from pagemill.streaming import intake


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, data in (("a.png", b"one"), ("b.JPG", b"two"), ("c.txt", b"no"), ("d.png", b"one"), ("e.tmp.png", b"three")):
        (root / name).write_bytes(data)
    return str(root)


def test_scan(spark, folder):
    seen = files.hashed(files.scan_images(spark, folder, ("**/*.tmp.png",)))
    assert sorted(os.path.basename(r["file_path"]) for r in seen.collect()) == ["a.png", "b.JPG", "d.png"]
    assert seen.select("file_hash").distinct().count() == 2


def test_vault(spark, tmp_path):
    for name, text in (("x/one.md", '---\ntitle: "Given"\n---'), (".hid/two.md", "title: no"), ("three.txt", "title: no"), ("four.md", "plain")):
        p = tmp_path / "v" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert {r["title"] for r in files.vault_titles(spark, str(tmp_path / "v")).collect()} == {"one", "Given", "four"}


def test_manifests_and_logs(spark, tmp_path):
    for s, n in (("s1", 2), ("s2", 1)):
        d = tmp_path / "arch" / s
        d.mkdir(parents=True)
        (d / "manifest.json").write_text(json.dumps({"items": [{"image": f"i{k}", "chars": k} for k in range(n)]}, indent=1))
    assert {(r["snapshot"], r["image"]) for r in files.read_manifests(spark, str(tmp_path / "arch")).collect()} == {("s1", "i0"), ("s1", "i1"), ("s2", "i0")}
    (tmp_path / "log").write_text('{"level": "INFO", "message": "m", "page": "7"}\n')
    r = files.read_logs(spark, str(tmp_path / "log")).first()
    assert (r["level"], r["message"], r["extra"]) == ("INFO", "m", {"page": "7"})


def test_publish_and_snapshot(spark, tmp_path):
    notes = spark.createDataFrame([(1, "n.md", "old"), (2, "n.md", "é new")], "page_id long, file_name string, markdown string")
    out = str(tmp_path / "out")
    assert sinks.publish(notes, out).collect()[0]["bytes"] == 6
    assert os.listdir(out) == ["n.md"] and open(out + "/n.md", encoding="utf-8").read() == "é new"
    errors = spark.createDataFrame([("bad", "RuntimeError: x")], "image string, error string")
    archive = str(tmp_path / "snap")
    pages = spark.createDataFrame([("1", [1, 2], 0.123456)], "image string, blocks array<int>, confidence double").withColumn("tables", F.lit(None).cast("array<int>"))
    named = notes.select(F.col("page_id").cast("string").alias("image"), "markdown")
    for name in ("s1", "s2"):
        sinks.write_snapshot(named, archive, name, snapshots.note_metrics(named, pages=pages), "in", "now", errors)
    assert files.snapshots(spark, archive) == ["s1", "s2"] and open(archive + "/latest.txt").read() == "s2\n"
    with open(archive + "/s1/manifest.json", encoding="utf-8") as f:
        made = json.load(f)
    assert made["image_count"] == 3 and made["items"][0] == {"image": "1", "chars": 3, "lines": 1, "table_rows": 0, "external_tables": 0, "ocr_blocks": 2, "confidence": 0.1235}
    assert {tuple(r) for r in snapshots.listing(files.read_manifests(spark, archive)).collect()} == {("s1", 3, 1), ("s2", 3, 1)}


def test_snapshots_as_partitions(spark, tmp_path):
    archive = str(tmp_path / "arch")
    notes = lambda t: spark.createDataFrame([("a", t), ("b", "x\ny")], "image string, markdown string")
    errors = spark.createDataFrame([("bad", "RuntimeError: x")], "image string, error string")
    for name, text in (("s1", "one"), ("s2", "two"), ("s1", "three")):
        sinks.write_snapshot_rows(notes(text), archive, name, errors=errors)
    items = files.read_snapshot_rows(spark, archive)
    assert {tuple(r) for r in snapshots.listing(items).collect()} == {("s1", 3, 1), ("s2", 3, 1)}
    one = items.where("snapshot = 's1'")
    assert {(r["image"], r["chars"], r["error"]) for r in one.collect()} == {("a", 5, None), ("b", 3, None), ("bad", None, "RuntimeError: x")}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    both = files.read_snapshot_rows(spark, archive, "notes")
    assert {r["state"]: r["n"] for r in snapshots.summary(snapshots.compare(both.where("snapshot = 's1'"), both.where("snapshot = 's2'"))).collect()} == {"changed": 1, "unchanged": 1}


def test_notes_are_published_whole_or_not(spark, tmp_path):
    spark.dataSource.register(sinks.notes_source())
    out = str(tmp_path / "notes")
    os.makedirs(out)
    df = spark.range(40).selectExpr("concat('n', id, '.md') AS file_name", "concat('text é ', id) AS markdown").repartition(4)
    df.write.format("notes").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(f"n{k}.md" for k in range(40)) and open(out + "/n7.md", encoding="utf-8").read() == "text é 7"
    bad = spark.range(40).selectExpr("concat('m', id, '.md') AS file_name", "if(id = 33, raise_error('stop'), 'x') AS markdown").repartition(4, "file_name")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("notes").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(f"n{k}.md" for k in range(40))


def test_cache_is_refreshed(spark, tmp_path):
    calls = []
    images_ = spark.createDataFrame([("a", 1), ("b", 2)], "image string, n int")

    def recognise(version):
        def run(missing):
            calls.append(sorted(r["image"] for r in missing.collect()))
            return missing.select("image", F.concat("image", F.lit(version)).alias("record"))

        return run

    cache = str(tmp_path / "_cache")
    look = lambda d: {(r["image"], r["record"], r["cached"]) for r in d.collect()}
    assert look(files.refreshed(spark, images_.where("n = 1"), cache, recognise("1"))) == {("a", "a1", False)}
    assert look(files.refreshed(spark, images_, cache, recognise("2"))) == {("a", "a1", True), ("b", "b2", False)}
    time.sleep(1.1)
    assert look(files.refreshed(spark, images_, cache, recognise("3"), use=False)) == {("a", "a3", False), ("b", "b3", False)}
    assert calls == [["a"], ["b"], ["a", "b"]]


def test_listings(spark, folder, tmp_path):
    open(folder + "/z.heic", "wb").close()
    assert [os.path.basename(r["path"]) for r in files.list_images(spark, folder).collect()] == ["a.png", "b.JPG", "d.png", "e.tmp.png"]
    for name in ("w/one.md", "w/deep/one.md", "w/two words.md", "w/other.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("title: no")
    assert sorted(r["title"] for r in files.wiki_titles(spark, str(tmp_path / "w")).collect()) == ["one", "one", "two words"]
    assert files.normal_path("/a/./b/../c") == "/a/c"


def test_log_lines(spark, tmp_path):
    log = logs.set_up(str(tmp_path / "l/run.log"))
    log = logs.set_up(str(tmp_path / "l/run.log"))
    log.info("read %d", 3, extra={"page": 7})
    try:
        1 / 0
    except ZeroDivisionError:
        log.exception("failed")
    rows = files.read_logs(spark, str(tmp_path / "l/run.log")).collect()
    assert [(r["level"], r["message"], r["module"]) for r in rows] == [("INFO", "read 3", "test_io"), ("ERROR", "failed", "test_io")]
    assert rows[0]["extra"] == {"page": "7"} and "ZeroDivisionError" in rows[1]["exception"]


def test_status(spark):
    rows = [(k, f"f{k}", s, 1, f"e{k}", k, k) for k, s in enumerate(["failed", "pending", "failed", "completed", "failed", "failed"])]
    t = spark.createDataFrame(rows, "id long, file_path string, status string, attempts int, last_error string, created_at int, updated_at int")
    assert sinks.status_report(t).splitlines() == ["tasks: 6 (pending 1, processing 0, completed 1, failed 4)", "failed: f5: e5", "failed: f4: e4", "failed: f2: e2"]


def test_stream_dedup_survives_restart(spark, folder, tmp_path):
    table, cp = str(tmp_path / "tasks"), str(tmp_path / "cp")

    def once():
        q = intake.run(intake.first_of_content(intake.watch(spark, folder)), cp, intake.to_task_table(table), once=True)
        q.awaitTermination(60)
        return spark.read.parquet(table).count()

    assert once() == 3
    with open(folder + "/f.png", "wb") as f:
        f.write(b"two")
    with open(folder + "/g.png", "wb") as f:
        f.write(b"four")
    assert once() == 4


def test_stream_to_notes(spark, folder, tmp_path):
    out, cp = str(tmp_path / "notes"), str(tmp_path / "cp")

    def once():
        q = pipeline.stream_notes(intake.watch(spark, folder, ("**/*.tmp.png",)), cp, out, {DEFAULT_ENGINE: recognize.FakeRecognizer()}, None, F.to_date(F.lit("2024-03-05")), once=True, log=str(tmp_path / "log"), delay_seconds=0.5)
        q.awaitTermination(120)
        return sorted(os.listdir(out))

    assert once() == ["2024-03-05_a.md", "2024-03-05_b.md"]  # d has a's content
    for name, data in (("f.png", b"two"), ("g.png", b"four")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    began = time.time()
    assert once() == ["2024-03-05_a.md", "2024-03-05_b.md", "2024-03-05_g.md"]
    assert time.time() - began >= 0.5
    state = intake.TaskLog(spark, str(tmp_path / "log")).tasks().collect()
    assert [(r["status"], r["attempts"]) for r in state] == [("completed", 0)] * 3


def counting(calls, fail=()):
    """A recogniser that writes a line a call; files whose text is in fail are refused."""

    def make():
        read = recognize.FakeRecognizer()()

        def run(content):
            with open(calls, "a") as f:
                f.write(content.decode().splitlines()[0] + "\n")
            if content.decode() in fail:
                raise RuntimeError("no model")
            return read(content)

        return run

    return make


def test_each_file_is_recognised_once(spark, folder, tmp_path):
    calls = str(tmp_path / "calls")
    q = pipeline.stream_notes(intake.watch(spark, folder, ("**/*.tmp.png",)), str(tmp_path / "cp"), str(tmp_path / "notes"), {DEFAULT_ENGINE: counting(calls)}, None, F.to_date(F.lit("2024-03-05")), once=True)
    q.awaitTermination(120)
    lines = open(calls).read().split("\n")[:-1]
    assert len(lines) == len(set(lines)) == len(os.listdir(str(tmp_path / "notes"))) == 2  # two contents, one call each


def test_failures_are_tried_again(spark, folder, tmp_path):
    """Three times in all, each with a micro-batch that brings something new; then no more."""
    calls, log = str(tmp_path / "calls"), intake.TaskLog(spark, str(tmp_path / "cp-tasks"))
    bad = open(f"{folder}/a.png").read()
    for k in range(5):
        with open(f"{folder}/new{k}.png", "w") as f:
            f.write(f"new {k}")
        q = pipeline.stream_notes(intake.watch(spark, folder, ("**/*.tmp.png",)), str(tmp_path / "cp"), str(tmp_path / "notes"), {DEFAULT_ENGINE: counting(calls, (bad,))}, None, F.to_date(F.lit("2024-03-05")), once=True)
        q.awaitTermination(120)
        state = {r["file_path"].rsplit("/", 1)[-1]: (r["status"], r["attempts"], r["last_error"]) for r in log.tasks().collect()}
        assert state["a.png"] == ("failed", min(k + 1, 3), "RuntimeError: no model") and state[f"new{k}.png"] == ("completed", 0, None)
    lines = open(calls).read().split("\n")
    assert lines.count(bad.splitlines()[0]) == 3 and all(lines.count(f"new {k}") == 1 for k in range(5))
    assert "failed 1" in sinks.status_report(log.tasks())


def test_log_is_compacted(spark, tmp_path):
    """What a micro-batch reads does not grow with the log, and says what all events say."""
    log = intake.TaskLog(spark, str(tmp_path / "log"), every=4)
    events, deltas = {}, []
    for number in range(14):
        log.compact(number - 1)
        deltas.append(len(log._names("delta")))
        rows = [(f"p{number}", f"h{number}"), ("p0", "h0")] if number else [("p0", "h0")]
        df = spark.createDataFrame(rows, "path string, file_hash string").coalesce(1)
        if number != 9:
            log.add(df.where(F.col("path") == f"p{number}"), number, "pending")
        log.add(df, number, "failed" if number % 3 == 0 else "completed", F.lit(f"e{number}"))
        for path, h in rows:
            events.setdefault(h, []).append((number, "failed" if number % 3 == 0 else "completed", f"e{number}"))
    assert max(deltas) <= 2 * 4 and len(log._names("state")) <= 2
    got = {r["task_id"]: (r["status"], r["attempts"], r["last_error"], r["file_path"]) for r in log.tasks().collect()}
    assert got == {h: (e[-1][1], sum(x[1] == "failed" for x in e), e[-1][2], "p" + h[1:]) for h, e in events.items()}
    assert {r["file_hash"] for r in log.known(13).collect()} == {f"h{k}" for k in range(13)}
    assert {r["file_hash"] for r in log.retryable(14).collect()} == {"h3", "h6", "h9", "h12"}
    os.makedirs(str(tmp_path / "log/state/000000099"))  # a snapshot whose writer died
    assert len(log.tasks().collect()) == 14


def test_regions_are_transcribed_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def model():
        def tell(content):
            with open(calls, "a") as f:
                f.write("x")
            return None if content == b"bad" else content.decode()

        return tell

    crops = spark.createDataFrame([(1, 0, b"one"), (1, 1, b"two"), (2, 0, b"bad"), (2, 1, b"three"), (3, 0, b"four")], "page_id long, region_id int, content binary")
    got = {r["page_id"]: (r["markdown"], r["n_regions"]) for r in recognize.rebuild_pages(crops, model).collect()}
    assert got == {1: ("one\n\ntwo", 2), 3: ("four", 1)} and len(open(calls).read()) == 5


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    vault = tmp_path / "vault"
    (vault / "00-RAW").mkdir(parents=True)
    (vault / "00-RAW" / "a.png").write_bytes(b"Plan of the year\nsome text")
    settings = tmp_path / "c.json"
    settings.write_text(json.dumps({"vault": {"root": str(vault)}, "ocr": {"recognizer": "pagemill.operators.recognize:line_reader"}, "processing": {"watch_delay_seconds": 0}}))
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["run", "--config", str(settings), "--drain"]) == 0
    assert [n[10:] for n in os.listdir(vault / "99-Audit/OCR-Pending")] == ["_a.md"]
    assert cli.main(["run", "--config", str(settings), "--once", folder + "/a.png"]) == 0
    assert cli.main(["run", "--config", str(settings), "--status"]) == 0
    assert "completed 1" in capsys.readouterr().out
    archive = str(tmp_path / "arch")
    for name, more in (("s1", []), ("s2", ["--use-cache"])):
        assert cli.main(["snapshot", "run", "--archive", archive, "--input-dir", folder, "--name", name, "--config", str(settings), *more]) == 0
    assert "s1 -> s2: added 0, removed 0, changed 0, unchanged 4" in capsys.readouterr().out
    assert cli.main(["snapshot", "compare", "--archive", archive, "--old", "s2", "--new", "s1"]) == 0
    assert cli.main(["snapshot", "list", "--archive", archive]) == 0
    assert "s2  images=4 errors=0" in capsys.readouterr().out
    assert cli.main(["snapshot", "compare", "--archive", archive, "--old", "no"]) == 1
    assert cli.main(["run", "--config", str(tmp_path / "none.json")]) == 1
    with pytest.raises(ValueError):
        bad = tmp_path / "c.yaml"
        bad.write_text("vault: [")
        config.read(str(bad))


def test_images():
    red, blue = (200, 30, 30), (20, 40, 220)
    a = np.zeros((40, 40, 3), np.uint8)
    a[:, :20], a[:, 20:] = red, blue
    grid = images.color_grid(a)
    assert grid[0][0] == images.hex_color(red) and grid[0][-1] == images.hex_color(blue) and len(grid) == 4
    assert images.cell_colors(a, [[(0, 0, 20, 40), (20, 0, 40, 40)]]) == [[images.hex_color(red), images.hex_color(blue)]]
    assert {c for c, _ in images.main_colors(a)} == {images.hex_color(red), images.hex_color(blue)}
    assert images.upscaled(a).shape == (80, 80, 3)
    b = np.full((50, 50), 200, np.uint8)
    b[25, 25] = 10
    assert images.binarized(b)[25, 25] == 0 and images.binarized(b)[0, 0] == 255
    assert (images.ruled(b, [10], [20])[10] == 0).all()
    corners = images.ordered_corners(np.array([[9, 9], [0, 0], [0, 9], [9, 0]]))
    assert corners.tolist() == [[0, 0], [9, 0], [9, 9], [0, 9]]


def test_settings():
    s = config.load({"vault": {"root": "/v"}, "ocr": {"table_structure": {"enhance_adopt": True}}})
    assert s.adopt and s.workers == 2 and s.adopt_margin == 0.30
    for bad in ({}, {"vault": {"root": "/v"}, "processing": {"max_worker_threads": 0}}, {"vault": {"root": "/v"}, "processing": {"max_worker_threads": True}}):
        with pytest.raises(ValueError):
            config.load(bad)
