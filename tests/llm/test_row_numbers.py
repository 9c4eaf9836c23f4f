"""Rows keep their numbers when the executors, and with them the splits of the files, change between two readings."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import decontam, exact_dedup, simhash, suffix_dedup, warc
from pagemill.llm._common import numbered

SPLITS = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture(scope="module")
def files(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split") / "docs")
    rows = [(k, t, "en", "s", 1) for k, t in enumerate([*texts, *texts[::2]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(24).write.parquet(path)
    return path


@pytest.fixture()
def two_clusters(spark, files, monkeypatch):
    """run(f): f(docs), with another number of splits at each file scan that Spark plans."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    calls = []
    from pagemill.llm import _common

    def changing(df, name, *rest, real=_common.written, **options):
        out = real(df, name, *rest, **options)
        calls.append(name)
        spark.conf.set(SPLITS, str([1, 7, 3, 24][len(calls) % 4]))
        return out

    for module in (_common, exact_dedup, simhash, suffix_dedup, warc, decontam):
        monkeypatch.setattr(module, "written", changing)
    yield lambda f: f(spark.read.parquet(files))
    assert calls
    spark.conf.unset(SPLITS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def numbers(spark, df, n):
    spark.conf.set(SPLITS, str(n))
    return {(r["row"], r["doc_id"]) for r in numbered(df, "row").select("row", "doc_id").collect()}


def test_numbers_hold(spark, files):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    docs = spark.read.parquet(files)
    plain = {n: (spark.conf.set(SPLITS, str(n)), {(r[0], r[1]) for r in docs.select(F.monotonically_increasing_id(), "doc_id").collect()})[1] for n in (1, 7)}
    assert plain[1] != plain[7]  # what the numbers guard against
    want = numbers(spark, docs, 1)
    assert len({n for n, _ in want}) == len(want) == docs.count()
    assert numbers(spark, docs, 7) == want == numbers(spark, docs.where("doc_id >= 0").select("text", "doc_id"), 3)
    spark.conf.unset(SPLITS)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_rows_are_numbered_once(spark, files):
    """Rows that are not a file's, one for one."""
    docs = spark.read.parquet(files)
    for df in (docs.union(docs), docs.join(docs.select("doc_id"), "doc_id"), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(50).select(F.col("id").alias("doc_id")), docs.withColumn("_metadata", F.lit(1)), docs.limit(0)):
        own = numbered(df, "row")
        a, b = ({(r["row"], r["doc_id"]) for r in own.collect()} for _ in range(2))
        assert a == b and len({n for n, _ in a}) == df.count()


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, simhash.drop_near_copies])
def test_drops_the_right_rows(spark, files, two_clusters, drop):
    got = sorted(r["doc_id"] for r in two_clusters(drop).collect())
    assert got == sorted(r["doc_id"] for r in drop(spark.createDataFrame(spark.read.parquet(files).collect())).collect())
    if drop is exact_dedup.drop_exact_copies:
        first = {}
        for r in sorted(spark.read.parquet(files).collect()):
            first.setdefault(" ".join((r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ")) if (r["text"] or "").strip() else (" " if r["text"] else ""), r["doc_id"])
        assert len(got) == len(first)


def test_contaminated_rows(spark, files, sf, two_clusters, tmp_path):
    bench = str(tmp_path / "benchmark.parquet")
    text = max((r["text"] or "" for r in spark.read.parquet(files).collect()), key=len)
    spark.createDataFrame([(1, " ".join(text.split()[:12]))], "item_id long, text string").write.parquet(bench)
    got = {r["doc_id"] for r in two_clusters(lambda d: corpus_pipeline.drop_contaminated(spark, d, str(tmp_path))).collect()}
    report = decontam.contamination_report(spark.read.parquet(files), spark.read.parquet(bench)).collect()
    assert got == {r["doc_id"] for r in report if not r["contaminated"]} and len(got) < len(report)


def test_reports(spark, files, two_clusters):
    for report in (suffix_dedup.repeat_report, exact_dedup.dedup_report):
        still = sorted(map(tuple, report(spark.createDataFrame(spark.read.parquet(files).collect())).collect()))
        assert sorted(map(tuple, two_clusters(report).collect())) == still


def test_archives(spark, files, two_clusters):
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("text"), F.lit("x" * 1000)).alias("html"))
    got = two_clusters(lambda d: warc.archive_round_trip(pages(d))).collect()
    top = {}
    for r in got:
        top[r["payload_digest"]] = max(top.get(r["payload_digest"], -1), r["page_id"])
    assert len(got) == spark.read.parquet(files).count()
    for r in got:
        last = r["page_id"] == top[r["payload_digest"]] or r["payload_bytes"] < 1000
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last else ("revisit", top[r["payload_digest"]]))
