"""Workers that don't have the package, tables with clashing columns, and the SQL of the queries."""

import os
import subprocess
import sys

import duckdb
import pytest

from pagemill.llm import exact_dedup, simhash
from pagemill.llm.queries import ORACLES, QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.range(2).mapInArrow(lambda it: it, "id long").collect()  # the workers' path is set by now
sys.path.insert(0, sys.argv[1])
from pagemill.llm.queries import QUERIES
for name, query in QUERIES.items():
    assert query(spark, sys.argv[2]).count() > 0, name
print("all ran")
"""


def test_workers_need_no_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]


CLASHES = ["row_id", "row_no", "row_no_", "row_flag", "row_gone", "__no", "__word", "__bits", "bits_word", "bits_held", "digest", "kind", "component", "the_text", "lang_pred", "margin"]


@pytest.fixture(scope="module")
def clashing(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "d")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.selectExpr("*", *(f"doc_id AS `{c}`" for c in CLASHES)).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, simhash.drop_near_copies])
def test_clashing_columns(spark, sf, clashing, drop):
    plain = {r["doc_id"] for r in drop(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    got = drop(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == plain and all(r[c] == r["doc_id"] for r in rows for c in CLASHES)


def test_clashing_columns_in_the_pipeline(spark, sf, clashing):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, sf).columns == clashing.columns


def test_stages_on_odd_and_empty_tables(spark, sf, odd, empty, tmp_path):
    import corpus_pipeline

    long = str(tmp_path / "long")
    spark.createDataFrame([(1, "the and thing on er was " * 60_000, "en"), (None, "the and thing on er was " * 60_000, None), (3, "", "en"), (4, None, None)], "doc_id long, text string, lang string").coalesce(1).write.parquet(long)
    for docs in (odd, empty, spark.read.parquet(long)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            assert n <= docs.count() or name == "packing"
            if name == "packing":
                assert docs.isEmpty() or out.agg({"length": "sum"}).first()[0] >= docs.count()
    assert [stage(spark, spark.read.parquet(long), sf).count() for _, stage in corpus_pipeline.STAGES[1:4]] == [2, 2, 4]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_says_the_same(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_texts_over_a_megabyte(spark, tmp_path):
    """Each operator on one text of many words, one long word, a copy, and little else: whole texts, however long."""
    from pyspark.sql import functions as F

    from pagemill.llm import decontam, langid, lattice_lm, license_scan, packing, pii_crf, suffix_dedup
    from pagemill.llm.queries import tokenizer_path

    many = " ".join(f"word{k % 7919}" for k in range(160_000)) + " call +1 (974) 555-3436"
    texts = [many, "x" * 1_200_000, many, None, ""]
    path = str(tmp_path / "d")
    spark.createDataFrame([(k, t, "en" if k < 2 else None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    bench = spark.createDataFrame([(1, "word7 word8 word9")], "item_id long, text string")
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    a = by_id(decontam.contamination_report(docs, bench))
    assert a[0]["n_words"] == 160_005 and a[0]["n_hit"] == 3 * sum(k % 7919 == 7 for k in range(160_000 - 2)) and a[1]["n_words"] == 1
    b = by_id(suffix_dedup.repeat_report(docs))
    assert b[0]["n_bytes"] == len(many) == b[0]["n_removed"] and b[1]["n_removed"] == 1_200_000 and b[4]["n_bytes"] == 0
    assert {k: r["component_id"] for k, r in by_id(simhash.near_report(docs)).items()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}
    assert len(by_id(license_scan.license_report(docs))) == len(by_id(langid.language_report(docs))) == 5
    assert by_id(pii_crf.find_personal_data(docs))[2]["n_phone"] == 1
    assert {k: r["keep_id"] for k, r in by_id(exact_dedup.dedup_report(docs)).items()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == 5 and all(r["n"] == r["t"] for r in packed)
    score = by_id(lattice_lm.score_documents(docs, tokenizer_path("piece_bpe_32k.model")))
    assert score[0]["n_tokens"] == 160_005 and score[1]["n_tokens"] == 2 and score[0]["score"] < 0
