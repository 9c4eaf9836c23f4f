import random

import pytest

WORDS = "the and thing on er was heon reed ble, Tion. shan über été x1 THE 42 ou".split()


def make_texts(seed=3, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 9, 40, 120, 400]))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(90))
    out = []
    for k, t in enumerate(base):
        out.append(t if k % 5 else t + " " + passage)
        if k % 7 == 0:
            out.append(t)
        if k % 6 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append("\n".join(w) if k % 12 else " ".join(w))
    return [None, "", " \t\n", "...", "a" * 700, "ab" * 400, *out]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    rows = [(k, t, ["en", "de"][k % 2], "src", 0, 1, "clash") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_id long, key long, digest string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, repeated rows."""
    path = str(tmp_path_factory.mktemp("llm") / "odd")
    rows = [(None, "same text here", None), (None, None, "en"), (7, "same  text\there", "en"), (7, "same text here", "en"), (7, "same text here", "en"), (3, "other words " * 60, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)
