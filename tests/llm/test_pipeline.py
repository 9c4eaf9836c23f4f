"""Each stage of the corpus pipeline on what its predecessor kept, against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import langid
from pagemill.llm.queries import tokenizer_path


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())


@pytest.fixture(scope="module")
def chain(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        made = stage(spark, docs, sf)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return [[{r["doc_id"]: r for r in a.collect()}, b.collect()] for a, b in out]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language(chain, spark, sf):
    before, after = chain[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tool = langid.Classifier(langid.train_dictionaries(docs.where(langid.fold(docs["doc_id"], 4) != 2)))
    want = {k for k, r in before.items() if (got := tool(r["text"]))[0] != "und" and got[2] >= langid.MIN_MARGIN}
    assert {r["doc_id"] for r in after} == want and len(want) > 0.9 * len(before)


def test_exact(chain):
    before, after = chain[1]
    first = {}
    for k in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[k]["text"] or ""), k)
    assert {r["doc_id"] for r in after} == set(first.values())


def test_near(chain):
    before, after = chain[2]
    kept = {r["doc_id"] for r in after}

    def shingles(t):
        w = (t or "").lower().split()
        return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)}

    sets = {k: shingles(r["text"]) for k, r in before.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(before)
    label = {k: k for k in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(a, b) >= 0.8:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    assert kept == {root(k) for k in ids}


def test_clean(chain, spark, sf):
    before, after = chain[3]
    bad = set()
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(item["text"])
        bad |= {" " + " ".join(w[i : i + 10]) + " " for i in range(max(1, len(w) - 9))} if w else set()
    want = {k for k, r in before.items() if not any(b in " " + " ".join(words(r["text"])) + " " for b in bad)}
    assert {r["doc_id"] for r in after} == want


def test_packed(chain):
    from tokenizers import Tokenizer

    before, after = chain[4]
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    total = 0
    for k, r in before.items():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        pieces = sorted((p for p in after if p["doc_id"] == k), key=lambda p: p["start"])
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1]] and sum(p["length"] for p in pieces) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in pieces)
        total += len(ids)
    sequences = {p["sequence_id"] for p in after}
    assert len(sequences) <= -(-total // 2048) + 4


def test_run_is_the_chain(chain, spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in chain[4][1])
