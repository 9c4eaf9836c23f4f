"""Token counts against the library on whole texts."""

import random

import pytest

from pagemill.llm import token_counts
from pagemill.llm.queries import tokenizer_path

BITS = ["<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "word", "'s", "don't", "été", "汉字", "\U0001f600", "12", "345", "...", "<|", "|>", "endoftext", " ", "　", "\x1c", "\x85", "a", " the", " of", "é", "​"]


def make():
    rng = random.Random(4)
    out = [None, "", "", " ", "x" * 5000, " " * 3000, "a" * 700 + " b", "word " * 900 + "<|endoftext|>" * 40]
    out += ["".join(rng.choice(BITS) for _ in range(rng.choice([1, 5, 30, 300, 900]))) for _ in range(200)]
    out += ["".join(rng.choice(["a", "bc"]) for _ in range(1500)) + " " + "".join(rng.choice(BITS) for _ in range(300)) for _ in range(15)]
    out += [("x" * rng.randrange(80) + rng.choice([" ", "  ", "<|endoftext|>", "\n"])) * rng.randrange(1, 40) for _ in range(100)]
    return out


@pytest.fixture(scope="module")
def texts():
    return make()


@pytest.fixture(scope="module")
def frame(spark, texts):
    rows = [(f"d{k}" if k else None, t, 1, 2, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string, row_id long, k long, data string").repartition(6)


@pytest.fixture(scope="module")
def want(texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return {f"d{k}" if k else None: (len((t or "").encode()), n := len(tool.encode(t or "", add_special_tokens=False)), n > 1024) for k, t in enumerate(texts)}


@pytest.mark.parametrize("chunk, overlap", [(97, 20), (60, 40), (200, 64), (32768, 2048)])
def test_against_whole_texts(frame, want, chunk, overlap):
    """Tiny chunks: words, white space and special strings over many chunks, and seams within each of them."""
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(frame, tokenizer_path("byte_bpe_50k.json"), chunk=chunk, overlap=overlap).collect()}
    assert got == want


def test_huge_text(spark, want):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = ["".join(rng.choice(BITS) + rng.choice([" ", "x", ", "]) for _ in range(120_000)), "ab" * 100_000 + " end", "word " * 150_000]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {k: len(tool.encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}


def test_other_tokenizers_read_whole_texts(spark, texts):
    import sentencepiece
    from tokenizers import Tokenizer

    few = texts[:40]
    df = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")
    piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(piece.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False)))):
        got = token_counts.count_tokens(df, tokenizer_path(name), chunk=50, overlap=10).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: count(t or "") for k, t in enumerate(few)}


def test_cache_is_bounded(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 50)
    counter = token_counts.TokenCounter(tokenizer_path("byte_bpe_50k.json"))
    full = token_counts.TokenCounter(tokenizer_path("byte_bpe_50k.json"))
    plain = [t or "" for t in texts]
    assert sum((counter.whole(plain[k : k + 20]) for k in range(0, len(plain), 20)), []) == full.counts(plain)


def test_odd_and_empty_tables(odd, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    assert token_counts.count_tokens(empty, path).collect() == []
    got = token_counts.count_tokens(odd, path).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2
