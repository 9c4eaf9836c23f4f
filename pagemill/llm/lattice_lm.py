"""Document probabilities under a subword unigram model, summed over all segmentations.

The pieces are those of an existing vocabulary.  Their first weights come from
its own scores; two rounds of expectation maximisation over the distinct words
of all training documents fit them to the corpus.  A document's probability is
the product of its words' (no piece runs over white space) and its end's; a
word's is the sum over every way to cut it into pieces, by a forward recursion
in log space.  A word that training documents hold is one more edge, over its
whole length; such edges share all but the Good-Turing mass of new words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, drop_path, releasing, written
from pagemill.llm.langid import fold

BLOCK_WORDS = 3_000_000
WORDS_A_TASK = 400_000
ROUNDS = 2
BATCH = 4096
SMOOTHING = 0.05
MARK = "▁"
LOW = -1e30


class Pieces:
    """Pieces by text; the last two ids are the end of a document and a byte of a character that no piece holds.

    state() and of() turn them into plain data and back: what is broadcast must
    not need this package in the worker.
    """

    def __init__(self, model: str | None = None) -> None:
        if model is None:
            return
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        own = [(p.id_to_piece(k), p.get_score(k)) for k in range(p.get_piece_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k) or p.is_unused(k))]
        self.index = {t: k for k, (t, _) in enumerate(own)}
        self.end, self.byte = len(own), len(own) + 1
        self.longest = max(len(t) for t in self.index)
        self.tables = _tables(self.index)
        # The vocabulary scores are negated ranks: by Zipf's law, weights.
        ranks = np.array([max(0.0, -s) if s > -1e8 else len(own) for _, s in own])
        weight = np.concatenate([1 / (ranks + 50), [1e-3, 1e-5]])
        self.log = np.log(weight / weight.sum())

    def state(self) -> tuple:
        return self.index, self.end, self.byte, self.longest, self.log, self.tables

    @classmethod
    def of(cls, state: tuple) -> Pieces:
        out = cls()
        out.index, out.end, out.byte, out.longest, out.log, out.tables = state
        return out

    def fit(self, counts: np.ndarray) -> None:
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum())


STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _signs(words: list[str]) -> np.ndarray:
    """Code points, [place, word], of words of one length."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).T.astype(np.uint64)


def _tables(index: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the sorted fingerprints of its pieces and their ids; no two pieces share one."""
    by_length: dict[int, list[str]] = {}
    for t in index:
        by_length.setdefault(len(t), []).append(t)
    out = []
    for n in range(1, max(by_length) + 1):
        held = by_length.get(n, [])
        prints = np.zeros(len(held), np.uint64)
        for row in _signs(held) if held else ():
            prints = _grown(prints, row)
        order = np.argsort(prints)
        if np.unique(prints).size < prints.size:
            raise ValueError("two pieces have one fingerprint")
        out.append((prints[order], np.array([index[held[k]] for k in order], np.int32)))
    return out


def _grown(prints: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of strings with one sign more."""
    x = (prints ^ (signs + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * STEP
    return x ^ (x >> np.uint64(32))


def _edges(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores [length of piece - 1, place of its first sign, word] of words of one length; -1 where there is no piece."""
    n = len(words[0])
    longest = min(n, pieces.longest)
    ids = np.full((longest, n, len(words)), -1, np.int32)
    signs = _signs(words)
    prints = np.zeros_like(signs)
    for k in range(longest):
        prints = _grown(prints[: n - k], signs[k:])
        known, number = pieces.tables[k]
        if known.size:
            at = np.searchsorted(known, prints)
            at[at == known.size] = 0
            ids[k, : n - k] = np.where(known[at] == prints, number[at], -1)
    score = np.where(ids >= 0, pieces.log[ids], LOW)
    missing = np.argwhere(ids[0] < 0)
    for i, w in missing.tolist():
        size = len(words[w][i].encode("utf-8", "surrogatepass"))
        ids[0, i, w] = pieces.byte
        score[0, i, w] = size * (pieces.log[pieces.byte] - np.log(256))
    return ids, score


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def forward(words: list[str], pieces: Pieces, want_counts: bool = False) -> tuple[np.ndarray, list | None]:
    """Natural-log probability of each word (of one length, mark included), and the edges' posteriors if wanted."""
    n = len(words[0])
    ids, score = _edges(words, pieces)
    longest = score.shape[0]
    a = np.zeros((n + 1, len(words)))
    for j in range(1, n + 1):
        a[j] = _lse(np.stack([a[j - k - 1] + score[k, j - k - 1] for k in range(min(longest, j))]))
    if not want_counts:
        return a[n], None
    b = np.zeros((n + 1, len(words)))
    for i in range(n - 1, -1, -1):
        b[i] = _lse(np.stack([score[k, i] + b[i + k + 1] for k in range(min(longest, n - i))]))
    out = []
    for k in range(longest):
        post = np.exp(np.minimum(0, a[: n - k] + score[k, : n - k] + b[k + 1 :] - a[n]))
        out.append((ids[k, : n - k], post))
    return a[n], out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
        step = max(1, min(BATCH, 400_000 // max(1, int(sizes[part[0]]) * 8)))
        for k in range(0, part.size, step):
            yield part[k : k + step]


def log10_words(words: list[str], pieces: Pieces) -> np.ndarray:
    out = np.zeros(len(words))
    for part in _by_length(words):
        out[part] = forward([MARK + words[k] for k in part], pieces)[0]
    return out / np.log(10)


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    total = np.zeros(pieces.byte + 1)
    for part in _by_length(words):
        weight = counts[part]
        marked = [MARK + words[k] for k in part]
        _, edges = forward(marked, pieces, want_counts=True)
        for k, (ids, post) in enumerate(edges):
            w = post * weight
            real = ids >= 0
            if k == 0 and (ids == pieces.byte).any():
                for i, x in np.argwhere(ids == pieces.byte).tolist():
                    w[i, x] *= len(marked[x][i].encode("utf-8", "surrogatepass"))
            total += np.bincount(ids[real], weights=w[real], minlength=total.size)
    return total


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, in UTF-8."""
    return text.encode().lower().split() if text else []


PASS = "kind string, block long, docs binary, word binary, local int, c long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of documents: one row of the documents as local word numbers, and a row per distinct word with its count in training documents."""
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("docs", pa.binary()), ("word", pa.binary()), ("local", pa.int32()), ("c", pa.int64())])
    base, number = TaskContext.get().partitionId() << 32, 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    vocab: dict[bytes, int] = {}
    rows: list[list] = []
    flat: list[np.ndarray] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        block = base + number
        every = np.concatenate(flat)
        trained = np.repeat(np.array([not r[1] for r in rows]), [r[2] for r in rows])
        c = np.bincount(every[trained], minlength=len(vocab))
        docs = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "held_out", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_batch(docs)
        head = sink.getvalue().to_pybytes()
        blob = len(head).to_bytes(8, "little") + head + squeeze(every.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(["docs"]), pa.array([block], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([int((~docs.column(1).to_numpy(zero_copy_only=False)).sum())], pa.int64())], schema=schema)
        words = list(vocab)
        for k in range(0, len(words), 50_000):
            n = len(words[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(["words"] * n), pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.array(words[k : k + n], pa.binary()), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(c[k : k + n].astype(np.int64))], schema=schema)

    for b in batches:
        for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            found = words_of(text.as_py())
            for w in set(found).difference(vocab):
                vocab[w] = len(vocab)
            flat.append(np.fromiter(map(vocab.__getitem__, found), np.uint32, len(found)))
            rows.append([doc, held, len(found)])
            size += len(found) + 1
            if size >= BLOCK_WORDS:
                yield from close()
                vocab, rows, flat, size, number = {}, [], [], 0, number + 1
    if rows:
        yield from close()


def with_word_edge(log_pieces: np.ndarray, c: np.ndarray, n: int, known: float) -> np.ndarray:
    """Natural-log probabilities from those over pieces and the counts c of n tokens; known: the share of whole-word edges."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log1p(-known) + log_pieces, np.log(known * c / max(n, 1)))


def train_pieces(words: DataFrame, model: str, rounds: int = ROUNDS) -> Pieces:
    """words: (word binary), every distinct word of the training documents once: pieces stand for words without a count.  The driver gets a sum per piece."""
    spark = words.sparkSession
    pieces = Pieces(model)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces.state())

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, own = None, Pieces.of(sent.value)
            for b in batches:
                got = expected_counts([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], np.ones(b.num_rows), own)
                total = got if total is None else total + got
            if total is not None:
                at = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        sums = words.select("word").mapInArrow(releasing(expect), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        fitted = np.zeros(pieces.byte + 1)
        for r in sums:
            fitted[r["piece"]] = r["n"]
        fitted[pieces.end] = 1
        pieces.fit(fitted)
        sent.unpersist()
    return pieces


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, model: str, folds: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the rows whose fold isn't held out.  Tokens are lower-cased words
    and an end for each document; base_score is the add-one unigram score over
    them, score the lattice model's.  Null and empty texts are their end alone.
    Texts of any length are scored whole.  Repeated rows stay rows and count as often.  With nothing to learn from,
    base_score is of uniform counts and score of the vocabulary's own weights.
    Only the two named columns are read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(F.col(doc_id), folds) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    passed, passed_path = written(own.mapInArrow(releasing(_blocks), PASS), "blocks", partition_by="kind")
    words = passed.where("kind = 'words'").select("block", "word", "local", "c")
    deal = max(3 * spark.sparkContext.defaultParallelism, -(-words.count() // WORDS_A_TASK))
    counts, counts_path = written(words.repartition(deal, "word").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_docs = passed.where("kind = 'docs'").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    seen = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n, v = seen[0] + n_docs, seen[1] + (n_docs > 0)
    known = 1 - max(1, seen[2]) / n if n else 0.0
    pieces = train_pieces(counts.where("c > 0"), model, rounds if seen[1] else 0)
    sent = spark.sparkContext.broadcast(pieces.state())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces.of(sent.value)
        for b in batches:
            lp = log10_words([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], own) * np.log(10)
            lp = with_word_edge(lp, b.column(1).to_numpy().astype(float), n, known) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp)], names=["word", "c", "lp"])

    weighed, weighed_path = written(counts.mapInArrow(releasing(weigh), "word binary, c long, lp double"), "weighed")
    looked = words.drop("c").join(weighed, "word").groupBy("block").agg(F.collect_list(F.struct("local", "c", "lp")).alias("found"))
    blocks = passed.where("kind = 'docs'").select("block", "docs").join(looked, "block", "left").select("docs", "found")
    end_count, end_lp = n_docs, float(with_word_edge(pieces.log[pieces.end], np.float64(n_docs), n, known) / np.log(10))
    below = n + v + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(b.num_rows):
                blob = b.column(0)[k].as_py()
                head = int.from_bytes(blob[:8], "little")
                rows = pa.ipc.open_stream(blob[8 : 8 + head]).read_all()
                flat = np.frombuffer(unsqueeze(blob[8 + head :]), np.uint32)
                found = b.column(1)[k].values
                size = 0 if found is None else len(found)
                c, lp = np.zeros(size), np.zeros(size)
                if size:
                    local = found.field("local").to_numpy(zero_copy_only=False)
                    c[local] = found.field("c").to_numpy(zero_copy_only=False)
                    lp[local] = found.field("lp").to_numpy(zero_copy_only=False)
                lengths = rows.column("n").to_numpy()
                doc = np.repeat(np.arange(lengths.size), lengths)
                sums = [np.bincount(doc, weights=x[flat], minlength=lengths.size) if flat.size else np.zeros(lengths.size) for x in (np.log10((c + 1) / below), lp, (c > 0).astype(float))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.select(["doc_id", "held_out"]).combine_chunks().to_batches()[0].columns,
                        pa.array(lengths + 1),
                        pa.array(sums[2].astype(np.int64) + (end_count > 0)),
                        pa.array(np.full(lengths.size, n, np.int64)),
                        pa.array(sums[0] + np.log10((end_count + 1) / below)),
                        pa.array(sums[1] + end_lp),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out, _ = written(blocks.mapInArrow(releasing(score), SCORED), "scores")
    drop_path(spark, passed_path, counts_path, weighed_path)
    return out
