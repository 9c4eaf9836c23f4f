"""Packing of token sequences by vector bin packing with a dot-product heuristic.

Examples are placed under three limits at once: tokens, segments and
loss-bearing tokens.  A bin takes, of a bounded look-ahead of waiting pieces,
the one whose demand has the largest dot product with what the bin has left;
when no whole piece fits and cutting is allowed, it takes the head of the
longest one.  Bins are filled within a task, so nothing is shuffled and at most
one bin a task stays part-full.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, releasing

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
LOOK_AHEAD = 256
SEGMENTS = 64
CACHE = 300_000


class VectorPacker:
    """Bins with limits (tokens, segments, loss tokens).  Yields (piece, bin, offset), pieces being (key, start, length, loss)."""

    def __init__(self, tokens: int, segments: int, loss: int, look_ahead: int, cut: bool) -> None:
        self.cap = np.array([tokens, segments, loss], float)
        self.cut, self.look = cut, look_ahead
        self.demand = np.zeros((0, 3))
        self.wait: list[tuple] = []
        self.bins = 0
        self.fresh()

    def fresh(self) -> None:
        self.bin, self.bins = self.bins, self.bins + 1
        self.left, self.used, self.inside = self.cap.copy(), 0, 0

    def close(self) -> None:
        if self.inside:
            self.fresh()

    def place(self, key, start: int, length: int, loss: int) -> tuple:
        out = ((key, start, length, loss), self.bin, self.used)
        self.used += length
        self.inside += 1
        self.left -= (length, 1, loss)
        return out

    def feed(self, pieces: list[tuple], end: bool = False) -> Iterator[tuple]:
        """pieces: (key, start, length, loss_of), loss_of(a, b) being the loss tokens of [a, b) of the example."""
        tokens = int(self.cap[0])
        fresh = []
        for key, start, length, loss_of in pieces:
            if not self.cut and (length > tokens or loss_of(start, start + length) > self.cap[2]):
                raise ValueError("an example is larger than a sequence and may not be cut")
            while True:
                n = min(length, tokens)
                while loss_of(start, start + n) > self.cap[2]:
                    n = max(1, n // 2)
                if n == tokens:  # it fills a bin of its own
                    yield (key, start, n, loss_of(start, start + n)), self.bins, 0
                    self.bins += 1
                else:
                    fresh.append((key, start, n, loss_of))
                start, length = start + n, length - n
                if length <= 0:
                    break
        self.wait += fresh
        self.demand = np.concatenate([self.demand, np.array([(n, 1, loss_of(a, a + n)) for _, a, n, loss_of in fresh], float).reshape(-1, 3)])
        while self.wait and (end or len(self.wait) >= self.look):
            fits = (self.demand[: self.look] <= self.left).all(axis=1)
            if fits.any():
                score = self.demand[: self.look] / self.cap @ (self.left / self.cap)
                k = int(np.argmax(np.where(fits, score, -1)))
                key, start, n, loss_of = self._take(k)
                yield self.place(key, start, n, loss_of(start, start + n))
            elif self.cut and self.left.min() >= 1:
                k = int(np.argmax(self.demand[: self.look, 0]))
                key, start, n, loss_of = self.wait[k]
                head = int(min(n, self.left[0]))
                while head > 0 and loss_of(start, start + head) > self.left[2]:
                    head //= 2
                if head == 0:
                    self.close()
                    continue
                yield self.place(key, start, head, loss_of(start, start + head))
                self.wait[k] = (key, start + head, n - head, loss_of)
                self.demand[k] = (n - head, 1, loss_of(start + head, start + n))
                if n == head:
                    self._take(k)
            else:
                self.close()
            if self.left[0] < 1:
                self.close()
        if end:
            self.close()

    def _take(self, k: int) -> tuple:
        got = self.wait[k]
        last = len(self.wait) - 1
        self.wait[k] = self.wait[last]
        self.wait.pop()
        self.demand[k] = self.demand[last]
        self.demand = self.demand[:last]
        return got


class WordTokens:
    """Token ids, packed as little-endian 32-bit words, of whole texts.

    The tokenizer drops white space and joins nothing across the words, digits
    and runs of marks that it cuts a text into, so the ids of a text are those
    of its parts in a row.  Texts of ASCII and Latin letters are cut here by
    the tokenizer's own rule, others at spaces only; parts are remembered, of a
    bounded number.
    """

    UNSAFE = re.compile(r"[^\n -~À-ÖØ-öø-ÿ]|<\|")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not self._cuts_alike():
            raise ValueError(f"{path} does not cut texts as this packer does")
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The model reads bytes as letters: those that print as they are, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = dict(zip([*shown, *(b for b in range(256) if b not in shown)], [*shown, *range(256, 324)], strict=True))

    def _cuts_alike(self) -> bool:
        """Whether the tokenizer lower-cases, drops white space and cuts where PART does: tried on a text with each case."""
        t = "I'll  GO: 42x'S\nÀé\t(-- don't9.5"
        whole = self.tokenizer.encode(t, add_special_tokens=False).ids
        parts = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in self.PART.findall(t.lower())]
        return whole == [i for p in parts for i in p]

    def ids(self, part: str) -> bytes:
        """Of a part that PART has cut."""
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE // 2:  # what is not used again while the other half fills is forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = []
        for t in texts:
            if self.UNSAFE.search(t):
                words = t.replace("\n", " ").split(" ")
                for w in set(words):
                    if "\0" + w in older:
                        known["\0" + w] = older["\0" + w]
                new = [w for w in dict.fromkeys(words) if "\0" + w not in known]
                for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known["\0" + w] = array("I", e.ids).tobytes()
                out.append(b"".join([known["\0" + w] for w in words]))
            else:
                parts = self.PART.findall(t.lower())
                for p in set(parts).difference(known):
                    known[p] = older[p] if p in older else self.ids(p)
                out.append(b"".join(map(known.__getitem__, parts)))
        return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, tokens: int = 2048, segments: int = SEGMENTS, loss: int | None = None, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    Documents end in end_id and are cut freely; all their tokens bear loss.  A
    null or empty text is its end token alone.  Each row of docs is a document,
    repeated ones too; null ids stay null.  Other columns aren't read.  A sequence is
    at most `tokens` long; the last one of a task may be shorter.  An empty table
    gives no pieces.
    """
    arrow_batches(docs.sparkSession)
    limit = tokens if loss is None else loss
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens(tokenizer)
        packer = VectorPacker(tokens, segments, limit, look_ahead, True)
        base = TaskContext.get().partitionId() << 36
        span = lambda a, b: b - a  # noqa: E731  every token bears loss

        def rows(placed: Iterator[tuple]) -> pa.RecordBatch:
            out = []
            for ((doc, blob), start, n, bearing), b, offset in placed:
                out.append((doc, start, n, zlib.crc32(blob[4 * start : 4 * (start + n)]), len(blob) // 4, base + b, offset, bearing))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 8, schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k in range(0, len(ids), 200):
                blobs = encode([t or "" for t in batch.column(1).slice(k, 200).to_pylist()])
                yield rows(packer.feed([((d, b := blob + end), 0, len(b) // 4, span) for d, blob in zip(ids[k : k + 200], blobs, strict=True)]))
        yield rows(packer.feed([], end=True))

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(releasing(pack), PIECES)


def pack_examples(examples: DataFrame, key: str, n_tokens: str, n_loss: str, tokens: int = 2048, segments: int = 64, loss: int = 1024, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Instruction examples, never cut: key, tokens, loss, sequence_id, offset.

    Null counts are 0; negative ones, and examples larger than a sequence,
    raise.  Examples of no tokens take a segment.  Repeated keys stay apart.
    """
    kind = examples.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(tokens, segments, loss, look_ahead, False)
        base = TaskContext.get().partitionId() << 36
        schema = None

        def rows(placed) -> pa.RecordBatch:
            out = list(placed)
            return pa.RecordBatch.from_arrays([pa.array([p[0][0] for p in out], schema), *(pa.array(x, pa.int64()) for x in ([p[0][2] for p in out], [p[0][3] for p in out], [base + p[1] for p in out], [p[2] for p in out]))], ["key", "tokens", "loss", "sequence_id", "offset"])

        def pieces(batch) -> list[tuple]:
            out = []
            for k, n, bear in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if n < 0 or bear < 0 or bear > n:
                    raise ValueError(f"example {k}: {n} tokens, {bear} of them with loss")
                out.append((k, 0, n, _constant(bear)))
            return out

        for batch in batches:
            schema = batch.schema.field(0).type
            yield rows(packer.feed(pieces(batch)))
        if schema is not None:
            yield rows(packer.feed([], end=True))

    zero = F.lit(0).cast("long")
    own = examples.select(F.col(key), F.coalesce(F.col(n_tokens).cast("long"), zero), F.coalesce(F.col(n_loss).cast("long"), zero))
    return own.toDF("key", "t", "l").mapInArrow(releasing(pack), f"key {kind}, tokens long, loss long, sequence_id long, offset long")


def _constant(n: int) -> Callable[[int, int], int]:
    return lambda a, b: n


TURN = re.compile(r"assistant|model|bot", re.IGNORECASE)


def pack_conversations(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", end_id: int = 1, tokens: int = 2048, segments: int = 16, loss: int = 1536, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """A row per conversation part: conv_id, part, tokens, loss, sequence_id, offset: instruction data under all three limits.

    A turn is its text's ids and end_id; the turns whose role is an answering
    one (TURN) bear loss.  Conversations are never cut within a turn, but one of
    more tokens or loss than a sequence takes is cut between turns into parts,
    and a turn that is larger alone is cut into pieces.  Null texts are empty;
    null roles bear no loss; null conversation ids are one conversation.  Turns
    go by number, nulls first, equal ones by role and text; repeated rows stay.
    An empty table gives an empty result.  Other columns are not read.
    """
    arrow_batches(turns.sparkSession)
    own = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens(tokenizer)
        for b in batches:
            sizes = [len(x) // 4 + 1 for x in encode([t or "" for t in b.column("text").to_pylist()])]
            bears = [bool(r and TURN.fullmatch(r)) for r in b.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(sizes, pa.int64()), pa.array([n if y else 0 for n, y in zip(sizes, bears, strict=True)], pa.int64())], names=["conv_id", "turn", "role", "n", "bears"])

    most = min(tokens, loss)
    sized = own.mapInArrow(releasing(count), "conv_id long, turn long, role string, n long, bears long")
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most)), lambda k: F.struct(k.alias("k"), F.least(F.lit(most).cast("long"), F.col("n") - k * most).alias("n")))
    cut = sized.select("conv_id", "turn", "role", "bears", F.explode(pieces).alias("p")).select("conv_id", F.struct("turn", "role", F.col("p.k").alias("k"), F.col("p.n").alias("n"), F.when(F.col("bears") > 0, F.col("p.n")).otherwise(0).alias("b")).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<n:bigint,b:bigint>>").alias("done"))

    def take(s, x):
        fits = (s["n"] + x["n"] <= tokens) & (s["b"] + x["b"] <= loss)
        closed = F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["n"].alias("n"), s["b"].alias("b")))))
        return F.struct((F.when(fits, s["n"]).otherwise(0) + x["n"]).alias("n"), (F.when(fits, s["b"]).otherwise(0) + x["b"]).alias("b"), closed.alias("done"))

    # A conversation's turns are counts here, not texts: a bounded record.
    parts = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("conv_id", F.aggregate("xs", start, take, lambda s: F.concat(s["done"], F.array(F.struct(s["n"], s["b"])))).alias("parts"))
    examples = parts.select("conv_id", F.posexplode("parts").alias("part", "p")).select(F.struct("conv_id", "part").alias("key"), "p.n", "p.b")
    placed = pack_examples(examples, "key", "n", "b", tokens, segments, loss, look_ahead)
    return placed.select("key.conv_id", F.col("key.part").cast("long").alias("part"), "tokens", "loss", "sequence_id", "offset")
