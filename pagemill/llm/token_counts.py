"""Token counts of whole texts, those of huge texts by overlap resynchronisation.

A huge text is cut into chunks that overlap, so that its parts are encoded by
many tasks.  A byte-level tokenizer reads from left to right and keeps no state
between words: once two encodings have a word's end at the same place, they
agree from there on.  Each chunk's count is therefore taken up to the first end
of a word that it shares with its successor, within their overlap and clear of
the chunk's own right edge, and the successor's from there.  Where the overlap
holds no such place, the chunks are joined, which widens the overlap to all of
the next chunk, and looked at again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, drop_path, releasing, written

LIMIT = 1024
CHUNK = 64 << 10
OVERLAP = 2 << 10
CACHE = 100_000
SLICE = 1 << 18
LEARN = 4096
FIRST = "row_id long, doc_id {id}, n_bytes long, n_tokens long, k long, body long, data binary"
MARKS = "row_id long, k long, upto long, n long, head_ends array<long>, head_counts array<long>, tail_ends array<long>, tail_counts array<long>"

#: What may be white space or invisible by any table of characters: fixed values.
BLANK = frozenset([*map(chr, range(0x21)), *map(chr, range(0x7F, 0xA1)), " ", "᠎", *map(chr, range(0x2000, 0x2010)), *map(chr, range(0x2028, 0x2030)), *map(chr, range(0x205F, 0x2070)), "　", "﻿"])
#: Marks, and letters and digits by any table of characters: fixed values.
MARKS_AT_END = ".,;:!?"
WORD_END = frozenset([*map(chr, range(0x30, 0x3A)), *map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0xD7)), *map(chr, range(0xD8, 0xF7)), *map(chr, range(0xF8, 0x100))])


class TokenCounter:
    """Counts of whole texts, as the library gives them; `splittable`: whether word ends resynchronise, and `edge`: how far from its right edge a chunk's word ends are proven."""

    def __init__(self, path: str) -> None:
        self.cache: dict[str, int | None] = {}
        self.aged: dict[str, int | None] = {}
        if path.endswith(".model"):
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tool, self.splittable, self.edge = tool, False, 0
            self.counts = lambda texts: [len(x) for x in tool.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's; threads would each hold memory
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        tool.no_truncation()
        tool.no_padding()
        self.tool = tool
        self.counts = lambda texts: [len(x) for x in tool.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(tool.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"]) for t in added)
        self.splittable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and plain
        # A longer special string may begin where the chunk ends, and the white space before it is read otherwise then.
        if self.splittable:  # a byte-level token has a character a byte
            self.token_bytes = np.zeros(tool.get_vocab_size(), np.int64)
            for token, k in tool.get_vocab().items():
                self.token_bytes[k] = len(token)
            for t in added:
                self.token_bytes[t["id"]] = len(t["content"].encode())
        self.edge = 2 + max((len(t["content"]) for t in added), default=0)

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of texts.  Where words resynchronise, texts are taken apart before each space after a character that surely is none, and parts seen before are looked up."""
        if not self.splittable:
            return self.counts(texts) if texts else []
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > SLICE:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held) if held else out

    def _learn(self, parts: list[str]) -> None:
        """Counts of parts after a space, read in one text: each part's end is a word's end, found among the tokens' ends by bytes."""
        for k in range(0, len(parts), LEARN):
            some = [" " + p for p in parts[k : k + LEARN]]
            ids = np.array(self.tool.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids)
            at = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(p.encode()) for p in some])) + 1
            self.cache.update(zip(parts[k : k + LEARN], np.diff(at, prepend=0).tolist(), strict=True))

    def _slice(self, texts: list[str]) -> list[int]:
        if len(self.cache) > CACHE:
            self.aged, self.cache = self.cache, {}
        cache = self.cache
        parts = [t.split(" ") for t in texts]
        new = set().union(*parts) - cache.keys()
        known = new & self.aged.keys()
        cache.update((p, self.aged[p]) for p in known)
        new -= known
        fine = [p for p in new if p and p[-1] not in BLANK]
        cache.update(dict.fromkeys(new.difference(fine)))  # None: what follows such a part is not to be told apart from it
        # A mark after a letter or digit is a word of its own: only what stands before it need be learnt.
        ended = [(p, core) for p in fine if (core := p.rstrip(MARKS_AT_END)) != p and core and core[-1] in WORD_END]
        self._learn(list({*fine}.difference(p for p, _ in ended).union(core for _, core in ended) - cache.keys()))
        if ended:
            marks = list({p[len(core) :] for p, core in ended})
            more = dict(zip(marks, self.counts(marks), strict=True))
            cache.update([(p, cache[core] + more[p[len(core) :]]) for p, core in ended])
        out, odd = [], []
        for ps in parts:
            found = list(map(cache.__getitem__, ps))
            if None in found:
                joined, held = [], ps[0]
                for p in ps[1:]:
                    if held and held[-1] not in BLANK:
                        joined.append(held)
                        held = " " + p
                    else:
                        held += " " + p
                odd.append((len(out), [*joined, held]))
                out.append(0)
            else:
                odd.append((len(out), ps[:1]))
                out.append(sum(found) - found[0])
        # First parts, and the parts of texts with odd white space, with what stands before them.
        need = [p for p in {p for _, ps in odd for p in ps if p}]
        counts = dict(zip(need, self.counts(need), strict=True)) if need else {}
        for at, ps in odd:
            out[at] += sum(counts[p] for p in ps if p)
        return out

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(ends of words, tokens up to each, all tokens) of a chunk."""
        e = self.tool.encode(text, add_special_tokens=False)
        n = len(e)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        words = np.fromiter(e.word_ids, np.int64, n)
        last = np.append(np.flatnonzero(words[1:] != words[:-1]), n - 1)
        offsets = e.offsets
        return np.fromiter((offsets[i][1] for i in last), np.int64, last.size), last + 1, n


def _cut(data: bytes, at: int) -> int:
    """The start of the character that holds byte `at`."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _first(path: str, chunk: int, overlap: int) -> Callable:
    """(row_id, doc_id, text) -> a row per text with its count, or per huge text a row without one and a row per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            huge = [counter.splittable and n > chunk for n in sizes]
            counts = iter(counter.whole([t for t, h in zip(texts, huge, strict=True) if not h]))
            out, held = [], 0
            for row, doc, text, n, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, sizes, huge, strict=True):
                out.append((row, doc, n, None if h else next(counts), None, None, None))
                if h:
                    data, start, k = text.encode(), 0, 0
                    while start < n:
                        end = n if start + chunk + overlap >= n else _cut(data, start + chunk)
                        out.append((row, None, None, None, k, end - start, data[start : _cut(data, end + overlap)]))
                        held += len(out[-1][-1])
                        start, k = end, k + 1
                        if held > 4 << 20:
                            yield batch(out, b.schema.field(1).type)
                            out, held = [], 0
            yield batch(out, b.schema.field(1).type)

    def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.binary()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row_id", "doc_id", "n_bytes", "n_tokens", "k", "body", "data"])

    return releasing(run)


def _marked(path: str) -> Callable:
    """(row_id, k, upto, body, data) -> MARKS: word ends and counts in the chunk's overlap with the chunk before, and with the one behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for b in batches:
            out = []
            for row, k, upto, body, reach, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = data.decode()
                ends, counts, n = counter.chunk(text)
                within = len(data[:body].decode())
                # The chunk's own start is a place too: the reader stands there with nothing read.
                in_head = ends <= len(data[: _cut(data, reach)].decode())
                proven = (ends >= within) & (ends <= len(text) - counter.edge)
                head = (np.append(0, ends[in_head]), np.append(0, counts[in_head]))
                out.append((row, k, upto, n, *(x.tolist() for x in (*head, ends[proven] - within, counts[proven]))))
            names = ["row_id", "k", "upto", "n", "head_ends", "head_counts", "tail_ends", "tail_counts"]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names=names)

    return releasing(run)


def _spliced(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """(row_id, n_tokens) of huge texts.  chunks: (row_id, k, body, data), written; data is the chunk's body and its overlap with the next."""
    spark = chunks.sparkSession
    encoded = lambda df: written(df.repartition("row_id", "k").select("row_id", "k", "upto", "body", F.lit(overlap).cast("long").alias("reach"), "data").mapInArrow(_marked(path), MARKS), "marks")
    marks, marks_path = encoded(chunks.withColumn("upto", F.col("k")))
    while True:
        after = marks.select(F.col("row_id").alias("of"), F.col("k").alias("next"), F.col("head_ends").alias("next_ends"), F.col("head_counts").alias("next_counts"))
        place = F.array_min(F.array_intersect("tail_ends", "next_ends"))
        seams = marks.join(after, (F.col("row_id") == F.col("of")) & (F.col("upto") + 1 == F.col("next"))).withColumn("place", place)
        left = F.element_at("tail_counts", F.array_position("tail_ends", F.col("place")).cast("int"))
        right = F.element_at("next_counts", F.array_position("next_ends", F.col("place")).cast("int"))
        twice = F.when(F.col("place").isNotNull(), F.col("n") - left + right)  # tokens that this chunk and the next both count
        seams, seams_path = written(seams.select("row_id", "k", "upto", F.col("place").isNull().alias("open"), twice.alias("twice")), "seams")
        open_seams = seams.where("open")
        if open_seams.isEmpty():
            break
        # Runs of chunks with open seams become one chunk each.
        state = marks.select("row_id", "k", "upto").join(open_seams.select("row_id", "k", "open"), ["row_id", "k"], "left")
        follows = F.coalesce(F.lag("open").over(Window.partitionBy("row_id").orderBy("k")), F.lit(False))
        run = state.withColumn("first", F.sum(F.when(follows, 0).otherwise(1)).over(Window.partitionBy("row_id").orderBy("k")))
        runs = run.groupBy("row_id", "first").agg(F.min("k").alias("k"), F.max("upto").alias("upto"), F.count("*").alias("joined")).where("joined > 1").drop("first", "joined")
        parts = chunks.select(F.col("row_id").alias("of"), F.col("k").alias("part"), "body", "data").join(runs, (F.col("of") == F.col("row_id")) & F.col("part").between(F.col("k"), F.col("upto")))
        piece = F.struct("part", F.expr("CASE WHEN part = upto THEN data ELSE substring(data, 1, cast(body AS int)) END").alias("data"))
        wide = parts.groupBy("row_id", "k", "upto").agg(F.sum("body").alias("body"), F.array_sort(F.collect_list(piece)).alias("parts"))
        wide = wide.select("row_id", "k", "upto", "body", F.expr("aggregate(parts, cast('' AS binary), (a, x) -> concat(a, x.data))").alias("data"))
        new, _ = encoded(wide)
        kept = marks.join(new.select(F.col("row_id").alias("of"), F.col("k").alias("a"), F.col("upto").alias("b")), (F.col("row_id") == F.col("of")) & F.col("k").between(F.col("a"), F.col("b")), "left_anti")
        marks, marks_path = written(kept.union(new), "marks")
        drop_path(spark, seams_path)
    every = marks.select("row_id", "n").union(seams.select("row_id", -F.col("twice")))
    return every.groupBy("row_id").agg(F.sum("n").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are what the tokenizer's library gives for whole texts, without
    special tokens added; special strings in a text are read as its default
    does.  Null texts are empty, and empty ones have no tokens.  Texts of over
    `chunk` bytes are cut, with `overlap` bytes in common, and resynchronised if
    the tokenizer is a byte-level one; others are encoded whole.  Repeated rows
    and ids are rows of their own, null ids stay; ids keep their type.  Only the
    two named columns are read.  An empty table gives an empty result.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be within the chunk")
    spark = docs.sparkSession
    arrow_batches(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    first, _ = written(own.mapInArrow(_first(tokenizer, chunk, overlap), FIRST.format(id=id_type)), "counted")
    rows = first.where("k is null").select("row_id", "doc_id", "n_bytes", "n_tokens")
    huge = _spliced(first.where("k is not null").select("row_id", "k", "body", "data"), tokenizer, overlap)
    late = rows.where("n_tokens is null").drop("n_tokens").join(huge, "row_id").select("row_id", "doc_id", "n_bytes", "n_tokens")
    return rows.where("n_tokens is not null").union(late).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
