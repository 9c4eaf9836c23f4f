"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes are taken at sampled places only: in every string of `length` bytes
the leftmost of the smallest head hashes marks a place, so equal strings mark
equal places, one byte in about (length - HEAD) / 2 is marked, and each string
belongs to exactly one marked suffix.  A batch's suffix array holds its marked
suffixes in the order of (head, surroundings), both as 64-bit fingerprints:
an order that, like the lexicographic one, brings equal suffixes together, at a
cost a byte that a corpus can pay.

New batches are merge-scanned against the existing levels: a head that two of
them hold is a possible long match.  Two levels of equal size merge into the
next.  Matched suffixes whose surroundings are equal as a whole (by two 64-bit
fingerprints from independent tables) are matches in full; for the rest the
suffixes' own bytes are brought together by head and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._common import MOST_WORDS, arrow_batches, bit_words, drop_path, filter_words, may_hold, numbered, releasing, written

LENGTH = 200
HEAD = 32
BATCHES = 3
CHUNK = 1 << 20
PLACES = 1 << 24
CROWD = 16_384
SETTLE_BYTES = 4 << 20
DEALT = 40_000
STEP = 0x9E3779B97F4A7C15 | 1
WRAP = (1 << 64) - 1

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and its inverse, modulo 2 ** 64, for i in [0, n)."""
    if "up" not in _tables or _tables["up"].size < n:
        for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["up"][:n], _tables["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_random = np.random.default_rng(11).integers(0, 1 << 64, (2, 256), np.uint64, endpoint=False)


class _Text:
    """Documents in a row, with prefix sums from which the fingerprint of any part is read."""

    def __init__(self, docs: list[bytes]) -> None:
        self.sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(docs), np.uint8)
        self.up, self.down = _powers(self.data.size + 1)
        self.sums = [self._sums(t) for t in _random]

    def _sums(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(self.data.size + 1, np.uint64)
        np.cumsum(table[self.data] * self.up[:-1], out=out[1:])
        return out

    def prints(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[end] - s[start]) * self.down[start])


class Marks:
    """The marked suffixes of a text: for each, its document, head and surroundings, and the string starts lo to hi that belong to it."""

    def __init__(self, text: _Text, length: int) -> None:
        n, width = text.data.size, length - HEAD + 1
        self.text = text
        places = n - length + 1
        if places <= 0:
            self.doc = self.lo = self.hi = self.at = np.zeros(0, np.int64)
            self.key = self.ctx = np.zeros(0, np.uint64)
            return
        s = text.sums[0]
        heads = _mix((s[HEAD:] - s[:-HEAD]) * text.down[: n - HEAD + 1])
        low = (heads & np.uint64(WRAP ^ (PLACES - 1))) | np.arange(heads.size, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = width - span
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        at = (low & np.uint64(PLACES - 1)).astype(np.int64)
        doc = np.repeat(np.arange(text.sizes.size), text.sizes)
        inside = np.nonzero(doc[:places] == doc[length - 1 :])[0]
        at = at[inside]
        first = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(inside) != 1)]) if inside.size else np.zeros(0, bool)
        firsts = np.nonzero(first)[0]
        lasts = np.concatenate([firsts[1:], [inside.size]]) - 1 if firsts.size else firsts
        self.lo, self.hi, self.at = inside[firsts], inside[lasts], at[firsts]
        at = self.at
        self.doc = doc[self.lo]
        self.key = heads[at]
        shape = (at - self.lo).astype(np.uint64) << np.uint64(32) | (self.hi - self.lo).astype(np.uint64)
        self.ctx = _mix(text.prints(1, self.lo, self.hi + length) ^ shape * np.uint64(STEP))

    def strings(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, mark and fingerprint of every string of the marks `which`."""
        n = self.hi[which] - self.lo[which] + 1
        mark = np.repeat(which, n)
        start = np.arange(mark.size) - np.repeat(np.cumsum(n) - n, n) + self.lo[mark]
        return start, mark, _mix(self.text.prints(1, start, start + length) ^ self.key[mark])


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Text]]:
    """Row numbers, offsets and text, a chunk at a time.  A document over CHUNK comes in parts that overlap so far that each string is in one of them."""
    rows: list[int] = []
    offsets: list[int] = []
    docs: list[bytes] = []
    size = 0
    for b in batches:
        for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = text.as_py()
            for at in range(0, max(1, len(data)), CHUNK):
                part = data[at : at + CHUNK + length - 1]
                if docs and size + len(part) > CHUNK:
                    yield np.array(rows, np.int64), np.array(offsets, np.int64), _Text(docs)
                    rows, offsets, docs, size = [], [], [], 0
                rows.append(row)
                offsets.append(at)
                docs.append(part)
                size += len(part)
    if docs:
        yield np.array(rows, np.int64), np.array(offsets, np.int64), _Text(docs)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _records(length: int, batches_of: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches_of
        for _, _, text in _chunks(batches, length):
            m = Marks(text, length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.key.size, batch, np.int32)), _long(m.key), _long(m.ctx)], names=["batch", "key", "ctx"])

    return run


class SuffixFamily:
    """Sparse suffix arrays in levels: level k holds none or one, of 2 ** k batches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[str | None] = []
        self.heads: list[str] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key long, ctx long, n long").parquet(path)

    def add(self, records: DataFrame) -> None:
        """records: (key, ctx, n), one row per distinct suffix of the batch."""
        new, path = written(records.sortWithinPartitions("key", "ctx"), "suffixes")
        scan = new.select("key", "n", F.lit(True).alias("fresh"))
        for level in self.levels:
            if level:
                scan = scan.union(self._read(level).select("key", "n", F.lit(False)))
        found = scan.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("fresh").alias("fresh")).where("fresh and n > 1").select("key")
        self.heads.append(written(found, "heads")[1])
        k = 0
        while k < len(self.levels) and self.levels[k]:
            both = self._read(path).union(self._read(self.levels[k]))
            _, merged = written(both.groupBy("key", "ctx").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "ctx"), "suffixes")
            drop_path(self.spark, path, self.levels[k])
            path, self.levels[k] = merged, None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = path

    def matched(self) -> DataFrame:
        """(key, ctx, n) of every suffix whose head more than one suffix has."""
        heads = reduce(DataFrame.union, (self.spark.read.schema("key long").parquet(p) for p in self.heads)).distinct()
        every = reduce(DataFrame.union, (self._read(p) for p in self.levels if p))
        return every.join(heads, "key", "left_semi").groupBy("key", "ctx").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        drop_path(self.spark, *(p for p in self.levels if p), *self.heads)
        self.levels, self.heads = [], []


class _BitSet:
    """A set of well mixed 64-bit values, with false positives: 16 bits a value up to MOST_WORDS words (16 MB)."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def holds(self, x: np.ndarray) -> np.ndarray:
        word = (x >> np.uint64(6)) & np.uint64(self.words.size - 1)
        return (self.words[word.astype(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bits(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """The words of a _BitSet of the values, of which there are about `count`."""
    size = min(filter_words(count) * 2, MOST_WORDS * 2)
    words = keys.groupBy(F.shiftright(column, 6).bitwiseAND(F.lit(size - 1)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(size, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


SPANS = "row_id long, lo long, hi long"
PARTIAL = "key long, row_id long, lo long, head int, seeker boolean, data binary"
STRINGS = "one long, two long, row_id long, at long, seeker boolean"


def partial_matches(key: np.ndarray, head: np.ndarray, seeker: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, first, last): of each seeker of which a string of `length` bytes is in another mark too, the first and last such start within its data.

    Marks of one key are suffixes with equal heads; head is where in the data
    the head begins.  Equal strings hold the head at the same place, so a mark's
    matched strings overlap in its head and cover one run of bytes.  Strings are
    found by fingerprint and compared byte by byte.
    """
    text = _Text(data)
    wins = text.sizes - length + 1
    mark = np.repeat(np.arange(key.size), wins)
    start = np.arange(mark.size) - np.repeat(np.cumsum(wins) - wins, wins) + text.starts[:-1][mark]
    away = (text.starts[:-1] + head)[mark] - start
    prints = _mix(text.prints(1, start, start + length) ^ key[mark] * np.uint64(STEP) ^ away.astype(np.uint64))
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    same = p[1:] == p[:-1]
    partner = np.full(order.size, -1, np.int64)
    partner[order[1:][same]] = order[:-1][same]
    partner[order[:-1][same]] = order[1:][same]
    # Strings stand by mark and start: the first and the last with a partner are the ends of what a seeker has.
    found = np.nonzero((partner >= 0) & seeker[mark])[0]
    if not found.size:
        return found, found, found
    edge = np.diff(mark[found]) != 0
    firsts, lasts = found[np.concatenate([[True], edge])], found[np.concatenate([edge, [True]])]
    who = mark[firsts]
    good = np.ones(who.size, bool)
    for ends in (firsts, lasts):
        for k in range(0, ends.size, 20_000):
            part = ends[k : k + 20_000]
            mine, other = (text.data[start[x][:, None] + np.arange(length)] for x in (part, partner[part]))
            good[k : k + 20_000] &= (mine == other).all(axis=1)
    low, high = start[firsts] - text.starts[who], start[lasts] - text.starts[who]
    for k in np.nonzero(~good)[0].tolist():  # fingerprints that collide
        m = int(who[k])
        others = {data[o][i : i + length] for o in np.nonzero(key == key[m])[0].tolist() if o != m for i in range(len(data[o]) - length + 1)}
        hits = [i for i in range(len(data[m]) - length + 1) if data[m][i : i + length] in others]
        low[k], high[k] = (hits[0], hits[-1]) if hits else (-1, -1)
    keep = low >= 0
    return who[keep], low[keep], high[keep]


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(row_id, lo, hi): runs of starts of strings of `length` bytes whose bytes start more than once.  docs: (row_id, data), a file source."""
    spark = docs.sparkSession
    made = docs.select("row_id", "data").mapInArrow(releasing(_records(length, batches)), "batch int, key long, ctx long")
    log, log_path = written(made.groupBy("batch", "key", "ctx").agg(F.count("*").alias("n")), "marks", partition_by="batch")
    family = SuffixFamily(spark)
    for k in range(batches):
        family.add(log.where(F.col("batch") == k).select("key", "ctx", "n"))
    drop_path(spark, log_path)
    suffixes, suffixes_path = written(family.matched(), "matched")
    family.drop()
    # Heads of suffixes of which one at least is alone in its surroundings.
    lone = suffixes.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1")
    mixed, mixed_path = written(lone.select("key", "kinds"), "mixed")
    n_suffixes = suffixes.agg(F.count_distinct("key"), F.count_if(F.col("n") == 1)).first()
    n_mixed = mixed.agg(F.count("*"), F.count_if(F.col("kinds") > CROWD), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    crowds = mixed.where(F.col("kinds") > CROWD)
    sets = spark.sparkContext.broadcast((_bits(suffixes, "key", n_suffixes[0]), _bits(mixed, "key", n_mixed[0]), _bits(suffixes.where("n = 1"), "ctx", n_suffixes[1]), _bits(crowds, "key", n_mixed[1])))

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks that may be matched."""
        known = _BitSet(sets.value[0])
        for rows, offsets, text in _chunks(parts, length):
            m = Marks(text, length)
            maybe = np.nonzero(known.holds(m.key))[0]
            base = (text.starts[:-1] - offsets)[m.doc[maybe]]
            yield pa.RecordBatch.from_arrays([_long(m.key[maybe]), _long(m.ctx[maybe]), pa.array(rows[m.doc[maybe]]), pa.array(m.lo[maybe] - base), pa.array(m.hi[maybe] - base)], names=["key", "ctx", "row_id", "lo", "hi"])

    def partial_marks(m: Marks, told: np.ndarray, crowded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks whose head may have lone surroundings, whether they seek (or only witness), and what has been told now.

        Surroundings that more than one place has are known as a whole: they only
        witness the strings of others, once a task.
        """
        split, single, crowd = (_BitSet(x) for x in sets.value[1:])
        fine = np.nonzero(split.holds(m.key))[0]
        fine = fine[crowd.holds(m.key[fine]) == crowded]
        kinds, kind, count = np.unique(m.ctx[fine] ^ m.key[fine] * np.uint64(3), return_index=True, return_counts=True)
        fine = fine[kind]
        seeker = (count == 1) & single.holds(m.ctx[fine])
        fresh = seeker | ~np.isin(kinds, told)
        return fine[fresh], seeker[fresh], np.union1d(told, kinds[~seeker])

    def look_closer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Such marks with their bytes."""
        told = np.zeros(0, np.uint64)
        for rows, offsets, text in _chunks(parts, length):
            m = Marks(text, length)
            fine, seeker, told = partial_marks(m, told, False)
            base = (text.starts[:-1] - offsets)[m.doc[fine]]
            lo, end = m.lo[fine], m.hi[fine] + length
            data = [text.data[a:z].tobytes() for a, z in zip(lo.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_long(m.key[fine]), pa.array(rows[m.doc[fine]]), pa.array(lo - base), pa.array((m.at[fine] - lo).astype(np.int32)), pa.array(seeker), pa.array(data, pa.binary())], names=["key", "row_id", "lo", "head", "seeker", "data"])

    def strings_of_crowds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every string of the marks whose head is in a crowd, as two fingerprints."""
        told = np.zeros(0, np.uint64)
        for rows, offsets, text in _chunks(parts, length):
            m = Marks(text, length)
            fine, seeker, told = partial_marks(m, told, True)
            base = text.starts[:-1] - offsets
            for k in range(0, fine.size, 2000):
                start, mark, prints = m.strings(fine[k : k + 2000], length)
                seeks = np.repeat(seeker[k : k + 2000], m.hi[fine[k : k + 2000]] - m.lo[fine[k : k + 2000]] + 1)
                doc = m.doc[mark]
                yield pa.RecordBatch.from_arrays([_long(prints), _long(text.prints(0, start, start + length)), pa.array(rows[doc]), pa.array(start - base[doc]), pa.array(seeks)], names=["one", "two", "row_id", "at", "seeker"])

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial matches of the marks of each head; heads come one after the other, and are compared as soon as enough bytes are held."""
        held: list[tuple[int, int, int, int, bool, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            key, row, lo, head, seeker, data = (list(c) for c in zip(*held, strict=True))
            who, first, last = partial_matches(np.array(key, np.int64).view(np.uint64), np.array(head, np.int64), np.array(seeker, bool), data, length)
            row, lo = np.array(row, np.int64)[who], np.array(lo, np.int64)[who]
            if who.size:
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(lo + first), pa.array(lo + last)], names=["row_id", "lo", "hi"])

        for b in parts:
            for mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SETTLE_BYTES and mark[0] != held[-1][0]:
                    yield from close()
                    held, size = [], 0
                held.append(mark)
                size += len(mark[-1])
        if held:
            yield from close()

    texts = docs.select("row_id", "data")
    deal = max(spark.sparkContext.defaultParallelism, -(-n_mixed[2] // DEALT))
    closer = texts.mapInArrow(releasing(look_closer), PARTIAL)
    fine = closer.repartition(deal, "key").sortWithinPartitions("key").mapInArrow(releasing(settle), SPANS)
    marks = texts.mapInArrow(releasing(look), "key long, ctx long, row_id long, lo long, hi long")
    whole = marks.join(suffixes.where("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("row_id", "lo", "hi")
    spans = whole.union(fine)
    if n_mixed[1]:
        strings = texts.mapInArrow(releasing(strings_of_crowds), STRINGS)
        twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
        spans = spans.union(strings.where("seeker").join(twice, ["one", "two"], "left_semi").select("row_id", F.col("at").alias("lo"), F.col("at").alias("hi")))
    out, _ = written(spans, "spans")
    drop_path(spark, suffixes_path, mixed_path)
    return out


def _joined(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Byte ranges [lo, hi) to remove, from sorted starts; ranges that touch become one."""
        row = lo = hi = None
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for r, a, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r == row and a <= hi:
                    hi = max(hi, z + length)
                else:
                    if row is not None:
                        out.append((row, lo, hi))
                    row, lo, hi = r, a, z + length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row_id", "lo", "hi"])
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (row, lo, hi)], names=["row_id", "lo", "hi"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """One row per row of docs: row_id, doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if texts is true.

    Every byte is removed that a string of `length` bytes covers which also
    starts anywhere else, in the same text too; strings are judged on the input.
    Null texts are empty; texts shorter than `length` stay.  Repeated rows are
    copies of one another: all are removed.  Only the two named columns are
    read.  An empty table gives an empty result.
    """
    if length <= HEAD:
        raise ValueError(f"length must be over {HEAD}")
    spark = docs.sparkSession
    arrow_batches(spark)
    own = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data")), "row_id")
    spans = repeated_spans(own, length, batches)
    ranges = spans.repartition(F.col("row_id")).sortWithinPartitions("row_id", "lo").mapInArrow(releasing(_joined(length)), SPANS)
    by_row, _ = written(ranges.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges")), "ranges")
    words = filter_words(by_row.count())
    bits, _ = written(bit_words(by_row, "row_id", words), "filter")
    marked = may_hold(own, "row_id", bits, words, "touched")
    clean = marked.where("not touched").select("row_id", "doc_id", "data", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("ranges"))
    touched = marked.where("touched").drop("touched").join(by_row, "row_id", "left").select("row_id", "doc_id", "data", "ranges")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for row, doc, data, ranges in zip(*b.columns, strict=True):
                data = data.as_py()
                kept, at, gone = [], 0, 0
                spans = ranges.as_py() or ()
                for s in spans:
                    kept.append(data[at : s["lo"]])
                    at, gone = s["hi"], gone + s["hi"] - s["lo"]
                kept = b"".join([*kept, data[at:]])
                out.append((row.as_py(), doc.as_py(), len(data), gone, len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * texts
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=["row_id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])

    return clean.union(touched).mapInArrow(releasing(cut), "row_id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def repeat_report(docs: DataFrame) -> DataFrame:
    """remove_repeats() in the columns doc_id, n_bytes, n_removed, n_spans, kept_sha256; its rules for nulls, empty and long texts, ties, repeated rows, empty tables and other columns hold."""
    return remove_repeats(docs).drop("row_id")
