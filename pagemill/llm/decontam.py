"""Benchmark decontamination over a positional inverted index of the training text.

The index is distributed by document: each segment (a few megabytes of
documents, one row of a Parquet table in the shared folder) holds, for every
term, the delta-coded positions at which it stands in the segment.  A query
window is matched segment by segment: its terms' lists, shifted by their place
in the window, are intersected from the rarest term on.  No term's list is ever
in one place, so a word that fills a third of the corpus costs no more than any
other, and each segment is matched by one task of bounded memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, releasing, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEGMENT_WORDS = 1_000_000
BLOCK_CHARS = 8 << 20
BLOCKS = 4
NEAR_BLOCK = 1 << 14
SEGMENT = "rows binary, starts binary, ids binary, terms binary, sizes binary, postings binary"
MATCH = "row_id long, doc_id long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>, near_items array<string>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(_lower(text)) if text else []


def _lower(text: str) -> str:
    """A-Z only, as bytes.lower does."""
    return text.encode().lower().decode()


class _Segment:
    """Gathers documents; pack() turns them into one row of the index."""

    def __init__(self) -> None:
        self.vocab: defaultdict[str, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__  # a new word gets the next number
        self.rows: list[int] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, row: int, doc: int | None, text: str | None) -> None:
        found = WORD.findall(_lower(text)) if text else []
        self.parts.append(np.fromiter(map(self.vocab.__getitem__, found), np.uint32, len(found)))
        self.rows.append(row)
        self.ids.append(doc)
        self.lengths.append(len(found))
        self.n += len(found)

    def pack(self) -> dict[str, bytes]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        # A gap of one position between documents: no phrase runs from one into the next.
        starts = np.zeros(len(self.rows) + 1, np.int64)
        np.cumsum(np.array(self.lengths, np.int64) + 1, out=starts[1:])
        at = np.arange(flat.size, dtype=np.int64) + np.repeat(np.arange(len(self.rows)), self.lengths)
        sizes = np.bincount(flat, minlength=len(self.vocab)).astype(np.uint32)
        both = flat.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
        both.sort()  # by term, then place
        at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        delta = np.diff(at, prepend=0)
        firsts = np.zeros(len(self.vocab), np.int64)
        np.cumsum(sizes[:-1], out=firsts[1:])
        delta[firsts] = at[firsts]
        ids = pa.array(self.ids, pa.int64())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as out:
            out.write_batch(pa.record_batch([ids], ["id"]))
        return {"rows": np.array(self.rows, np.int64).tobytes(), "starts": starts.tobytes(), "ids": sink.getvalue().to_pybytes(), "terms": squeeze("\x00".join(self.vocab).encode()), "sizes": squeeze(sizes.tobytes()), "postings": squeeze(delta.astype(np.uint32).tobytes())}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.binary()) for c in ("rows", "starts", "ids", "terms", "sizes", "postings")])
    seg = _Segment()
    for batch in batches:
        for row, doc, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            seg.add(row.as_py(), doc.as_py(), text.as_py())
            if seg.n >= SEGMENT_WORDS or len(seg.rows) >= 50_000:
                yield pa.RecordBatch.from_pylist([seg.pack()], schema=schema)
                seg = _Segment()
    if seg.rows:
        yield pa.RecordBatch.from_pylist([seg.pack()], schema=schema)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> tuple[DataFrame, str]:
    """Writes the positional index of all documents to the shared folder; returns it and its path.

    One row of docs is one document: repeated ids and rows stay apart, a null
    text has no words, a null id is kept.  Other columns are not read.  row: a
    column of row numbers, if docs has one; else rows get numbers that hold
    within the index alone.
    """
    arrow_batches(docs.sparkSession)
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    own = docs.select(number.alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(own.mapInArrow(releasing(_segments), SEGMENT), "postings")


def query_block(items: list[tuple[str | None, str | None]], window: int) -> dict:
    """Query items as windows of words, in plain lists and arrays.

    vocab: the words; table: a row of word numbers a window, short windows
    filled with their first word; sizes: words of each; names: item ids;
    owners[cuts[n]:cuts[n + 1]]: the items of window n.  Items of fewer words
    than a window are one window; items of none have none.
    """
    vocab: dict[str, int] = {}
    seen: dict[tuple[int, ...], dict[int, None]] = {}
    for k, (_, text) in enumerate(items):
        found = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        for i in range(max(1, len(found) - window + 1) if found else 0):
            seen.setdefault(tuple(found[i : i + window]), {})[k] = None
    return {
        "vocab": list(vocab),
        "table": np.array([[*w, *[w[0]] * (window - len(w))] for w in seen], np.int64).reshape(-1, window),
        "sizes": np.fromiter(map(len, seen), np.int64, len(seen)),
        "names": [name for name, _ in items],
        "owners": [k for ks in seen.values() for k in ks],
        "cuts": np.concatenate([[0], np.cumsum(np.fromiter(map(len, seen.values()), np.int64, len(seen)))]),
    }


def _has(sorted_at: np.ndarray, values: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_at, values)
    k[k == sorted_at.size] = 0
    return sorted_at[k] == values


def _within(at: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, reach: int) -> np.ndarray:
    """Where windows of `reach` words of one document begin that hold a place of every list, at places of the first list.

    A window can be moved right until it begins with one of its places, so only
    the places of all lists around those of the first are tried as beginnings.
    """
    found = []
    for k in range(0, at.size, NEAR_BLOCK):
        part = at[k : k + NEAR_BLOCK]
        begin = []
        for x in lists:
            a, b = np.searchsorted(x, part - (reach - 1)), np.searchsorted(x, part, side="right")
            n = b - a
            begin.append(x[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        begin = np.unique(np.concatenate(begin))
        end = np.minimum(begin + reach, starts[np.searchsorted(starts, begin, side="right")])
        for x in lists:
            m = np.searchsorted(x, begin)
            keep = (m < x.size) & (x[np.minimum(m, x.size - 1)] < end)
            begin, end = begin[keep], end[keep]
        found.append(begin)
    return np.concatenate(found)


def _match_segment(row: dict, blocks: list[dict], slop: int | None) -> dict:
    unsqueeze = zstandard.ZstdDecompressor().decompress
    terms = unsqueeze(row["terms"]).decode().split("\x00")
    sizes = np.frombuffer(unsqueeze(row["sizes"]), np.uint32).astype(np.int64)
    starts = np.frombuffer(row["starts"], np.int64)
    deltas = np.frombuffer(unsqueeze(row["postings"]), np.uint32)
    ends = np.cumsum(sizes)
    place = {w: k for k, w in enumerate(terms)} if sizes.size else {}
    n_docs = starts.size - 1
    cover = np.zeros(int(starts[-1]) + 1, np.int32)
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    lists: dict[int, np.ndarray] = {}

    def postings(term: int) -> np.ndarray:
        got = lists.get(term)
        if got is None:
            got = lists[term] = np.cumsum(deltas[ends[term] - sizes[term] : ends[term]], dtype=np.int64)
        return got

    for block in blocks:
        local = np.fromiter((place.get(w, -1) for w in block["vocab"]), np.int64, len(block["vocab"]))
        if not local.size:
            continue
        names, owners, cuts = block["names"], block["owners"], block["cuts"]
        for n in np.nonzero((local[block["table"]] >= 0).all(axis=1))[0].tolist():
            size = int(block["sizes"][n])
            mine = local[block["table"][n, :size]]
            held = {name for k in owners[cuts[n] : cuts[n + 1]] if (name := names[k]) is not None}
            rarest = np.argsort(sizes[mine], kind="stable")
            at = postings(mine[rarest[0]]) - rarest[0]
            for k in rarest[1:]:
                if not at.size:
                    break
                at = at[_has(postings(mine[k]), at + k)]
            if at.size:
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                    items.setdefault(d, set()).update(held)
            if slop is not None:
                reach = size + slop
                distinct = list(dict.fromkeys(mine[rarest].tolist()))
                at = postings(distinct[0])
                for t in distinct[1:]:  # first, any occurrence within reach
                    other = postings(t)
                    k = np.searchsorted(other, at - (reach - 1))
                    at = at[(k < other.size) & (other[np.minimum(k, other.size - 1)] < at + reach)]
                    if not at.size:
                        break
                if not at.size:
                    continue
                at = _within(at, [postings(t) for t in distinct], starts, reach)
                for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                    near.setdefault(d, set()).update(held)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
    lo, hi = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    of = np.searchsorted(starts, lo, side="right") - 1
    spans: dict[int, list[dict]] = {}
    for d, x, y in zip(of.tolist(), (lo - starts[of]).tolist(), (hi - starts[of]).tolist(), strict=True):
        spans.setdefault(d, []).append({"lo": x, "hi": y})
    return {
        "row_id": np.frombuffer(row["rows"], np.int64).tolist(),
        "doc_id": pa.ipc.open_stream(row["ids"]).read_all().column("id").to_pylist(),
        "n_words": (np.diff(starts) - 1).tolist(),
        "spans": [spans.get(d, []) for d in range(n_docs)],
        "items": [sorted(items.get(d, ())) for d in range(n_docs)],
        "near_items": [sorted(near.get(d, ())) for d in range(n_docs)],
    }


def _blocks_of(items: DataFrame, window: int) -> Iterator[dict]:
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") + 1
        if size >= BLOCK_CHARS:
            yield query_block(held, window)
            held, size = [], 0
    if held:
        yield query_block(held, window)


def match_index(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 10, slop: int | None = None) -> DataFrame:
    """One row per indexed document: row_id, doc_id, n_words, n_hit, items (exact phrases), near_items (all terms within window + slop words, any order), spans (the hit runs of words).

    items is a stated query set, read block by block (BLOCK_CHARS of text
    each); at most BLOCKS of them are sent to the executors at once, and the
    index is read once for so many.  Null or word-less items match nothing;
    the words of an item of null id are hit, but it is in no list; repeated
    items are matched once.  Proximity is looked for only where slop is given:
    in every window around the rarest term, so the places reported are all
    there are.
    """
    if window < 1 or (slop is not None and slop < 0):
        raise ValueError("window must be at least 1 and slop at least 0")
    spark = index.sparkSession
    arrow_batches(spark)
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def one_pass(blocks: list[dict]) -> DataFrame:
        sent = spark.sparkContext.broadcast(blocks)  # bounded: BLOCKS blocks of BLOCK_CHARS

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield pa.RecordBatch.from_pydict(_match_segment(batch.slice(k, 1).to_pylist()[0], sent.value, slop), schema=schema)

        return index.mapInArrow(releasing(match), MATCH)

    passes = [one_pass([])] if items.isEmpty() else []
    held: list[dict] = []
    for block in _blocks_of(items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")), window):
        held.append(block)
        if len(held) == BLOCKS:
            passes.append(written(one_pass(held), "pass")[0])
            held = []
    if held:
        passes.append(one_pass(held) if not passes else written(one_pass(held), "pass")[0])
    out = passes[0]
    if len(passes) > 1:
        every = reduce(DataFrame.union, passes).groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")))
        out = every.select("row_id", "doc_id", "n_words", F.array_sort("spans").alias("spans"), *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(s["end"], x["lo"]))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end")))["n"]
    return out.select("row_id", "doc_id", "n_words", hit.cast("long").alias("n_hit"), "items", "near_items", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """build_index() and match_index() in one: a row per document, in no order.  Empty tables give no rows, or rows without hits."""
    index, _ = build_index(docs, doc_id, text, row)
    return match_index(index, items, window=window, slop=slop)


def contamination_report(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """decontaminate() in the columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A row per row of docs, repeated ones too.  Null and empty texts have no
    words; texts of any length are matched whole; null ids stay null.  Ties do
    not arise: every window that occurs counts.  An empty table of documents
    gives an empty result, an empty benchmark no hits.  Other columns, of
    whatever name, are not read.
    """
    m = decontaminate(docs, items, window, slop)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))

