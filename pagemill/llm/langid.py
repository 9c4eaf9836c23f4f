"""Language identification by compression: the language whose dictionary shrinks a text most.

Each language has a zstandard raw-content dictionary cut from a bounded sample
of labelled texts.  A text is compressed against each, piece by piece so that
it cannot feed on its own beginning, and the smallest total wins.  A narrow
margin between the two smallest is a rejection.  Case, digits and punctuation
are folded away first, in dictionaries and texts alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm._common import arrow_batches, releasing

UNKNOWN = "und"
DICTIONARY_BYTES = 192 << 10
SAMPLE_TEXTS = 400
TEXT_BYTES = 2048
MAX_LANGUAGES = 100
PIECE = 4096
LEVEL = 9
MIN_MARGIN = 0.003
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    return OTHER.sub(" ", text).lower()


def train_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = DICTIONARY_BYTES, sample: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Raw-content dictionaries by language from the labelled rows of docs (the caller has taken away those held out).

    Bounds: about `sample` distinct texts a language, chosen by hash over all
    rows, of which up to TEXT_BYTES bytes each, from a place chosen by the hash,
    are put in a row until `size` bytes are full.  Copies of a text count once.  At most MAX_LANGUAGES labels.
    Rows with a null or empty text or label are left out.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(text) > 0").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: is {lang} a label?")
    if not counts:
        return {}
    share = F.try_element_at(F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n)))), F.col("lang"))
    unit = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    texts = rows.where(unit <= share).groupBy("lang", "h").agg(F.max(F.expr(f"substring(text, 1 + pmod(h, greatest(1, length(text) - {TEXT_BYTES})), {2 * TEXT_BYTES})")).alias("text"))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["h"], folded(r["text"]).encode()[:TEXT_BYTES]))
    out = {}
    for name, chosen in sorted(found.items()):
        parts, full = [], 0
        for _, t in sorted(chosen):
            parts.append(t)
            full += len(t)
            if full >= size:
                break
        out[name] = b" ".join(parts)
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.tools = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> np.ndarray:
        data = folded(text).encode()
        n = max(1, round(len(data) / PIECE))
        cuts = [len(data) * k // n for k in range(n + 1)]
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return np.array([sum(len(press(p)) for p in pieces) - 8 * n for press in self.tools])

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin: by how much of its size the second smallest is larger than the smallest."""
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = int(order[0])
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0
        margin = float(sizes[order[1]] - sizes[best]) / max(1.0, float(sizes[order[1]]))
        score = 1 / float(np.exp2(-np.minimum(60, (sizes - sizes[best]) * 2.0)).sum())
        return self.names[best], score, max(0.0, margin)


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs and lang_pred, score (0 to 1), margin, accepted; columns of docs that have one of these names are replaced.

    Null texts and texts without a letter are "und", with score and margin 0.
    accepted is false for them and where the margin is below min_margin.  Whole
    texts are compressed, whatever their length.  An empty table gives an empty
    result; without dictionaries all is "und".
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = docs.drop(*ADDED.names)
    at = own.columns.index(text)
    sent = spark.sparkContext.broadcast(dictionaries)  # bounded: MAX_LANGUAGES dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Classifier(sent.value)
        for b in batches:
            got = [tool(t.as_py()) for t in b.column(at)]
            names, scores, margins = ([g[k] for g in got] for k in range(3))
            flags = [m >= min_margin and n != UNKNOWN for n, m in zip(names, margins, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(flags, pa.bool_())], names=[*b.schema.names, *ADDED.names])

    return own.mapInArrow(releasing(run), T.StructType([*own.schema.fields, *ADDED.fields]))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; the fold of a null id is that of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def language_report(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """A row per row of docs: doc_id, held_out, lang_pred, score, margin, accepted; the dictionaries come from rows whose fold isn't held out.

    Null texts and texts without a letter are "und", as are all where no row is
    labelled; whole texts are compressed, however long.  Of equal sizes the first
    language by name is predicted.  Repeated rows stay rows.  An empty table gives
    an empty result.  Other columns are not read.
    """
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    dictionaries = train_dictionaries(own.where("not held_out"))
    return identify(own.select("doc_id", "held_out", "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")


def keep_identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of docs whose language is accepted, in the columns of docs."""
    dictionaries = train_dictionaries(docs.where(fold(F.col("doc_id"), folds) != held))
    names = docs.columns
    safe = docs.toDF(*(f"c{k}" for k in range(len(names))))
    out = identify(safe, dictionaries, f"c{names.index('text')}")
    return out.where("accepted").select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)))
