"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints that differ in at most d bits agree in at least B - d of their B
bytes, position by position.  The index holds (positions, bytes) postings of
groups of positions, chosen so that any B - d positions include a whole group:
lists of single bytes would hold a 256th of the corpus each.  For each list,
shared positional bytes are tallied per pair, pairs below the guaranteed
minimum dropped, and the rest verified by their differing bits.  Only distinct
fingerprints are indexed, and a list yields a spanning forest of its links, so
neither a large group of copies nor one of near copies makes pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm._common import arrow_batches, components, drop_path, joined_rows, numbered, releasing, spare_name, without_rows, written

BITS, BYTES = 64, 8
LONG_LIST = 2048
SEED = 42


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words, space-joined; of the whole sequence if it has fewer."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in runs), np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, h.size, 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        whole = bits.shape[0] // 255 * 255
        counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > h.size).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, keep: tuple[str, ...] = ("row_id", "doc_id")) -> DataFrame:
    """keep, and fp: the fingerprint as a signed 64-bit long.  Null and word-less texts have fingerprint 0."""
    arrow_batches(docs.sparkSession)
    own = docs.select(*keep, F.col(text).cast("string").alias(spare_name(docs, "the_text")))
    out = T.StructType([*own.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((majority(shingle_hashes(t.as_py(), words)) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return own.mapInArrow(releasing(run), out)


def covering_groups(distance: int) -> list[tuple[int, ...]]:
    """Groups of byte positions of which any BYTES - distance matching positions include a whole one."""
    least = BYTES - distance
    if least < 1:
        raise ValueError("at this distance no byte need match: choose 7 or less")
    half = (least + 1) // 2  # one half of the bytes holds at least this many of the matches
    return [c for part in (range(BYTES // 2), range(BYTES // 2, BYTES)) for c in combinations(part, half)]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * (BYTES - 1 - p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(fps: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).cast("short").alias("group"), F.col("fp").bitwiseAND(F.lit(_mask(g)).cast("long")).alias("bytes")) for k, g in enumerate(groups)))
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.group", "k.bytes")


def _forest(cols: np.ndarray, distance: int, least: int) -> tuple[list[int], list[int]]:
    """A spanning forest, as index pairs, of the links among the rows of cols (distinct fingerprints, as bytes).

    Breadth first: each reached fingerprint is held against those not yet
    reached, so a dense list costs little more than its size.
    """
    rest = np.arange(cols.shape[0])
    us: list[int] = []
    vs: list[int] = []
    queue: list[int] = []
    while rest.size:
        if queue:
            f = queue.pop()
        else:
            f, rest = int(rest[0]), rest[1:]
        if least:
            tally = (cols[rest] == cols[f]).sum(axis=1) if rest.size < 64 else sum((cols[rest, p] == cols[f, p]).astype(np.uint8) for p in range(cols.shape[1]))
            near = np.nonzero(tally >= least)[0]
        else:
            near = np.arange(rest.size)
        near = near[np.bitwise_count(cols[rest[near]] ^ cols[f]).sum(axis=1) <= distance]
        if near.size:
            found = rest[near].tolist()
            us += [f] * len(found)
            vs += found
            queue += found
            rest = np.delete(rest, near)
    return us, vs


LINKS = "u long, v long"
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links_of_lists(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fps in b.column(0):
                fps = fps.values.to_numpy(zero_copy_only=False).astype(np.int64)
                u, v = _forest(fps.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, BYTES), distance, BYTES - distance)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(fps[u]), pa.array(fps[v])], schema=_LINKS)

    return run


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(u, v): links among the distinct fingerprints in column fp that connect all that differ in at most `distance` bits.

    Lists over LONG_LIST are refined: their members are listed anew under each
    group of as many positions as are guaranteed to match, which leaves free
    only `distance` bytes: such a list has 2 ** (8 * distance) members at most.
    """
    groups = covering_groups(distance)
    postings, path = written(_postings(fps, groups), "postings")
    sizes = postings.groupBy("group", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    long, long_path = written(sizes.where(F.col("size") > LONG_LIST), "long")
    is_long = F.col("l.size").isNotNull()
    short = postings.alias("p").join(long.alias("l"), ["group", "bytes"], "left").where(~is_long).groupBy("group", "bytes").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    whole = list(combinations(range(BYTES), BYTES - distance))
    hot = postings.join(long.select("group", "bytes"), ["group", "bytes"], "left_semi").select("fp").distinct()
    refined = _postings(hot, whole).groupBy("group", "bytes").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    found = short.select("fps").mapInArrow(releasing(_links_of_lists(distance)), LINKS)
    if long.take(1):
        found = found.union(refined.select("fps").mapInArrow(releasing(_links_of_lists(distance)), LINKS))
    out, _ = written(found.distinct(), "links")
    drop_path(fps.sparkSession, path, long_path)
    return out


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of docs: row_id, doc_id, fp (long), fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most
    `distance` differing bits, itself included (null ids are ignored unless there
    are no others).  Texts of fewer words than a shingle are one shingle;
    word-less and null texts have fingerprint 0, linked like any other.
    Repeated rows stay rows, in one component.  Only the two named columns are
    read.  An empty table gives an empty result.
    """
    own = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "row_id")
    marked, _ = written(fingerprints(own, "text", words), "fingerprints")
    kinds, kinds_path = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "kinds")
    groups = components(links(kinds.select("fp"), distance))
    joined = kinds.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    joined, joined_path = written(joined, "joined")
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp, _ = written(joined.join(least, "component").select("fp", "component_id"), "components")
    drop_path(docs.sparkSession, kinds_path, joined_path)
    return marked.join(by_fp, "fp", "left").select("row_id", "doc_id", "fp", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_report(docs: DataFrame) -> DataFrame:
    """near_components() in the columns doc_id, fingerprint, component_id; its rules for nulls, empty and long texts, ties, repeated rows, empty tables and other columns hold."""
    return near_components(docs).select("doc_id", "fingerprint", "component_id")


# Near copies by a share of shingles: the index of fingerprints, and prefixes and wider fingerprints for what it does not reach, choose what is worth comparing; the shingle sets themselves decide.

WIDE = 4
WIDE_BYTES = WIDE * BYTES
SPREADS = 6
KEYS = 16
HOT_SAMPLE = 8
HOT_WORDS = 1 << 18
TALLY = 1 << 20
GROUP = 16_384
GUIDES = 16
BLOCK = 4096
UNIT = 512


def wide_majority(h: np.ndarray) -> bytes:
    """WIDE fingerprints of 64 bits, from hashes mixed anew for each."""
    out = []
    for k in range(WIDE):
        x = h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))).to_bytes(BYTES, "big"))
    return b"".join(out)


def bits_at(similarity: float, spreads: float | None = SPREADS) -> int:
    """Differing bits of wide fingerprints that pairs of this Jaccard similarity keep below: the mean for sets of like size, and `spreads` standard deviations; None: any number."""
    if spreads is None:
        return 64 * WIDE
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * WIDE * share + spreads * np.sqrt(64 * WIDE * share * (1 - share)))


def prefix(hashes: np.ndarray, similarity: float, hot: np.ndarray | None = None, keys: int | None = KEYS) -> np.ndarray:
    """Keys of sorted distinct hashes, such that two sets of this similarity share one: the first in an order that has those marked in hot last.

    For certain, that takes as many as may be missing in the other set, and one
    more: keys=None gives these.  Where not over half are hot, KEYS are enough
    but for a small chance: in any order, each of the first of both sets is
    shared with a chance of at least 0.55 (0.8 where none is hot), and the chance
    that none of KEYS is, is below 3e-6 (7e-12).
    """
    most = hashes.size - int(np.ceil(similarity * hashes.size - 1e-9)) + 1
    if hot is not None and hot.any():
        hashes = np.concatenate([hashes[~hot], hashes[hot]])
        if 2 * np.count_nonzero(hot) > hashes.size:
            return hashes[:most]
    return hashes[: most if keys is None else min(most, keys)]


def hot_bits(keys: DataFrame) -> DataFrame:
    """(word, bits): at most HOT_WORDS rows; the bit of each of keys (key), which are hashes themselves, is set."""
    word = F.shiftright("key", 6).bitwiseAND(F.lit(HOT_WORDS - 1))
    return keys.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))


def hot_among(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in words, the set behind hot_bits()."""
    return (words[(hashes >> np.uint64(6)) & np.uint64(words.size - 1)] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest, as index pairs, of the pairs of non-empty sets whose Jaccard similarity is at least this.  Breadth first, as _forest()."""
    sizes = np.array([x.size for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rest = np.arange(sizes.size)
    us: list[int] = []
    vs: list[int] = []
    queue: list[tuple[int, np.ndarray]] = []
    while rest.size:
        if queue:
            f, own = queue.pop()
        else:
            f, own = int(rest[0]), flat[: sizes[0]]
            rest, flat, sizes = rest[1:], flat[sizes[0] :], sizes[1:]
            if not rest.size:
                break
        held = np.zeros(values.size, bool)
        held[own] = True
        starts = np.cumsum(sizes) - sizes
        both = np.add.reduceat(held[flat], starts, dtype=np.int64)
        near = both / (sizes + own.size - both) >= similarity
        if near.any():
            for k in np.nonzero(near)[0].tolist():
                us.append(f)
                vs.append(int(rest[k]))
                queue.append((vs[-1], flat[starts[k] : starts[k] + sizes[k]]))
            flat = flat[np.repeat(~near, sizes)]
            rest, sizes = rest[~near], sizes[~near]
    return us, vs


def _verified(own: DataFrame, maybe: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links of kinds whose shingle sets have the similarity.  maybe: (row_id, kind, weight, group), a row of each kind; only kinds of one group are compared.

    A group of a weight up to GROUP is held by one task; larger ones are spread
    over many tasks.  A kind weighs one, or as many as it has UNIT shingles, so
    that a task holds at most GROUP * UNIT shingles (8 bytes each) and the
    kind that goes beyond.
    """
    spark = own.sparkSession
    sizes, sizes_path = written(maybe.groupBy("group").agg(F.sum("weight").alias("size")).where(F.col("size") > GROUP), "large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kinds, sets = None, [], []

        def links_of() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                u, v = similar_forest(sets, similarity)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array([kinds[k] for k in u], pa.int64()), pa.array([kinds[k] for k in v], pa.int64())], schema=_LINKS)

        for b in batches:
            for g, kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != group:
                    yield from links_of()
                    group, kinds, sets = g, [], []
                kinds.append(kind)
                sets.append(np.unique(shingle_hashes(text.as_py(), words)))
        yield from links_of()

    texts = joined_rows(own.select("row_id", "text"), "row_id", maybe.join(sizes, "group", "left_anti")).select("group", "kind", "text")
    found, found_path = written(texts.repartition("group").sortWithinPartitions("group").mapInArrow(releasing(run), LINKS), "verified")
    if not sizes.isEmpty():
        found = found.union(_spread(own, maybe.join(sizes, "group"), words, similarity))
    drop_path(spark, sizes_path)
    return found


class Guides:
    """Shingle sets that others are held against: an inverted index of their hashes, and which of them belong together."""

    def __init__(self, kinds: list[int], sets: list[np.ndarray], similarity: float) -> None:
        self.kinds, self.similarity = kinds, similarity
        self.sizes = np.array([x.size for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.us, self.vs = similar_forest(sets, similarity) if len(sets) > 1 else ([], [])
        self.label = np.arange(len(sets))
        for u, v in zip(self.us, self.vs, strict=True):  # breadth first: u has its label by now
            self.label[v] = self.label[u]

    def like(self, own: np.ndarray) -> list[int]:
        """One guide of each kind of guide that own is similar to."""
        a, b = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        n = b - a
        both = np.bincount(self.owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=self.sizes.size)
        near = np.nonzero(both / (self.sizes + own.size - both) >= self.similarity)[0]
        return [self.kinds[k] for k in near[np.unique(self.label[near], return_index=True)[1]].tolist()]


def _spread(own: DataFrame, large: DataFrame, words: int, similarity: float) -> DataFrame:
    """_verified() of large groups (row_id, kind, weight, group, size: the sum of weights), in bounded memory: links that connect all similar kinds.

    Some kinds guide: all of their group are held against them, in as many tasks
    as it takes.  Kinds of the group's largest component need not guide, for what
    is outside will be held against them; so rounds go on until all outside have
    guided, first a few by chance, then BLOCK at a time.
    """
    spark = own.sparkSession

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.list_(pa.int64())), b.column(4)], names=["group", "kind", "size", "shingles", "weight"])

    texts = joined_rows(own.select("row_id", "text"), "row_id", large).select("group", "kind", "size", "text", "weight")
    members, members_path = written(texts.mapInArrow(releasing(to_sets), "group long, kind long, size long, shingles array<long>, weight long"), "members")
    shares = F.ceil(F.col("size") / BLOCK).cast("int")

    def held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kinds, sets, guides = None, [], [], None
        us: list[int] = []
        vs: list[int] = []
        for b in batches:
            for group, share, guiding, kind, hashes in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                if (group, share) != part:
                    part, kinds, sets, guides = (group, share), [], [], None
                own_set = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if guiding:
                    kinds.append(kind)
                    sets.append(own_set)
                    continue
                if guides is None:
                    guides = Guides(kinds, sets, similarity)
                    us += [kinds[k] for k in guides.us]
                    vs += [kinds[k] for k in guides.vs]
                found = [g for g in guides.like(own_set) if g != kind]
                us += [kind] * len(found)
                vs += found
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_LINKS)
                us, vs = [], []

    outside, done, links_paths, number = members.select("group", "kind", "weight"), None, [], 0
    drop: list[str] = []
    while True:
        if number < 2:
            picks = outside.groupBy("group").agg(*(F.min_by("kind", F.xxhash64("kind", F.lit(100 * number + j))).alias(f"k{j}") for j in range(GUIDES)))
            guides = picks.select("group", F.explode(F.array_distinct(F.array(*(f"k{j}" for j in range(GUIDES))))).alias("kind"))
        else:
            most = outside.groupBy("group").agg(F.sum("weight").alias("n")).agg(F.max("n")).first()[0]
            guides = outside.where(F.pmod(F.xxhash64("kind", F.lit(7)), F.lit(max(1, -(-2 * most // BLOCK)))) == 0) if most > BLOCK else outside
        guides, path = written(guides.select("group", "kind"), "guides")
        drop.append(path)
        if guides.isEmpty() and not outside.isEmpty():  # no hash fell into the block: any one will do
            guides, path = written(outside.groupBy("group").agg(F.min("kind").alias("kind")), "guides")
            drop.append(path)
        led = members.join(guides, ["group", "kind"], "left_semi").select("group", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(True).alias("guiding"), "kind", "shingles")
        dealt = members.select("group", F.pmod(F.xxhash64("kind", F.lit(3)), shares.cast("long")).cast("int").alias("share"), F.lit(False).alias("guiding"), "kind", "shingles")
        both = led.union(dealt).repartition("group", "share").sortWithinPartitions("group", "share", F.col("guiding").desc(), "kind")
        _, path = written(both.mapInArrow(releasing(held_against), LINKS), "links")
        links_paths.append(path)
        links = spark.read.schema(LINKS).parquet(*links_paths)
        parts, parts_path = written(components(links), "parts")
        labelled = members.select("group", "kind", "weight").join(parts, F.col("kind") == F.col("node"), "left").select("group", "kind", "weight", F.coalesce("component", "kind").alias("component"))
        main = labelled.groupBy("group", "component").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
        done = guides if done is None else done.union(guides)
        rest, path = written(labelled.join(main, ["group", "component"], "left_anti").select("group", "kind", "weight").join(done, ["group", "kind"], "left_anti"), "outside")
        drop += [path, parts_path]
        outside, number = rest, number + 1
        if outside.isEmpty():
            break
    drop_path(spark, members_path, *drop)
    return spark.read.schema(LINKS).parquet(*links_paths)


def tallied(words: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, size) of texts (any, text): the shingles that this share of a task's texts hold, two at least, and how many do.

    They are counted within the task, so that a shingle is one row of it however
    many texts hold it, and those of single texts are none.  Over TALLY shingles
    the rarest are forgotten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            texts += len(sets)
            keys, at = np.unique(np.concatenate([keys, *sets]), return_inverse=True)
            sizes = np.bincount(at, np.concatenate([sizes, np.ones(at.size - sizes.size, np.int64)]), keys.size).astype(np.int64)
            least = 2
            while keys.size > TALLY:
                keys, sizes, least = keys[sizes >= least], sizes[sizes >= least], least + 1
        often = sizes >= max(2, share * texts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(sizes[often])], names=["key", "size"])

    return run


def _prefixes(own: DataFrame, kinds: DataFrame, words: int, similarity: float, n_keys: int | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(kind, prefix): by an order of the shingles that has the frequent ones last; (key): those that still are; and the paths to drop.

    Shingles that LONG_LIST kinds or more hold in their prefixes are put last,
    with others that a sample of those kinds shows to be as frequent, and the
    prefixes that hold one of them are made anew, until none is new: any one
    order of all shingles gives complete lists.  What is put last is known by a
    set of HOT_WORDS words of bits, which is all that leaves the executors: where
    it is full, some rare shingles are put last as well, by all texts alike.
    """
    spark = own.sparkSession
    prefixes, paths = kinds.select("row_id", "kind", "prefix"), []
    hot = np.zeros(HOT_WORDS, np.uint64)

    def holding(table: DataFrame, column: str) -> DataFrame:
        """table, with the keys in column that hot has; rows that have none are left out."""
        sent = spark.sparkContext.broadcast(hot)
        at = table.columns.index(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some = pa.array([bool(hot_among(x.values.to_numpy().view(np.uint64), sent.value).any()) for x in b.column(at)], pa.bool_())
                yield b.filter(some)

        return table.mapInArrow(run, table.schema)

    while True:
        sizes = prefixes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= LONG_LIST)
        keys, keys_path = written(sizes.select("key"), "frequent")
        found = _words_of(hot_bits(keys))
        if not (found & ~hot).any():
            return prefixes.select("kind", "prefix"), keys, [*paths, keys_path]
        hot = hot | found
        old, old_path = written(holding(prefixes, "prefix").select("row_id", "kind"), "hot")

        some, some_path = written(old.where(F.pmod(F.xxhash64("kind"), F.lit(HOT_SAMPLE)) == 0), "some")
        sample = joined_rows(own.select("row_id", "text"), "row_id", some).select("row_id", "text")
        least = max(2, LONG_LIST // HOT_SAMPLE)
        counts = sample.mapInArrow(releasing(tallied(words, least / (4 * max(1, some.count())))), "key long, size long")
        shown = counts.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") >= least)
        hot = hot | _words_of(hot_bits(shown))
        drop_path(spark, old_path, some_path)
        old, old_path = written(holding(prefixes, "prefix").select("row_id", "kind"), "hot")  # the sample's keys too: all texts keep to one order
        handle = spark.sparkContext.broadcast(hot)

        def anew(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for t in b.column(2):
                    own_set = np.unique(shingle_hashes(t.as_py(), words))
                    made.append(prefix(own_set, similarity, hot_among(own_set, handle.value), n_keys).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], names=["row_id", "kind", "prefix"])

        new = joined_rows(own.select("row_id", "text"), "row_id", old).select("row_id", "kind", "text").mapInArrow(releasing(anew), "row_id long, kind long, prefix array<long>")
        prefixes, new_path = written(prefixes.join(old.select("kind"), "kind", "left_anti").select("row_id", "kind", "prefix").union(new), "prefixes")
        drop_path(spark, old_path, keys_path, *paths)
        paths = [new_path]


def _words_of(bits: DataFrame) -> np.ndarray:
    """The bit set behind hot_bits(): HOT_WORDS words, whatever the number of keys."""
    got, out = bits.toArrow(), np.zeros(HOT_WORDS, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _met_in_index(kinds: DataFrame, distance: int = 3) -> tuple[DataFrame, list[str]]:
    """(u, v): candidate links among kinds (kind, fp) whose fingerprints the byte-position index connects, equal ones included, by links() with its count filter; and the paths to drop."""
    spark = kinds.sparkSession
    groups, path = written(components(links(kinds.select("fp").distinct(), distance)), "index")
    placed, placed_path = written(kinds.join(groups, F.col("fp") == F.col("node"), "left").select("kind", F.coalesce("component", "fp").alias("place")), "placed")
    drop_path(spark, path)
    first = placed.groupBy("place").agg(F.min("kind").alias("first"), F.count("*").alias("n")).where("n > 1")
    return placed.join(first, "place").where("kind <> first").select(F.col("first").alias("u"), F.col("kind").alias("v")), [placed_path]


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, row: str | None = None, keys: int | None = KEYS, spreads: float | None = SPREADS) -> DataFrame:
    """One row per row of docs: row_id, doc_id, component (long), kept: one row of each component of near copies, the one of the smallest id (nulls last, then the first row).

    Texts are near copies where the sets of their shingles have at least this
    Jaccard similarity; chains of near copies are one group.  Fingerprints that
    the byte-position index connects are candidates.  At this similarity most
    pairs differ in more bits than it allows, so for the rest pairs are looked
    for that share one of the `keys` keys of their prefixes, as all of this
    similarity do but for a chance below 3e-6 each; 0 leaves the index alone.
    Of the rest, pairs within bits_at() of each other, by wide fingerprints of the
    distinct shingles, are compared by the sets themselves: that is all but a
    chance of `spreads` standard deviations.  The candidates of the index are
    compared by their sets too.  keys=None and spreads=None leave
    nothing to chance: whole prefixes, of which no fingerprint takes pairs away.
    Word-less and null texts are copies of one another.  row: a column of
    numbers as numbered() gives them, if docs has one.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    most = bits_at(similarity, spreads)
    own = numbered(docs, row := spare_name(docs, "row_no")) if row is None else docs
    own = own.select(F.col(row).alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(2)]
            kinds = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            firsts = pa.array([prefix(x, similarity, keys=keys).view(np.int64) if x.size else None for x in sets], pa.list_(pa.int64()))
            marks = [wide_majority(x) if x.size else None for x in sets]
            fps = pa.array([None if m is None else int.from_bytes(m[:BYTES], "big", signed=True) for m in marks], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds), fps, pa.array(marks, pa.binary()), firsts, pa.array([max(1, -(-x.size // UNIT)) for x in sets], pa.int64())], names=["row_id", "doc_id", "kind", "fp", "mark", "prefix", "weight"])

    marked, path = written(own.select("row_id", "doc_id", "text").mapInArrow(releasing(mark), "row_id long, doc_id long, kind long, fp long, mark binary, prefix array<long>, weight long"), "marks")
    first = marked.where("mark is not null").groupBy("kind").agg(F.min("row_id").alias("row_id"))
    kinds, kinds_path = written(marked.join(first.select("row_id"), "row_id", "left_semi").select("row_id", "kind", "fp", "mark", "prefix", "weight"), "kinds")
    met, met_paths = _met_in_index(kinds.select("kind", "fp"))
    prefixes, frequent, prefix_paths = _prefixes(own, kinds, words, similarity, keys)
    posted = prefixes.select("kind", F.explode("prefix").alias("key"))
    if frequent.isEmpty():
        stars = spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    else:  # no list of a frequent key is gathered: its kinds are one group of candidates
        often, often_path = written(posted.join(frequent, "key"), "often")
        prefix_paths.append(often_path)
        stars = often.join(often.groupBy("key").agg(F.min("kind").alias("first")), "key").select(F.col("first").alias("u"), F.col("kind").alias("v"))
        posted = posted.join(frequent, "key", "left_anti")
    lists = posted.groupBy("key").agg(F.collect_list("kind").alias("kinds")).where("size(kinds) > 1")
    lists, lists_path = written(lists.groupBy(F.array_sort("kinds").alias("kinds")).agg(F.min("key").alias("key")), "lists")
    listed = lists.select(F.col("key").alias("list"), F.explode("kinds").alias("kind")).join(kinds.select("kind", "mark"), "kind").groupBy("list").agg(F.collect_list(F.struct("kind", "mark")).alias("members"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.column(0):
                members = row.values
                ids = members.field("kind").to_numpy(zero_copy_only=False)
                cols = np.frombuffer(b"".join(members.field("mark").to_pylist()), np.uint8).reshape(-1, WIDE_BYTES)
                u, v = _forest(cols, most, 0)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], schema=_LINKS)

    maybe = components(listed.select("members").mapInArrow(releasing(link), LINKS).union(stars).union(met).distinct())
    maybe, maybe_path = written(maybe.join(kinds, F.col("node") == F.col("kind")).select("row_id", "kind", "weight", F.col("component").alias("group")), "maybe")
    found = components(_verified(own, maybe, words, similarity))
    of_kind, of_path = written(found, "of-kind")
    rows, rows_path = written(marked.select("row_id", "doc_id", "kind").join(of_kind, marked["kind"] == of_kind["node"], "left").select("row_id", "doc_id", F.coalesce("component", "kind").alias("component")), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("f")).select("component", F.col("f.row_id").alias("first"))
    out = rows.join(first, "component").select("row_id", "doc_id", "component", (F.col("row_id") == F.col("first")).alias("kept"))
    out, _ = written(out, "near")
    drop_path(spark, path, kinds_path, *met_paths, *prefix_paths, lists_path, maybe_path, of_path, rows_path)
    return out


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of near_copies(), in its own columns, whatever their names.

    Null and word-less texts are copies of one another; texts of fewer words
    than a shingle are one shingle, and very long ones are read whole.  The row
    of the smallest id stays, null ids last, and one of rows that are alike.  An
    empty table stays empty.
    """
    own = numbered(docs, row := spare_name(docs, "row_no"))
    return without_rows(own, near_copies(own, doc_id, text, words, similarity, row).where("not kept"), row)
