"""Merkle manifest of a dataset: one tree a group, and one over the groups' roots, with a proof for each row.

A node is known by its tree, level and index.  A partition turns its leaves
into a sparse forest: whenever all siblings of a run are there, their number
being known from the tree's size, the run closes and becomes its parent, so
that only nodes at the partition's edges stay unresolved.  Forests form a
commutative monoid (union, then closing of runs), so a tree of merges, by
ancestors further and further up, ends in one node a tree whatever the
partitions held.  Proofs go the other way: the closed runs high up are handed
down to blocks of leaves, and a task that holds a block has the rest itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, drop_path, releasing, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
BLOCK_LEVEL = 3
MERGE_LEVELS = 4
EMIT_ROWS = 4096
NODE = "tree string, n long, level int, idx long, digest binary, kids array<binary>"
NODE_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("kids", pa.list_(pa.binary()))])
STEPS = "array<struct<pos:int,kids:array<binary>>>"


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return next(k for k in range(64) if 1 << FAN_BITS * k >= n)


def parent_digest(kids: list[bytes]) -> bytes:
    return hashlib.sha256("".join(map(bytes.hex, kids)).encode()).digest()


class Forest:
    """Unresolved nodes by run.  add() closes each run whose siblings are all there; merging is adding another's nodes, in any order."""

    def __init__(self, keep_level: int) -> None:
        self.open: dict[tuple[str, int, int], dict[int, bytes]] = {}
        self.sizes: dict[str, int] = {}
        self.keep_level = keep_level
        self.out: list[tuple] = []  # tops, and closed runs from keep_level up

    def add(self, tree: str, n: int, level: int, idx: int, digest: bytes) -> None:
        while True:
            here = -(-n // (1 << FAN_BITS * level))  # nodes of the tree at this level
            if here == 1:
                self.out.append((tree, n, level, 0, digest, None))
                return
            run = idx >> FAN_BITS
            got = self.open.setdefault((tree, level, run), {})
            got[idx & (FAN - 1)] = digest
            self.sizes[tree] = n
            if len(got) < min(FAN, here - run * FAN):
                return
            kids = [got[k] for k in range(len(got))]
            del self.open[tree, level, run]
            digest = parent_digest(kids)
            if level >= self.keep_level:
                self.out.append((tree, n, level, run, digest, kids))
            level, idx = level + 1, run

    def unresolved(self) -> Iterator[tuple]:
        for (tree, level, run), got in self.open.items():
            for k, digest in got.items():
                yield tree, self.sizes[tree], level, run * FAN + k, digest, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE_ARROW, strict=True)], schema=NODE_ARROW)


def _merging(keep_level: int):
    """Batches of (tree, n, level, idx, digest) -> the nodes of the merged forest, and the runs that closed (kids not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(keep_level)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                forest.add(*row)
                if len(forest.out) >= EMIT_ROWS:
                    yield _batch(forest.out)
                    forest.out = []
        held = forest.out
        for node in forest.unresolved():
            held.append(node)
            if len(held) >= EMIT_ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return releasing(run)


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """df (tree, further columns) with idx, the row's place in its tree by `order`, and n, the tree's size; written.

    Rows are dealt by range, so a tree of any size is spread; a place is the
    one within the partition and what the tree has in partitions before.
    """
    # A row's number breaks ties, so that rows alike can be split too; which of them comes first changes nothing.
    sort = ["tree", *order, "tie"]
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop("tie")
    placed, path = written(dealt.withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    out = placed.join(offsets, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
    out, _ = written(out.drop("part", "at", "first", "before"), "indexed")
    drop_path(df.sparkSession, path)
    return out


def resolved(leaves: DataFrame, keep_level: int) -> tuple[DataFrame, DataFrame, int]:
    """(tops, closed runs from keep_level up, height of the highest tree) of leaves (tree, n, idx, digest).

    First every task merges what it reads; then unresolved nodes meet by their
    ancestor MERGE_LEVELS higher, again and again, until each tree is one node.
    """
    top = height(leaves.agg(F.max("n")).first()[0] or 1)
    nodes = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest").mapInArrow(_merging(keep_level), NODE)
    nodes, _ = written(nodes, "forest")
    rounds = [nodes]
    is_top = F.expr(f"n <= shiftleft(1L, level * {FAN_BITS})")
    for level in range(MERGE_LEVELS, top + MERGE_LEVELS, MERGE_LEVELS):
        rest = nodes.where(F.col("kids").isNull() & ~is_top).select("tree", "n", "level", "idx", "digest")
        ancestor = F.expr(f"shiftright(idx, greatest(0, {level} - level) * {FAN_BITS})")
        nodes, _ = written(rest.repartition(F.col("tree"), ancestor).mapInArrow(_merging(keep_level), NODE), "forest")
        rounds.append(nodes)
    every = reduce(DataFrame.union, rounds)
    tops = every.where(F.col("kids").isNull() & is_top).select("tree", "n", "level", "digest")
    return tops, every.where(F.col("kids").isNotNull()).select("tree", "level", F.col("idx").alias("run"), "kids"), top


def handed_down(tops: DataFrame, runs: DataFrame, top: int, floor: int) -> DataFrame:
    """(tree, level, idx, steps): for each node at level `floor`, or the top of a lower tree, the runs from there up, lowest first.

    tops: (tree, level, steps), steps being what follows above the tree.  A node
    is handed to 16 below it at most, whatever the tree's size.
    """
    known = tops.select("tree", "level", F.lit(0).cast("long").alias("idx"), "steps")
    done = [known.where(F.col("level") <= floor)]
    above = known.where(F.col("level") > floor)
    for level in range(top - 1, floor - 1, -1):
        here = runs.where(F.col("level") == level).select(F.col("tree").alias("of"), "run", "kids")
        down = above.where(F.col("level") == level + 1).join(here, (F.col("tree") == F.col("of")) & (F.col("idx") == F.col("run"))).select("tree", "run", "kids", "steps", F.posexplode("kids").alias("pos", "kid"))
        down = down.select("tree", F.lit(level).alias("level"), (F.col("run") * FAN + F.col("pos")).alias("idx"), F.concat(F.array(F.struct("pos", "kids")), "steps").cast(STEPS).alias("steps"))
        above = above.where(F.col("level") <= level).union(down)
    return reduce(DataFrame.union, [*done, above.where(F.col("level") == floor)])


def _hex(digests: list[bytes]) -> bytes:
    return b"".join(digests).hex().encode()


def proof_digest(steps: list[tuple[int, list[bytes]]]) -> str:
    """SHA-256 of all siblings, from the lowest level up."""
    return hashlib.sha256(b"".join(_hex(kids[:pos]) + _hex(kids[pos + 1 :]) for pos, kids in steps)).hexdigest()


def folded(leaf: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf leads to by its siblings."""
    for pos, kids in steps:
        leaf = parent_digest([*kids[:pos], leaf, *kids[pos + 1 :]])
    return leaf


def _proofs(root: bytes, siblings: bool):
    """Rows sorted by (tree, block, idx), the block's own steps first (idx -1) -> a row per leaf."""

    def block_rows(steps: list, subroot: bytes, leaves: list[tuple]) -> Iterator[tuple]:
        above = [(s["pos"], s["kids"]) for s in steps]
        n, first = leaves[0][0], leaves[0][1]
        levels = [[leaf for _, _, _, leaf, _ in leaves]]
        while len(levels) <= BLOCK_LEVEL and -(-n // (1 << FAN_BITS * (len(levels) - 1))) > 1:
            low = levels[-1]
            levels.append([parent_digest(low[k : k + FAN]) for k in range(0, len(low), FAN)])
        tail = b"".join(_hex(kids[:pos]) + _hex(kids[pos + 1 :]) for pos, kids in above)
        for k, (_, idx, doc, leaf, bent) in enumerate(leaves):
            if idx != first + k:
                raise ValueError("a leaf is missing")
            own, at = [], k
            for low in levels[:-1]:
                run = at & ~(FAN - 1)
                own.append((at - run, low[run : run + FAN]))
                at >>= FAN_BITS
            proof = hashlib.sha256(b"".join(_hex(kids[:pos]) + _hex(kids[pos + 1 :]) for pos, kids in own) + tail).hexdigest()
            steps = own + above
            reached = folded(bent or leaf, steps)
            yield (doc, leaf.hex(), subroot.hex(), root.hex(), proof, reached.hex(), reached == root, *([[[x.hex() for x in [*kids[:pos], *kids[pos + 1 :]]] for pos, kids in steps]] if siblings else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps, subroot, leaves, out, kind = None, None, None, [], [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [kind, *[pa.string()] * 5, pa.bool_(), *([pa.list_(pa.list_(pa.string()))] if siblings else [])]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["siblings"] if siblings else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            kind = b.schema.field("doc_id").type
            for tree, block, idx, n, doc, digest, bent, above in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if idx < 0:
                    if leaves:
                        out += block_rows(steps, subroot, leaves)
                        if len(out) >= (EMIT_ROWS if not siblings else 256):
                            yield flush()
                            out = []
                    key, steps, subroot, leaves = (tree, block), above, digest, []
                elif (tree, block) != key:
                    raise ValueError("a block has no steps")
                else:
                    leaves.append((n, idx, doc, digest, bent))
        if leaves:
            out += block_rows(steps, subroot, leaves)
        if out:
            yield flush()

    return releasing(run)


def field_text(column: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def build_manifest(leaves: DataFrame, siblings: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and siblings (array by level of arrays) if asked for.

    leaves: (tree string, not null; doc_id of any type that can be ordered;
    digest binary; bent binary or null).  A tree's leaves ascend by doc_id, null
    first, then by digest; trees ascend by name, bytewise.  Where bent is given,
    the root is folded from it in place of the leaf's digest.  No leaves: no rows.
    """
    spark = leaves.sparkSession
    arrow_batches(spark)
    out_type = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<array<string>>" if siblings else "")
    leaves = indexed(leaves.select("tree", "doc_id", "digest", "bent"), ["doc_id", "digest"])
    tops, runs, top = resolved(leaves, BLOCK_LEVEL)
    # The tree over the groups' roots, whose leaves are as many as there are groups.
    of_groups = indexed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"])
    last, group_runs, last_top = resolved(of_groups, 0)
    root = last.select("digest").first()
    if root is None:
        return spark.createDataFrame([], out_type)
    group_paths = handed_down(last.select("tree", "level", F.array().cast(STEPS).alias("steps")), group_runs, last_top, 0)
    subroots = of_groups.join(group_paths.select("idx", "steps"), "idx").select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "steps")
    subroots, _ = written(subroots, "subroots")
    paths = handed_down(tops.join(subroots, "tree").select("tree", "level", "steps"), runs, top, BLOCK_LEVEL)
    block = FAN_BITS * BLOCK_LEVEL
    heads = paths.join(subroots.select("tree", "subroot"), "tree").select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(leaves.schema["doc_id"].dataType).alias("doc_id"), F.col("subroot").alias("digest"), F.lit(None).cast("binary").alias("bent"), "steps")
    rows = leaves.select("tree", F.shiftright("idx", block).alias("block"), "idx", "n", "doc_id", "digest", "bent", F.lit(None).cast(STEPS).alias("steps")).union(heads)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(_proofs(bytes(root[0]), siblings), out_type)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, bent) of documents: one tree a source, null first.  bent: the digest with A-Z of the text in lower case, for ids whose CRC-32 five divides."""
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda t: F.unhex(F.sha2(F.concat(*(field_text(t if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    return written(docs.select(tree.alias("tree"), "doc_id", digest(text).alias("digest"), F.when(tampered, digest(lower)).alias("bent")), "leaves")[0]


def merkle_manifest(docs: DataFrame, siblings: bool = False) -> DataFrame:
    """build_manifest() of documents, a tree a source, tampered copies folded for a fifth of the ids.

    Leaves are SHA-256 digests of the five columns of documents, null as `-`;
    further columns are not read.  Texts of any length and empty ones are
    hashed whole.  A null doc_id comes first in its source and is not tampered
    with; equal ids ascend by leaf, repeated rows are leaves of their own, and a
    null source is a tree of its own before all others.  A text without A-Z
    leads to the root though tampered with.  An empty table gives no rows.
    """
    return build_manifest(document_leaves(docs), siblings)
