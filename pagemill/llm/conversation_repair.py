"""Repair of conversations' structure by a dynamic programme that a prefix trie shares.

A conversation's rows become a signature, a letter for each row's role and
fault, written from the last row to the first.  The distinct signatures, sorted,
are a prefix trie walked depth first: a stack holds the programme's layers along
the current path, a signature keeps those of the prefix that it shares with the
one before, and adds its own.  A layer holds, for each state of the pattern
`(s?(ua)+)?`, the least cost of what follows; at a signature's end the cheapest
edits are read off its layers, from the first row on.  Copies of a signature are
solved once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm._common import arrow_batches, releasing, written

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
FAR = 1 << 40
#: States: nothing yet, after s, after u, after a.  Where a kept, reroled or inserted row of the role leads; what may be inserted.
START, SYSTEM, USER, ASSISTANT = range(4)
TURN = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
NEXT = {(s, role): t for s, role, t in TURN}
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
EMIT_ROWS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _inserted(base: list[int]) -> list[int]:
    """Least costs where rows may be inserted first."""
    user, assistant = min(base[USER], INSERT + base[ASSISTANT]), min(base[ASSISTANT], INSERT + base[USER])
    return [min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, assistant]


def first_layer() -> list[int]:
    """Costs after the last row: the pattern may end before its first turn or after an assistant's."""
    return _inserted([0, FAR, FAR, 0])


def options(letter: str) -> tuple[bool, str, int]:
    """(may only be deleted, role, further cost if it stays) of a signature's letter: x; s, u, a or o, in capitals where the row is truncated."""
    return letter == "x", letter.lower(), CUT if letter.isupper() else 0


def next_layer(letter: str, after: list[int]) -> list[int]:
    """The layer before a row, by the one after it."""
    doomed, role, more = options(letter)
    base = [DELETE + c for c in after]
    if not doomed:
        for state, to in MADE.items():
            base[state] = min(base[state], REROLE + more + after[to])
            if (state, role) in NEXT:
                base[state] = min(base[state], KEEP + more + after[NEXT[state, role]])
    return _inserted(base)


def cheapest(signature: str, layers: list[list[int]]) -> str:
    """The ASCII-least of the cheapest edits.  signature: last row first; layers[k]: with k rows to come.  Each letter leads to one state, so the least letter that stays cheapest is the right one."""
    state, k, out = START, len(signature), []
    while True:
        cost = layers[k][state]
        if k == 0 and cost == 0:
            return "".join(out)
        if k:
            doomed, role, more = options(signature[k - 1])
            after = layers[k - 1]
            if DELETE + after[state] == cost:
                out.append("D")
                k -= 1
                continue
        if INSERT + layers[k][MADE[state]] == cost:
            out.append("I")
            state = MADE[state]
        elif (to := NEXT.get((state, role))) is not None and KEEP + more + after[to] == cost:
            out.append("K")
            state, k = to, k - 1
        else:
            out.append("R")
            state, k = MADE[state], k - 1


class Trie:
    """Depth-first walk over sorted signatures: layers of the current path, made once for each shared prefix."""

    def __init__(self) -> None:
        self.path, self.layers, self.made = "", [first_layer()], 0

    def solve(self, signature: str) -> tuple[int, str]:
        n, most = 0, min(len(signature), len(self.path))
        if signature[:most] == self.path[:most]:
            n = most
        else:
            low, high = 0, most  # the first place that differs lies in (low, high]
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if signature[:mid] == self.path[:mid] else (low, mid)
            n = low
        del self.layers[n + 1 :]
        for letter in signature[n:]:
            self.layers.append(next_layer(letter, self.layers[-1]))
        self.made += len(signature) - n
        self.path = signature
        return self.layers[-1][START], cheapest(signature, self.layers)


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature (string, last row first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            got = [trie.solve(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], names=["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(releasing(run), "signature string, cost long, audit string")


BLANKS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage by CRC-32 of `conv_id:turn`, nulls as one space; dropped ones with gone, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """rows with mark (digest of the text), nth (of its role and text) and fault: blank, duplicate, truncated, none; the first that applies.  Texts are left behind."""
    light = rows.select("conv_id", "turn", "role", "gone", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"), F.rtrim("text", F.lit(BLANKS)).alias("bare"))
    light = light.select("conv_id", "turn", "role", "gone", "mark", (F.col("bare") == "").alias("blank"), (~F.right("bare", F.lit(1)).isin(".", "!", "?")).alias("cut"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "mark", "gone").orderBy("turn"))
    fault = F.when(F.col("blank"), "blank").when(F.col("nth") > 1, "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    return light.withColumn("nth", nth).withColumn("fault", fault).drop("blank", "cut")


def _summaries(id_type: pa.DataType) -> Callable:
    """Rows in the order of (conv_id, turn, role, mark) -> a row per conversation: its signature, gaps, faults and illegal pairs.  Holds a letter a row."""
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, any_rows = [], None, False
        letters, count, turns = [], {}, None

        def close() -> None:
            gaps = 0 if turns is None else turns[1] - turns[0] + 1 - turns[2]
            out.append((now, "".join(reversed(letters)), gaps, *(count.get(k, 0) for k in names[3:])))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [id_type, pa.string(), *[pa.int64()] * 5], strict=True)], names=names)

        before = ""
        for b in batches:
            for conv, turn, role, gone, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not any_rows or conv != now:
                    if any_rows:
                        close()
                        if len(out) >= EMIT_ROWS:
                            yield flush()
                            out = []
                    now, any_rows, letters, count, turns, before = conv, True, [], {}, None, None
                if gone:
                    continue
                if turn is not None:
                    turns = [turn, turn, 1] if turns is None else [turns[0], turn, turns[2] + (turn != turns[1])]
                count[fault] = count.get(fault, 0) + 1
                first = role[:1]
                if before is not None and before + first not in ("su", "ua", "au"):
                    count["illegal"] = count.get("illegal", 0) + 1
                before = first
                kind = first if first in ("s", "u", "a") else "o"
                letters.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind)
        if any_rows:
            close()
            yield flush()

    return releasing(run)


def _repaired(id_type: pa.DataType, texts: bool) -> Callable:
    """A conversation's answer first, then its rows in order -> the answer and the digest of the repaired rows; or, with texts, the repaired rows."""
    roles = {START: "", SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, audit, at, state, digest, n = [], None, "", 0, START, None, 0

        def put(role: str, text: str) -> None:
            nonlocal n
            if texts:
                out.append((head[0], n, role, text))
            else:
                digest.update(f"{chr(10) * (n > 0)}{role}:{text}".encode())
            n += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = MADE[state], at + 1
                put(roles[state], "")

        def flush() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string()] if texts else [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv_id", "position", "role", "text"] if texts else ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def close() -> None:
            insert()
            if not texts:
                out.append((*head, audit, digest.hexdigest()))

        for b in batches:
            for conv, is_row, role, text, *answer in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_row:
                    if head is not None:
                        close()
                        if len(out) >= EMIT_ROWS:
                            yield flush()
                            out = []
                    *head, audit = conv, *answer
                    at, state, digest, n = 0, START, hashlib.sha256(), 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = NEXT[state, role[:1]]
                    put(role, text)
                elif edit == "R":
                    state = MADE[state]
                    put(roles[state], text)
        if head is not None:
            close()
        if out:
            yield flush()

    return releasing(run)


def _answers(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    arrow_batches(spark)
    order = ["conv_id", "turn", "role", "mark", "nth"]  # of equal rows the first comes before its duplicates
    faults = _faults(rows).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "gone", "fault")
    summary = faults.mapInArrow(_summaries(_arrow(faults)), f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")
    summary, _ = written(summary, "signatures")
    return summary.join(solve_signatures(summary), "signature").drop("signature")


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def _edited(conversations: DataFrame, damage: bool, texts: bool) -> DataFrame:
    rows = damaged(conversations) if damage else conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda c: F.lit(None).cast(c)
    answers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    heads = _answers(rows).select("conv_id", F.lit(False).alias("is_row"), none(rows.schema["turn"].dataType).alias("turn"), none("string").alias("role"), none("binary").alias("mark"), none("string").alias("text"), *answers, "audit")
    body = rows.where("not gone").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"), "text", *(none("long").alias(c) for c in answers), none("string").alias("audit"))
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "mark").select("conv_id", "is_row", "role", "text", *answers, "audit")
    schema = f"conv_id {kind}, position long, role string, text string" if texts else f"conv_id {kind}, {', '.join(c + ' long' for c in answers)}, audit string, repaired_sha256 string"
    return both.mapInArrow(_repaired(_arrow(rows), texts), schema)


def repair_report(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (damaged()) unless damage is false.  They stand in
    the order of turn, null first, then of role and the text's digest.  Null
    role and text are one space: such a row is blank, its role none of the
    pattern's, and so is an empty role.  A null conv_id is a conversation like
    any other, and ids keep their type.  Very long texts only move; a
    conversation of any length is streamed, with a letter a row in memory.
    Conversations without rows after damage have zeros, no audit and the digest
    of an empty string.  Other columns are not read; an empty table gives no rows.
    """
    return _edited(conversations, damage, False)


def repaired_rows(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired rows themselves (conv_id, position, role, text), by the rules of repair_report(); inserted rows have an empty text."""
    return _edited(conversations, damage, True)
