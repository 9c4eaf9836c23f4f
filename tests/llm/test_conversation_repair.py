"""Conversation repair against a search through all edits."""

import hashlib
import random
import re
import zlib

from pagemill.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, mark long, fault string, audit string, kind long"


def solve(rows):
    """(cost, audit, repaired rows) by trying all edits up to a cost, from zero on."""
    limit = 0
    while True:
        found = []

        def walk(i, cost, edits, roles, out, limit=limit, found=found):
            if cost > limit or not re.fullmatch("s?(ua)*u?", "".join(roles)):
                return
            if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(roles)):
                found.append((edits, out))
            if i < len(rows):
                role, text, fault = rows[i]
                more = fault == "truncated"
                walk(i + 1, cost + 3, edits + "D", roles, out)
                if fault not in ("blank", "duplicate"):
                    if role[:1]:
                        walk(i + 1, cost + more, edits + "K", [*roles, role[:1]], [*out, (role, text)])
                    for r in ("user", "assistant"):
                        walk(i + 1, cost + 2 + more, edits + "R", [*roles, r[0]], [*out, (r, text)])
            for r in ("user", "assistant"):
                walk(i, cost + 2, edits + "I", [*roles, r[0]], [*out, (r, "")])

        walk(0, 0, "", [], [])
        if found:
            return limit, *min(found)
        limit += 1


def brute(table, damage=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit, kept = solve(faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:], strict=False))
        counts = [sum(f[2] == k for f in faults) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest())
    return out


def make(seed=5, n=120):
    rng = random.Random(seed)
    table = []
    for conv in [None, *range(n)]:
        for t in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            table.append((conv, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "ok", "  ", "what? ", "Done!\n", "é.", None, "a b"])))
    return table


def frame(spark, table):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in table], SCHEMA).repartition(6)


def by_conv(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_against_all_edits(spark):
    table = make()
    for damage in (True, False):
        assert by_conv(repair.repair_report(frame(spark, table), damage)) == brute(table, damage)


def test_given_conversations(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert by_conv(repair.repair_report(rows)) == brute([tuple(r) for r in rows.collect()])


def test_repaired_rows(spark):
    """The rows behind the digest."""
    table = make(8, 40)
    got = {}
    for r in sorted(repair.repaired_rows(frame(spark, table)).collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = brute(table, damage=False)
    assert all(hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == w[-1] for conv, w in want.items())


def test_string_ids_long_texts_and_empty_tables(spark):
    long = "word " * 300_000 + "."
    rows = [("c-1", 0, "user", long), ("c-1", 1, "assistant", long), ("c-2", 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = by_conv(repair.repair_report(df, damage=False))
    assert got["c-1"][:7] == (0, 0, 0, 0, 0, 0, "KK") and got["c-2"][:7] == (0, 1, 0, 0, 0, 3, "D")
    assert got["c-1"][7] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert repair.repair_report(df.limit(0)).collect() == []


def test_long_conversation(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Text {t}.") for t in range(30_000)]
    got = by_conv(repair.repair_report(frame(spark, rows), damage=False))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 30_000)


def test_trie_shares_prefixes():
    """Layers are made once for each distinct prefix of the signatures, and answers don't depend on what came before."""
    rng = random.Random(2)
    signatures = sorted({"".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(7))) for _ in range(400)})
    trie = repair.Trie()
    got = [trie.solve(s) for s in signatures]
    assert trie.made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert got == [repair.Trie().solve(s) for s in signatures]
    named = {"x": ("user", "", "blank"), **{c: (r, f"{r}.", "none") for c, r in (("s", "system"), ("u", "user"), ("a", "assistant"), ("o", "tool"))}}
    named |= {c.upper(): (r, r, "truncated") for c, (r, _, f) in list(named.items()) if f == "none"}
    for s, (cost, audit) in zip(signatures[::9], got[::9], strict=True):
        assert (cost, audit) == solve([named[c] for c in reversed(s)])[:2]
