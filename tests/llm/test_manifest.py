"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest

from pagemill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, idx long, digest string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 16 * 16
        out.append((at - first, nodes[first : first + 16]))
        at //= 16
    return out


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: h(map(field, [*r[:4], text]))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    above = levels_of([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps, at = steps_of(trees[s], i) + steps_of(above, j), leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            for pos, kids in steps:
                at = h([*kids[:pos], at, *kids[pos + 1 :]])
            proof = h(x for pos, kids in steps for k, x in enumerate(kids) if k != pos)
            out.append((r[0], leaf, trees[s][-1][0], above[-1][0], proof, at, at == above[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SCHEMA).repartition(5)


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_groups_nulls_ties_and_repeats(spark):
    rows = [(k if k % 50 else None, ["a", "b", None, "", "é", "z"][0 if k % 7 else k % 6], None, k, f"Text {k // 3}" if k % 11 else None) for k in range(700)]
    rows += [(5, "a", None, 1, "Same")] * 40 + [(k, f"s{k}", "x", 0, "") for k in range(300)] + [(9, "long", "", 1, "Word " * 300_000)]
    same(merkle.merkle_manifest(frame(spark, rows)).collect(), brute(rows))


@pytest.mark.parametrize("block, merge", [(3, 4), (1, 1), (2, 1)])
def test_high_trees(spark, monkeypatch, block, merge):
    """Trees of up to five levels, whose proofs are handed down over several of them."""
    monkeypatch.setattr(merkle, "BLOCK_LEVEL", block)
    monkeypatch.setattr(merkle, "MERGE_LEVELS", merge)
    monkeypatch.setattr(merkle, "EMIT_ROWS", 100)
    rows = [(k, "a" if k < 4500 else f"t{k % 3}", "en", 1, f"Text {k}") for k in range(5200)]
    same(merkle.merkle_manifest(frame(spark, rows)).collect(), brute(rows))


def test_five_levels(spark):
    rows = [(k, "a", "en", 1, f"T{k}") for k in range(70_000)]
    got = merkle.merkle_manifest(frame(spark, rows)).collect()
    assert merkle.height(70_000) == 5
    same(got, brute(rows))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes(spark, n):
    rows = [(k, "a", "en", 1, f"T{k}") for k in range(n)]
    got = merkle.merkle_manifest(frame(spark, rows), siblings=True).collect()
    same([tuple(r)[:7] for r in got], brute(rows))
    for r in got:
        assert r["proof_sha256"] == h(x for level in r["siblings"] for x in level)


def test_empty(spark, empty):
    assert merkle.merkle_manifest(empty).collect() == []


def test_forests_merge_in_any_order():
    """Union of forests is associative and commutative: however leaves are dealt and merged, the same top comes out, and every run closes once."""
    rng = random.Random(1)
    for n in (1, 5, 16, 40, 257, 600):
        leaves = [("t", n, 0, k, bytes([k % 256]) * 32) for k in range(n)]
        want = None
        for _ in range(4):
            rng.shuffle(leaves)
            cuts = sorted(rng.choices(range(n + 1), k=4))
            forests, done = [], []
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                forests.append(f := merkle.Forest(0))
                for node in leaves[a:b]:
                    f.add(*node)
            while len(forests) > 1:
                one, two = forests.pop(rng.randrange(len(forests))), forests.pop()
                for node in two.unresolved():
                    one.add(*node[:5])
                one.out += two.out
                forests.append(one)
            done = sorted(forests[0].out, key=str)
            assert not forests[0].open and sum(x[5] is None for x in done) == 1
            want = want or done
            assert done == want
