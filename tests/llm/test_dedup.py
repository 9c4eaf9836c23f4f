import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, simhash, suffix_dedup


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk, crowd", [(suffix_dedup.CHUNK, suffix_dedup.CROWD), (500, suffix_dedup.CROWD), (500, 2)])
@pytest.mark.parametrize("length", [200, 60])
def test_repeats_match_brute_force(docs, texts, length, chunk, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SETTLE_BYTES", chunk)
    got = {r["doc_id"]: tuple(r)[2:6] for r in suffix_dedup.remove_repeats(docs, length=length).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, length)


def test_partial_matches_survive_colliding_fingerprints(monkeypatch):
    rng = np.random.default_rng(8)
    head = bytes(rng.integers(97, 123, 40, np.uint8))
    sides = [bytes(rng.integers(97, 123, 60, np.uint8)) for _ in range(4)]
    data = [sides[0] + head + sides[1], sides[2] + head + sides[1], sides[0] + head + sides[3], sides[2] + head + sides[3][:30]]
    args = (np.array([5, 5, 5, 6], np.uint64), np.full(4, 60), np.ones(4, bool), data, 80)
    want = {0: (0, 80), 1: (60, 80), 2: (0, 20)}
    for mix in (suffix_dedup._mix, lambda x: x & np.uint64(1)):
        monkeypatch.setattr(suffix_dedup, "_mix", mix)
        who, first, last = suffix_dedup.partial_matches(*args)
        got = dict(zip(who.tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True))
        assert {m: ends for m, ends in got.items() if m in want} == want or mix is not suffix_dedup._mix
    assert {m for m in got} <= {0, 1, 2, 3}


def test_repeats_odd(odd, empty):
    assert suffix_dedup.repeat_report(empty).count() == 0
    rows = suffix_dedup.remove_repeats(odd, texts=True).collect()
    assert len(rows) == 6
    assert {bytes(r["kept"]) for r in rows if r["doc_id"] == 7} == {b"same  text\there", b"same text here"}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd, length=10)


def test_exact_groups(docs, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(norm)
    for k, t in enumerate(norm):
        first.setdefault(t, k)
    got = {r["doc_id"]: r for r in exact_dedup.dedup_report(docs).collect()}
    for k, t in enumerate(norm):
        r = got[k]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (first[t], size[t], first[t] == k, hashlib.sha256(t.encode()).hexdigest())


def test_exact_collisions_are_told_apart(docs):
    weak = lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(t), F.lit(3))), 16, "0"))
    a = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    b = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, digest=weak, memtables=7, fanout=2).collect()}
    assert a == b


def test_memtables_grow_with_the_table(docs, texts, monkeypatch):
    """As many memtables as the rows fill, with levels of two runs, give the same groups."""
    made, flush = [], exact_dedup.MergeIndex.flush
    monkeypatch.setattr(exact_dedup.MergeIndex, "flush", lambda self, records: (made.append(1), flush(self, records)))
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", -(-len(texts) // 6))
    rows = lambda got: {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()}
    many = rows(exact_dedup.exact_groups(docs, fanout=2))
    assert 5 <= len(made) <= 6 and many == rows(exact_dedup.exact_groups(docs, memtables=1))


@pytest.mark.parametrize("fanout", [2, 4])
def test_merge_index(spark, fanout):
    """Hits are found as memtables come, by filters and runs; compaction keeps the smallest identifier."""
    rng = np.random.default_rng(2)
    index, seen = exact_dedup.MergeIndex(spark, fanout), defaultdict(list)
    for k in range(5):
        rows = [(bytes([int(d)]) * 4, (False, int(rng.integers(1000)), 10 * k + j)) for j, d in enumerate(rng.integers(0, 60, 12))]
        for d, keeper in rows:
            seen[d].append(keeper)
        index.flush(spark.createDataFrame([(bytearray(d), keeper, 1) for d, keeper in rows], exact_dedup.RUN))
        assert {bytes(r["digest"]) for r in index.hits().collect()} == {d for d, ks in seen.items() if len(ks) > 1}
    assert all(len(level) < fanout for level in index.levels)
    assert {bytes(r["digest"]): (tuple(r["keeper"]), r["n"]) for r in index.records().collect()} == {d: (min(ks), len(ks)) for d, ks in seen.items()}
    index.drop()
    assert index.hits().count() == 0


def test_exact_odd(odd, empty):
    assert exact_dedup.dedup_report(empty).count() == 0
    rows = exact_dedup.exact_groups(odd).collect()
    same = [r for r in rows if r["group_size"] == 4]
    assert len(same) == 4 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {7}
    assert exact_dedup.drop_exact_copies(odd).count() == 3


def brute_fingerprint(text, words):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_simhash_components(docs, texts, distance):
    fps = [brute_fingerprint(t, 3) for t in texts]
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in simhash.near_components(docs, distance=distance).collect()}
    for k, f in enumerate(fps):
        assert got[k]["fingerprint"] == f"{f:016x}"
        assert got[k]["component_id"] == root(k)


def test_simhash_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 5)
    rng = np.random.default_rng(1)
    fps = {int(rng.integers(1 << 62)) ^ sum(1 << int(b) for b in rng.integers(0, 63, 2)) for _ in range(50)}
    centre = int(rng.integers(1 << 62))
    fps |= {centre ^ sum({1 << int(b) for b in rng.integers(0, 63, 4)}) for _ in range(150)}
    fps = sorted(fps)
    links = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want, have = defaultdict(set), defaultdict(set)
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 3:
                want[a].add(b)
    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        have[a].add(b)
        have[b].add(a)

    def parts(g):
        seen, out = set(), set()
        for f in fps:
            if f not in seen:
                stack, part = [f], {f}
                while stack:
                    for y in g[stack.pop()] - part:
                        part.add(y)
                        stack.append(y)
                seen |= part
                out.add(frozenset(part))
        return out

    assert parts(want) == parts(have)


def test_near_copies(spark, tmp_path, empty, odd):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(80):
        w = [vocab[i] for i in rng.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(w)))
        if k % 4 == 0:
            for _ in range(2):
                w[int(rng.integers(300))] = "new"
            rows.append((2 * k + 1, " ".join(w)))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()}
    assert kept == {2 * k for k in range(80)}
    assert simhash.near_copies(empty).count() == 0 and simhash.near_report(empty).count() == 0
    assert sum(r["kept"] for r in simhash.near_copies(odd).collect()) == 3


def near_rows(texts, spark, path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    return {r["doc_id"]: r for r in simhash.near_copies(spark.read.parquet(path)).collect()}


def shingle_set(t):
    w = t.split()
    return set(zip(*(w[i:] for i in range(5)), strict=False))


def test_near_copies_spare_what_is_not_similar(spark, tmp_path):
    rng = np.random.default_rng(3)
    new = lambda n: [f"w{i}" for i in rng.integers(0, 50000, n)]
    line, texts = new(25), []
    for _ in range(12):  # different texts with one repeated line
        texts.append(" ".join(new(200) + line * 20))
    for _ in range(30):  # pairs a little under the similarity
        w = new(300)
        texts.append(" ".join(w))
        for at in range(20, 200, 20):
            w[at] = "changed"
        texts.append(" ".join(w))
    a, b = shingle_set(texts[12]), shingle_set(texts[13])
    assert 0.7 < len(a & b) / len(a | b) < 0.8
    got = near_rows(texts, spark, str(tmp_path / "d"))
    assert all(r["kept"] for r in got.values())


@pytest.mark.parametrize("long_list, group", [(simhash.LONG_LIST, simhash.GROUP), (8, simhash.GROUP), (8, 1)])
def test_near_copies_just_over_the_similarity(spark, tmp_path, monkeypatch, long_list, group):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(4)
    head, texts = [f"h{k}" for k in range(30)], []
    for k in range(120):  # pairs of two, no chains; all texts share their head
        n = int(rng.integers(60, 400))
        w = head + [f"w{i}" for i in rng.integers(0, 50000, n)]
        other, at = list(w), n
        while True:
            changed = [*other[:at], "changed", *other[at + 1 :]]
            a, b = shingle_set(" ".join(w)), shingle_set(" ".join(changed))
            if len(a & b) / len(a | b) < 0.8 or at < 40:
                break
            other, at = changed, at - 7
        texts += [" ".join(w), " ".join(other)]
    got = near_rows(texts, spark, str(tmp_path / "d"))
    assert {k for k, r in got.items() if r["kept"]} == set(range(0, 240, 2))


def test_index_proposes_near_copies(spark, tmp_path):
    """Without any prefix key, the byte-position index of fingerprints finds close copies, and what is not similar stays apart."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(20):
        w = [f"w{i}" for i in rng.integers(0, 50000, 1500)]
        texts += [" ".join(w), " ".join([*w[:700], "changed", *w[701:]])]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    of = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.read.parquet(path), keys=0).collect()}
    together = sum(of[k] == of[k + 1] for k in range(0, 40, 2))
    assert together >= 12 and len(set(of.values())) == 40 - together


def test_large_groups_are_spread(spark, tmp_path, monkeypatch):
    """Chains and clusters of one candidate group, held against a few guides at a time."""
    monkeypatch.setattr(simhash, "GUIDES", 2)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(9)
    texts, label = [], []
    for cluster, n in enumerate((30, 12, 9, 1, 1)):
        w = [f"c{cluster}w{i}" for i in rng.integers(0, 50000, 200)]
        for k in range(n):  # each a little changed from the one before: a chain
            w = [*w]
            w[int(rng.integers(200))] = f"new{cluster}.{k}"
            texts.append(" ".join(w))
            label.append(cluster)
    path = str(tmp_path / "d")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_id long, text string").repartition(3).write.parquet(path)
    own = spark.read.parquet(path)
    large = own.select("row_id", F.col("row_id").alias("kind"), F.lit(0).cast("long").alias("group"), F.lit(1).cast("long").alias("weight"), F.lit(len(texts)).cast("long").alias("size"))
    sets = [shingle_set(t) for t in texts]
    links = [(r["u"], r["v"]) for r in simhash._spread(own, large, 5, 0.8).collect()]
    assert all(len(sets[u] & sets[v]) / len(sets[u] | sets[v]) >= 0.8 for u, v in links)

    def parts(pairs):
        of = list(range(len(texts)))

        def root(x):
            while of[x] != x:
                x = of[x]
            return x

        for u, v in pairs:
            a, b = root(u), root(v)
            of[max(a, b)] = min(a, b)
        return [root(k) for k in range(len(texts))]

    want = parts([(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8])
    assert parts(links) == want and len(set(want)) >= 5


def test_prefixes_meet():
    rng = np.random.default_rng(5)
    for n in (1, 4, 5, 10, 15, 37, 300):
        for _ in range(50):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if np.intersect1d(a, b).size / np.union1d(a, b).size >= 0.8:
                hot = np.unique(rng.choice(a, n // 2)) if n < 100 else np.unique(rng.choice(a, int(0.9 * n), replace=False))
                for keys in (simhash.KEYS, None):
                    assert np.intersect1d(*(simhash.prefix(x, 0.8, np.isin(x, hot), keys) for x in (a, b))).size
                    assert np.intersect1d(*(simhash.prefix(x, 0.8, keys=keys) for x in (a, b))).size


def test_hot_bits(spark):
    """Every key put in the set is found again; a set that is full says yes to more, never no."""
    rng = np.random.default_rng(8)
    keys = rng.integers(-(1 << 63), 1 << 63, 500)
    words = simhash._words_of(simhash.hot_bits(spark.createDataFrame([(int(k),) for k in keys], "key long")))
    assert simhash.hot_among(keys.view(np.uint64), words).all()
    assert simhash.hot_among(rng.integers(0, 1 << 62, 10_000).astype(np.uint64), words).mean() < 0.01
    assert not simhash._words_of(simhash.hot_bits(spark.createDataFrame([], "key long"))).any()


def test_tallied():
    """Shingles are counted within a task: a row for each that is held often, none for those of single texts, and few are kept at once."""
    rng = np.random.default_rng(14)
    head = [f"h{k}" for k in range(30)]
    texts = [" ".join([*head, *(f"w{i}" for i in rng.integers(0, 1 << 40, 200))]) for _ in range(60)]
    batches = [pa.RecordBatch.from_pydict({"row_id": list(range(k, k + 20)), "text": texts[k : k + 20]}) for k in (0, 20, 40)]
    want = dict.fromkeys(simhash.shingle_hashes(" ".join(head), 5).view(np.int64).tolist(), 60)
    for most in (simhash.TALLY, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "TALLY", most)
            (out,) = simhash.tallied(5, 0.5)(iter(batches))
        assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)) == want and out.num_rows == 26


@pytest.mark.parametrize("hot_words", [simhash.HOT_WORDS, 1])
def test_default_finds_what_whole_prefixes_find(spark, tmp_path, monkeypatch, hot_words):
    """near_copies() against whole prefixes without fingerprints, and against all pairs; a bit set of one word, in which all is hot, changes nothing."""
    monkeypatch.setattr(simhash, "LONG_LIST", 20)
    monkeypatch.setattr(simhash, "HOT_WORDS", hot_words)
    rng = np.random.default_rng(12)
    head, texts = [f"h{k}" for k in range(25)], []
    for k in range(150):  # each pair's similarity falls near 0.8, on both sides; all share a passage, some a longer one
        w = head[: 25 if k % 3 else 12] + [f"w{i}" for i in rng.integers(0, 50000, int(rng.integers(40, 250)))]
        other = list(w)
        for at in range(30, 30 + 5 * int(rng.integers(1, 2 + len(w) // 45)), 5):
            other[min(at, len(w) - 1)] = "changed"
        texts += [" ".join(w), " ".join(other)]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    groups = lambda got: sorted(sorted(x) for x in _members(got).values())
    default = groups(simhash.near_copies(docs).collect())
    assert default == groups(simhash.near_copies(docs, keys=None, spreads=None).collect())
    sets = [shingle_set(t) for t in texts]
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if of[i] != of[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    want: dict[int, list[int]] = {}
    for k, x in enumerate(of):
        want.setdefault(x, []).append(k)
    assert default == sorted(want.values()) and 170 < len(want) < 280


def _members(rows):
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["component"], []).append(r["doc_id"])
    return out
