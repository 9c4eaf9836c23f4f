import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import decontam, langid, lattice_lm, license_scan, packing, pii_crf
from pagemill.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_decontamination(spark, docs, texts, empty, odd):
    long = words(max((t for t in texts if t), key=lambda t: len(words(t))))
    items = [(1, " ".join(long[20:45])), (2, "was Heon!"), (3, " ".join(long[5:10] + ["nowhere"] * 9)), (4, None), (5, "..."), (11, " ".join(long[30:41])), (12, "was heon"), (13, "er")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination_report(docs, bench, slop=2).collect()}
    for k, t in enumerate(texts):
        w = words(t)
        hit, found = [False] * len(w), set()
        for item, text in items:
            q = words(text)
            for x in [q[i : i + 10] for i in range(max(1, len(q) - 9))] if q else []:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        hit[i : i + len(x)] = [True] * len(x)
                        found.add(str(item))
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), sum(hit), len(found), any(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["n_near_items"] >= len(found)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(odd, bench.where("item_id < 0")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(odd, bench).count() == 6


def test_decontamination_null_ids(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "red blue green"), (1, "red blue green"), (None, "one two"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(path)
    bench = spark.createDataFrame([(None, "red blue"), (7, "blue green"), (8, "blue green"), (8, "red"), (None, "two")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.contamination_report(spark.read.parquet(path), bench).collect()), key=str)
    assert got == sorted([(1, 3, 3, 2), (1, 3, 3, 2), (None, 2, 1, 0), (3, 0, 0, 0)], key=str)


def test_decontamination_segments_and_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, f"was heon reed {w}") for k, w in enumerate(["the", "on", "er", "tion"])] + [(9, "over the")], "item_id long, text string")
    want = sorted(decontam.contamination_report(docs, bench).collect())
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 300)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 10)
    monkeypatch.setattr(decontam, "BLOCKS", 2)
    assert sorted(decontam.contamination_report(docs, bench).collect()) == want


def test_proximity(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "red x blue y green"), (2, "green red blue"), (3, "red a a a a a a blue green"), (4, "red blue"), (5, "red blue green")], "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontam.contamination_report(spark.read.parquet(path), spark.createDataFrame([(1, "red blue green")], "item_id long, text string"), slop=2).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (1, 1)}


def test_licenses(spark, tmp_path, empty, odd):
    mit = next(t for i, k, t in license_scan.KNOWN if i == "MIT" and k == "text")
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper()), (2, "some prose\nThis work is Licenced under the GNU GPL, v 3\nmore"), (3, "no such thing"), (4, None), (5, "  licensed UNDER the MIT license!! ")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"], r["n_license_lines"]) for r in license_scan.license_report(spark.read.parquet(path)).collect()}
    for i, _, t in license_scan.known_texts():
        assert re.search(license_scan.HINT, t.replace("\n", " ")), t
    assert got == {1: ("MIT", "", 0), 2: (None, "GPL-3.0", 1), 3: (None, "", 0), 4: (None, "", 0), 5: ("MIT", "MIT", 1)}
    assert license_scan.license_report(empty).count() == 0 and license_scan.license_report(odd).count() == 6
    assert license_scan.scan_licenses(odd, known=[]).where("license_id is not null").count() == 0


COMMON = "/usr/share/common-licenses"


def test_whole_licenses(spark, tmp_path):
    import os

    texts = {r: t for r, k, t in license_scan.KNOWN if k == "text"}
    rows = [(k, f"  {license_scan.HEADINGS[i][0].upper()}\n\nCopyright (c) 2001, 2020 Some One\n\n" + texts[i].replace("\n", "\n\n").replace(". ", ".\n")) for k, i in enumerate(sorted(license_scan.HEADINGS))]
    want = dict(enumerate(sorted(license_scan.HEADINGS)))
    for name, i in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{COMMON}/{name}"):
            with open(f"{COMMON}/{name}", encoding="utf-8") as f:
                rows.append((len(rows), f.read()))
            want[len(rows) - 1] = i
    rows.append((len(rows), "prose\n" + texts["ISC"].replace("\n", " ") + "\nprose"))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = license_scan.license_report(spark.read.parquet(path)).collect()
    assert {r["doc_id"]: r["license_id"] for r in got if r["license_id"]} == want
    assert {r["line_licenses"] for r in got if r["doc_id"] == len(rows) - 1} == {"ISC"}


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    return [(k, *m.span()) for k, p, ok in BASE for m in p.finditer(t or "") if ok(m.group())]


def test_base_spans():
    rng = np.random.default_rng(5)
    parts = ["a@b.co", "x.y%z@h-1.org_c@d.e", "@", "a@", "@b.c", "1.2.3.4", "999.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (974) 555-3436", "+1", "+12 3", " ", " ", "\n", "é", "12", "-", "."]
    for _ in range(3000):
        t = "".join(parts[i] for i in rng.integers(0, len(parts), 8))
        assert pii_crf.base_spans(t) == brute_spans(t), t


def test_personal_data(spark, tmp_path, empty, odd):
    t = "mail und.34@mail7.example.com or joe.12 [at] mail.example.org, call (974) 555-3436 or +1 (974) 555-3436; card 4111.1111.1111.1111 not 4111111111111112, 2020-01-02, v1.2.3"
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, t), (2, None), (3, "plain prose, 42 pages")], "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r for r in pii_crf.find_personal_data(spark.read.parquet(path)).collect()}
    spans = [(k, t[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got[1]["spans"].split(","))]
    assert spans == [("email", "und.34@mail7.example.com"), ("email", "joe.12 [at] mail.example.org"), ("card", "4111.1111.1111.1111"), ("phone", "(974) 555-3436"), ("phone", "+1 (974) 555-3436")]
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t)).encode()).hexdigest()
    assert got[2]["spans"] == got[3]["spans"] == ""
    assert pii_crf.find_personal_data(empty).count() == 0 and pii_crf.find_personal_data(odd).count() == 6


@pytest.mark.parametrize("syllables", [("th", "er", "on", "an"), ("ka", "mo", "ri", "tu", "sel", "bro", "qui")])
def test_field_adds_what_the_patterns_miss(syllables):
    field, held = pii_crf.train(), pii_crf.labelled_table(12, syllables, 30)
    missed = found = wrong = 0
    for w, labels in held:
        text = " ".join(w)
        start = len(w[0]) + 1
        want = {(labels[0][2:], start, start + len(" ".join(w[1:-1])))} if labels[0] != "O" else set()
        ((base, every),) = pii_crf.all_spans([text], field)
        added = set(every) - set(base)
        open_ = {x for x in want if not any(a < x[2] and x[1] < b for _, a, b in base)}
        missed += len(open_ - added)
        found += len(open_ & added)
        wrong += len(added - want)
    assert found > 200 and missed <= 0.05 * found and wrong <= 0.02 * found


def test_long_words_and_written_out_addresses():
    field = pii_crf.train()
    texts = ["a1" * 600_000, "[at] " * 50_000, "x " * 500_000 + "jo.th at mail dot example dot org", "at", "a at b"]
    got = pii_crf.all_spans(texts, field)
    assert [e for _, e in got] == [[], [], [("email", 1_000_000, 1_000_033)], [], []]


def test_viterbi_is_the_best_path():
    field = pii_crf.train()
    rng = np.random.default_rng(0)
    for n in (1, 2, 3):
        x = rng.normal(0, 3, (n, len(pii_crf.LABELS)))
        best = max(np.ndindex(*[len(pii_crf.LABELS)] * n), key=lambda p: field.step[0, p[0]] + sum(x[t, p[t]] for t in range(n)) + sum(field.step[p[t - 1], p[t]] for t in range(1, n)) + field.step[p[-1], 0])
        assert field.decode([x]) == [list(best)]


def test_packing_round_trip(docs, texts, empty, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for limits in ({}, {"tokens": 64, "segments": 3, "loss": 40, "look_ahead": 5}):
        rows = packing.pack_documents(docs, path, **limits).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        for k, t in enumerate(texts):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            at = 0
            for r in sorted(by_doc[k], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
            assert at == len(ids)
        for pieces in by_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= limits.get("tokens", 2048) and len(pieces) <= limits.get("segments", packing.SEGMENTS) and at <= limits.get("loss", 2048)
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(odd, path).where("doc_id is null").count() == 2


def test_pack_examples(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{k}", int(n), int(rng.integers(0, n + 1))) for k, n in enumerate(rng.integers(0, 200, 300))] + [(None, None, None), ("k1", 5, 5)]
    got = packing.pack_examples(spark.createDataFrame(rows, "key string, n long, l long"), "key", "n", "l", tokens=256, segments=4, loss=150).collect() if all(r[2] is None or r[2] <= 150 for r in rows) else None
    if got is None:
        rows = [(k, n, None if b is None else min(b, 150)) for k, n, b in rows]
        got = packing.pack_examples(spark.createDataFrame(rows, "key string, n long, l long"), "key", "n", "l", tokens=256, segments=4, loss=150).collect()
    assert Counter((r["key"], r["tokens"], r["loss"]) for r in got) == Counter((k, n or 0, b or 0) for k, n, b in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append(r)
    for s in seqs.values():
        assert sum(r["tokens"] for r in s) <= 256 and len(s) <= 4 and sum(r["loss"] for r in s) <= 150


def test_language_id(spark, sf, empty, odd):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.language_report(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert langid.language_report(empty).count() == 0
    assert langid.keep_identified(empty).columns == empty.columns
    assert {r["lang_pred"] for r in langid.language_report(odd).where("doc_id is null").collect()} <= {"und", "en", "de"}
    nothing = langid.Classifier({"en": b"the and thing", "de": b"der und"})
    assert nothing(None)[0] == nothing("")[0] == nothing("123 ...")[0] == "und" and nothing("é")[0] in ("en", "de")


def brute_lattice(word, pieces):
    w = "▁" + word
    a = [0.0] + [-math.inf] * len(w)
    for j in range(1, len(w) + 1):
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.index.get(w[i:j])
            if k is not None:
                a[j] = np.logaddexp(a[j], a[i] + pieces.log[k])
            elif j == i + 1:
                a[j] = np.logaddexp(a[j], a[i] + len(w[i:j].encode()) * (pieces.log[pieces.byte] - math.log(256)))
    return a[-1] / math.log(10)


def test_lattice(docs, texts, empty, odd):
    model = tokenizer_path("piece_bpe_32k.model")
    pieces = lattice_lm.Pieces(model)
    some = ["the", "thingonreed", "été", "\U0001f9ff", "a", "x1", "über"]
    assert np.allclose(lattice_lm.log10_words(some, pieces), [brute_lattice(w, pieces) for w in some])
    got = {r["doc_id"]: r for r in lattice_lm.score_documents(docs, model).collect()}
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    train = Counter()
    for k, w in enumerate(tokens):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        if not got[k]["held_out"]:
            train.update([*w, None])
    n, v = sum(train.values()), len(train)
    fit = lattice_lm.Pieces(model)
    for _ in range(lattice_lm.ROUNDS):
        vocab = [w for w in train if w is not None]
        c = lattice_lm.expected_counts(vocab, np.ones(len(vocab)), fit)
        c[fit.end] = 1
        fit.fit(c)
    known = 1 - max(1, sum(train[w] == 1 for w in train if w is not None)) / n

    def log10_p(w):
        p = brute_lattice(w, fit) if w is not None else fit.log[fit.end] / math.log(10)
        return np.logaddexp(p * math.log(10) + math.log(1 - known), math.log(known * train[w] / n) if train[w] else -math.inf) / math.log(10)

    assert abs(np.exp(fit.log).sum() - 1) < 1e-9
    for k, w in enumerate(tokens):
        r = got[k]
        every = [*w, None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(every), sum(train[x] > 0 for x in every), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in every))
        assert r["score"] == pytest.approx(sum(map(log10_p, every)))
    assert lattice_lm.score_documents(empty, model).count() == 0
    assert lattice_lm.score_documents(odd, model).count() == 6


def test_proximity_is_whole(spark, tmp_path):
    rng = np.random.default_rng(6)
    terms = [f"t{k}" for k in range(5)]
    texts = ["fill t0 " + "fill " * 5 + "t1 fill t2 t1 fill t3 t4"]
    for _ in range(150):
        p = [0.02, *rng.uniform(0.02, 0.2, 4)]
        texts.append(" ".join(rng.choice([*terms, "fill"], 60, p=[*p, 1 - sum(p)])))
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    bench = spark.createDataFrame([(1, " ".join(terms))], "item_id long, text string")
    got = {r["doc_id"]: r["n_near_items"] for r in decontam.contamination_report(spark.read.parquet(path), bench, slop=7).collect()}
    want = {k: int(any(set(terms) <= set(w[i : i + 12]) for i in range(len(w)))) for k, w in enumerate(t.split() for t in texts)}
    assert got == want and 20 < sum(want.values()) < 130


def test_pack_conversations(spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    rows = [(k, t, ["user", "assistant"][t % 2], " ".join(rng.choice(["red", "blue", "greenish", "42"], int(rng.integers(0, 60)))), "x") for k in range(40) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 0, None, None, "x"), (3, None, "Assistant", "red " * 300, "x"), rows[0]]
    p = str(tmp_path / "c")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string").repartition(3).write.parquet(p)
    got = packing.pack_conversations(spark.read.parquet(p), path, tokens=256, segments=4, loss=120).collect()
    n = Counter()
    loss = Counter()
    for c, _, r, t, _ in rows:
        size = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        n[c] += size
        loss[c] += size if r in ("assistant", "Assistant") else 0
    have, bears, seqs = Counter(), Counter(), {}
    for r in got:
        have[r["conv_id"]] += r["tokens"]
        bears[r["conv_id"]] += r["loss"]
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert have == n and +bears == +loss
    for s in seqs.values():
        assert sum(r["tokens"] for r in s) <= 256 and len(s) <= 4 and sum(r["loss"] for r in s) <= 120
        assert sorted(r["offset"] for r in s) == [int(x) for x in np.cumsum([0, *[r["tokens"] for r in sorted(s, key=lambda r: (r["offset"], r["tokens"] > 0))][:-1]])]
    assert any(sum(r["loss"] for r in s) > 100 for s in seqs.values())
    assert packing.pack_conversations(spark.read.parquet(p).where("conv_id < 0"), path).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.WordTokens(tokenizer_path("byte_bpe_50k.json"))


def test_language_ties_and_brute_force():
    """Sizes are those of one-shot compression with the same raw dictionary; ties go to the first language by name, with margin 0."""
    import zstandard

    rng = np.random.default_rng(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    dictionaries = {"xx": make(["ka", "mo", "ri"], 400).encode(), "aa": make(["th", "er", "on"], 400).encode()}
    tool = langid.Classifier(dictionaries)
    for parts, name in ((["ka", "mo", "ri"], "xx"), (["th", "er", "on"], "aa")):
        for n in (30, 2500):
            text = make(parts, n)
            data = langid.folded(text).encode()
            pieces = max(1, round(len(data) / langid.PIECE))
            cuts = [len(data) * k // pieces for k in range(pieces + 1)]
            want = []
            for k in sorted(dictionaries):
                d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                want.append(sum(len(c.compress(data[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) - 8 * pieces)
            assert abs(tool.sizes(text) - want).max() <= 2 * pieces
            assert tool(text)[0] == name
    assert langid.Classifier({"b": b"same words", "a": b"same words"})("some words")[::2] == ("a", 0.0)
