import gzip
import hashlib
import random

from pyspark.sql import functions as F

from pagemill.llm import warc
from pagemill.llm._common import new_path


def sha(b):
    return hashlib.sha1(b).hexdigest()


def test_round_trip(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "u1", big), (2, "u\n2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "u", big), (6, "u", "é" * 600)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(spark.read.parquet(path)).collect()}
    for k, _, t in rows:
        data = (t or "").encode()
        again = t == big and k != 9
        assert got[k] == (len(data), sha(data), "revisit" if again else "response", 9 if again else None)


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Of equal rows one is the response; columns named as the operator's own aren't read; a megabyte comes back whole."""
    big, long = "y" * 1500, "z" * 2_000_000
    rows = [(7, "u", big), (7, "u", big), (8, "u", long), (8, "u", long), (2, "u", "s"), (2, "u", "s")]
    path = str(tmp_path / "p")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("mark", "keep", "row_id", "payload", "maybe", "bits_word", "n"):
        df = df.withColumn(c, F.lit("clash"))
    df.coalesce(1).write.parquet(path)
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.read.parquet(path)).collect()]
    assert sorted(got, key=str) == sorted([(2, 1, "response", None), (2, 1, "response", None), (7, 1500, "response", None), (7, 1500, "revisit", 7), (8, 2_000_000, "response", None), (8, 2_000_000, "revisit", 8)], key=str)


def test_empty_table(spark, empty):
    pages = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.archive_round_trip(pages).count() == 0


def records(n=12, compress=True):
    out = []
    for k in range(n):
        data = bytes(random.Random(k).choices(b"abcdefgh <>/\n", k=900 + k))
        out.append(warc.record(k, "u", data, "response", None, sha(data), compress))
    return out


def check(data, lost, where):
    found = list(warc.salvage(data))
    assert [r["page_id"] for r, *_ in found if r] == [k for k in range(12) if k not in lost]
    gaps = [(a, b) for r, a, b, _ in found if r is None]
    assert gaps == where
    covered = sorted({(a, b) for _, a, b, _ in found})
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_salvage():
    for compress in (True, False):
        raw = records(compress=compress)
        starts = [sum(map(len, raw[:k])) for k in range(13)]
        check(b"".join(raw), set(), [])
        for k in (0, 5, 11):
            hurt = bytearray(b"".join(raw))
            hurt[starts[k] + len(raw[k]) // 2] ^= 0x55
            check(bytes(hurt), {k}, [(starts[k], starts[k + 1])])
            check(b"".join(raw[:k] + [raw[k][:200]] + raw[k + 1 :]), {k}, [(starts[k], starts[k] + 200)])
        junk = b"junk \x1f\x8b\x08 WARC/1.1\r\n junk"
        check(b"".join([*raw[:4], junk, *raw[4:]]), set(), [(starts[4], starts[4] + len(junk))])
        check(b"".join(raw[:11]) + raw[11][: len(raw[11]) // 2], {11}, [(starts[11], starts[11] + len(raw[11]) // 2)])
    mixed = records(6) + records(12, False)[6:]
    check(b"".join(mixed), set(), [])
    assert list(warc.salvage(b"")) == []


def member(parts):
    return gzip.compress(b"".join(parts), 4)


def test_salvage_inside_members():
    """Members of several records: damage to one leaves the others; of a member that breaks off, what came before stays."""
    plain = records(compress=False)
    ids = lambda data: [r["page_id"] for r, *_ in warc.salvage(data) if r]
    assert ids(member(plain[:3]) + member(plain[3:])) == list(range(12))
    for k in (0, 1, 2):
        hurt = [bytearray(x) for x in plain[:3]]
        hurt[k][len(hurt[k]) // 2] ^= 0x55
        data = member(hurt) + member(plain[3:])
        assert ids(data) == [j for j in range(12) if j != k]
        gaps = [(a, b, why) for r, a, b, why in warc.salvage(data) if r is None]
        lo, hi = sum(map(len, plain[:k])), sum(map(len, plain[: k + 1]))
        assert [(a, b) for a, b, _ in gaps] == [(0, len(member(hurt)))] and f"bytes {lo} to {hi} of the member" in gaps[0][2]
    whole = member(plain[:6])
    cut = whole[: len(whole) * 2 // 3]
    got = ids(cut + member(plain[6:]))
    assert got[-6:] == list(range(6, 12)) and got[:-6] == list(range(len(got) - 6)) and 0 < len(got) - 6 < 6
    assert [(a, b) for r, a, b, _ in warc.salvage(cut + member(plain[6:])) if r is None] == [(0, len(cut))]
    assert ids(member([]) + member(plain)) == list(range(12))


def test_gaps_are_logged(spark):
    path = new_path(spark, "hurt")
    raw = records()
    rows = spark.createDataFrame([(k, "u", b"payload %d" % k, "response", None, sha(b"payload %d" % k)) for k in range(12)], "page_id long, url string, payload binary, record_type string, refers_to long, payload_digest string").coalesce(1)
    warc.write_archives(rows, path, archive_bytes=600)
    assert {bytes(r["payload"]) for r in warc.read_archives(spark, path).collect()} == {b"payload %d" % k for k in range(12)}
    with open(path.removeprefix("file://") + "/more.warc", "wb") as f:
        f.write(raw[0] + b"garbage" + raw[1])
    gap = warc.read_archives(spark, path).where("gap is not null").collect()
    assert [(r["start"], r["end"], r["page_id"]) for r in gap] == [(len(raw[0]), len(raw[0]) + 7, None)]
