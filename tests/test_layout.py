"""Page rules on small literal pages."""

import datetime
import random
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import text as X
from pagemill.operators import gates, geometry, layout, linking, recognize, render, tasks
from pagemill.plans import layout_queries, pipeline


def cell(cx, cy, text="x", w=30, h=18):
    return (text, [(float(cx - w / 2), float(cy - h / 2)), (float(cx + w / 2), float(cy + h / 2))])


def grid(xs, ys, **kw):
    return [cell(x, y, f"{i}.{j}", **kw) for j, y in enumerate(ys) for i, x in enumerate(xs)]


def blocks_of(spark, *pages):
    rows = [(p, k, "text", t, box) for p, cells in enumerate(pages) for k, (t, box) in enumerate(cells)]
    return geometry.with_metrics(spark.createDataFrame(rows, "page_id long, block_id long, type string, text string, bbox array<struct<x:double,y:double>>"))


def rendered(spark, *pages, enhanced=None, source="a/b.png"):
    names = spark.createDataFrame([(p, source) for p in range(len(pages))], "page_id long, source_path string")
    return sorted(layout.render_pages(blocks_of(spark, *pages), names, enhanced).collect(), key=lambda r: r["page_id"])


def tables(spark, cells, enhanced=None):
    """The parts of one table chunk, in order."""
    keyed = geometry.assign_rows(blocks_of(spark, cells)).withColumns({"band_no": F.lit(0), "side": F.lit(0), "chunk": F.lit(1)})
    return sorted(layout.parts_of(geometry.items_of(keyed, layout.CHUNK), enhanced).collect(), key=lambda r: r["path"])


def one(spark, column, *values, names="abc"):
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=False))).select(column.alias("r")).first()["r"]


def test_grid_quality(spark):
    even = grid([50, 150, 250], [10, 40, 70, 100])
    collided = [*grid([60 * k for k in range(14)], [10, 40, 70]), *(cell(8, y) for y in (10, 40, 70)), *(cell(68, y) for y in (10, 40, 70))]
    rowed = geometry.assign_rows(blocks_of(spark, even, collided))
    a, b = sorted(geometry.grid_quality(rowed).collect(), key=lambda r: r["page_id"])
    assert a["score"] > 0.9 and a["collision"] == 0 and a["n_cols"] == 3
    assert b["score"] < 0.62 and b["collision"] == 1 and b["n_cols"] == 14
    assert [r["is_table"] for r in sorted(geometry.table_like(rowed).collect(), key=lambda r: r["page_id"])] == [True, True]


def test_gutter(spark):
    cut = lambda xs: one(spark, layout.gutter(F.col("a")), xs)
    assert cut([10.0, 30.0, 50.0, 70.0, 200.0, 220.0, 240.0, 260.0]) == 135
    assert cut([10.0, 110.0, 210.0, 310.0]) is None
    assert cut([10.0 * k for k in range(9)]) is None
    assert cut([0.0, 500.0, *(520.0 + 20 * k for k in range(8))]) is None
    left, right = grid([10, 50, 90, 130], [10, 40, 70], w=10), grid([500, 540, 580, 620], [10, 40, 70], w=10)
    r = rendered(spark, left + right)[0]
    assert len(r["scores"]) == 2 and r["body"].count("| --- | --- | --- | --- |") == 2


def test_gutters_nest(spark):
    page = [c for g in (0, 700, 1600) for c in grid([g + 40 * k for k in range(4)], [10, 34, 58], w=12)]
    note = cell(2200, 10, "a remark at the side", w=200)
    r = rendered(spark, [*page, note])[0]
    assert len(r["scores"]) == 3 and r["body"].endswith("a remark at the side")


def test_rows_and_lines(spark):
    stacked = [cell(10, 10, "a"), cell(10, 40, "b"), cell(10, 100, "c")]
    offset = [cell(10, 10), cell(60, 12), cell(10, 40), cell(60, 42)]
    rowed = geometry.assign_rows(blocks_of(spark, stacked, offset))
    assert sorted((r["page_id"], r["row_no"]) for r in rowed.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert not geometry.table_like(rowed.where("page_id = 0")).first()["is_table"]
    assert rendered(spark, [cell(10, y, t) for y, t in ((10, "a first line of text that is too long for a title"), (40, "then a second line"), (100, "and, far below, some more"))])[0]["body"] == "a first line of text that is too long for a title\n\nthen a second line\n\nand, far below, some more"
    pairs = [cell(x, y, t, w=60) for y in (10, 34, 100) for x, t in ((10, f"left {y} and a longer text"), (400, "r"))]
    items = geometry.items_of(geometry.assign_rows(blocks_of(spark, pairs)), ["page_id"])
    assert items.select(layout.lines(F.col("items")).alias("md")).first()["md"] == "left 10 and a longer text r\nleft 34 and a longer text r\n\nleft 100 and a longer text r"


def test_halves(spark):
    left = [cell(100, 20 + 30 * k, f"left line {k} of some length", w=150) for k in range(4)]
    right = [cell(500, 27 + 30 * k, f"right line {k} of some length", w=150) for k in range(4)]
    sides = {r["text"]: r["side"] for r in layout.reading_regions(layout.content(blocks_of(spark, left + right))).collect()}
    assert all(v == int(t.startswith("right")) for t, v in sides.items())
    body = rendered(spark, left + right)[0]["body"]
    assert body.index("left line 3") < body.index("right line 0")
    few = {r["side"] for r in layout.reading_regions(layout.content(blocks_of(spark, left[:3] + right[:3]))).collect()}
    assert few == {0}


def test_side_notes(spark):
    grid_part, note = tables(spark, [*grid([50, 150, 250], [10, 40, 70, 100]), cell(500, 40, "aside", w=120)])
    assert note["md"] == "aside" and "| 0.1 | 1.1 | 2.1 |" in grid_part["md"] and grid_part["score"] > 0.9


def test_side_notes_of_one_left_edge(spark):
    _, note = tables(spark, [*grid([50, 150, 250], [10, 40, 70, 100]), cell(500, 43, "second", w=120), cell(500, 38, "first", w=120)])
    assert note["md"] == "first second"


def test_a_page_is_gathered_once(spark, sf):
    plan = layout_queries.rendered_pages(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("Join") == 1 and plan.count("Window [") <= 3


def poor_page():
    return [c for y in (10, 40, 70, 100) for c in [*grid([60 * k for k in range(14)], [y]), cell(8, y), cell(68, y)]]


def test_low_quality_region_is_recorded(spark):
    (r,) = tables(spark, poor_page())
    assert "[!warning]" in r["md"] and r["poor"]["n_cols"] == 14 and r["poor"]["quality"] < 0.62


@pytest.mark.parametrize("verdict, mark", [("adopt", "[!note]"), ("compare", "[!tip]")])
def test_enhanced_tables(spark, verdict, mark):
    boxes = [p for _, box in poor_page() for p in box]
    box = [int(f(p[k] for p in boxes)) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1))]
    rows = [(0, 3, "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", {"bbox": box}, None, "ppstructurev3", verdict, 0.4, 0.95), (0, 4, "<table></table>", {"bbox": [0, 0, 1, 1]}, None, None, "adopt", 0.4, 0.95), (0, 5, "", {"bbox": [1]}, None, None, None, None, None)]
    e = spark.createDataFrame(rows, "page_id long, item_id int, html string, region struct<bbox:array<int>>, engine string, backend string, verdict string, score_base double, score_enhanced double")
    (r,) = tables(spark, poor_page(), e)
    assert mark in r["md"] and "PP-StructureV3" in r["md"] and "| 1 | 2 |" in r["md"]
    assert ("S_b=0.4, S_e=0.95" in r["md"]) == (verdict == "adopt") == ("[!warning]" not in r["md"])


def test_titles(spark):
    head = [cell(100, 20, "Quarterly review", w=200, h=40), *(cell(100, 80 + 30 * k, "some longer line of body text, here", w=300) for k in range(5))]
    body = [cell(100, 20 + 30 * k, "a plain body line that goes on for rather a long while", w=300) for k in range(4)]
    noise = [cell(100, 20, "3/7"), cell(100, 60, "---")]
    a, b, c, d = rendered(spark, head, body, noise, [], source="a\\b.c.png")
    assert (a["title"], a["title_source"], a["summary_mode"]) == ("Quarterly review", "heading", "") and "Quarterly" not in a["body"]
    assert b["title_source"] == "summary" and b["summary_mode"] == "condensed" and len(b["title"]) <= 30
    assert {(r["title"], r["title_source"]) for r in (c, d)} == {("b.c", "filename")} and d["body"] == "" and not d["needs_rebuild"]


def test_region_heading(spark):
    texts = lambda first: [cell(100, -200, "Title of the page", w=300, h=50), cell(100, 20, first, w=200), *(cell(100, 50 + 28 * k, f"a line of body text, number {k}", w=300) for k in range(3))]
    got = [r["body"].startswith("> ") for r in rendered(spark, *(texts(t) for t in ("1. first", "short:", "注意：", "plain first", "(a) item", "x" * 30 + ":")))]
    assert got == [True, True, True, False, True, False]


def test_summaries(spark):
    cases = {"short one. more": ("short one", "complete"), "- listed, with a mark": ("listed, with a mark", "complete"), "x" * 36: ("x" * 36, "tolerated"), "first clause, second clause, a third clause that is long": ("first clause, second clause", "condensed"), "nocommas" * 9: (("nocommas" * 9)[:30], "condensed"), ".starts with a stop": (".starts with a stop", "complete"), '"quoted" text': ("'quoted' text", "complete")}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", X.summary_title(F.col("t")), X.summary_mode(X.clean_title(X.leading_sentence(F.col("t"))))).collect()}
    assert got == cases


def test_title_cleaning(spark):
    for t, want in (("计量 量一致", "计量 一致"), ("一—一 段", "一 段"), ("标题 （ 注 ）", "标题（注）"), ("plain title", "plain title"), ("a  b", "a b")):
        assert one(spark, X.clean_title(F.col("a")), t) == want


def test_noise(spark):
    cases = {"   ": ("empty", "empty"), "智能图形": ("toolbar", "toolbar"), "工具": ("toolbar", None), "三三三栏": ("toolbar", None), "1111": (None, None), "---": ("symbol", "symbol"), "第3页": ("page_number", "page_number"), "演示工具很长的正文句子在这里": ("toolbar", "toolbar"), "plain words": (None, None)}
    for t, (inside, outside) in cases.items():
        assert one(spark, X.noise_kind(F.col("a"), True), t) == inside, t
        assert one(spark, X.noise_kind(F.col("a"), False), t) == outside, t


def test_scalars(spark):
    assert one(spark, X.sanitize_filename(F.col("a")), "a b--c?é.png") == "a-b-c_é.png"
    assert one(spark, X.occurrences(F.col("a"), F.col("b")), "aaaa", "aa") == 2
    assert one(spark, X.numeric_tokens(F.col("a")), "1,234.5% and 7") == ["1234.5%", "7"]
    assert one(spark, X.same_text(F.col("a"), F.col("b")), "A, b!", "ab")
    assert one(spark, X.matches_pattern(F.col("a"), "**/*.tmp"), "x/y.tmp") and not one(spark, X.matches_pattern(F.col("a"), "**/*.tmp"), "x/y.png")
    assert one(spark, X.matches_pattern(F.col("a"), "**/.*"), "x/.hid") and one(spark, X.matches_pattern(F.col("a"), "*.tmp"), "y.tmp")
    assert one(spark, recognize.correction_prompt(F.col("a"), F.col("b")), "t", "simple_table").startswith("Correct any OCR errors in this table cell")


def test_html(spark):
    md = lambda h: one(spark, render.html_to_markdown(F.col("a")), h)
    assert md("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>") == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert md("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>") == "a\nb"
    assert md("no table") == md("<table></table>") == ""
    rows = lambda h, tidy: one(spark, X.html_rows(F.col("a"), tidy), h)
    assert rows("<table><tr></tr><tr><td> a  b </td></tr></table>", False) == [[], ["a  b"]]
    odd = "<TABLE><TR class=x><TD colspan='2'>a&lt;b&gt; &amp;amp; <b>bold</b> &#65;&#x4e2d;&nbsp;<!-- no --> </TD><th>\n t \n h</th></TR><tr><td> </td></tr></TABLE>"
    assert rows(odd, True) == [["a<b> &amp; bold A中", "t h"]]
    assert rows("<p>&#0; &#xD800;</p><tr><td>&#0;&#xD800;&bogus;</td></tr>", True) == [["&#0;&#xD800;&bogus;"]]


def test_rows_by_running_mean(spark):
    """The native fold and the column runs against loops over the same pages."""
    rng = random.Random(4)
    pages = [[cell(rng.randint(0, 500), rng.randint(0, 300), f"t{k}", rng.randint(5, 60), rng.randint(8, 30)) for k in range(rng.randint(1, 40))] for _ in range(60)]
    blocks = blocks_of(spark, *pages).cache()
    got = {}
    for r in geometry.assign_rows(blocks).collect():
        got.setdefault(r["page_id"], {})[r["block_id"]] = (r["row_no"], r["place"])
    anchors = {r["page_id"]: r["anchors"] for r in geometry.column_anchors(geometry.assign_rows(blocks)).collect()}
    by_page = {}
    for r in blocks.collect():
        by_page.setdefault(r["page_id"], []).append(r)
    for p, bs in by_page.items():
        high = sorted(b["height"] for b in bs)[len(bs) // 2]
        rows = []
        for b in sorted(bs, key=lambda b: (b["center_y"], b["block_id"])):
            if rows and abs(fmean(x["center_y"] for x in rows[-1]) - b["center_y"]) <= max(0.7 * high, 8) + 1e-9:
                rows[-1].append(b)
            else:
                rows.append([b])
        for k, row in enumerate(rows):
            for place, b in enumerate(sorted(row, key=lambda b: (b["min_x"], b["center_y"], b["block_id"]))):
                assert got[p][b["block_id"]] == (k, place)
        xs = sorted(b["center_x"] for b in bs)
        starts = [0, *(i for i in range(1, len(xs)) if xs[i] - xs[i - 1] > max(1.5 * high, 20)), len(xs)]
        runs = [xs[i:j] for i, j in zip(starts, starts[1:], strict=False)]
        runs = [r for r in runs if len(r) > 1 or len(rows) < 3] or runs
        assert anchors[p] == pytest.approx([fmean(r) for r in runs])


def test_gates(spark):
    assert one(spark, gates.adopt_verdict(F.col("a"), F.col("b"), True, 0.62, 0.15, 0.80), 0.40, 0.90) == "adopt"
    for a, b in ((0.60, 0.70), (0.70, 0.95), (0.40, 0.78)):
        assert one(spark, gates.adopt_verdict(F.col("a"), F.col("b"), True, 0.62, 0.15, 0.80), a, b) == "compare"
    src = spark.createDataFrame([(1, "10 20"), (2, "10 20"), (3, "10 20"), (4, "none")], "k long, t string")
    made = spark.createDataFrame([(1, "20, 10"), (2, "10"), (3, "10 20 99"), (4, "5")], "k long, m string")
    got = {r["k"]: (r["hit"], round(r["fabricate"], 3)) for r in gates.consistency(src, made, "k", "t", "m").collect()}
    assert got == {1: (1.0, 0.0), 2: (0.5, 0.0), 3: (1.0, 0.333), 4: (0.0, 1.0)}
    v = spark.createDataFrame([(0.5, 0.5, 0.1)], "hit double, fabricate double, struct double")
    r = gates.rebuild_verdict(v).first()
    assert not r["adopt"] and r["reasons"] == ["hit 0.50 < 0.90 (dropped content)", "fabricate 0.50 > 0.05 (invented numbers)", "structure 0.10 < 0.50"]


def test_links_of_all_tiers(spark):
    """Titles and texts over few letters, so that all kinds of containment come up, against the nested loop."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh中文") for _ in range(rng.randrange(1, 9)))
    titles = spark.createDataFrame([(w,) for w in {word() for _ in range(150)} | {"A-b", "aab", "", "-"}], "title string")
    grams = spark.createDataFrame([(w,) for w in {word() for _ in range(300)} | {"ab", "AAB", "", "--"}], "text string")
    look = lambda df: sorted(tuple(r) for r in df.collect())
    got = look(linking.match_titles_all(grams, titles).select("text", "target", "confidence", "match_type"))
    want = look(linking.match_titles_unpruned(grams, titles).where("text <> '' and target <> ''").select("text", "target", "confidence", "match_type"))
    drop = lambda rows: [r for r in rows if r[0].strip("-") and r[1].strip("-")]
    assert drop(got) == drop(want) and any(0.4 < r[2] < 0.6 for r in got)


def test_best_path_of_ideographs():
    """Against all ways to cut a run."""
    from pagemill.operators.segment import best_path

    rng = random.Random(2)
    for _ in range(300):
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 8)))
        words = {run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + 4) + 1) if rng.random() < 0.5}
        weights = {w: -float(rng.randrange(1, 9)) for w in sorted(words)}
        every = [[]]
        for k, sign in enumerate(run):
            every = [[*p, sign] for p in every] + ([[*p[:-1], p[-1] + sign] for p in every] if k else [])
        legal = [p for p in every if all(w in weights or len(w) == 1 for w in p) and max(map(len, p)) <= 4]
        want = max(legal, key=lambda p: (sum(weights.get(w, -20.0) for w in p), [len(w) for w in reversed(p)]))
        assert best_path(run, weights, -20.0, 4) == want


def test_notes_in_ideographs_are_linked(spark):
    from pagemill.operators import segment

    titles = spark.createDataFrame([("数据湖",), ("机器学习",), ("Plan",)], "title string")
    docs = spark.createDataFrame([(1, "我们用机器学习处理数据湖里的日志"), (2, "the Plan，机器学习"), (3, None), (4, "机器坏了")], "doc_id long, text string")
    words = segment.dictionary(docs, titles)
    cut = segment.segmenter(words)
    got = {r["doc_id"]: r["w"] for r in docs.select("doc_id", cut(F.col("text")).alias("w")).collect()}
    assert {"机器学习", "数据湖"} <= set(got[1]) and "".join(got[1]) == "我们用机器学习处理数据湖里的日志" and got[2] == ["the", "Plan", "机器学习"] and got[3] == []
    best = linking.top_per_target(linking.link_candidates(docs, titles, segment=cut))
    exact = {(r["doc_id"], r["target"]) for r in best.collect() if r["match_type"] == "exact"}
    assert exact == {(1, "机器学习"), (1, "数据湖"), (2, "机器学习"), (2, "Plan")}


def test_boxes_that_meet(spark):
    """Boxes of all sizes, points and edges that touch, each pair once."""
    rng = random.Random(5)
    box = lambda: (lambda x, y, w, h: (x, y, x + w, y + h))(float(rng.randrange(-300, 3000)), float(rng.randrange(-50, 3000)), float(rng.choice([0, 1, 7, 64, 300, 2500])), float(rng.choice([0, 2, 64, 128, 900])))
    a, b = ([(k % 3, *box(), k) for k in range(250)] for _ in range(2))
    ddl = "page_id long, x0 double, y0 double, x1 double, y1 double, {0}_id long"
    got = sorted((r["a_id"], r["b_id"]) for r in geometry.meeting(spark.createDataFrame(a, ddl.format("a")), spark.createDataFrame(b, ddl.format("b"))).collect())
    want = sorted((p[5], q[5]) for p in a for q in b if p[0] == q[0] and max(p[1], q[1]) <= min(p[3], q[3]) and max(p[2], q[2]) <= min(p[4], q[4]))
    assert got == want and len(want) > 100


def test_a_huge_page_is_spread(spark):
    """One page of 60,000 boxes and 4,000 regions: its tiles are dealt over the tasks, and the result is the range join's."""
    boxes = spark.range(60_000).selectExpr("1L AS page_id", "id AS block_id", "'text' AS type", "cast(id % 300 * 10 AS double) AS center_x", "cast(id div 300 * 10 AS double) AS center_y")
    regions = spark.range(4000).selectExpr("1L AS page_id", "id AS region_id", "cast(id % 63 * 45 AS double) AS x0", "cast(id div 63 * 30 AS double) AS y0", "cast(id % 63 * 45 + 40 AS double) AS x1", "cast(id div 63 * 30 + 25 AS double) AS y1")
    got = geometry.blocks_in_regions(boxes, regions).groupBy("region_id").count()
    counts = {r["region_id"]: r["count"] for r in got.collect()}
    fit = lambda lo, hi, top: sum(1 for v in range(0, top * 10, 10) if lo <= v <= hi)
    want = {k: n for k in range(4000) if (n := fit(k % 63 * 45, k % 63 * 45 + 40, 300) * fit(k // 63 * 30, k // 63 * 30 + 25, 200))}
    assert counts == want


def test_upper_medians_by_rank(spark):
    from pagemill.functions import stats as S

    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.choice([None, float(rng.randrange(20)), rng.random()])) for _ in range(400)] + [(9, None)]
    got = {(r["g"], r["m"]) for r in S.with_upper_median(spark.createDataFrame(rows, "g int, v double"), ["g"], {"m": F.col("v")}).collect()}
    values = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    assert got == {(g, v[len(v) // 2] if v else None) for g, v in values.items()}


def test_links_pruned_and_not(spark):
    rng = random.Random(3)
    grams = spark.createDataFrame([("".join(rng.choice("abc ") for _ in range(rng.randint(1, 8))),) for _ in range(300)] + [("A-b",)], "text string").distinct()
    titles = spark.createDataFrame([("".join(rng.choice("abc ") for _ in range(rng.randint(2, 8))),) for _ in range(40)] + [("ab",)], "title string")
    row = lambda r: (r["text"], r["target"], round(r["confidence"], 9), r["match_type"])
    a = {row(r) for r in linking.match_titles(grams, titles).collect()}
    b = {row(r) for r in linking.match_titles_unpruned(grams, titles).where("confidence >= 0.6").collect()}
    assert a == b and a


def test_recognition_falls_back(spark):
    def broken():
        raise RuntimeError("no model")

    files = spark.createDataFrame([("a.png", bytearray(b"line one\nline two"), "mineru")], "path string, content binary, engine string")
    r = recognize.recognize(files, {"mineru": broken, geometry.DEFAULT_ENGINE: recognize.FakeRecognizer()}).first()
    assert r["engine_used"] == geometry.DEFAULT_ENGINE and len(r["blocks"]) == 2 and r["error"] is None


def test_notes_end_to_end(spark):
    def block(k, text, x, y, w=60.0, h=16.0):
        return (k, "text", text, 0.9, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], False)

    blocks = [block(0, "Overview of titles", 50.0, 40.0, 300.0, 40.0), *(block(1 + 3 * r + c, f"c{r}{c}", 50.0 + 120 * c, 150.0 + 26 * r) for r in range(3) for c in range(2)), block(20, "3/7", 700.0, 900.0)]
    page = (7, "raw/shot one.png", 0.9, "e", "mixed", blocks, [("<table><tr><td>q</td><td>r</td></tr></table>", [], None, 0.5, "x", None)], None, None)
    pages = spark.createDataFrame([page], schemas.PAGE)
    titles = spark.createDataFrame([("Overview",)], "title string")
    note = pipeline.note_pages(pages, titles, F.lit(datetime.date(2024, 3, 5)), correct=recognize.identity_model).first()
    assert note["file_name"] == "2024-03-05_shot-one.md"
    md = note["markdown"]
    assert md.startswith('---\ntitle: "Overview of titles"\ndate: 2024-03-05\npage: 3/7\ntags: ["ocr/pending", "ocr/table"]')
    assert "| c00 | c01 |\n| --- | --- |" in md and "[[Overview]]" in md and "[页号] 3/7" in md and "| q | r |" in md
    assert md.count("Overview of titles") == 1


def test_tasks(spark):
    events = spark.createDataFrame([(1, 1, "pending", None, None), (2, 1, "failed", "e", None), (3, 1, "failed", "f", None), (4, 1, "pending", None, None), (5, 2, "completed", None, None)], schemas.TASK_EVENT)
    got = {r["task_id"]: (r["status"], r["attempts"], r["last_error"]) for r in tasks.fold_events(events).collect()}
    assert got == {1: ("pending", 2, None), 2: ("completed", 0, None)}


def test_stitch(spark):
    parts = spark.createDataFrame([(1, 0, "one line\nshared line"), (1, 1, "shared line\nlast"), (1, 2, None)], "doc_id long, part int, text string")
    assert render.stitch_regions(parts).first()["text"] == "one line\nshared line\n\nlast"


def test_enhancement(spark):
    def backend():
        def read(crop, region, blocks, offset):
            if bytes(crop) == b"bad":
                raise RuntimeError("no")
            return "<table>" + "<tr><td>a</td><td>b</td><td>c</td></tr>" * 4 + "</table>" if bytes(crop) == b"t" else None

        return read

    rows = [(1, k, bytearray(c), [0, 0, 9, 9], 0.4, 3, "[]", 0, 0) for k, c in enumerate([b"t", b"bad", b"none"])]
    crops = spark.createDataFrame(rows, "page_id long, region_id int, content binary, bbox array<int>, quality double, n_cols int, blocks string, x0 int, y0 int")
    got = recognize.enhance_regions(crops, backend, "ppstructurev3", enabled=True).collect()
    assert [(r["item_id"], r["score_enhanced"], r["verdict"]) for r in got] == [(0, 1.0, "adopt")]
    assert recognize.enhance_regions(crops, backend, "vision").first()["verdict"] == "compare"
    assert recognize.enhance_regions(crops, backend, "manual").count() == 0


def test_rebuild(spark):
    crops = spark.createDataFrame([(1, 0, bytearray(b"# head")), (1, 1, bytearray(b"line two")), (2, 0, bytearray(b"x")), (2, 1, bytearray(b"fail"))], "page_id long, region_id int, content binary")
    got = recognize.rebuild_pages(crops, lambda: lambda c: None if bytes(c) == b"fail" else bytes(c).decode()).collect()
    assert [tuple(r) for r in got] == [(1, "# head\n\nline two", 2)]


def picture(h=300, w=400):
    import numpy as np

    a = np.zeros((h, w, 3), np.uint8)
    a[..., 0] = np.arange(w) % 256
    a[..., 1] = (np.arange(h) % 256)[:, None]
    return a


def as_image(a):
    return (a.shape[0], a.shape[1], a.shape[2], bytearray(a[..., ::-1].tobytes()))


PICTURES = "page_id long, image struct<height:int,width:int,nChannels:int,data:binary>"


def written(df, folder):
    """Flows read rendered pages several times: from a table."""
    path = f"{folder}/rendered"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_enhancement_end_to_end(spark, tmp_path):
    from pagemill.operators import flows
    from pagemill.operators.backends import Registry

    def reader():
        from pagemill.operators import images

        def read(crop, region, blocks, offset):
            return f"<table><tr><td>{images.from_png(crop).shape}</td><td>{len(blocks)}</td></tr>" + "<tr><td>1</td><td>2</td></tr>" * 5 + "</table>" if region["n_cols"] == 14 else None

        return read

    rows = [(0, k, "text", t, [{"x": x, "y": y} for x, y in b]) for k, (t, b) in enumerate(poor_page())]
    blocks = geometry.with_metrics(spark.createDataFrame(rows, "page_id long, block_id long, type string, text string, bbox array<struct<x:double,y:double>>").select("*", F.col("bbox").alias("box")), "box").drop("box")
    pictures = spark.createDataFrame([(0, as_image(picture(200, 900)))], PICTURES)
    (part,) = tables(spark, poor_page())
    drawn = spark.createDataFrame([(0, [part["poor"]])], "page_id long, poor array<struct<bbox:array<int>,quality:double,n_cols:int>>")
    registry = Registry().add("gridboost", reader)
    made = flows.enhance(drawn, blocks, pictures, registry, enabled=True, base_max=0.7, margin=0.1, least=0.5).collect()
    assert [(r["page_id"], r["item_id"], r["verdict"], r["backend"]) for r in made] == [(0, 0, "adopt", "gridboost")]
    assert "<td>(123, 809, 3)</td><td>64</td>" in made[0]["html"]
    (again,) = tables(spark, poor_page(), flows.enhance(drawn, blocks, pictures, registry, enabled=True, base_max=0.7, margin=0.1, least=0.5))
    assert "[!note]" in again["md"] and "[!warning]" not in again["md"]
    assert flows.enhance(drawn, blocks, pictures, registry, override="manual").count() == 0
    assert flows.enhance(drawn, blocks, pictures, registry, tier="ppstructurev3").count() == 0  # too many columns for the slow reader
    assert registry.choose()[0] == "gridboost" and registry.choose("manual", "vision") == ("manual", None) and registry.choose(None, "vision")[0] == "vision"


def test_rebuild_end_to_end(spark, tmp_path):
    from pagemill.operators import flows

    page = [cell(60 + 200 * (k % 2), 20 + 70 * (k // 2), f"part {k} 1{k}", w=80) for k in range(8)]
    blocks, names = blocks_of(spark, page, page[:3]), spark.createDataFrame([(0, "a"), (1, "b")], "page_id long, source_path string")
    drawn = written(layout.render_pages(blocks, names), tmp_path)
    assert {r["page_id"]: r["needs_rebuild"] for r in drawn.collect()} == {0: True, 1: False}
    pictures = spark.createDataFrame([(p, as_image(picture())) for p in (0, 1)], PICTURES)
    regions = flows.page_regions(blocks.where("page_id = 0"))
    n = regions.count()
    assert n == 4
    good = flows.rebuild(drawn, blocks, pictures, lambda: lambda crop: "| part | 10 11 12 13 14 15 16 17 |\n| --- | --- |\n| 1 2 3 4 5 6 7 0 | x |").collect()
    assert [(r["page_id"], r["n_regions"], r["hit"], r["fabricate"], r["adopt"]) for r in good] == [(0, 4, 1.0, 0.0, True)]
    bad = flows.rebuild(drawn, blocks, pictures, lambda: lambda crop: "77 88").first()
    assert not bad["adopt"] and len(bad["reasons"]) == 3
    assert flows.rebuild(drawn, blocks, pictures, lambda: lambda crop: None).count() == 0
    body = flows.with_rebuilt(drawn, spark.createDataFrame(good, flows.rebuild(drawn, blocks, pictures, lambda: lambda crop: "x").schema))
    assert {r["page_id"]: r["body"].startswith("| part") for r in body.collect()} == {0: True, 1: False}


def test_server_and_isolated_backends(tmp_path):
    import json
    import sys
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from pagemill.operators import backends, images

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"response": "```html <table><tr><td>a</td></tr></table>``` done"}).encode()
            self.send_response(500 if seen[-1]["model"] == "broken" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_port}/"
    crop = images.png(picture(20, 3000))
    assert backends.vision_tables(backends.Server(at, "m", 5))()(crop, {}, [], (0, 0)) == "<table><tr><td>a</td></tr></table>"
    assert seen[-1]["options"] == {"temperature": 0.0, "num_predict": 2048} and len(seen[-1]["images"]) == 1
    assert backends.vision_tables(backends.Server(at, "broken", 5))()(crop, {}, [], (0, 0)) is None
    assert backends.vision_regions(backends.Server(at, "m", 5, keep_alive="30m"))()(crop).startswith("```html") and seen[-1]["keep_alive"] == "30m"
    assert backends.corrector(backends.Server("http://127.0.0.1:9/", "m", 1))()(["Text: as it is\nCorrected:"]) == ["as it is"]
    http.shutdown()
    worker = tmp_path / "w.py"
    worker.write_text("import json, sys\nprint('noise')\nprint(json.dumps({'html': '<table>%d</table>' % len(open(sys.argv[1], 'rb').read())}))")
    assert backends.isolated([sys.executable, str(worker)])()(crop, {}, [], (0, 0)) == f"<table>{len(crop)}</table>"
    assert backends.isolated([sys.executable, "-c", "import time; time.sleep(9)"], timeout=0.5)()(crop, {}, [], (0, 0)) is None
    assert backends.isolated(["no-such-command"])()(crop, {}, [], (0, 0)) is None


def test_colors_of_image_rows(spark):
    import numpy as np

    from pagemill.operators import images

    a = np.zeros((30, 40, 3), np.uint8)
    a[:, :30] = (200, 30, 30)
    df = spark.createDataFrame([(1, as_image(a))], PICTURES)
    r = df.select(images.page_colors(F.col("image"), 2).alias("c"), images.color_grids(F.col("image")).alias("g")).first()
    assert [(c["color"], c["share"]) for c in r["c"]] == [("#c81e1e", 0.75), ("#000000", 0.25)] and r["g"][0][0] == "#c81e1e" and r["g"][-1][-1] == "#000000"


def test_images_prepared():
    import numpy as np

    from pagemill.operators import images

    a = picture()
    assert (images.from_png(images.png(a)) == a).all() and (images.from_png(images.png(a[..., 0])) == a[..., 0]).all()
    assert images.shrunk(a, 100).shape == (75, 100, 3) and images.shrunk(a, 1000) is a
    assert abs(images.shrunk(np.full((50, 90), 77, np.uint8), 20).astype(int) - 77).max() == 0
    tilted = np.zeros((240, 320), np.uint8)
    quad = np.array([[40, 30], [270, 60], [250, 210], [60, 190]], float)
    ys, xs = np.mgrid[0:240, 0:320]
    inside = np.ones(tilted.shape, bool)
    for p, q in zip(quad, np.roll(quad, -1, axis=0), strict=True):
        inside &= (q[0] - p[0]) * (ys - p[1]) - (q[1] - p[1]) * (xs - p[0]) >= 0
    tilted[inside] = 200
    polygon = images.hull(np.argwhere(inside)[:, ::-1])
    assert abs(images.ordered_corners(images.four_corners(polygon)) - quad).max() <= 3
    flat = images.straightened(tilted, quad)
    assert abs(flat.shape[1] - np.linalg.norm(quad[0] - quad[1])) <= 1 and (flat[3:-3, 3:-3] == 200).mean() > 0.98
    assert images.four_corners(images.hull(np.argwhere((ys - 120) ** 2 + (xs - 160) ** 2 < 90**2))) is None
    rng = np.random.default_rng(0)
    dull = (100 + 20 * (xs > 160) + rng.normal(0, 4, xs.shape)).astype(np.uint8)
    assert images.equalized(dull).std() > dull.std()
    clean = images.denoised(dull, strength=10)
    assert clean[:, :140].std() < 0.5 * dull[:, :140].std() and abs(float(clean[:, 180:].mean()) - float(dull[:, 180:].mean())) < 1
    out = images.prepared(a[:120, :160], upscale=False)
    assert out["final"].shape == out["corrected"].shape[:2] and len(out["colors"]) > 1
    grid = images.gridded(np.full((60, 100, 3), 255, np.uint8), [{"bbox": [{"x": x, "y": y}, {"x": x + 10, "y": y + 10}]} for x in (10, 60) for y in (5, 40)], (0, 0))
    assert (grid == 0).any() and (grid[:, 40] == 0).all() and (grid[27] == 0).all()


def test_mixed_when_reading_failed(spark):
    pages = spark.createDataFrame([(0, None), (1, "RuntimeError: x"), (2, "")], "page_id long, error string")
    got = {r["page_id"]: r["content_type"] for r in geometry.classify_pages(pages, blocks_of(spark, grid([50, 150], [10, 40]), grid([50], [10]))).collect()}
    assert got == {0: "simple_table", 1: "mixed", 2: "pure_text"}


def test_tables_and_grids_by_ordinal(spark):
    cells = spark.createDataFrame([(1, t, 0, c, f"{t}{c}") for t in (0, 1) for c in (0, 1)], "page_id long, table_no int, row_no int, place int, text string")
    grids = spark.createDataFrame([(1, 1, [["#ff0000"]])], "page_id long, table_no int, grid array<array<string>>")
    by = ["page_id", "table_no"]
    got = {r["table_no"]: r["html"] for r in render.html_tables(render.colored_cells(cells, grids, by), by).collect()}
    assert "bgcolor" not in got[0] and '<td bgcolor="#ff0000">10</td><td>11</td>' in got[1]


def test_known_paths(spark):
    f = "file_path string, file_hash string, created_at int"
    files = spark.createDataFrame([("a", "h1", 1), ("b", "h1", 2), ("c", "h2", 3), ("d", "h3", 4), ("e", "h4", 5), ("e", "h5", 6)], f)
    known = spark.createDataFrame([("h2", "x"), ("h9", "d")], "file_hash string, file_path string")
    assert {(r["file_path"], r["file_hash"], r["copies"]) for r in tasks.new_tasks(files, known).collect()} == {("a", "h1", 2), ("e", "h4", 1)}


def test_segmenter(spark):
    from pagemill.functions import text as X

    by_sign = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{IsHan}]|[a-z]+"), F.lit(0))
    docs, titles = spark.createDataFrame([(1, "这是年度报告 abc")], "doc_id long, text string"), spark.createDataFrame([("年 度",)], "title string")
    assert linking.link_candidates(docs, titles).count() == 0
    assert {r["text"] for r in linking.link_candidates(docs, titles, segment=by_sign).collect()} == {"年 度"}
    assert X.tokens is not by_sign
