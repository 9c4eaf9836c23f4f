"""Page geometry over block rows: margins, rows, columns, bands, grids and their scores.

blocks has page_id, block_id and the metrics of with_metrics().  Every operator
shuffles by page once at most; a page is a bounded group.  `by` names the
columns of a group (a page, or a region of it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import stats as S
from pagemill.functions import text as X
from pagemill.functions.stats import let

MARGIN = 0.07
METRICS = ("min_x", "max_x", "min_y", "max_y", "center_x", "center_y", "width", "height")
QUALITY_MIN = 0.62
WIDE_COLUMNS = 9
# Why a region is, or is not, taken for a regular table.
REASONS = ("too few text boxes", "too few rows", "too few columns (not tabular)", "ultra-dense matrix", "irregular layout (flowchart?)", "regular ruled table")


def with_metrics(blocks: DataFrame, bbox: str = "bbox") -> DataFrame:
    return blocks.select(*(c for c in blocks.columns if c not in METRICS), *(v.alias(k) for k, v in S.box_metrics(F.col(bbox)).items()))


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("type") == "text") & ~X.is_blank(F.col("text")))


def partition_blocks(blocks: DataFrame) -> DataFrame:
    """adds reason (null: content) and page_number (of blocks that are one).

    Margins are the top and bottom 7 % of the page's text extent.  A page number
    is N/M anywhere, 第N页, or the only bare number of 1 to 4 digits in a margin
    of the right quarter.  Blocks other than text are content; a page without
    any usable text has no blocks at all.
    """
    w = Window.partitionBy("page_id")
    only = lambda c: F.when(F.col("__t"), F.col(c))
    packed = X.compact(F.coalesce("text", F.lit("")))
    b = blocks.withColumn("__c", packed).select("*", X.count_terms(F.col("__c"), X.WEAK_TERMS).alias("__weak"), ((F.col("type") == "text") & (F.col("__c") != "")).alias("__t"))
    b = b.select("*", F.min(only("min_y")).over(w).alias("__top"), F.max(only("max_y")).over(w).alias("__end"), F.min(only("min_x")).over(w).alias("__left"), F.max(only("max_x")).over(w).alias("__right"))
    high = F.greatest(F.col("__end") - F.col("__top"), F.lit(1.0))
    wide = F.greatest(F.col("__right") - F.col("__left"), F.lit(1.0))
    b = b.where("__top is not null").select("*", (F.col("__top") + high * MARGIN).alias("__head"), (F.col("__end") - high * MARGIN).alias("__foot"))
    b = b.withColumn("__margin", (F.col("max_y") <= F.col("__head")) | (F.col("min_y") >= F.col("__foot")))
    explicit = F.when(F.col("__t"), X.explicit_page_number_of(F.col("__c")))
    right = (F.col("center_x") - F.col("__left")) / wide >= 0.75
    bare = F.when(F.col("__t") & explicit.isNull() & F.col("__margin") & right, X.bare_page_number_of(F.col("__c")))
    b = b.select("*", explicit.alias("__explicit"), bare.alias("__bare"))
    lone = F.count("__bare").over(w) == 1
    b = b.withColumn("page_number", F.coalesce("__explicit", F.when(lone, F.col("__bare"))))
    kind = X.noise_kind_of(F.col("__c"), F.col("__weak"), F.col("__margin"))
    reason = (
        F.when(~F.col("__t"), F.lit(None).cast("string"))
        .when(F.col("page_number").isNotNull(), "page_number")
        .when(kind.isin("toolbar", "symbol", "empty"), kind)
        .when(F.col("__margin") & X.is_margin_noise_of(F.col("__c")), F.when(F.col("min_y") >= F.col("__foot"), "footer").otherwise("header"))
    )
    out = b.withColumn("reason", reason).withColumn("page_number_rank", F.when(F.col("__explicit").isNotNull(), 0).when(F.col("page_number").isNotNull(), 1))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def page_numbers(partitioned: DataFrame) -> DataFrame:
    """(page_id, page_number): explicit ones first, then by place in the page."""
    return partitioned.where("page_number is not null").groupBy("page_id").agg(F.min_by("page_number", F.struct("page_number_rank", "block_id")).alias("page_number"))


def _centroid_fold(items: Column, value: str, tolerance: Column) -> Column:
    """Cluster numbers of values in order: one joins the cluster whose running mean is within tolerance, else starts one."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("row"))

    def within(most: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            v = x[value] if value else x
            near = (s["n"] > 0) & (F.abs(v - F.try_divide(s["sum"], s["n"])) <= most)
            same = F.struct(F.array_append(s["out"], s["row"]).alias("out"), (s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n"), s["row"].alias("row"))
            new = F.struct(F.array_append(s["out"], s["row"] + 1).alias("out"), v.alias("sum"), F.lit(1).alias("n"), (s["row"] + 1).alias("row"))
            return F.when(near, same).otherwise(new)

        return F.aggregate(items, start, step)["out"]

    return let(tolerance, within)


def nested(blocks: DataFrame, by: list[str], *order: str) -> DataFrame:
    """(by, items): a group's blocks as an array of struct<(order), b>, sorted by order."""
    rest = [c for c in blocks.columns if c not in by]
    item = F.struct(*(F.col(c).alias(f"__{c}") for c in order), F.struct(*rest).alias("b"))
    return blocks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))


def row_tolerance(heights: Column) -> Column:
    return F.greatest(S.upper_median_of(heights) * 0.7, F.lit(8.0))


def row_numbers(items: Column) -> Column:
    """array<int>: the row of each of nested() items that are sorted by center_y."""
    return _centroid_fold(items, "__center_y", row_tolerance(F.transform(items, lambda i: i["b"]["height"])))


def cut_at(items: Column, starts: Column) -> Column:
    """array<array>: items cut before each of starts, which begin with 0."""
    return let(starts, lambda s: F.transform(s, lambda p, k: F.slice(items, p + 1, F.coalesce(F.get(s, k + 1), F.size(items)) - p)))


def row_runs(items: Column) -> Column:
    """array<array>: the rows of a group's blocks that are sorted by center_y and block_id, as assign_rows() has them; each is a run of them."""
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("k"))

    def within(most: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            v = x["center_y"]
            near = (s["n"] > 0) & (F.abs(v - F.try_divide(s["sum"], s["n"])) <= most)
            same = F.struct(s["starts"].alias("starts"), (s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n"), (s["k"] + 1).alias("k"))
            new = F.struct(F.array_append(s["starts"], s["k"]).alias("starts"), v.alias("sum"), F.lit(1).alias("n"), (s["k"] + 1).alias("k"))
            return F.when(near, same).otherwise(new)

        return cut_at(items, F.aggregate(items, start, step)["starts"])

    return let(row_tolerance(F.transform(items, lambda i: i["height"])), within)


def assign_rows(blocks: DataFrame, by: list[str] | None = None, order_in_row: str = "min_x") -> DataFrame:
    """adds row_no and place (in the row): rows are clusters of center_y by running mean, within max(0.7 upper-median height, 8)."""
    by = by or ["page_id"]
    g = nested(blocks, by, "center_y", "block_id")
    g = g.withColumn("rows", row_numbers(F.col("items")))
    flat = g.select(*by, F.explode(F.arrays_zip("items", "rows")).alias("z")).select(*by, "z.items.b.*", F.col("z.rows").alias("row_no"))
    w = Window.partitionBy(*by, "row_no").orderBy(order_in_row, "center_y", "block_id")
    return flat.withColumn("place", F.row_number().over(w) - 1)


def row_boxes(rowed: DataFrame, by: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """One row per visual row: its box, size, text and mean centre, and extra aggregates."""
    by = by or ["page_id"]
    texts = F.array_sort(F.collect_list(F.struct("place", X.stripped(F.coalesce(F.col("text"), F.lit(""))).alias("t"))))
    return rowed.groupBy(*by, "row_no").agg(
        F.min("min_y").alias("top"), F.max("max_y").alias("bottom"), F.min("min_x").alias("left"), F.max("max_x").alias("right"),
        F.max("height").alias("row_height"), F.avg("center_y").alias("row_center"), F.count("*").alias("n_blocks"),
        F.array_join(F.filter(F.transform(texts, lambda x: x["t"]), lambda t: t != ""), " ").alias("row_text"), *(extra or []),
    )


def with_bands(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """adds band_no: a band ends where the gap below its last row is over max(2.8 upper-median height, 28)."""
    by = by or ["page_id"]
    row, upward = Window.partitionBy(*by, "row_no"), Window.partitionBy(*by).orderBy("row_no")
    sized = S.with_upper_median(rowed, by, {"__mh": F.col("height")})
    b = sized.select("*", F.min("min_y").over(row).alias("__top"), F.max("max_y").over(row).alias("__bottom"))
    above = F.max(F.struct("row_no", "__bottom")).over(upward.rangeBetween(Window.unboundedPreceding, -1))["__bottom"]
    cut = F.when(F.col("__top") - above > F.greatest(F.col("__mh") * 2.8, F.lit(28.0)), F.col("row_no"))
    passed = F.size(F.collect_set("__cut").over(upward.rangeBetween(Window.unboundedPreceding, 0)))
    return b.withColumn("__cut", cut).withColumn("band_no", passed).drop("__top", "__bottom", "__mh", "__cut")


def bands(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, row_no, band_no) of with_bands()."""
    by = by or ["page_id"]
    return with_bands(rowed, by).groupBy(*by, "row_no").agg(F.first("band_no").alias("band_no"))


def gap_clusters(values: DataFrame, by: list[str], value: str, gap: Column | str) -> DataFrame:
    """adds cluster: numbers of runs of sorted values whose steps are at most gap (a column of values)."""
    w = Window.partitionBy(*by).orderBy(value)
    step = F.col(value) - F.lag(value).over(w)
    new = F.coalesce((step > (F.col(gap) if isinstance(gap, str) else gap)).cast("int"), F.lit(0))
    return values.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def anchors(xs: Column, height: Column, n_rows: Column) -> Column:
    """Column anchors of sorted centres: means of runs whose steps are at most max(1.5 height, 20); runs of one are dropped where there are three rows or more, unless none would be left."""
    empty = F.array().cast("array<struct<sum:double,n:int,last:double>>")

    def within(of: Column) -> Column:
        def step(runs: Column, x: Column) -> Column:
            last = F.try_element_at(runs, F.lit(-1))
            longer = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct((last["sum"] + x).alias("sum"), (last["n"] + 1).alias("n"), x.alias("last"))))
            return F.when(x - last["last"] <= of["gap"], longer).otherwise(F.array_append(runs, F.struct(x.alias("sum"), F.lit(1).alias("n"), x.alias("last"))))

        def strong(runs: Column) -> Column:
            return let(F.filter(runs, lambda k: (k["n"] > 1) | (of["n_rows"] < 3)), lambda several: F.transform(F.when(F.size(several) > 0, several).otherwise(runs), lambda k: k["sum"] / k["n"]))

        return F.aggregate(xs, empty, step, strong)

    return let(F.struct(F.greatest(height * 1.5, F.lit(20.0)).alias("gap"), n_rows.alias("n_rows")), within)


def column_anchors(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, anchors array<double>, n_rows): the anchors of each group's blocks."""
    by = by or ["page_id"]
    g = rowed.groupBy(*by).agg(F.array_sort(F.collect_list("center_x")).alias("xs"), F.collect_list("height").alias("hs"), F.size(F.collect_set("row_no")).alias("n_rows"))
    return g.select(*by, anchors(F.col("xs"), S.upper_median_of(F.col("hs")), F.col("n_rows")).alias("anchors"), "n_rows")


# A table's blocks as one array of structs, sorted by row_no and place: its rules as expressions, so that nothing is joined back.

ITEM = ("row_no", "place", "block_id", "text", *METRICS)


def items_of(rowed: DataFrame, by: list[str]) -> DataFrame:
    """(by, items): items has what ITEM names, as far as rowed has it."""
    return rowed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*(c for c in ITEM if c in rowed.columns)))).alias("items"))


def item_anchors(items: Column) -> Column:
    of = lambda c: F.transform(items, lambda i: i[c])
    return anchors(F.array_sort(of("center_x")), S.upper_median_of(of("height")), F.size(F.array_distinct(of("row_no"))))


def item_rows(items: Column) -> Column:
    """The rows of a table, as an array of arrays."""
    begins = lambda i, k: (k == 0) | (i["row_no"] != F.get(items, k - 1)["row_no"])
    return cut_at(items, F.array_compact(F.transform(items, lambda i, k: F.when(begins(i, k), k))))


def _snapped_rows(items: Column, columns: Column) -> Column:
    """Of each row, struct<col, offset, center_x, place, text> of its blocks."""
    snap = lambda i: let(S.nearest_pair(columns, i["center_x"]), lambda n: F.struct(n["i"].alias("col"), n["d"].alias("offset"), i["center_x"].alias("center_x"), i["place"].alias("place"), i["text"].alias("text")))
    return F.transform(item_rows(items), lambda row: F.transform(row, snap))


def with_cells(tables: DataFrame, when: Column | None = None) -> DataFrame:
    """tables (items) with anchors and cells: the rows' blocks with their columns; null where `when` is given and not true."""
    found = item_anchors(F.col("items"))
    return tables.withColumn("anchors", found if when is None else F.when(when, found)).withColumn("cells", F.when(F.col("anchors").isNotNull(), _snapped_rows(F.col("items"), F.col("anchors"))))


def _used(row: Column) -> Column:
    return F.size(F.array_distinct(F.transform(row, lambda c: c["col"])))


def is_table(cells: Column, n_cols: Column) -> dict[str, Column]:
    """n_rows, n_multi, n_cols, n_aligned and is_table: two rows or more of several blocks, 60 % of all, that fill two columns or more."""
    count = lambda rows, test: F.size(F.filter(rows, test))
    n_rows, n_multi, n_aligned = F.size(cells), count(cells, lambda r: F.size(r) >= 2), count(cells, lambda r: _used(r) >= 2)
    ok = (n_rows >= 2) & (n_multi >= 2) & (n_multi / n_rows >= 0.6) & (n_cols >= 2) & (n_aligned >= 2) & (n_aligned / n_rows >= 0.6)
    return {"n_rows": n_rows, "n_multi": n_multi, "n_cols": n_cols, "n_aligned": n_aligned, "is_table": ok}


def quality(tables: DataFrame) -> DataFrame:
    """adds fill, align, stab, collision, col_penalty, n_cols and score to with_cells(): how well rows snap to a grid; null below two columns."""
    n_cols, n_rows = F.size("anchors"), F.size("cells")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    t = tables.withColumn("__used", F.transform("cells", lambda r: _used(r).cast("double"))).withColumn("__mean", total(F.col("__used")) / n_rows)
    dev = F.sqrt(total(F.transform("__used", lambda u: (u - F.col("__mean")) * (u - F.col("__mean")))) / n_rows)
    drift = S.upper_median_of(F.flatten(F.transform("cells", lambda r: F.transform(r, lambda c: c["offset"]))))
    gaps = F.transform(F.slice("anchors", 2, n_cols), lambda a, i: a - F.get("anchors", i))
    step = F.greatest(F.coalesce(S.upper_median_of(gaps), F.lit(1.0)), F.lit(1.0))
    t = t.withColumns(
        {
            "fill": total(F.col("__used")) / (n_rows * n_cols),
            "align": F.greatest(F.lit(0.0), 1 - drift / (step * 0.5)),
            "stab": S.spread(F.col("__mean"), dev),
            "collision": F.size(F.filter("cells", lambda r: _used(r) < F.size(r))) / n_rows,
            "col_penalty": S.clamp((n_cols - WIDE_COLUMNS) / F.lit(float(WIDE_COLUMNS))),
            "n_cols": n_cols,
        }
    ).drop("__used", "__mean")
    c = F.col
    score = S.clamp(0.30 * c("fill") + 0.30 * c("align") + 0.20 * c("stab") + 0.20 * (1 - c("collision")) - 0.35 * c("col_penalty"))
    return t.withColumn("score", F.when(n_cols >= 2, score))


def cell_texts(cells: Column, n_cols: Column) -> Column:
    """array<array<string>>: of each row the escaped texts of its columns, those of one column joined in the order of their centres; rows without text are dropped."""
    text = lambda c: X.escape_cell(F.coalesce(c["text"], F.lit("")))
    ordered = lambda row: F.array_sort(F.transform(row, lambda c: F.struct(c["center_x"].alias("x"), c["place"].alias("k"), c["col"].alias("col"), text(c).alias("t"))))
    of_column = lambda row, k: F.array_join(F.transform(F.filter(row, lambda c: (c["col"] == k) & (c["t"] != "")), lambda c: c["t"]), " ")
    columns = F.sequence(F.lit(0), F.greatest(n_cols, F.lit(1)) - 1)
    filled = F.transform(cells, lambda row: let(ordered(row), lambda o: F.transform(columns, lambda k: of_column(o, k))))
    return F.filter(filled, lambda row: F.exists(row, lambda t: t != ""))


def snapped(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """adds anchors, col (nearest anchor, the first of equal ones), offset (distance to it), n_cols; a group is gathered once and not joined."""
    by = by or ["page_id"]
    g = rowed.groupBy(*by).agg(F.collect_list(F.struct(*(c for c in rowed.columns if c not in by))).alias("items"))
    b = g.withColumn("anchors", item_anchors(F.col("items"))).select(*by, "anchors", F.inline("items"))
    near = b.withColumn("__n", S.nearest_pair(F.col("anchors"), F.col("center_x")))
    return near.withColumns({"col": F.col("__n.i"), "offset": F.col("__n.d"), "n_cols": F.size("anchors")}).drop("__n")


def table_like(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_rows, n_multi, n_cols, n_aligned, is_table) of each group's blocks."""
    by = by or ["page_id"]
    t = with_cells(items_of(rowed, by))
    return t.select(*by, *(v.alias(k) for k, v in is_table(F.col("cells"), F.size("anchors")).items()))


def grid_quality(rowed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, fill, align, stab, collision, col_penalty, n_cols, score) of each group's blocks; groups below two columns are left out."""
    by = by or ["page_id"]
    q = quality(with_cells(items_of(rowed, by)))
    return q.where("n_cols >= 2").select(*by, "fill", "align", "stab", "collision", "col_penalty", "n_cols", "score")


# Routing of a recogniser's raw boxes.


def clusters_of(values: Column, tolerance: Column) -> Column:
    """array<int> of cluster numbers of sorted values by running mean."""
    return _centroid_fold(F.array_sort(values), "", tolerance)


def content_features(blocks: DataFrame) -> DataFrame:
    """(page_id, n, is_grid, is_complex, has_math, content_type) from text boxes; unclamped sizes.

    Grid: 4 boxes or more in 2 rows and 2 columns or more, two of each with
    several boxes, that fill 0.35 of rows times columns.  Complex: 6 boxes or
    more with an area variance over half the mean.
    """
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    g = blocks.groupBy("page_id").agg(
        F.count("*").alias("n"), F.collect_list("center_y").alias("ys"), F.collect_list("center_x").alias("xs"),
        F.collect_list(F.when(h > 0, h)).alias("hs"), F.collect_list(F.when(w > 0, w)).alias("ws"),
        F.var_pop(w * h).alias("area_var"), F.avg(w * h).alias("area_mean"), F.coalesce(F.bool_or(X.has_math(F.col("text"))), F.lit(False)).alias("has_math"),
    )
    g = g.withColumn("rows", clusters_of(F.col("ys"), F.greatest(S.upper_median_of(F.col("hs")) * 0.7, F.lit(8.0)))).withColumn("cols", clusters_of(F.col("xs"), F.greatest(S.upper_median_of(F.col("ws")) * 0.5, F.lit(12.0))))
    multi = lambda c: F.size(F.filter(F.array_distinct(c), lambda k: F.size(F.filter(c, lambda j: j == k)) >= 2))
    n_rows, n_cols = F.array_max("rows") + 1, F.array_max("cols") + 1
    grid = (F.col("n") >= 4) & (F.size("hs") > 0) & (F.size("ws") > 0) & (n_rows >= 2) & (n_cols >= 2) & (multi(F.col("rows")) >= 2) & (multi(F.col("cols")) >= 2) & (F.col("n") / F.greatest(n_rows * n_cols, F.lit(1)) >= 0.35)
    g = g.withColumn("is_grid", F.coalesce(grid, F.lit(False))).withColumn("is_complex", (F.col("n") >= 6) & (F.col("area_var") > F.col("area_mean") * 0.5))
    kind = F.when(F.col("is_grid"), F.when(F.col("is_complex"), "complex_table").otherwise("simple_table")).when(F.col("has_math"), "math_special").otherwise("pure_text")
    return g.select("page_id", "n", "is_grid", "is_complex", "has_math", kind.alias("content_type"))


def classify_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, content_type) of pages (page_id, error): mixed where reading failed, pure text where nothing was found, else by content_features()."""
    f = content_features(blocks).select("page_id", "content_type")
    failed = F.coalesce("error", F.lit("")) != ""
    return pages.join(f, "page_id", "left").select("page_id", F.when(failed, "mixed").otherwise(F.coalesce("content_type", F.lit("pure_text"))).alias("content_type"))


# Recognition engines by content type.
ENGINES = {"pure_text": "paddleocr_vl", "simple_table": "paddleocr_vl", "complex_table": "mineru", "mixed": "paddleocr_vl", "math_special": "mathpix_api"}
DEFAULT_ENGINE = "paddleocr_vl"


def engine_for(content_type: Column, engines: dict[str, str] | None = None, math_key: str = "") -> Column:
    out = F.lit(DEFAULT_ENGINE)
    for kind, engine in (ENGINES | (engines or {})).items():
        if engine == "mathpix_api" and not math_key:
            engine = DEFAULT_ENGINE
        out = F.when(content_type == kind, engine).otherwise(out)
    return out


# Regions.


def _levels(boxes: DataFrame) -> Column:
    """The exponent of the smallest power of two that is no smaller than a box's longer side."""
    return F.greatest(F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)))), F.lit(0)).cast("int")


def _tiled(boxes: DataFrame, levels: DataFrame) -> DataFrame:
    """boxes (page_id, x0, y0, x1, y1, ...) with level, tx, ty: a row per tile that a box touches, on each of its page's levels (page_id, levels) from its own on; so at most four a level."""
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    whole = boxes.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).withColumn("own_level", _levels(boxes))
    each = whole.join(levels, "page_id").withColumn("level", F.explode(F.filter("levels", lambda k: k >= F.col("own_level")))).drop("levels")
    return each.withColumn("tx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("ty", F.explode(F.sequence(at("y0"), at("y1"))))


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each pair of boxes of a page (page_id, x0, y0, x1, y1, and a_ or b_ columns of their own) that meet, edges included, once.

    An equi-join on tiles whose size doubles from level to level: a pair meets on
    the larger box's level, in the tile of the corner where their intersection
    begins.  So a page of any number of boxes is spread over its tiles.
    """
    every = a.select("page_id", _levels(a).alias("k")).union(b.select("page_id", _levels(b).alias("k"))).groupBy("page_id").agg(F.collect_set("k").alias("levels"))
    corners = ("x0", "y0", "x1", "y1", "own_level")
    named = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in corners})
    j = named(_tiled(a, every), "a").join(named(_tiled(b, every), "b"), ["page_id", "level", "tx", "ty"])
    size = F.pow(F.lit(2.0), F.col("level"))
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    meet = (x0 <= F.least("a_x1", "b_x1")) & (y0 <= F.least("a_y1", "b_y1")) & (F.col("level") == F.greatest("a_own_level", "b_own_level"))
    return j.where(meet & (F.floor(x0 / size) == F.col("tx")) & (F.floor(y0 / size) == F.col("ty"))).drop("level", "tx", "ty", "a_own_level", "b_own_level")


def blocks_in_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Text blocks whose centre lies in a region (page_id, region_id, x0, y0, x1, y1), edges included: centres, as boxes without size, that meet it."""
    texts = blocks.where((F.col("type") == "text") & F.col("center_x").isNotNull() & F.col("center_y").isNotNull())
    points = texts.select("page_id", F.col("center_x").alias("x0"), F.col("center_y").alias("y0"), F.col("center_x").alias("x1"), F.col("center_y").alias("y1"), F.struct(*blocks.columns).alias("a_row"))
    own = [c for c in regions.columns if c != "page_id"]
    boxes = regions.select("page_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.struct(*own).alias("b_row"))
    return meeting(points, boxes).select("a_row.*", *(F.col(f"b_row.{c}") for c in own))


def padded_boxes(regions: DataFrame, width: Column, height: Column, pad: int = 14, least: int = 8, most: int = 4) -> DataFrame:
    """The first `most` regions of a page, padded and clipped; those under `least` on a side are dropped."""
    w = Window.partitionBy("page_id").orderBy("region_id")
    zero = F.lit(0)
    out = regions.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")
    out = out.withColumns({"x0": F.greatest(F.rint("x0").cast("int") - pad, zero), "y0": F.greatest(F.rint("y0").cast("int") - pad, zero), "x1": F.least(F.rint("x1").cast("int") + pad, width), "y1": F.least(F.rint("y1").cast("int") + pad, height)})
    return out.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def match_enhanced(regions: DataFrame, enhanced: DataFrame, accept: float = 0.5) -> DataFrame:
    """Each region's enhanced table of the largest overlap, at least `accept`; of equal ones the first.  Columns: page_id, region_id, item_id, iou."""
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    one = regions.select("page_id", *box, F.struct("region_id", "x0", "y0", "x1", "y1").alias("a_row"))
    two = enhanced.select("page_id", *box, F.struct("item_id", "x0", "y0", "x1", "y1").alias("b_row"))
    a, b = [F.col(f"a_row.{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"b_row.{c}") for c in ("x0", "y0", "x1", "y1")]
    pairs = meeting(one, two).select("page_id", "a_row.region_id", "b_row.item_id", S.iou(a, b).alias("iou")).where(F.col("iou") > 0)
    best = pairs.groupBy("page_id", "region_id").agg(F.max_by(F.struct("item_id", "iou"), F.struct("iou", (-F.col("item_id")).alias("first"))).alias("m"))
    return best.select("page_id", "region_id", "m.item_id", "m.iou").where(F.col("iou") >= accept)


def applicability(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, n_cols, row_stab, reason, applicable): whether a region looks like a regular ruled table.

    Rows and columns are runs of centres (gaps over max(0.8 and 1.2 upper-median
    height, 8 and 12)); blocks belong to the nearest run centre of each.
    """
    mh = F.col("__mh")
    b = S.with_upper_median(blocks, by, {"__mh": F.col("max_y") - F.col("min_y")}).select(*by, "block_id", "center_x", "center_y", F.when(mh == 0, 1.0).otherwise(mh).alias("mh"))
    ys = gap_clusters(b, by, "center_y", F.greatest(F.col("mh") * 0.8, F.lit(8.0))).groupBy(*by, "cluster").agg(F.avg("center_y").alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("rows"))
    xs = gap_clusters(b, by, "center_x", F.greatest(F.col("mh") * 1.2, F.lit(12.0))).groupBy(*by, "cluster").agg(F.avg("center_x").alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("cols"))
    placed = b.join(ys, by).join(xs, by).select(*by, S.nearest(F.col("rows"), F.col("center_y")).alias("r"), S.nearest(F.col("cols"), F.col("center_x")).alias("k"), F.size("rows").alias("n_rows"), F.size("cols").alias("n_cols"))
    rows = placed.groupBy(*by, "r").agg(F.count_distinct("k").alias("used"), F.count("*").alias("n"), F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"))
    # A row cluster that no block is nearest to counts as a row of no columns.
    g = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"), F.sum("used").alias("s"), F.sum(F.col("used") * F.col("used")).alias("ss"))
    mean = F.col("s") / F.col("n_rows")
    dev = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n_rows") - mean * mean))
    g = g.withColumn("row_stab", S.spread(mean, dev))
    reason = (
        F.when(F.col("n") < 3, REASONS[0])
        .when(F.col("n_rows") < 3, REASONS[1])
        .when(F.col("n_cols") < 2, REASONS[2])
        .when(F.col("n_cols") > 12, REASONS[3])
        .when(F.col("row_stab") < 0.55, REASONS[4])
        .otherwise(REASONS[5])
    )
    return g.select(*by, "n_rows", "n_cols", "row_stab", reason.alias("reason"), (reason == REASONS[5]).alias("applicable"))


def built_tables(blocks: DataFrame) -> DataFrame:
    """Blocks of pages that hold a consistent grid, with row_no and place: 3 rows or more of several blocks, modal width 3 or more (the smallest of equal ones), 60 % of those rows within one of it."""
    rowed = assign_rows(blocks, order_in_row="center_x")
    rows = rowed.groupBy("page_id", "row_no").agg(F.count("*").alias("n")).where("n >= 2")
    mode = rows.groupBy("page_id", "n").agg(F.count("*").alias("k")).groupBy("page_id").agg(F.max_by("n", F.struct("k", (-F.col("n")).alias("small"))).alias("mode"), F.sum("k").alias("multi"))
    good = rows.join(mode, "page_id").where(F.abs(F.col("n") - F.col("mode")) <= 1)
    pages = good.groupBy("page_id").agg(F.count("*").alias("fit"), F.first("multi").alias("multi"), F.first("mode").alias("mode")).where((F.col("multi") >= 3) & (F.col("mode") >= 3) & (F.col("fit") >= 3) & (F.col("fit") / F.col("multi") >= 0.6))
    return rowed.join(good.select("page_id", "row_no").join(pages.select("page_id"), "page_id"), ["page_id", "row_no"])


def table_regions(built: DataFrame, pad: int = 8) -> DataFrame:
    """(page_id, x, y, w, h): the padded box around each page's built table, cut at the page's origin."""
    g = built.groupBy("page_id").agg(*(f(c).alias(c) for f, c in ((F.min, "min_x"), (F.max, "max_x"), (F.min, "min_y"), (F.max, "max_y"))))
    zero = F.lit(0)
    x0, y0 = F.greatest(F.col("min_x"), F.lit(0.0)).cast("int"), F.greatest(F.col("min_y"), F.lit(0.0)).cast("int")
    x1, y1 = F.col("max_x").cast("int"), F.col("max_y").cast("int")
    return g.select("page_id", F.greatest(x0 - pad, zero).alias("x"), F.greatest(y0 - pad, zero).alias("y"), (F.greatest(x1 - x0, F.lit(1)) + 2 * pad).alias("w"), (F.greatest(y1 - y0, F.lit(1)) + 2 * pad).alias("h"))


def grid_lines(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, line): whole midpoints between runs of centres, rows and columns of a virtual ruling."""
    b = S.with_upper_median(blocks, by, {"mh": F.col("max_y") - F.col("min_y")}).select(*by, "center_x", "center_y", "mh")
    out = None
    for axis, value, gap in (("row", "center_y", F.greatest(F.col("mh") * 0.8, F.lit(8.0))), ("column", "center_x", F.greatest(F.col("mh") * 1.2, F.lit(12.0)))):
        runs = gap_clusters(b, by, value, gap).groupBy(*by, "cluster").agg(F.min(value).alias("low"), F.max(value).alias("high"))
        nxt = F.lead("low").over(Window.partitionBy(*by).orderBy("cluster"))
        lines = runs.select(*by, F.lit(axis).alias("axis"), ((F.col("high") + nxt) / 2).cast("int").alias("line")).where("line is not null")
        out = lines if out is None else out.union(lines)
    return out
