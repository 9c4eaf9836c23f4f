"""Aggregates and box arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def upper_median(column: str) -> Column:
    """sorted[n // 2] of a group: the larger middle value of an even number."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def upper_median_of(values: Column) -> Column:
    """The same of an array; null of an empty one."""
    return let(F.array_sort(values), lambda v: F.try_element_at(v, F.floor(F.size(v) / 2).cast("int") + 1))


def with_upper_median(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """adds, under each name, sorted[n // 2] of a value within its group; null values don't count.

    Ranks are counted in a window that is sorted and streamed: no list of a
    group's values is gathered, so a group may be of any size.
    """
    every = Window.partitionBy(*by)
    for name, value in values.items():
        rank = F.row_number().over(every.orderBy(F.col("__v").asc_nulls_last()))
        df = df.withColumn("__v", value).withColumns({"__r": rank, "__n": F.count("__v").over(every)})
        middle = F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col("__v"))).over(every)
        df = df.withColumn(name, middle).drop("__v", "__r", "__n")
    return df


def spread(mean: Column, deviation: Column) -> Column:
    """1 - deviation / max(mean, 1), not below 0."""
    return F.greatest(F.lit(0.0), 1 - deviation / F.greatest(mean, F.lit(1.0)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def box_metrics(bbox: Column) -> dict[str, Column]:
    """Extents, centre and size of a list of points; a missing box is all zero, sizes are at least 1."""
    xs, ys = F.transform(bbox, lambda p: p["x"]), F.transform(bbox, lambda p: p["y"])
    zero = F.lit(0.0)
    x0, x1, y0, y1 = (F.coalesce(f(v), zero) for f, v in ((F.array_min, xs), (F.array_max, xs), (F.array_min, ys), (F.array_max, ys)))
    return {"min_x": x0, "max_x": x1, "min_y": y0, "max_y": y1, "center_x": (x0 + x1) / 2, "center_y": (y0 + y1) / 2, "width": F.greatest(x1 - x0, F.lit(1.0)), "height": F.greatest(y1 - y0, F.lit(1.0))}


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two corner boxes; 0 where they do not meet."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    inside = w * h
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0)) * F.greatest(r[3] - r[1], F.lit(0))
    union = area(a) + area(b) - inside
    return F.when((inside > 0) & (union > 0), inside / union).otherwise(F.lit(0.0))


def nearest_pair(anchors: Column, x: Column) -> Column:
    """struct<d, i>: distance and index (from 0) of the anchor nearest to x; the first of equal ones."""
    return F.array_min(F.transform(anchors, lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i"))))


def nearest(anchors: Column, x: Column) -> Column:
    return nearest_pair(anchors, x)["i"]


def has_structure(fill: Column, stab: Column, rows: Column, cols: Column) -> Column:
    """Structure score: 0.45 fill + 0.35 stability + 0.20 size."""
    return clamp(0.45 * fill + 0.35 * stab + 0.20 * F.least(F.lit(1.0), rows * cols / 12.0))
