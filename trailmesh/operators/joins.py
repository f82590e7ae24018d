"""Joins that Spark has no operator for: as-of, ranges, views, distinct-pair and triple candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], stretch: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its group at or before it.

    One shuffle: both sides are dealt by the group together and the last value is carried
    along the order. ``stretch`` also deals groups by spans of ``on`` so that one large group
    isn't one task; spans pass their last value on through one row each.
    """
    marked = left.select(*by, on, F.struct(*(left[c] for c in left.columns)).alias("__l"), F.lit(None).cast(_type(right, values)).alias("__v"), F.lit(1).alias("__o"))
    marked = marked.unionByName(right.select(*by, on, F.lit(None).cast(_type_of(left)).alias("__l"), F.struct(*values).alias("__v"), F.lit(0).alias("__o")))
    span = F.floor(F.col(on) / stretch) if stretch else F.lit(0)
    marked = marked.withColumn("__s", span)
    within = Window.partitionBy(*by, "__s").orderBy(on, "__o").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__found", F.last("__v", ignorenulls=True).over(within))
    if stretch:
        ends = marked.where("__v IS NOT NULL").groupBy(*by, "__s").agg(F.max_by("__v", F.struct(on)).alias("__end"))
        spans = marked.select(*by, "__s").distinct().join(ends, [*by, "__s"], "left")
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
        spans = spans.select(*by, "__s", before.alias("__before"))
        marked = marked.join(spans, [*by, "__s"]).withColumn("__found", F.coalesce("__found", "__before"))
    return marked.where("__l IS NOT NULL").select("__l.*", *(F.col(f"__found.{v}").alias(v) for v in values))


def _type(df: DataFrame, values: list[str]):
    return df.select(F.struct(*values).alias("x")).schema["x"].dataType


def _type_of(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType


def range_lookup(points: DataFrame, ranges: DataFrame, value: str, first: str, last: str, width: int) -> DataFrame:
    """Inner join on first <= value <= last: an equi-join on cells of ``width``; a range is in every cell that it touches.

    A width near the ranges' usual length keeps copies few.
    """
    cells = ranges.withColumn("__c", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    at = points.withColumn("__c", F.floor(F.col(value) / width))
    return at.join(cells, (at["__c"] == cells["__c"]) & (F.col(value) >= F.col(first)) & (F.col(value) <= F.col(last))).drop("__c")


def viewport_cull(views: DataFrame, boxes: DataFrame, cell: float, padding: float = 1.0) -> DataFrame:
    """Pairs of a view and a box (x1, y1, x2, y2) that overlap, views padded; a grid join, each pair once."""

    def cells(df: DataFrame, p: str, pad: float) -> DataFrame:
        x = F.sequence(F.floor((F.col(f"{p}x1") - pad) / cell), F.floor((F.col(f"{p}x2") + pad) / cell))
        y = F.sequence(F.floor((F.col(f"{p}y1") - pad) / cell), F.floor((F.col(f"{p}y2") + pad) / cell))
        return df.withColumn("__x", F.explode(x)).withColumn("__y", F.explode(y))

    a, b = cells(views, "v_", padding), cells(boxes, "b_", 0)
    hit = (F.col("v_x1") - padding <= F.col("b_x2")) & (F.col("v_x2") + padding >= F.col("b_x1")) & (F.col("v_y1") - padding <= F.col("b_y2")) & (F.col("v_y2") + padding >= F.col("b_y1"))
    # a pair is met in several cells: it counts in the cell of its common corner
    corner = (F.floor(F.greatest(F.col("v_x1") - padding, F.col("b_x1")) / cell) == a["__x"]) & (F.floor(F.greatest(F.col("v_y1") - padding, F.col("b_y1")) / cell) == a["__y"])
    return a.join(b, (a["__x"] == b["__x"]) & (a["__y"] == b["__y"]) & hit & corner).drop("__x", "__y")


def viewport_sums(views: DataFrame, boxes: DataFrame, cell: float, view: str, value: str, padding: float = 1.0) -> DataFrame:
    """view, n, total: how many boxes each view overlaps and the sum of their values; views without a box are left out.

    Equal boxes are summed first, and equal views are met once: pairs grow with the places that there are, not with the rows at them.
    """
    at_view, at_box = ([f"{p}{c}" for c in ("x1", "y1", "x2", "y2")] for p in ("v_", "b_"))
    summed = boxes.groupBy(*at_box).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__t"))
    hit = viewport_cull(views.select(*at_view).distinct(), summed, cell, padding)
    found = hit.groupBy(*at_view).agg(F.sum("__n").alias("n"), F.sum("__t").alias("total"))
    return views.join(found, at_view).select(view, "n", "total")


def pairs_within(df: DataFrame, key: str, by: str, near: Column | None = None) -> DataFrame:
    """Pairs a < b of rows of the same group; ``near`` is a condition on a.* and b.*. For small dimension tables."""
    a, b = df.alias("a"), df.alias("b")
    on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return a.join(b, on & near if near is not None else on)


def first_of(sources: list[DataFrame], key: str, by: str) -> DataFrame:
    """Rows of all sources, a key once: that of the first source that has it, numbered in ``by``; of ties the least row."""
    marked = [s.withColumn(by, F.lit(i)) for i, s in enumerate(sources)]
    merged = marked[0]
    for s in marked[1:]:
        merged = merged.unionByName(s)
    rest = [c for c in merged.columns if c != key]
    least = F.min(F.struct(by, *(c for c in rest if c != by))).alias("__row")
    return merged.groupBy(key).agg(least).select(key, *(F.col("__row")[c].alias(c) for c in rest))
