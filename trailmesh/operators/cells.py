"""Pairs of places by cells: whole pairs of cells are decided by their least and greatest distance, only border pairs are expanded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import straight_line_km
from ..plans.fixpoint import forget, settle

DIAMETER_KM = 12742.0176
EXPAND = 1024  # pairs of positions that an undecided pair of cells may be expanded into, rather than split
DEPTH = 18  # halvings of a first cell: the last ones are about three metres wide
SLACK_KM = 1e-3  # cells decide nothing nearer to a threshold than this


def _class(km: Column, steps: Sequence[float]) -> Column:
    """How many of the ascending steps a distance reaches."""
    return sum((F.when(km >= s, 1).otherwise(0) for s in steps), F.lit(0))


def _positions(points: DataFrame, by: list[str]) -> DataFrame:
    """by, lon, lat, n, x, y, z: rows of one place together, as a point of the unit sphere."""
    lon, lat = F.radians("lon"), F.radians("lat")
    at = points.where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)").groupBy(*by, "lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    return at.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _cell(level: int) -> Column:
    """The octree cell of a point of the unit sphere: each level halves the one above."""
    return F.struct(*(F.floor((F.col(a) + 1) * 2**level / 2).alias(a) for a in "xyz"))


def _boxes(at: DataFrame, by: list[str], level: int) -> DataFrame:
    """by, cell, up (the cell above), m (positions), n (rows) and the box of what the cell holds."""
    ends = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((1, F.min), (2, F.max))]
    made = at.withColumn("cell", _cell(level)).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.struct(*ends).alias("box"))
    return made.withColumn("up", F.struct(*(F.floor(F.col("cell")[a] / 2).alias(a) for a in "xyz")))


def _between(a: Column, b: Column) -> tuple[Column, Column]:
    """The least and the greatest kilometres between points of two boxes: chords grow with distances along the ground."""
    least = [F.greatest(a[f"{c}1"] - b[f"{c}2"], b[f"{c}1"] - a[f"{c}2"], F.lit(0.0)) for c in "xyz"]
    most = [F.greatest(a[f"{c}2"] - b[f"{c}1"], b[f"{c}2"] - a[f"{c}1"]) for c in "xyz"]
    km = lambda d: DIAMETER_KM * F.asin(F.least(F.lit(1.0), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 2))
    return km(least), km(most)


def pair_counts(points: DataFrame, by: list[str], steps: Sequence[float], first: int = 4, few: int = EXPAND) -> DataFrame:
    """by, step, pairs, expanded: unordered pairs of a group's rows (lon, lat) by how many of the ascending ``steps`` (km) they reach.

    ``expanded`` of them come from distances of positions, the others from whole pairs of cells. Pairs of cells that lie
    within one step are counted at once; others are expanded if they hold at most ``few`` pairs of positions, and else both
    cells are split, all at once, one round a level. Rows of one position are one position with a count, so neither a hot group
    nor a hot place is expanded. Distances are rounded to six digits of a kilometre before they are compared. Rows without a
    place take no part; an empty table gives no rows. Null groups are groups.
    """
    named = {b: f"__by{i}" for i, b in enumerate(by)}  # nulls must meet: groups are compared as text that has no null
    plain = points.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("g"), F.struct(*(F.col(b).alias(named[b]) for b in by)).alias("group"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    groups = plain.groupBy("g").agg(F.first("group").alias("group"))
    at = settle(_positions(plain, ["g"]))
    made: list[DataFrame] = []
    kept = [at]

    def halves(level: int) -> tuple[DataFrame, DataFrame]:
        b = _boxes(at, ["g"], level)
        return tuple(b.select("g", *(F.col(c).alias(f"{p}_{c}") for c in ("cell", "up", "m", "n", "box"))) for p in "ab")

    def judged(pairs: DataFrame) -> DataFrame:
        low, high = _between(F.col("a_box"), F.col("b_box"))
        pairs = pairs.withColumns({"__low": low - SLACK_KM, "__high": high + SLACK_KM})
        same = F.col("a_cell") == F.col("b_cell")
        size = F.when(same, F.col("a_m") * (F.col("a_m") + 1) / 2).otherwise(F.col("a_m") * F.col("b_m"))
        kinds = F.when(_class(F.col("__low"), steps) == _class(F.col("__high"), steps), "whole").when(size <= few, "border").otherwise("split")
        rows = F.when(same, F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")
        return pairs.select("g", "a_cell", "b_cell", F.col("a_cell").alias("a_up"), F.col("b_cell").alias("b_up"), _class(F.col("__low"), steps).alias("step"), rows.alias("rows"), kinds.alias("kind"))

    def expanded(border: DataFrame, level: int) -> DataFrame:
        p = at.withColumn("cell", _cell(level))
        a, b = (p.select("g", *(F.col(c).alias(f"{k}_{c}") for c in ("cell", "lon", "lat", "n"))) for k in "ab")
        met = border.select("g", "a_cell", "b_cell").join(a, ["g", "a_cell"]).join(b, ["g", "b_cell"])
        place = lambda k: F.struct(f"{k}_lon", f"{k}_lat")
        met = met.where((F.col("a_cell") != F.col("b_cell")) | (place("a") <= place("b")))
        rows = F.when(place("a") == place("b"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")
        km = F.round(straight_line_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")), 6)
        return met.select("g", _class(km, steps).alias("step"), rows.alias("pairs"), rows.alias("expanded"))

    a, b = halves(first)
    pairs = a.join(b, "g").where("a_cell <= b_cell")  # the cells of one level: a bounded number on the sphere
    level = first
    while True:
        state = settle(judged(pairs))
        kept.append(state)
        made.append(state.where("kind = 'whole'").select("g", "step", F.col("rows").alias("pairs"), F.lit(0).cast("long").alias("expanded")))
        last = level == first + DEPTH
        made.append(expanded(state.where("kind != 'whole'" if last else "kind = 'border'"), level))
        split = state.where("kind = 'split'").select("g", "a_up", "b_up")
        if last or not split.take(1):
            break
        level += 1
        a, b = halves(level)
        pairs = split.join(a, ["g", "a_up"]).join(b, ["g", "b_up"]).where("a_up != b_up OR a_cell <= b_cell")
    every = made[0]
    for m in made[1:]:
        every = every.unionByName(m)
    out = settle(every.groupBy("g", "step").agg(F.sum("pairs").alias("pairs"), F.sum("expanded").alias("expanded")).where("pairs > 0"))
    for k in kept:
        forget(k)
    return out.join(groups, "g").select(*(F.col("group")[named[b]].alias(b) for b in by), "step", "pairs", "expanded")
