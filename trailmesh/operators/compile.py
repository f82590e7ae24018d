"""Way-like records to nodes, edges and shapes, as one DataFrame pipeline.

Input ways have way_id, tags (map) and nodes (array of ref, lon, lat, valid is lon and lat not null).
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE
from ..model import CLASSES
from ..plans.ids import numbered

# Fixed values of the road profile.
ACCESS_KEYS = ["motorcar", "motor_vehicle", "vehicle", "access"]
DENIED = ["no", "private", "agricultural", "forestry"]
ONEWAY_YES = ["yes", "1", "true"]
CONTROLS = ["traffic_signals", "stop", "give_way", "motorway_junction"]


def category(highway: Column) -> Column:
    """Position among the road classes, or null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CLASSES)), highway), F.lit(0)).cast("int") - 1


def access(tags: Column) -> Column:
    """The first access key that is present, null without one."""
    return F.coalesce(*(F.element_at(tags, k) for k in ACCESS_KEYS))


def excluded(tags: Column, nodes: Column) -> Column:
    """Why a way isn't compiled: class, access or geometry; null for one that is."""
    denied = F.coalesce(access(tags).isin(DENIED), F.lit(False)) | F.coalesce(F.element_at(tags, "impassable") == "yes", F.lit(False))
    bad = (F.coalesce(F.size(nodes), F.lit(0)) < 2) | ~F.forall(nodes, lambda n: n["lon"].isNotNull() & n["lat"].isNotNull())
    return F.when(category(F.element_at(tags, "highway")).isNull(), "class").when(denied, "access").when(bad, "geometry")


def direction(tags: Column) -> Column:
    """0 both, 1 along, 2 against: an explicit oneway wins over roundabouts and motorways."""
    oneway = F.element_at(tags, "oneway")
    implied = (F.coalesce(F.element_at(tags, "junction"), F.lit("")) == "roundabout") | (F.coalesce(F.element_at(tags, "highway"), F.lit("")) == "motorway")
    return F.when(oneway == "-1", 2).when(oneway.isin(ONEWAY_YES), 1).when(oneway.isNull() & implied, 1).otherwise(0)


def project_tags(tags: Column, keys: list[str]) -> Column:
    """Tags whose key, or its part before a colon, is one of the keys."""
    return F.map_filter(tags, lambda k, _: F.substring_index(k, ":", 1).isin(keys))


def profile_ids(ways: DataFrame, keys: list[str]) -> DataFrame:
    """way_id, profile: the number of the way's projected tags in order of first appearance."""
    tagged = ways.select("way_id", F.to_json(F.array_sort(F.map_entries(project_tags(F.col("tags"), keys)))).alias("tags"))
    first = numbered(tagged.groupBy("tags").agg(F.min("way_id").alias("way")), ["way"], "profile").select("tags", "profile")
    return tagged.join(first, "tags").select("way_id", "profile")


def selected(ways: DataFrame) -> DataFrame:
    return ways.where(excluded(F.col("tags"), F.col("nodes")).isNull())


def excluded_counts(ways: DataFrame) -> DataFrame:
    return ways.select(excluded(F.col("tags"), F.col("nodes")).alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def way_nodes(ways: DataFrame) -> DataFrame:
    """way_id, pos, ref, lon, lat, last."""
    return ways.select("way_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node")).select("way_id", "pos", "node.ref", "node.lon", "node.lat", (F.col("pos") == F.col("n") - 1).alias("last"))


def node_uses(points: DataFrame) -> DataFrame:
    return points.groupBy("ref").agg(F.count(F.lit(1)).alias("uses"))


def segments(points: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Points with the number of their segment: a way is split at ends, shared nodes and stops; split points are in both segments."""
    at = points.join(node_uses(points), "ref")
    if stops is not None:
        at = at.join(stops.select("ref", F.lit(True).alias("stop")).distinct(), "ref", "left")
    w = Window.partitionBy("way_id").orderBy("pos")
    cut = (F.col("pos") > 0) & ~F.col("last") & ((F.col("uses") > 1) | (F.coalesce(F.col("stop"), F.lit(False)) if stops is not None else F.lit(False)))
    at = at.withColumn("cut", cut).withColumn("seg", F.sum(F.col("cut").cast("int")).over(w))
    # the point of a cut opens its segment and also closes the one before
    both = F.when(F.col("cut"), F.array(F.col("seg") - 1, F.col("seg"))).otherwise(F.array("seg"))
    return at.select("way_id", "pos", "ref", "lon", "lat", F.explode(both).alias("seg"))


def segment_length_cm(parts: DataFrame) -> DataFrame:
    """way_id, seg, from_ref, to_ref, first, points, length_cm: planar lengths with half-even rounding to centimetres."""
    w = Window.partitionBy("way_id", "seg").orderBy("pos")
    lon0, lat0 = F.lag("lon").over(w), F.lag("lat").over(w)
    step = F.hypot((F.col("lon") - lon0) * F.cos(F.radians((F.col("lat") + lat0) / 2)), F.col("lat") - lat0) * METRES_PER_DEGREE
    sized = parts.withColumn("step", F.coalesce(step, F.lit(0.0)))
    out = sized.groupBy("way_id", "seg").agg(F.min_by("ref", "pos").alias("from_ref"), F.max_by("ref", "pos").alias("to_ref"), F.min("pos").alias("first"), F.count(F.lit(1)).alias("points"), F.bround(F.sum("step") * 100).cast("long").alias("length_cm"))
    return out.where("points > 1")


def dense_nodes(parts: DataFrame, order: DataFrame) -> DataFrame:
    """ref, node, x, y: ids by first encounter over ways in their order, then position."""
    ends = parts.select("way_id", "seg", "pos", "ref", "lon", "lat").join(order, ["way_id", "seg"]).where((F.col("ref") == F.col("from_ref")) | (F.col("ref") == F.col("to_ref")))
    first = ends.groupBy("ref").agg(F.min(F.struct("way_id", "pos")).alias("f"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    first = numbered(first.select("ref", "f.way_id", "f.pos", "lon", "lat"), ["way_id", "pos"], "node")
    return first.select("ref", "node", F.bround(F.col("lon") * 100000).cast("int").alias("x"), F.bround(F.col("lat") * 100000).cast("int").alias("y"))


def compile_graph(ways: DataFrame, stops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): node, x, y, osm_id and edge, u, v, length_cm, direction, category, way_id."""
    kept = selected(ways)
    parts = segments(way_nodes(kept), stops)
    sized = segment_length_cm(parts)
    ids = dense_nodes(parts, sized.select("way_id", "seg", "from_ref", "to_ref")).persist()
    tags = kept.select("way_id", direction(F.col("tags")).alias("direction"), category(F.element_at("tags", F.lit("highway"))).alias("category"))
    e = sized.join(ids.select(F.col("ref").alias("from_ref"), F.col("node").alias("u")), "from_ref").join(ids.select(F.col("ref").alias("to_ref"), F.col("node").alias("v")), "to_ref").join(tags, "way_id")
    edges = numbered(e, ["way_id", "seg"], "edge").select("edge", "u", "v", "length_cm", "direction", "category", "way_id")
    return ids.select("node", "x", "y", F.col("ref").alias("osm_id")), edges


def control_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (ref, tags) that control traffic: with any barrier, or a highway of CONTROLS. Their refs are ``stops`` of segments."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    return nodes.where(tag("barrier").isNotNull() | F.coalesce(tag("highway").isin(CONTROLS), F.lit(False)))


def restrictions_kept(restrictions: DataFrame, ways: DataFrame) -> DataFrame:
    """Restrictions with a member way that is compiled."""
    members = restrictions.select("id", F.explode("members").alias("m")).where("m.type = 'w'").select("id", F.col("m.ref").alias("way_id"))
    return restrictions.join(members.join(ways.select("way_id"), "way_id", "left_semi").select("id"), "id", "left_semi")


def resolve_members(restrictions: DataFrame, way_ids: DataFrame, node_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with dense ids, unresolved count by type): members without a match stay, with null."""
    m = restrictions.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.type", "m.ref", "m.role")
    ids = way_ids.select(F.lit("w").alias("type"), F.col("way_id").alias("ref"), F.col("edge").alias("dense")).unionByName(node_ids.select(F.lit("n").alias("type"), F.col("ref"), F.col("node").alias("dense")))
    found = m.join(ids, ["type", "ref"], "left")
    return found, found.groupBy("type").agg(F.sum(F.col("dense").isNull().cast("long")).alias("unresolved"), F.count(F.lit(1)).alias("members"))


def composite(sources: list[DataFrame], box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(ways, missing): sources merged, equal (way_id, version) once, ways touching the box whole; references without a location."""
    merged = sources[0]
    for s in sources[1:]:
        merged = merged.unionByName(s)
    merged = merged.dropDuplicates(["way_id", "version"])
    west, south, east, north = box
    inside = F.exists("nodes", lambda n: (n["lon"] >= west) & (n["lon"] <= east) & (n["lat"] >= south) & (n["lat"] <= north))
    kept = merged.where(inside)
    refs = kept.select("way_id", F.explode("nodes").alias("n")).where("n.lon IS NULL OR n.lat IS NULL").select("way_id", F.col("n.ref").alias("ref"))
    located = merged.select(F.explode("nodes").alias("n")).where("n.lon IS NOT NULL").select(F.col("n.ref").alias("ref")).distinct()
    return kept, refs.join(located, "ref", "left_anti")


# ---------------------------------------------------------------- simplification
def _off_chord(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Squared distances of points to the chord between two points."""
    chord, rel = last - first, points - first
    length = chord @ chord
    along = np.clip(rel @ chord / length, 0, 1) if length > 0 else np.zeros(len(points))
    rest = rel - np.outer(along, chord)
    return np.einsum("ij,ij->i", rest, rest)


def simplify_points(xs: list[float], ys: list[float], tolerance: float, lat: float | None = None) -> list[int]:
    """Positions kept by Douglas-Peucker, spans taken breadth first and measured whole.

    A span is split at its furthest point (the first of equal ones) if that is further than the
    tolerance. With lat, degrees in metres.
    """
    scale = (METRES_PER_DEGREE * math.cos(math.radians(lat)), METRES_PER_DEGREE) if lat is not None else (1.0, 1.0)
    line = np.column_stack((xs, ys)).reshape(-1, 2) * scale
    kept = np.zeros(len(line), bool)
    kept[[0, -1] if len(line) else []] = True
    spans = deque([slice(0, len(line))] if len(line) > 2 else [])
    while spans:
        s = spans.popleft()
        off = _off_chord(line[s.start + 1 : s.stop - 1], line[s.start], line[s.stop - 1])
        k = int(off.argmax())
        if off[k] > tolerance * tolerance:
            middle = s.start + 1 + k
            kept[middle] = True
            spans.extend(part for part in (slice(s.start, middle + 1), slice(middle, s.stop)) if part.stop - part.start > 2)
    return np.flatnonzero(kept).tolist()


def simplify(points: Column, tolerance: float) -> Column:
    """array<struct<x, y>> in degrees, simplified at a tolerance in metres."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for ps in s:
            if ps is None:
                out.append(None)
                continue
            ps = list(ps)
            xs, ys = [p["x"] for p in ps], [p["y"] for p in ps]
            keep = simplify_points(xs, ys, tolerance, sum(ys) / len(ys) if ys else 0.0)
            out.append([{"x": xs[i], "y": ys[i]} for i in keep])
        return pd.Series(out)

    return run(points)


def simplify_ring(xs: list[float], ys: list[float], tolerance: float) -> list[int]:
    """Positions kept of a closed ring: all of them where a simplified ring would have under four."""
    kept = simplify_points(xs, ys, tolerance)
    return kept if len(kept) > 3 else list(range(len(xs)))
