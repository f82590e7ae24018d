"""Borders and lakes: GeoJSON in, rings checked, points placed in polygons, lakes kept on land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import c, inside_ring, longitude_offset, ring_area, valid_ring
from ..model import METRES_PER_DEGREE

FEATURES = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:array<array<array<array<double>>>>>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, polygons of the MultiPolygon features of GeoJSON files: arrays of polygons of rings of struct<x, y>."""
    f = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.element_at("f.properties", "id").alias("id"), F.col("f.properties").alias("properties"), rings_of(F.col("f.geometry.coordinates")).alias("polygons"))


def rings_of(coordinates: Column) -> Column:
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(coordinates, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def ring_violations(features: DataFrame) -> DataFrame:
    """id, polygon, ring: rings that aren't closed, finite, in range and of four points."""
    each = features.select("id", F.posexplode("polygons").alias("polygon", "rings")).select("id", "polygon", F.posexplode("rings").alias("ring", "r"))
    return each.where(~valid_ring("r")).select("id", "polygon", "ring")


def inside_polygon(px, py, rings) -> Column:
    """In the outer ring and in none of the holes."""
    rings = c(rings)
    inner = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) > 0, inside_ring(px, py, F.element_at(rings, 1)) & ~F.exists(inner, lambda h: inside_ring(px, py, h))).otherwise(False)


def inside_any(px, py, polygons) -> Column:
    return F.exists(c(polygons), lambda p: inside_polygon(px, py, p))


def bounding_box(polygons: Column) -> Column:
    points = F.flatten(F.flatten(polygons))
    low, high = (lambda k: F.array_min(F.transform(points, lambda p: p[k]))), (lambda k: F.array_max(F.transform(points, lambda p: p[k])))
    return F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))


def covered(lon, lat, west, south, east, north, centre=0.0) -> Column:
    """In a box, with longitudes taken around a centre so that boxes over the antimeridian work."""
    x, a, b = (longitude_offset(v, centre) for v in (lon, west, east))
    return x.between(a, b) & c(lat).between(c(south), c(north))


def points_in(points: DataFrame, features: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points (x, y) with the ids of the features they are in: an equi-join on grid cells of the boxes, then the exact test."""
    boxed = features.select("id", "polygons", bounding_box(F.col("polygons")).alias("b"))
    boxed = boxed.withColumn("cx", F.explode(F.sequence(F.floor(F.col("b.x1") / cell), F.floor(F.col("b.x2") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("b.y1") / cell), F.floor(F.col("b.y2") / cell))))
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.join(boxed, ["cx", "cy"]).where(inside_any(F.col("x"), F.col("y"), F.col("polygons"))).drop("cx", "cy", "b", "polygons")


def area_km2(polygons: Column) -> Column:
    """Outer rings less holes, in square kilometres at each ring's mean latitude."""

    def ring(r: Column) -> Column:
        lat = F.aggregate(r, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(r)
        return ring_area(r) * F.cos(F.radians(lat)) * (METRES_PER_DEGREE / 1000) ** 2

    def polygon(p: Column) -> Column:
        inner = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        return ring(F.element_at(p, 1)) - F.aggregate(inner, F.lit(0.0), lambda s, h: s + ring(h))

    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + polygon(p))


def lakes_on_land(lakes: list[DataFrame], land: DataFrame, cell: float = 1.0) -> DataFrame:
    """id, name, area_km2, polygons: lakes of all sources with a vertex on land; an id once, from the first source with such a lake."""
    merged = lakes[0].withColumn("source", F.lit(0))
    for n, more in enumerate(lakes[1:], 1):
        merged = merged.unionByName(more.withColumn("source", F.lit(n)))
    corners = merged.select(F.struct("id", "source").alias("lake"), F.explode(F.flatten(F.flatten("polygons"))).alias("p")).select("lake", "p.x", "p.y").distinct()
    first = points_in(corners, land, cell).groupBy(F.col("lake.id").alias("id")).agg(F.min("lake.source").alias("source"))
    kept = merged.join(first, ["id", "source"], "left_semi").dropDuplicates(["id"])
    return kept.select("id", F.element_at("properties", "name").alias("name"), area_km2(F.col("polygons")).alias("area_km2"), "polygons")


def place_of_slug(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """slug with its place's columns; a slug of two places raises, an unknown one is left out."""
    twice = places.join(wanted.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(F.count_distinct("id").alias("n")).where("n > 1").select("slug").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['slug']} names more than one place")
    return wanted.join(places, "slug")
