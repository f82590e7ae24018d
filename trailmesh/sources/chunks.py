"""Edge and geometry chunks: columns of a chunk as arrays, and back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_BYTES = 14  # of an edge: three words of four bytes and two of one
POINT_BYTES, COUNT_BYTES = 8, 2  # of a shape's point, of a road's number of points
_COLUMNS = ("d_from", "rel", "length_cm", "direction", "category")


def edge_chunks(edges: DataFrame, size: int) -> DataFrame:
    """chunk, start, count and five arrays: differences of u, v - u, length, direction, category. A chunk has at most ``size`` edges."""
    rows = edges.withColumn("chunk", F.floor(F.col("edge") / size))
    w = Window.partitionBy("chunk").orderBy("edge")
    rows = rows.select("chunk", "edge", (F.col("u") - F.coalesce(F.lag("u").over(w), F.lit(0))).alias("d_from"), (F.col("v") - F.col("u")).alias("rel"), "length_cm", "direction", "category")
    packed = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("edge", *_COLUMNS))).alias("r"))
    return packed.select("chunk", F.col("r")[0]["edge"].alias("start"), F.size("r").alias("count"), *(F.col(f"r.{c}").alias(c) for c in _COLUMNS))


def read_edge_chunks(chunks: DataFrame) -> DataFrame:
    """edge, u, v, length_cm, direction, category: u is the running sum of its differences, v = u + rel."""
    return _edge_rows(chunks).drop("chunk")


def _edge_rows(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("chunk", "start", F.posexplode(F.arrays_zip(*_COLUMNS)).alias("p", "r")).select("chunk", (F.col("start") + F.col("p")).alias("edge"), "r.*")
    u = F.sum("d_from").over(Window.partitionBy("chunk").orderBy("edge").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("u", u).select("chunk", "edge", "u", (F.col("u") + F.col("rel")).alias("v"), "length_cm", "direction", "category")


def edge_chunk_violations(chunks: DataFrame, edges: int, nodes: int) -> DataFrame:
    """chunk, why: chunks beyond the edges or with columns of unequal size, and roads to nodes or of directions that aren't."""
    uneven = F.exists(F.array(*(F.size(c) for c in _COLUMNS)), lambda n: n != F.col("count"))
    layout = chunks.where((F.col("start") + F.col("count") > edges) | uneven).select("chunk", F.lit("layout").alias("why"))
    wrong = _edge_rows(chunks.where(~uneven)).where(f"u < 0 OR v < 0 OR u >= {nodes} OR v >= {nodes} OR direction > 2")
    return layout.unionByName(wrong.select("chunk", F.lit("connection").alias("why")).distinct())


def geometry_chunks(shapes: DataFrame, edges: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """chunk, start, counts, dx, dy: each road's number of points, and all their differences, from its first node on.

    ``shapes`` has edge and points (array of x, y) between a road's ends; roads without a row have none.
    """
    ends = edges.select("edge", "u").join(nodes.select(F.col("node").alias("u"), "x", "y"), "u").join(shapes, "edge", "left")
    points = F.coalesce("points", F.array().cast("array<struct<x:int,y:int>>"))
    line = F.concat(F.array(F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))), points)
    diff = lambda k: F.transform(points, lambda p, i: p[k] - F.get(line, i)[k])
    rows = ends.select(F.floor(F.col("edge") / size).alias("chunk"), F.struct("edge", F.size(points).alias("n"), diff("x").alias("dx"), diff("y").alias("dy")).alias("r"))
    packed = rows.groupBy("chunk").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select("chunk", F.col("r")[0]["edge"].alias("start"), F.col("r.n").alias("counts"), F.flatten("r.dx").alias("dx"), F.flatten("r.dy").alias("dy"))


def read_geometry_chunks(chunks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge, j, x, y: the points of each road, its ends included, in order.

    Points are dealt to roads by running sums of the counts; a chunk's arrays aren't repeated for its roads.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chunk").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    roads = chunks.select("chunk", "start", F.posexplode("counts").alias("p", "n")).withColumn("first", before)
    places = roads.where("n > 0").select("chunk", (F.col("start") + F.col("p")).alias("edge"), "first", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j"))
    points = chunks.select("chunk", F.posexplode(F.arrays_zip("dx", "dy")).alias("at", "d")).select("chunk", "at", "d.*")
    steps = places.withColumn("at", F.col("first") + F.col("j") - 1).join(points, ["chunk", "at"]).select("edge", "j", "dx", "dy")
    xy = nodes.select("node", "x", "y")
    ends = edges.select("edge", "u", "v")
    first = ends.join(xy, ends["u"] == xy["node"]).select("edge", F.lit(0).alias("j"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    along = Window.partitionBy("edge").orderBy("j")
    shape = steps.unionByName(first).select("edge", "j", F.sum("dx").over(along).alias("x"), F.sum("dy").over(along).alias("y"))
    counts = roads.select((F.col("start") + F.col("p")).alias("edge"), (F.col("n") + 1).alias("j"))
    last = ends.join(xy, ends["v"] == xy["node"]).join(counts, "edge").select("edge", "j", "x", "y")
    return shape.unionByName(last.select("edge", "j", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))


def vertices(counts: Column) -> Column:
    """Vertices that a chunk's roads are drawn with: two for each of a road's points + 1 segments."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + (n + 1) * 2)


def road_range(kind: Column, start: Column, count: Column, decoded_bytes: Column, drawn: Column) -> Column:
    """struct(start, count) of the roads that a geometry chunk's drawing holds; null where the layout isn't known, so that it must be decoded."""
    points = (decoded_bytes - count * COUNT_BYTES) / POINT_BYTES
    known = (kind == "geometry") & (start >= 0) & (count >= 1) & (points == F.floor(points)) & (points >= 0) & ((points + count) * 2 == drawn)
    return F.when(known, F.struct(start.alias("start"), count.alias("count")))


def should_compact(rows: Column, reached: Column, most: int = 2048) -> Column:
    """Whether a texture of the reached rows alone, at most ``most`` wide, has under half of all rows."""
    width = F.least(F.lit(most), F.greatest(F.lit(1), reached))
    return width * F.greatest(F.lit(1), F.ceil(reached / width)) * 2 < rows


def with_provenance(results: DataFrame, editions: DataFrame, by: str = "edition") -> DataFrame:
    """Results with the identity, compiler and profile of the edition that they were made from; unknown editions stay, with nulls."""
    return results.join(editions.select(by, F.struct("identity", "compiler", "profile").alias("dataset")), by, "left")
