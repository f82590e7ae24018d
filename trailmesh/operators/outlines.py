"""Union of outlines: segments are cut where they meet, inner sides go, and the rest is stitched into rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import forget, settle

FINE = 1 << 20  # steps of a unit in which crossings are placed
MOST = 1 << 25  # units that an extent may have, so that the tests of sides are exact in 64 bits
CROWD = 64  # segments of a cell beyond which it is quartered
DEEPEST = 26  # quarterings: cells are of one unit then
_LINE = ["lx", "ly", "hx", "hy"]
_PIECE = ["px", "py", "qx", "qy"]


def _side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Over 0 left of a to b, under 0 right, 0 on the line."""
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def _segments(features: DataFrame, by: list[str], unit: float) -> DataFrame:
    """g, shape, lx, ly, hx, hy, left: segments from their smaller to their larger end, and whether the inside is on the left."""
    polygons = features.select(F.struct(*by).alias("g"), F.explode("polygons").alias("rings")).dropDuplicates()
    rings = polygons.withColumn("shape", F.monotonically_increasing_id()).select("g", "shape", F.posexplode("rings").alias("at", "ring"))
    whole = lambda v: F.round(v / unit).cast("long")
    rings = rings.select("g", "shape", "at", F.transform("ring", lambda p: F.struct(whole(p["x"]).alias("x"), whole(p["y"]).alias("y"))).alias("ring")).where(F.size("ring") >= 4)
    sides = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.element_at("ring", 1)
    twice = F.aggregate("s", F.lit(0).cast("decimal(38,0)"), lambda t, s: (t + _side(first["x"], first["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])).cast("decimal(38,0)"))
    inside_left = (F.when(F.col("at") == 0, twice).otherwise(-twice)) > 0
    each = rings.withColumn("s", sides).select("g", "shape", inside_left.alias("left"), F.explode("s").alias("s")).where("s.a != s.b")
    swap = F.col("s.a") > F.col("s.b")
    ends = [F.when(swap, F.col(f"s.{b}")).otherwise(F.col(f"s.{a}")).alias(n) for a, b, n in (("a.x", "b.x", "lx"), ("a.y", "b.y", "ly"), ("b.x", "a.x", "hx"), ("b.y", "a.y", "hy"))]
    return each.select("g", "shape", *ends, (F.col("left") != swap).alias("left"))


def _quarter(dealt: DataFrame, side: int) -> DataFrame:
    """Segments in the quarters, of ``side`` units, of their cells that they touch."""
    parts = F.array(*(F.struct((F.col("cx") * 2 + i).alias("x"), (F.col("cy") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)))
    at = dealt.select("g", *_LINE, F.explode(parts).alias("c"))
    x1, y1 = F.col("c.x") * side, F.col("c.y") * side
    lx, ly, hx, hy = map(F.col, _LINE)
    corners = [_side(lx, ly, hx, hy, x1 + i * side, y1 + j * side) for i in (0, 1) for j in (0, 1)]
    box = (lx <= x1 + side) & (hx >= x1) & (F.least(ly, hy) <= y1 + side) & (F.greatest(ly, hy) >= y1)
    return at.where(box & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)).select("g", *_LINE, F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def _met(cells: DataFrame) -> DataFrame:
    """g, line, x, y: the places, in fine steps, where a cell's segments are cut by others of it."""
    a = cells.select("g", "cx", "cy", F.struct(*_LINE).alias("a"))
    pairs = a.join(a.withColumnRenamed("a", "b"), ["g", "cx", "cy"]).where("a < b")
    pairs = pairs.where("a.lx <= b.hx AND b.lx <= a.hx AND least(a.ly, a.hy) <= greatest(b.ly, b.hy) AND least(b.ly, b.hy) <= greatest(a.ly, a.hy)")
    end = lambda s, e: (F.col(f"{s}.{e}x"), F.col(f"{s}.{e}y"))
    of = lambda s, p: _side(*end(s, "l"), *end(s, "h"), *p)
    pairs = pairs.withColumns({"a1": of("a", end("b", "l")), "a2": of("a", end("b", "h")), "b1": of("b", end("a", "l")), "b2": of("b", end("a", "h"))})

    def on(s: str, side: str, p: tuple[Column, Column]) -> Column:
        (lx, ly), (hx, hy) = end(s, "l"), end(s, "h")
        hit = (F.col(side) == 0) & p[0].between(lx, hx) & p[1].between(F.least(ly, hy), F.greatest(ly, hy))
        return F.when(hit, F.struct(F.col(s).alias("line"), (p[0] * FINE).alias("x"), (p[1] * FINE).alias("y")))

    crossed = (F.signum("a1") * F.signum("a2") < 0) & (F.signum("b1") * F.signum("b2") < 0)
    # exact to the fine step below, so that lines through one point are cut at the same place whichever two meet
    place = lambda k: F.expr(f"(abs(cast(b2 AS decimal(20,0))) * a.l{k} + abs(cast(b1 AS decimal(20,0))) * a.h{k}) * {FINE} div (abs(cast(b1 AS decimal(20,0))) + abs(cast(b2 AS decimal(20,0))))")
    both = [F.when(crossed, F.struct(F.col(s).alias("line"), place("x").alias("x"), place("y").alias("y"))) for s in "ab"]
    cuts = F.array_compact(F.array(on("a", "a1", end("b", "l")), on("a", "a2", end("b", "h")), on("b", "b1", end("a", "l")), on("b", "b2", end("a", "h")), *both))
    return pairs.select("g", F.explode(cuts).alias("c")).select("g", "c.line", "c.x", "c.y").distinct()


def _cuts(lines: DataFrame, extent: int, crowd: int) -> DataFrame:
    """All places where segments of a group meet. Cells with over ``crowd`` segments are quartered, to cells of one unit at least."""
    side = 1 << max(0, int(extent)).bit_length()
    count, level = lines.count(), 0
    dealt = lines.select("g", *_LINE, F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    while crowd * 4 ** (level + 1) < count and side > 1:  # as long as cells are crowded on average
        side, level = side // 2, level + 1
        dealt = _quarter(dealt, side)
    found = None
    while True:
        dealt = settle(dealt)
        crowded = dealt.groupBy("g", "cx", "cy").count().where(F.col("count") > crowd).drop("count") if side > 1 and level < DEEPEST else None
        last = crowded is None or not crowded.take(1)
        met = _met(dealt if last else dealt.join(crowded, ["g", "cx", "cy"], "left_anti"))
        found = met if found is None else found.unionByName(met)
        if last:
            return found.distinct()
        side, level = side // 2, level + 1
        dealt = _quarter(dealt.join(crowded, ["g", "cx", "cy"], "left_semi"), side)


def _pieces(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """g, line, px..qy: the segments between the places where they are cut, in their direction."""
    line = lines.select("g", F.struct(*_LINE).alias("line"))
    ends = [line.select("g", "line", (F.col(f"line.{e}x") * FINE).alias("x"), (F.col(f"line.{e}y") * FINE).alias("y")) for e in "lh"]
    points = ends[0].unionByName(ends[1]).unionByName(cuts).distinct()
    along = (F.col("x") - F.col("line.lx") * FINE).cast("double") * (F.col("line.hx") - F.col("line.lx")) + (F.col("y") - F.col("line.ly") * FINE).cast("double") * (F.col("line.hy") - F.col("line.ly"))
    w = Window.partitionBy("g", "line").orderBy(along, "x", "y")
    return points.select("g", "line", F.col("x").alias("px"), F.col("y").alias("py"), F.lead("x").over(w).alias("qx"), F.lead("y").over(w).alias("qy")).where("qx IS NOT NULL")


def _covered(pieces: DataFrame, owners: DataFrame, segments: DataFrame) -> DataFrame:
    """The pieces that lie inside a shape that they aren't a side of.

    A piece's middle meets the shapes whose boxes hold it, by cells of each box's own size, and then the
    shape's segments of its height, by slabs of a few segments: their number on the right is odd inside.
    """
    low, high = F.least("ly", "hy"), F.greatest("ly", "hy")
    boxes = segments.groupBy("g", "shape").agg(F.min("lx").alias("x1"), F.max("hx").alias("x2"), F.min(low).alias("y1"), F.max(high).alias("y2"), F.count(F.lit(1)).alias("k"))
    boxes = boxes.withColumn("level", F.length(F.bin(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))).withColumn("slab", F.greatest(F.lit(1.0), (F.col("y2") - F.col("y1")) / F.greatest(F.lit(1.0), F.col("k") / 8)))
    boxes = settle(boxes)
    levels = [r[0] for r in boxes.select("level").distinct().collect()]  # sizes by powers of two: 27 at most
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level")))
    held = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y1")), cell(F.col("y2")))))
    middle = lambda k: (F.col(f"p{k}") + F.col(f"q{k}")) / (2.0 * FINE)
    at = pieces.select("g", *_PIECE, middle("x").alias("mx"), middle("y").alias("my")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    at = at.withColumns({"cx": cell(F.col("mx")), "cy": cell(F.col("my"))}).join(held, ["g", "level", "cx", "cy"]).where("mx > x1 AND mx < x2 AND my > y1 AND my < y2")
    at = at.join(owners.select("g", *_PIECE, "shape"), ["g", *_PIECE, "shape"], "left_anti")
    at = at.select("g", *_PIECE, "mx", "my", "shape", F.floor((F.col("my") - F.col("y1")) / F.col("slab")).alias("s"))
    nth = lambda v: F.floor((v - F.col("y1")) / F.col("slab"))
    tall = segments.where("ly != hy").join(boxes.select("shape", "y1", "slab"), "shape").select("shape", *_LINE, F.explode(F.sequence(nth(low), nth(high))).alias("s"))
    x = F.col("lx") + (F.col("my") - F.col("ly")) * (F.col("hx") - F.col("lx")) / (F.col("hy") - F.col("ly"))
    right = ((F.col("ly") > F.col("my")) != (F.col("hy") > F.col("my"))) & (x > F.col("mx"))
    odd = at.join(tall, ["shape", "s"]).where(right).groupBy("g", *_PIECE, "shape").count().where("count % 2 = 1")
    return odd.select("g", *_PIECE).distinct()


def _follow(edges: DataFrame) -> DataFrame:
    """e, to: each directed side with the next one of its ring; at a place with several, that which bounds the same inside."""
    angle = lambda a, b: F.atan2(F.col(f"{b}y") - F.col(f"{a}y"), (F.col(f"{b}x") - F.col(f"{a}x")))
    out = edges.select("g", F.col("fx").alias("x"), F.col("fy").alias("y"), "e", angle("f", "t").alias("angle"), F.lit(True).alias("out"))
    back = edges.select("g", F.col("tx").alias("x"), F.col("ty").alias("y"), "e", angle("t", "f").alias("angle"), F.lit(False).alias("out"))
    place = Window.partitionBy("g", "x", "y")
    kind = Window.partitionBy("g", "x", "y", "out")
    turned = out.unionByName(back).withColumns({"nth": F.row_number().over(kind.orderBy("angle")), "k": F.count(F.lit(1)).over(kind), "first": F.first("out").over(place.orderBy("angle"))})
    wanted = F.when(F.col("first"), F.col("nth")).when(F.col("nth") == 1, F.col("k")).otherwise(F.col("nth") - 1)
    left = turned.where("out").select("g", "x", "y", "nth", F.col("e").alias("to"))
    return turned.where("NOT out").select("g", "x", "y", wanted.alias("nth"), "e").join(left, ["g", "x", "y", "nth"]).select("e", "to")


def _rings(follow: DataFrame) -> DataFrame:
    """e, ring, ahead: the ring's least side, and how many sides ahead it is; by doubling, so in as many rounds as a ring's size has bits."""
    state = kept = settle(follow.select("e", "to", F.col("e").alias("ring"), F.lit(0).cast("long").alias("ahead")))
    length = 1
    while True:
        then = state.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"), F.col("ahead").alias("ahead2"))
        less = F.col("ring2") < F.col("ring")
        both = state.join(then, "to").select("e", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), F.when(less, F.col("ahead2") + length).otherwise(F.col("ahead")).alias("ahead"), less.alias("less"))
        both = settle(both)
        forget(kept)
        kept, state, length = both, both.drop("less"), length * 2
        if not both.where("less").take(1):
            return state.select("e", "ring", "ahead")


def union_outlines(features: DataFrame, by: list[str], unit: float = 1e-5, crowd: int = CROWD) -> DataFrame:
    """The sides of the union of each group's polygons: the columns ``by``, ring, n, x1, y1, x2, y2, corner.

    ``features`` has ``by`` and polygons: arrays of polygons of closed rings of struct<x, y>, the first ring
    outside and the others holes, in either direction; rings don't cross themselves. Coordinates are rounded to ``unit``,
    an extent is of at most MOST units, else this raises. Sides have the inside on their left, so outer
    rings go against the clock and holes with it; what touches in a point only stays apart. ``ring`` is an arbitrary number, ``n`` counts along it
    from 0; ``corner`` is false where a side goes straight on from the one before. Tests of sides are exact; crossings are
    placed at the fine step (unit / FINE) below.

    Equal polygons count once. Null groups are a group; null polygons and rings of under four points are left out. An empty table gives an empty table.

    All is joins by cell, slab and place: nothing of a group is gathered in a task but the pieces of one segment and the sides that meet in a place.
    """
    segments = settle(_segments(features, by, unit))
    low, high = F.least("ly", "hy"), F.greatest("ly", "hy")
    x0, x1, y0, y1 = segments.agg(F.min("lx"), F.max("hx"), F.min(low), F.max(high)).first()
    extent = 0 if x0 is None else max(x1 - x0, y1 - y0)
    if extent > MOST:
        raise ValueError(f"outlines extend over {extent} units, {MOST} are allowed")
    x0, y0 = x0 or 0, y0 or 0
    segments = segments.select("g", "shape", "left", *((F.col(c) - (x0 if c[1] == "x" else y0)).alias(c) for c in _LINE))
    lines = segments.select("g", *_LINE).distinct()
    pieces = _pieces(lines, _cuts(lines, extent, crowd))
    mine = segments.select("g", "shape", "left", F.struct(*_LINE).alias("line"))
    owners = settle(pieces.join(mine, ["g", "line"]))
    way = F.struct((F.col("line.hx") - F.col("line.lx")).alias("x"), (F.col("line.hy") - F.col("line.ly")).alias("y"))
    sides = owners.groupBy("g", *_PIECE).agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("right"), F.min(way).alias("way"))
    open_ = settle(sides.where("left != right"))
    outer = open_.join(_covered(open_, owners, segments), ["g", *_PIECE], "left_anti")
    turn = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b))
    edges = outer.select("g", "way", turn("px", "qx").alias("fx"), turn("py", "qy").alias("fy"), turn("qx", "px").alias("tx"), turn("qy", "py").alias("ty"))
    edges = settle(edges.withColumn("e", F.monotonically_increasing_id()))
    follow = settle(_follow(edges))
    ways = edges.select("e", "way")
    straight = follow.join(ways, "e").select(F.col("to").alias("e"), F.col("way").alias("before")).join(ways, "e").where("before.x * way.y = before.y * way.x").select("e", F.lit(False).alias("corner"))
    rings = _rings(follow)
    sizes = rings.groupBy("ring").agg(F.count(F.lit(1)).alias("size"))
    out = edges.join(rings, "e").join(sizes, "ring").join(straight, "e", "left")
    real = lambda c, o: (F.col(c) / float(FINE) + o) * unit
    return out.select(*(F.col(f"g.{c}").alias(c) for c in by), "ring", F.pmod(F.col("size") - F.col("ahead"), F.col("size")).alias("n"), real("fx", x0).alias("x1"), real("fy", y0).alias("y1"), real("tx", x0).alias("x2"), real("ty", y0).alias("y2"), F.coalesce("corner", F.lit(True)).alias("corner"))


def ring_sums(sides: DataFrame, by: list[str]) -> DataFrame:
    """by, ring, area, perimeter, corners: holes have an area under 0, so a group's areas add up to that of its union."""
    shoe = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return sides.groupBy(*by, "ring").agg((F.sum(shoe) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"), F.count_if("corner").alias("corners"))


def ring_points(sides: DataFrame, by: list[str]) -> DataFrame:
    """by, ring, points: each ring's corners as a closed array of struct<x, y>."""
    at = F.sort_array(F.collect_list(F.struct("n", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"))))
    corners = sides.where("corner").groupBy(*by, "ring").agg(F.transform(at, lambda r: r["p"]).alias("points"))
    return corners.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
