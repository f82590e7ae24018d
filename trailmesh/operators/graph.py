"""Graph tables as DataFrames: arcs, degrees, offsets, weights, components, reachability, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import planar_bound_cm, travel_ms
from ..model import FALLBACK_SPEED, SPEEDS
from ..plans.fixpoint import dealt_parts, fixpoint, forget, settle
from ..plans.ids import numbered



def build_arcs(edges: DataFrame) -> DataFrame:
    """arc, src, dst, edge, reversed, w: the forward arc unless direction is 2, the reverse arc unless it is 1."""
    ahead = edges.where("direction != 2").select(F.col("u").alias("src"), F.col("v").alias("dst"), "edge", F.lit(False).alias("reversed"), F.col("length_cm").alias("w"))
    back = edges.where("direction != 1").select(F.col("v").alias("src"), F.col("u").alias("dst"), "edge", F.lit(True).alias("reversed"), F.col("length_cm").alias("w"))
    return numbered(ahead.unionByName(back), ["src", "edge", "reversed"], "arc").select("arc", "src", "dst", "edge", "reversed", "w")


def reverse_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs by destination: position, original arc, dst, src, in ascending source and arc order."""
    return numbered(arcs.select("dst", "src", "arc", "w"), ["dst", "src", "arc"], "position")


def degrees(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """node, outgoing, incoming; one pass over the arcs."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


def offsets(nodes: DataFrame, arcs: DataFrame, block: int = 1024) -> DataFrame:
    """node, first, last: exclusive and inclusive prefix sums of the out-degree; two levels, by blocks of nodes."""
    d = degrees(nodes, arcs).select("node", F.col("outgoing").alias("d"), F.floor(F.col("node") / block).alias("block"))
    whole = d.groupBy("block").agg(F.sum("d").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.select("block", before.alias("before"))
    last = F.col("before") + F.sum("d").over(Window.partitionBy("block").orderBy("node"))
    return d.join(whole, "block").select("node", (last - F.col("d")).alias("first"), last.alias("last"))


def speed_of(category: Column) -> Column:
    known = F.element_at(F.array(*map(F.lit, SPEEDS)), F.greatest(category, F.lit(0)) + 1)
    return F.when((category >= 0) & (category < len(SPEEDS)), known).otherwise(FALLBACK_SPEED)


def time_arcs(arcs: DataFrame, edges: DataFrame) -> DataFrame:
    """The same arcs with costs in whole milliseconds."""
    speeds = edges.select("edge", speed_of(F.col("category")).alias("kph"))
    return arcs.join(speeds, "edge").select("arc", "src", "dst", "edge", "reversed", travel_ms(F.col("w"), F.col("kph")).alias("w"))


def seed_node(arcs: DataFrame) -> int:
    """The node of greatest total degree, lowest id."""
    ends = arcs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count()
    return ends.orderBy(F.desc("count"), "node").first()["node"]


# ---------------------------------------------------------------- fixpoints over tables
def expand(front: DataFrame, arcs: DataFrame, cost: str = "cost") -> DataFrame:
    """node, cost: the least cost at which one arc leads from a frontier (node, cost) to each node."""
    return front.join(arcs, front["node"] == arcs["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col(cost) + F.col("w")).alias(cost))


def _relaxed(arcs: DataFrame, start: DataFrame, src: str, dst: str, value: str, most: int) -> DataFrame:
    """The fixpoint of ``value`` at dst <= value at src + w, from ``start`` (node, value), which may have several rows a node.

    Arcs are dealt by the end that sends on, and kept while the rounds run.
    """
    parts = dealt_parts(arcs, arcs.count())
    # settled first: a kept table's plan goes with those of all rounds, and would be planned and held by the driver each time
    written = settle(arcs.select(F.col(src).alias("__from"), F.col(dst).alias("__to"), "w").repartition(parts, "__from"))
    dealt = written.persist()
    every = start.select("node", value).unionByName(dealt.select(F.col("__to").alias("node"), F.lit(None).cast("long").alias(value)))

    def step(front: DataFrame) -> DataFrame:
        return front.hint("shuffle_hash").join(dealt, F.col("node") == F.col("__from")).select(F.col("__to").alias("node"), (F.col(value) + F.col("w")).alias(value))

    try:
        return fixpoint(every, step, "node", value, most, parts)
    finally:
        dealt.unpersist()
        forget(written)


def shortest(arcs: DataFrame, starts: DataFrame, most: int = 100_000) -> DataFrame:
    """node, dist from the nearest start, for any size: only nodes that improved send on their costs."""
    return _relaxed(arcs, starts.select("node", F.lit(0).cast("long").alias("dist")), "src", "dst", "dist", most)


def shortest_each(arcs: DataFrame, starts: list[list[int]]) -> DataFrame:
    """k, node, dist from the nearest of the k-th starts: all searches share the rounds, on a copy of the graph for each."""
    n, spark = len(starts), arcs.sparkSession
    k = F.explode(F.array(*map(F.lit, range(n)))).alias("k")
    copies = arcs.select("src", "dst", "w", k).select((F.col("src") * n + F.col("k")).alias("src"), (F.col("dst") * n + F.col("k")).alias("dst"), "w")
    first = spark.createDataFrame([(s * n + k,) for k, some in enumerate(starts) for s in some], "node long")
    return shortest(copies, first).select((F.col("node") % n).cast("int").alias("k"), F.floor(F.col("node") / n).alias("node"), "dist")


def hops(arcs: DataFrame, starts: DataFrame, most: int = 100_000) -> DataFrame:
    """node, hops: fewest connections from the starts."""
    return shortest(arcs.withColumn("w", F.lit(1).cast("long")), starts, most).withColumnRenamed("dist", "hops")


def reachable(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    return hops(arcs, starts).select("node")


def backward(arcs: DataFrame) -> DataFrame:
    return arcs.select("arc", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge", "reversed", "w")


def mutually_reachable(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """node: those that are reached from the starts and reach them; both ways share the rounds, on a copy of the graph for each."""
    ways = arcs.select(F.explode(F.array(*(F.struct((F.col(a) * 2 + k).alias("src"), (F.col(b) * 2 + k).alias("dst")) for k, (a, b) in enumerate((("src", "dst"), ("dst", "src")))))).alias("e"))
    both = reachable(ways.select("e.*"), starts.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node")))
    return both.groupBy(F.floor(F.col("node") / 2).alias("node")).count().where("count = 2").select("node")


def repaired_bound(nodes: DataFrame, arcs: DataFrame, goal: int) -> DataFrame:
    """node, h: the planar bound lowered until h(u) <= w + h(v) on every arc."""
    ends = nodes.agg(F.max(F.abs("y")).alias("top")).crossJoin(nodes.where(F.col("node") == goal).select(F.col("x").alias("gx"), F.col("y").alias("gy")))  # one row
    h0 = nodes.crossJoin(F.broadcast(ends)).select("node", planar_bound_cm(F.col("x") - F.col("gx"), F.col("y") - F.col("gy"), F.col("top")).alias("h"))

    return _relaxed(arcs, h0, "dst", "src", "h", 100_000)


def weak_components(nodes: DataFrame, edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component: the smallest node of each weak component, by alternating star contractions."""
    at = settle(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a != b").distinct())
    mark = None
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        at = settle(large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return nodes.select("node").join(at, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def spanning_total(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, total: weight of the least spanning tree of each weak component, by Boruvka rounds.

    Each round every part picks its lightest edge to another part (ties by edge id, so picks
    never cycle) and parts are merged along the picks.
    """
    label = settle(nodes.select("node", F.col("node").alias("part")))
    chosen = None
    rest = edges.where("u != v").select("edge", "u", "v", "length_cm")
    while True:
        named = rest.join(label.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u").join(label.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v").where("pu != pv")
        sides = named.select(F.explode(F.array("pu", "pv")).alias("part"), F.struct("length_cm", "edge", "pu", "pv").alias("e"))
        picks = settle(sides.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct())
        if not picks.take(1):
            break
        chosen = picks.select("edge", "length_cm") if chosen is None else chosen.unionByName(picks.select("edge", "length_cm"))
        merged = weak_components(label.select(F.col("part").alias("node")).distinct(), picks, "pu", "pv")
        label = settle(label.join(merged, F.col("part") == merged["node"]).select(label["node"], F.col("component").alias("part")))
    if chosen is None:
        return label.groupBy(F.col("part").alias("component")).agg(F.lit(0).cast("long").alias("total"))
    parts = edges.select("edge", "u").join(chosen.distinct(), "edge").join(label, F.col("u") == F.col("node")).groupBy("part").agg(F.sum("length_cm").alias("total"))
    return label.select("part").distinct().join(parts, "part", "left").select(F.col("part").alias("component"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
