"""The public search interface: load a graph, snap points, run requests, get results and traces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import snap_metres
from ..model import GUARANTEE, METRES_PER_DEGREE, OPTIMAL, REQUESTS, RESULTS, SNAP_CATEGORY, SNAP_METRES, Algorithm
from ..shipping import ship
from . import kernels
from .arrays import COMPACT_ARCS, SLICE, compact, in_tasks, marks_of
from .graph import build_arcs, degrees, shortest, time_arcs, weak_components

CELL = 0.005  # degrees of latitude in a row of snapping cells, which are about as wide


# ---------------------------------------------------------------- snapping
def eligible_nodes(nodes: DataFrame, edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """Nodes on a road that may be snapped to, with arcs in and out."""
    good = edges.where(F.col("category") <= SNAP_CATEGORY).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    both = degrees(nodes, arcs).where("outgoing > 0 AND incoming > 0").select("node")
    return nodes.join(good, "node", "left_semi").join(both, "node", "left_semi")


def _column_width(row: Column) -> Column:
    """Degrees of longitude in a cell of a row: as long on the ground as the row is high, but for the poles."""
    return CELL / F.greatest(F.cos(F.radians((row + 0.5) * CELL)), F.lit(0.01))


def snap_pairs(points: DataFrame, eligible: DataFrame, components: DataFrame, metres: float = SNAP_METRES) -> DataFrame:
    """name, component, node, metres: the nodes that are compared with each point; the nearest of every weak component is among them.

    A point first meets the cells within reach, one row for each cell and component with the box of its nodes. The least of a component's
    greatest distances bounds its nearest node, so only cells whose least distance isn't beyond it are opened.
    """
    at = eligible.join(components, "node").select("node", "component", (F.col("x") / 1e5).alias("nx"), (F.col("y") / 1e5).alias("ny"))
    at = at.withColumn("row", F.floor(F.col("ny") / CELL)).withColumn("col", F.floor(F.col("nx") / _column_width(F.col("row"))))
    boxes = at.groupBy("row", "col", "component").agg(*(f(c).alias(f"{c}{i}") for c in ("nx", "ny") for i, f in ((1, F.min), (2, F.max))))
    reach = metres / METRES_PER_DEGREE + 1e-9
    wide = F.least(F.lit(360.0), F.lit(reach) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)))
    rows = points.select("name", "lon", "lat", wide.alias("wide"), F.explode(F.sequence(F.floor((F.col("lat") - reach) / CELL), F.floor((F.col("lat") + reach) / CELL))).alias("row"))
    side = lambda d: F.floor((F.col("lon") + d) / _column_width(F.col("row")))
    near = rows.withColumn("col", F.explode(F.sequence(side(-F.col("wide")), side(F.col("wide")))))
    gap = lambda p, k: F.greatest(F.col(f"{k}1") - F.col(p), F.col(p) - F.col(f"{k}2"), F.lit(0.0))
    span = lambda p, k: F.greatest(F.abs(F.col(f"{k}1") - F.col(p)), F.abs(F.col(f"{k}2") - F.col(p)))
    away = lambda d: snap_metres(F.lit(0.0), F.col("lat"), d("lon", "nx"), F.col("lat") + d("lat", "ny"))
    met = near.join(boxes, ["row", "col"]).withColumns({"__least": away(gap) - 1e-3, "__most": away(span) + 1e-3}).where(F.col("__least") <= metres)
    met = met.withColumn("__bound", F.min("__most").over(Window.partitionBy("name", "lon", "lat", "component")))
    opened = met.where("__least <= __bound").select("name", "lon", "lat", "row", "col", "component")
    found = opened.join(at, ["row", "col", "component"]).withColumn("metres", snap_metres("lon", "lat", "nx", "ny"))
    return found.where(F.col("metres") <= metres).select("name", "component", "node", "metres")


def snap_candidates(points: DataFrame, eligible: DataFrame, components: DataFrame, metres: float = SNAP_METRES) -> DataFrame:
    """name, component, node, metres: each point's nearest eligible node of every weak component; ties to the lower node."""
    found = snap_pairs(points, eligible, components, metres)
    return found.groupBy("name", "component").agg(F.min(F.struct("metres", "node")).alias("m")).select("name", "component", "m.node", "m.metres")


def snap(candidates: DataFrame, names: list[str]) -> DataFrame:
    """name, node, metres for two or more points: the component that all share with the least sum of distances, else each one's nearest.

    Equal sums go to the smaller list of sorted nodes. A point without a candidate raises.
    """
    near = candidates.where(F.col("name").isin(names))
    missing = set(names) - {r["name"] for r in near.select("name").distinct().collect()}
    for name in names:
        if name in missing:
            raise ValueError(f"No road within 2 km of {name}")
    sums = near.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("metres").alias("s"), F.array_sort(F.collect_list("node")).alias("nodes"))
    best = sums.where((F.col("k") == len(names)) & (F.size(F.array_distinct("nodes")) == len(names))).orderBy("s", "nodes").limit(1).select("component")
    if best.take(1):
        return near.join(best, "component", "left_semi").select("name", "node", "metres")
    one = near.groupBy("name").agg(F.min(F.struct("metres", "node")).alias("m")).select("name", "m.node", "m.metres")
    return one


# ---------------------------------------------------------------- searches
def _ends(request: Row | pd.Series) -> tuple[int, int | None]:
    goal = request["goal"]
    return int(request["start"]), None if goal is None or goal != goal else int(goal)


def _found(request: Row | pd.Series, g: kernels.Compact, marks: kernels.Landmarks | None) -> kernels.Found:
    name, (start, goal) = request["algorithm"], _ends(request)
    if name == Algorithm.MULTISOURCE.value:
        return kernels.multisource(g, [int(s) for s in request["sources"]])
    if name == Algorithm.ALT.value:
        return kernels.alt(g, start, goal, marks)
    if name == Algorithm.SPANNING_TREE.value:
        return kernels.spanning_tree(g, start, goal)
    return kernels.SEARCHES[name](g, start, goal)


def _row(request: Row | pd.Series, g: kernels.Compact, marks: kernels.Landmarks | None, traced: bool = True) -> tuple:
    f, name, (start, goal) = _found(request, g, marks), request["algorithm"], _ends(request)
    settled, examined, improved = f.counts()
    if f.route:
        nodes, edges, back, lengths = f.route
    elif f.cost is not None and name not in ("spanning-tree", "multisource"):
        nodes = [start, *(int(g.dst[a]) for a in f.arcs)]
        edges, back, lengths = [int(g.edge[a]) for a in f.arcs], [bool(g.back[a]) for a in f.arcs], [int(g.w[a]) for a in f.arcs]
    else:
        nodes = edges = back = lengths = None
    if f.tree and goal is None:
        edges = f.tree
    meeting = f.meeting or (None, None)
    return (int(request["query_id"]), name, start, goal, f.cost, settled, examined, improved, f.max_queue, nodes, edges, back, lengths, GUARANTEE.get(Algorithm(name)), meeting[0], meeting[1], f.corrected, np.frombuffer(f.words, np.int64) if traced else None)


class GraphStore:
    """A graph's tables with the searches over it.

    ``search`` runs each request of a table whole in one task, on arrays of the graph that
    tasks write to the shared folder and every worker reads once; the driver never holds them. That is done only up to ``limit`` counted arcs. Costs from one node to all
    (``costs``) come from fixpoints over the tables at every size, without event order.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, limit: int = COMPACT_ARCS, name: str = ""):
        ship(nodes.sparkSession)
        self.spark: SparkSession = nodes.sparkSession
        self.nodes, self.edges, self.limit, self.name = nodes, edges, limit, name
        self.arcs = build_arcs(edges).persist()
        self._parts: dict = {}

    def _once(self, key, make):
        if key not in self._parts:
            self._parts[key] = make()
        return self._parts[key]

    @property
    def components(self) -> DataFrame:
        return self._once("components", lambda: weak_components(self.nodes, self.edges).persist())

    def close(self) -> None:
        """Give back what is kept in executors: tables, and files of arrays. Later calls make them again."""
        self.arcs.unpersist()
        for part in self._parts.values():
            if part is not None:
                part.unpersist()
        self._parts.clear()

    def weighted(self, objective: str) -> DataFrame:
        return self.arcs if objective == "distance" else self._once("time", lambda: time_arcs(self.arcs, self.edges).persist())

    def arrays(self, objective: str = "distance"):
        """The graph's arrays; None beyond the limit."""
        return self._once(("arrays", objective), lambda: compact(self.nodes, self.weighted(objective), self.edges, self.limit))

    def landmarks(self):
        """At most four landmarks with two cost tables each, for the whole graph; each table is a task's."""
        return self._once("landmarks", lambda: marks_of(self.spark, self.arrays()))

    def snap(self, points: DataFrame, names: list[str]) -> DataFrame:
        found = snap_candidates(points, eligible_nodes(self.nodes, self.edges, self.arcs), self.components)
        return snap(found, names)

    def search(self, requests: DataFrame, objective: str = "distance", traced: bool = True) -> DataFrame:
        """RESULTS of every request (REQUESTS); ``cost`` is in centimetres or, for the time objective, milliseconds.

        Event words stay in the tasks unless ``traced``.
        """
        arrays, marks = self._asked(requests, objective)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    row = _row(r, arrays.value, marks.value if marks else None, traced)
                    yield pd.DataFrame([row], columns=RESULTS.names).astype({"goal": "Int64", "cost": "Int64", "meeting_node": "Int64", "meeting_cost": "Int64"})

        return in_tasks(requests, requests.count(), "query_id").mapInPandas(run, RESULTS)

    def traces(self, requests: DataFrame, objective: str = "distance") -> DataFrame:
        """query_id, algorithm, start, goal, before, words: the event words of every request in slices, each with how many are ``before`` it.

        So no row holds a whole log. A search without events has one slice without words.
        """
        arrays, marks = self._asked(requests, objective)
        size = SLICE

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    words = np.frombuffer(_found(r, arrays.value, marks.value if marks else None).words, np.int64)
                    for k in range(0, max(1, len(words)), size):
                        row = (int(r["query_id"]), r["algorithm"], *_ends(r), k, words[k : k + size])
                        yield pd.DataFrame([row], columns=["query_id", "algorithm", "start", "goal", "before", "words"]).astype({"goal": "Int64"})

        return in_tasks(requests, requests.count(), "query_id").mapInPandas(run, "query_id long, algorithm string, start long, goal long, before long, words array<long>")

    def _asked(self, requests: DataFrame, objective: str):
        """The arrays and landmarks that the requests need; wrong requests raise."""
        arrays = self.arrays(objective)
        if arrays is None:
            raise ValueError(f"more than {self.limit} arcs: use costs()")
        wanted = {r["algorithm"]: r["count"] for r in requests.groupBy("algorithm").count().collect()}
        if unknown := wanted.keys() - {a.value for a in Algorithm}:
            raise ValueError(f"unknown algorithm {sorted(unknown)}")
        if Algorithm.ALT.value in wanted and objective != "distance":
            raise ValueError("landmarks serve the distance objective only")
        if requests.where((F.col("algorithm") == Algorithm.MULTISOURCE.value) & (F.coalesce(F.size("sources"), F.lit(0)) != 3)).take(1):
            raise ValueError("multisource needs three sources")
        return arrays, self.landmarks() if Algorithm.ALT.value in wanted else None

    def request(self, algorithm: str, start: int, goal: int | None = None, sources: list[int] | None = None, objective: str = "distance") -> Row:
        """One search."""
        return self.search(self.spark.createDataFrame([(0, algorithm, start, goal, sources)], REQUESTS), objective).first()

    def costs(self, start: int, objective: str = "distance") -> DataFrame:
        """node, dist from one node, by fixpoint over the tables."""
        return shortest(self.weighted(objective), self.spark.createDataFrame([(start,)], "node long"))

    def time_result(self, results: DataFrame) -> DataFrame:
        """Add route_ms: for routes by distance an estimate with the trace unchanged."""
        return annotate_time(results, self.edges)


def trace_rows(results: DataFrame) -> DataFrame:
    """query_id, event (1-based), kind, id, side, word, of whole results or of slices."""
    before = F.col("before") if "before" in results.columns else F.lit(0)
    e = results.select("query_id", before.alias("before"), F.posexplode("words").alias("p", "word")).withColumn("p", F.col("p") + F.col("before"))
    return e.select("query_id", (F.col("p") + 1).cast("long").alias("event"), F.col("word").bitwiseAND(3).cast("int").alias("kind"), F.shiftright(F.col("word").bitwiseAND(0x7FFFFFFF), 2).alias("id"), F.shiftright("word", 31).cast("int").alias("side"), "word")


def annotate_time(results: DataFrame, edges: DataFrame) -> DataFrame:
    from ..functions.geo import travel_ms
    from .graph import speed_of

    steps = results.select("query_id", F.explode("route_edges").alias("edge"))
    cost = steps.join(edges.select("edge", "length_cm", "category"), "edge").groupBy("query_id").agg(F.sum(travel_ms(F.col("length_cm"), speed_of(F.col("category")))).alias("route_ms"))
    return results.join(cost, "query_id", "left").withColumn("route_ms", F.when(F.col("cost").isNotNull(), F.coalesce("route_ms", F.lit(0))))


def route_steps(results: DataFrame) -> DataFrame:
    """query_id, step, edge, reversed, src, dst, length: the rows of each route."""
    zipped = F.arrays_zip("route_edges", "route_reversed", "route_lengths")
    s = results.where("route_nodes IS NOT NULL").select("query_id", "route_nodes", F.posexplode(zipped).alias("step", "z"))
    return s.select("query_id", F.col("step").cast("long").alias("step"), F.col("z.route_edges").alias("edge"), F.col("z.route_reversed").alias("reversed"), F.get("route_nodes", F.col("step")).alias("src"), F.get("route_nodes", F.col("step") + 1).alias("dst"), F.col("z.route_lengths").alias("length"))


def route_violations(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that aren't the edge they name, go against its direction, or routes whose lengths don't sum to their cost."""
    s = route_steps(results).join(edges, "edge", "left")
    wrong = s.where("u IS NULL OR (NOT reversed AND (src != u OR dst != v OR direction = 2)) OR (reversed AND (src != v OR dst != u OR direction = 1)) OR length != length_cm")
    sums = route_steps(results).groupBy("query_id").agg(F.sum("length").alias("s"))
    off = results.where("route_nodes IS NOT NULL").join(sums, "query_id", "left").where("cost != coalesce(s, 0)")
    return wrong.select("query_id", "step", F.lit("step").alias("why")).unionByName(off.select("query_id", F.lit(None).cast("long").alias("step"), F.lit("cost").alias("why")))


def parent_chain(spark: SparkSession, parents: DataFrame, goal: int) -> DataFrame:
    """node, step: from the goal along parent links, by a recursive query (links don't cycle)."""
    parents.createOrReplaceTempView("__parents")
    return spark.sql(f"WITH RECURSIVE chain(node, step) AS (SELECT CAST({goal} AS BIGINT), 0 UNION ALL SELECT p.parent, c.step + 1 FROM chain c JOIN __parents p ON p.node = c.node WHERE p.parent IS NOT NULL) SELECT node, step FROM chain")


def agreement(results: DataFrame) -> DataFrame:
    """start, goal, costs: requests whose optimal algorithms disagree."""
    best = results.where(F.col("algorithm").isin([a.value for a in OPTIMAL if a not in (Algorithm.SPANNING_TREE, Algorithm.MULTISOURCE, Algorithm.TIME)]))
    return best.groupBy("start", "goal").agg(F.count_distinct(F.coalesce("cost", F.lit(-1))).alias("costs")).where("costs > 1")


def recent(df: DataFrame, per: list[str], order: str, n: int = 12) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*per).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
