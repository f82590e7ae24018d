"""Queries: searches, reachability, components, bounds, audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..model import REQUESTS, Algorithm
from ..operators import graph, kernels, replay, search, trace
from ..operators.arrays import from_arrays
from ..sources.tables import EDGES_SQL, GRAPH_SQL, NODES_SQL, SEED_SQL, arcs, edges, nodes
from .fixpoint import settle
from .q_etl import TIME_SQL
from .registry import query

_stores: dict = {}


def store(spark, sf_dir) -> search.GraphStore:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        s = search.GraphStore(nodes(spark, sf_dir), edges(spark, sf_dir))
        s.arcs = arcs(spark, sf_dir)
        _stores[key] = s
    return _stores[key]


def seed(spark, sf_dir) -> int:
    s = store(spark, sf_dir)
    return s._once("seed", lambda: graph.seed_node(s.arcs))


def _sources(spark, sf_dir) -> list[int]:
    n = store(spark, sf_dir)._once("count", lambda: nodes(spark, sf_dir).count())
    first = seed(spark, sf_dir)
    return [first, (first + n // 3) % n, (first + 2 * n // 3) % n]


def journeys(spark, sf_dir, algorithms: list[str], count: int = 12):
    """Requests from the seed to nodes spread over the graph, for each algorithm."""
    n = store(spark, sf_dir)._once("count", lambda: nodes(spark, sf_dir).count())
    s = seed(spark, sf_dir)
    rows = [(a * 1000 + k, name, s, (s + (k + 1) * (n // (count + 1))) % n, None) for a, name in enumerate(algorithms) for k in range(count)]
    return spark.createDataFrame(rows, REQUESTS)


def _spread(name: str, start: str, table: str = "arcs", src: str = "src", dst: str = "dst", w: str = "w") -> str:
    return f"""{name}(node, dist) USING KEY (node) AS (SELECT node::BIGINT, 0::BIGINT FROM {start} UNION
  SELECT t, min(nd) FROM (SELECT a.{dst} AS t, {name}.dist + {w} AS nd FROM {name} JOIN {table} a ON a.{src} = {name}.node
    LEFT JOIN recurring.{name} x ON x.node = a.{dst} WHERE x.dist IS NULL OR {name}.dist + {w} < x.dist) GROUP BY t)"""


_D = f"WITH RECURSIVE {GRAPH_SQL}, {SEED_SQL}"


def _from_arrays(spark, sf_dir, make, schema: str, objective: str = "distance"):
    """Rows that a function of the graph's arrays gives, made in one worker task."""
    arrays = store(spark, sf_dir).arrays(objective)
    if arrays is None:
        raise ValueError("the graph is too large for one worker; use the fixpoints of operators.graph")
    return from_arrays(spark, arrays, make, schema)


def _starts(spark, found):
    return spark.createDataFrame([(s,) for s in found], "node long").distinct()


@query(f"{_D}, {_spread('d', 'seed')} SELECT node, dist FROM d")
def sssp_distance(spark, sf_dir):
    return store(spark, sf_dir).costs(seed(spark, sf_dir))


@query(f"{_D}, {TIME_SQL}, {_spread('d', 'seed', 'tarcs')} SELECT node, dist AS ms FROM d")
def sssp_time(spark, sf_dir):
    return store(spark, sf_dir).costs(seed(spark, sf_dir), "time").withColumnRenamed("dist", "ms")


@query(f"{_D}, {_spread('d', 'seed', 'arcs', 'dst', 'src')} SELECT node, dist FROM d")
def reverse_distance(spark, sf_dir):
    return graph.shortest(graph.backward(store(spark, sf_dir).arcs), _starts(spark, [seed(spark, sf_dir)]))


@query(f"{_D}, {_spread('d', 'seed', w='1')} SELECT node, dist AS hops FROM d")
def bfs_hops(spark, sf_dir):
    return graph.hops(store(spark, sf_dir).arcs, _starts(spark, [seed(spark, sf_dir)]))


@query(f"{_D}, {_spread('d', 'seed', w='1')} SELECT node FROM d")
def reachability(spark, sf_dir):
    return graph.reachable(store(spark, sf_dir).arcs, _starts(spark, [seed(spark, sf_dir)]))


_MUTUAL = f"{_spread('f', 'seed', w='1')}, {_spread('b', 'seed', 'arcs', 'dst', 'src', '1')}"


@query(f"{_D}, {_MUTUAL} SELECT node FROM f INTERSECT SELECT node FROM b")
def mutual_reachable(spark, sf_dir):
    return graph.mutually_reachable(store(spark, sf_dir).arcs, _starts(spark, [seed(spark, sf_dir)]))


_COMPONENTS = f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, sides AS (SELECT u AS src, v AS dst FROM edges UNION ALL SELECT v, u FROM edges),
c(node, component) USING KEY (node) AS (SELECT node::BIGINT, node::BIGINT FROM nodes UNION
  SELECT t, min(m) FROM (SELECT b.dst AS t, c.component AS m FROM c JOIN sides b ON b.src = c.node LEFT JOIN recurring.c x ON x.node = b.dst WHERE c.component < x.component) GROUP BY t)"""


@query(f"{_COMPONENTS} SELECT node, component FROM c")
def weak_components(spark, sf_dir):
    return store(spark, sf_dir).components


@query(f"{_COMPONENTS}, s AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS share, (SELECT round(sum(length_cm) / 1e5, 3) FROM edges) AS km FROM s")
def component_stats(spark, sf_dir):
    sizes = store(spark, sf_dir).components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    km = edges(spark, sf_dir).agg(F.round(F.sum("length_cm") / 1e5, 3).alias("km"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share")).crossJoin(km)  # one row each


@query(f"{_D}, {_spread('f', 'seed')}, goal AS (SELECT (s.node + (SELECT count(*) FROM nodes) // 2) % (SELECT count(*) FROM nodes) AS node FROM seed s), {_spread('b', 'goal', 'arcs', 'dst', 'src')} SELECT coalesce(min(f.dist + b.dist), -1) AS cost FROM f JOIN b USING (node)")
def bidirectional_cost(spark, sf_dir):
    n, s = nodes(spark, sf_dir).count(), seed(spark, sf_dir)
    goal = (s + n // 2) % n
    req = spark.createDataFrame([(0, Algorithm.BIDIRECTIONAL.value, s, goal, None)], REQUESTS)
    return store(spark, sf_dir).search(req, traced=False).select(F.coalesce("cost", F.lit(-1)).alias("cost"))


_THREE = "three AS (SELECT node FROM seed UNION ALL SELECT (s.node + n // 3) % n FROM seed s, (SELECT count(*) AS n FROM nodes) UNION ALL SELECT (s.node + 2 * n // 3) % n FROM seed s, (SELECT count(*) AS n FROM nodes))"


def _nearest(spark, sf_dir):
    return graph.shortest(store(spark, sf_dir).arcs, _starts(spark, _sources(spark, sf_dir)))


def _territory(spark, sf_dir):
    sources = _sources(spark, sf_dir)

    def make(g):
        f = kernels.multisource(g, sources)
        node = f.nodes()
        return pd.DataFrame({"node": node} | {c: np.frombuffer(a, np.int64)[node] for c, a in zip(("dist", "source"), f.reached[1:], strict=True)})

    return _from_arrays(spark, sf_dir, make, "node long, dist long, source long")


@query(f"{_D}, {_THREE}, {_spread('d', 'three')} SELECT node, dist FROM d")
def multisource_distance(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(f"{_D}, {_THREE}, {_spread('d', 'three')} SELECT count(*) AS nodes, max(dist) AS furthest, sum(dist)::BIGINT AS total FROM d")
def multisource_extent(spark, sf_dir):
    return _nearest(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"), F.max("dist").alias("furthest"), F.sum("dist").alias("total"))


@query()
def territory_sizes(spark, sf_dir):
    return _territory(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("nodes"), F.max("dist").alias("furthest"))


_SINGLES = ", ".join(f"one{k} AS (SELECT (s.node + {k} * n // 3) % n AS node FROM seed s, (SELECT count(*) AS n FROM nodes)), {_spread(f's{k}', f'one{k}')}" for k in range(3))


@query(f"""{_D}, {_THREE}, {_spread('d', 'three')}, {_SINGLES}, least_of AS (SELECT node, min(dist) AS single FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY node)
SELECT count(*) AS nodes, sum((dist IS DISTINCT FROM single)::INTEGER)::BIGINT AS mismatches FROM d FULL JOIN least_of USING (node)""")
def territory_audit(spark, sf_dir):
    """Nodes whose territory distance differs from the least of three single searches: none are expected."""
    sources = _sources(spark, sf_dir)
    all_of = settle(graph.shortest_each(store(spark, sf_dir).arcs, [[s] for s in sources] + [sources]))
    t = all_of.where(F.col("k") == len(sources)).select("node", "dist")
    least = all_of.where(F.col("k") < len(sources)).groupBy("node").agg(F.min("dist").alias("single"))
    both = t.join(least, "node", "full")
    return both.agg(F.count(F.lit(1)).alias("nodes"), F.sum((~F.col("dist").eqNullSafe(F.col("single"))).cast("long")).alias("mismatches"))


_H0 = """goal AS (SELECT (s.node + (SELECT count(*) FROM nodes) // 2) % (SELECT count(*) FROM nodes) AS node FROM seed s),
h0 AS (SELECT n.node, floor(sqrt(pow((n.x - g.x) * cos(radians((SELECT max(abs(y)) FROM nodes) / 1e5)), 2) + pow(n.y - g.y, 2)) * 111.1950802)::BIGINT AS h FROM nodes n, (SELECT x, y FROM nodes WHERE node = (SELECT node FROM goal)) g)"""
_REPAIR = f"""{_H0}, r(node, h) USING KEY (node) AS (SELECT node, h FROM h0 UNION SELECT t, min(nh) FROM (SELECT a.src AS t, r.h + a.w AS nh FROM r JOIN arcs a ON a.dst = r.node LEFT JOIN recurring.r x ON x.node = a.src WHERE r.h + a.w < x.h) GROUP BY t)"""


@query(f"{_D}, {_REPAIR} SELECT node, h FROM r")
def potential_repair(spark, sf_dir):
    n, s = nodes(spark, sf_dir).count(), seed(spark, sf_dir)
    goal = (s + n // 2) % n
    return graph.repaired_bound(store(spark, sf_dir).nodes, store(spark, sf_dir).arcs, goal)


def _marks(k: int) -> str:
    """The k-th landmark, farthest from those before it, and its distances both ways."""
    far = "least(" + ", ".join(f"(SELECT pow((n.x - g.x)::BIGINT, 2) + pow((n.y - g.y)::BIGINT, 2) FROM nodes g JOIN l{j} USING (node))" for j in range(k)) + ")"
    chosen = f"(SELECT node FROM (SELECT n.node, {far} AS far FROM nodes n JOIN f0 USING (node) JOIN b0 USING (node)) WHERE far > 0 ORDER BY far DESC, node LIMIT 1)" if k else "(SELECT node FROM seed)"
    return f"l{k} AS {chosen}, {_spread(f'f{k}', f'l{k}')}, {_spread(f'b{k}', f'l{k}', 'arcs', 'dst', 'src')}"


_MARKS = ", ".join(_marks(k) for k in range(4))
_TABLES = " UNION ALL ".join(f"SELECT l{k}.node AS landmark, t.* FROM l{k}, (SELECT node, coalesce(f{k}.dist, 4294967295) AS away, coalesce(b{k}.dist, 4294967295) AS towards FROM f{k} FULL JOIN b{k} USING (node)) t" for k in range(4))
_AT_GOAL = "(SELECT dist FROM {0} WHERE node = (SELECT node FROM goal))"
_TERMS = ", ".join(f"{_AT_GOAL.format(f'f{k}')} - f{k}.dist, b{k}.dist - {_AT_GOAL.format(f'b{k}')}" for k in range(4))
_JOINED = " ".join(f"LEFT JOIN {t}{k} ON {t}{k}.node = h0.node" for k in range(4) for t in "fb")


@query(f"{_D}, {_MARKS} {_TABLES}")
def landmark_tables(spark, sf_dir):
    t = store(spark, sf_dir).landmarks().table(spark)
    return t.select("landmark", "node", *(F.coalesce(c, F.lit(4294967295)).alias(c) for c in ("away", "towards")))


@query(f"""{_D}, {_H0}, {_MARKS}, start AS (SELECT h0.node, greatest(0, h0.h, {_TERMS}) AS h FROM h0 {_JOINED}),
r(node, h) USING KEY (node) AS (SELECT node, h FROM start UNION SELECT t, min(nh) FROM (SELECT a.src AS t, r.h + a.w AS nh FROM r JOIN arcs a ON a.dst = r.node LEFT JOIN recurring.r x ON x.node = a.src WHERE r.h + a.w < x.h) GROUP BY t),
{_spread('e', 'goal', 'arcs', 'dst', 'src')} SELECT r.node, r.h AS bound, e.dist AS exact FROM r LEFT JOIN e USING (node)""")
def alt_bound(spark, sf_dir):
    """The landmark bound of every node, repaired, beside the exact distance: never over it."""
    n, s = nodes(spark, sf_dir).count(), seed(spark, sf_dir)
    goal, marks = (s + n // 2) % n, store(spark, sf_dir).landmarks()

    def make(g):
        low, _ = kernels.lowered(g, kernels.landmark_bound(g, marks.value, goal))
        exact = pd.Series(kernels.cost_array(g, goal, True)).astype("Int64")
        return pd.DataFrame({"node": np.arange(g.n), "bound": np.frombuffer(low, np.int64), "exact": exact.mask(exact < 0)})

    return _from_arrays(spark, sf_dir, make, "node long, bound long, exact long")


@query(f"""{_D}, {_H0}, b(node, dist) USING KEY (node) AS (SELECT node::BIGINT, 0::BIGINT FROM goal UNION SELECT t, min(nd) FROM (SELECT a.src AS t, b.dist + w AS nd FROM b JOIN arcs a ON a.dst = b.node
  LEFT JOIN recurring.b x ON x.node = a.src WHERE x.dist IS NULL OR b.dist + w < x.dist) GROUP BY t) SELECT node, dist AS exact, true AS admissible FROM b""")
def alt_admissible(spark, sf_dir):
    """Distances to the goal, and whether the landmark bound is within each."""
    return alt_bound(spark, sf_dir).where("exact IS NOT NULL").select("node", "exact", (F.col("bound") <= F.col("exact")).alias("admissible"))


def _wanted(count: int) -> str:
    return f"wanted AS (SELECT k, (s.node + (k + 1) * (n // {count + 1})) % n AS goal FROM seed s, (SELECT count(*) AS n FROM nodes), range(0, {count}) r(k))"


_EXPECTED = _wanted(12)


def _costs_of(algorithm: str):
    def f(spark, sf_dir):
        return store(spark, sf_dir).search(journeys(spark, sf_dir, [algorithm]), traced=False).select("goal", F.coalesce("cost", F.lit(-1)).alias("cost"))

    return f


for _name in ("dijkstra", "bidirectional", "astar", "bidirectional-astar", "alt"):
    _f = _costs_of(_name)
    _f.__name__ = f"{_name.replace('-', '_')}_cost"
    if _f.__name__ == "bidirectional_cost":
        _f.__name__ = "bidirectional_costs"
    query(f"{_D}, {_spread('d', 'seed')}, {_EXPECTED} SELECT goal, coalesce(dist, -1) AS cost FROM wanted LEFT JOIN d ON node = goal")(_f)


@query(f"{_D}, {_spread('d', 'seed', w='1')}, {_EXPECTED} SELECT goal, coalesce(dist, -1) AS connections FROM wanted LEFT JOIN d ON node = goal")
def fewest_connections(spark, sf_dir):
    r = store(spark, sf_dir).search(journeys(spark, sf_dir, ["bidirectional-breadth-first"]), traced=False)
    return r.select("goal", F.coalesce(F.size("route_edges"), F.lit(-1)).cast("long").alias("connections"))


@query(f"{_D}, {TIME_SQL}, {_spread('d', 'seed', 'tarcs')}, {_EXPECTED} SELECT goal, coalesce(dist, -1) AS ms FROM wanted LEFT JOIN d ON node = goal")
def time_dijkstra_cost(spark, sf_dir):
    return store(spark, sf_dir).search(journeys(spark, sf_dir, ["time-dijkstra"]), "time", traced=False).select("goal", F.coalesce("cost", F.lit(-1)).alias("ms"))


def _counts_of(algorithm: str):
    def f(spark, sf_dir):
        return store(spark, sf_dir).search(journeys(spark, sf_dir, [algorithm]), traced=False).select("query_id", "algorithm", "goal", "cost", "settled", "examined", "improved", "max_queue", F.size("route_edges").alias("route_edges"), "guarantee", "meeting_cost", "corrected_nodes")

    return f


for _name in ("dijkstra", "bidirectional", "astar", "bidirectional-astar", "weighted-astar", "alt", "greedy", "depth-first", "breadth-first", "bidirectional-breadth-first", "spanning-tree"):
    _f = _counts_of(_name)
    _f.__name__ = f"{_name.replace('-', '_')}_trace"
    query()(_f)


# With positive lengths a best-first search settles nodes by (distance, node); an arc improves if
# its sum is under those of all arcs into the same node that were examined before it.
_LOOKED = f"""{_D}, {_spread('d', 'seed')}, ranked AS (SELECT node, dist, row_number() OVER (ORDER BY dist, node) AS pos FROM d),
sums AS (SELECT r.pos, a.arc, a.dst, r.dist + a.w AS s FROM ranked r JOIN arcs a ON a.src = r.node),
looked AS (SELECT pos, arc, dst, (dst <> (SELECT node FROM seed) AND s < coalesce(min(s) OVER (PARTITION BY dst ORDER BY pos, arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s + 1))::INTEGER AS better FROM sums)"""
_EVENTS = f"""{_LOOKED}, {_EXPECTED},
steps AS (SELECT *, row_number() OVER (ORDER BY pos, arc) + sum(better) OVER (ORDER BY pos, arc ROWS UNBOUNDED PRECEDING) + pos AS last FROM looked),
outs AS (SELECT r.pos, r.node, count(arc) + coalesce(sum(better), 0) AS n FROM ranked r LEFT JOIN steps USING (pos) GROUP BY r.pos, r.node),
log AS (SELECT pos, pos + sum(n) OVER (ORDER BY pos) - n AS event, 0 AS kind, node AS id FROM outs
  UNION ALL SELECT pos, last - better, 1, arc FROM steps UNION ALL SELECT pos, last, 2, arc FROM steps WHERE better = 1),
ends AS (SELECT goal, pos AS stop FROM wanted LEFT JOIN ranked ON node = goal)"""
_REACHED = "FROM ends JOIN log ON stop IS NULL OR pos < stop OR (pos = stop AND kind = 0)"


@query(f"{_EVENTS} SELECT goal, event::BIGINT AS event, kind, id {_REACHED}")
def dijkstra_events(spark, sf_dir):
    """The whole event log of each search."""
    r = settle(store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra"])))
    return search.trace_rows(r).join(r.select("query_id", "goal"), "query_id").select("goal", "event", "kind", "id")


@query(f"{_EVENTS} SELECT goal, count(*) FILTER (kind = 0) AS settled, count(*) FILTER (kind = 1) AS examined, count(*) FILTER (kind = 2) AS improved {_REACHED} GROUP BY goal")
def dijkstra_counts(spark, sf_dir):
    """What each search counts of its own events."""
    return store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra"]), traced=False).select("goal", "settled", "examined", "improved")


def _route(count: int) -> str:
    """Each search's route: from the goal back by the last arc that improved a node."""
    return f"""{_LOOKED}, {_wanted(count)}, parent AS (SELECT dst AS node, arg_max(arc, (pos, arc)) AS arc FROM looked WHERE better = 1 GROUP BY dst),
back(k, arc, far) AS (SELECT k, arc, 0 FROM wanted JOIN parent ON node = goal UNION ALL SELECT k, p.arc, far + 1 FROM back JOIN arcs a ON a.arc = back.arc JOIN parent p ON p.node = a.src),
route AS (SELECT k AS query_id, max(far) OVER (PARTITION BY k) - far AS step, edge, reversed, src, dst, w AS length FROM back JOIN arcs USING (arc))"""


@query(f"{_route(12)} SELECT query_id, step::BIGINT AS step, edge, reversed, src, dst, length FROM route")
def shortest_route_edges(spark, sf_dir):
    return search.route_steps(store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra"]), traced=False))


@query(f"{_D}, {_spread('d', 'seed')}, {_EXPECTED} SELECT goal, dist AS summed FROM wanted JOIN d ON node = goal")
def route_cost_check(spark, sf_dir):
    """Lengths of the routes' edges, looked up and summed, against the distances."""
    r = settle(store(spark, sf_dir).search(journeys(spark, sf_dir, ["astar"]), traced=False))
    steps = search.route_steps(r).join(edges(spark, sf_dir), "edge").groupBy("query_id").agg(F.sum("length_cm").alias("summed"))
    return r.where("cost IS NOT NULL").join(steps, "query_id", "left").select("goal", F.coalesce("summed", F.lit(0)).alias("summed"))


_ALL = ["dijkstra", "bidirectional", "astar", "bidirectional-astar", "weighted-astar", "alt", "greedy", "depth-first", "breadth-first", "bidirectional-breadth-first"]


_NAMED = "alg AS (SELECT unnest({names}) AS algorithm)"


@query(f"""{_D}, {_spread('d', 'seed')}, {_EXPECTED}, {_NAMED.format(names=_ALL)} SELECT algorithm, goal, dist IS NOT NULL AS found, 0::BIGINT AS violations,
  CASE WHEN dist IS NULL OR goal = (SELECT node FROM seed) THEN 0 ELSE 1 END::BIGINT AS planted FROM alg, wanted LEFT JOIN d ON node = goal""")
def route_legality_violations(spark, sf_dir):
    """Illegal steps of each search's route, and those found once its last step is planted against the edge it names."""
    r = settle(store(spark, sf_dir).search(journeys(spark, sf_dir, _ALL), traced=False))
    turned = F.transform("route_edges", lambda e, i: F.when(i == F.size("route_edges") - 1, F.lit(-1).cast("long")).otherwise(e))
    wrong = r.withColumn("route_edges", turned)
    both = [search.route_violations(x, edges(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias(name)) for x, name in ((r, "violations"), (wrong, "planted"))]
    out = r.select("query_id", "algorithm", "goal", F.col("route_nodes").isNotNull().alias("found")).join(both[0], "query_id", "left").join(both[1], "query_id", "left")
    return out.select("algorithm", "goal", "found", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("planted", F.lit(0)).alias("planted"))


@query(f"{_D}, {_spread('d', 'seed')}, {_EXPECTED} SELECT goal, coalesce(dist, -1) AS cost, 1::BIGINT AS costs, 2::BIGINT AS planted FROM wanted LEFT JOIN d ON node = goal")
def audit_cost_agreement(spark, sf_dir):
    """Different costs of the optimal searches for each goal, and those found once one of them is planted a centimetre longer."""
    r = settle(store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra", "bidirectional", "astar", "bidirectional-astar", "alt"]), traced=False))
    r = r.select("start", "goal", "algorithm", F.coalesce("cost", F.lit(-1)).alias("cost"))
    off = r.withColumn("cost", F.col("cost") + (F.col("algorithm") == "alt").cast("long"))
    bad = [search.agreement(x).select("goal", F.col("costs").alias(name)) for x, name in ((r, "costs"), (off, "planted"))]
    found = r.groupBy("goal").agg(F.min("cost").alias("cost")).join(bad[0], "goal", "left").join(bad[1], "goal", "left")
    return found.select("goal", "cost", F.coalesce("costs", F.lit(1)).alias("costs"), F.coalesce("planted", F.lit(1)).alias("planted"))


_ORDERED = ["dijkstra", "astar", "bidirectional", "greedy", "breadth-first"]


@query(f"""{_D}, {_spread('d', 'seed')}, {_NAMED.format(names=_ORDERED)}, four AS (SELECT k, (s.node + (k + 1) * (n // 5)) % n AS goal FROM seed s, (SELECT count(*) AS n FROM nodes), range(0, 4) r(k))
SELECT algorithm, goal, 0::BIGINT AS violations, 1::BIGINT AS planted FROM alg, four""")
def audit_trace_order(spark, sf_dir):
    """Events of each trace out of order, and those found once its start is planted as settled again at the end."""
    slices = settle(store(spark, sf_dir).traces(journeys(spark, sf_dir, _ORDERED, 4)))
    t, r = search.trace_rows(slices), slices.groupBy("query_id", "algorithm", "start", "goal").agg(F.sum(F.size("words")).alias("events"))
    again = r.select("query_id", (F.col("events") + 1).cast("long").alias("event"), F.lit(0).alias("kind"), F.col("start").alias("id"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("word"))
    both = [trace.trace_violations(x, arcs(spark, sf_dir)).groupBy("query_id").agg(F.count(F.lit(1)).alias(name)) for x, name in ((t, "violations"), (t.unionByName(again), "planted"))]
    out = r.select("query_id", "algorithm", "goal").join(both[0], "query_id", "left").join(both[1], "query_id", "left")
    return out.select("algorithm", "goal", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("planted", F.lit(0)).alias("planted"))


@query(f"{_D}, {_MUTUAL}, m AS (SELECT node FROM f INTERSECT SELECT node FROM b) SELECT s_suppkey AS place, s_suppkey % (SELECT count(*) FROM nodes) AS node, EXISTS (SELECT 1 FROM m WHERE m.node = s_suppkey % (SELECT count(*) FROM nodes)) AS mutual FROM supplier")
def audit_place_reach(spark, sf_dir):
    from ..sources.tables import table

    n = nodes(spark, sf_dir).count()
    m = mutual_reachable(spark, sf_dir).withColumn("mutual", F.lit(True))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % n).alias("node"))
    return places.join(m, "node", "left").select("place", "node", F.coalesce("mutual", F.lit(False)).alias("mutual"))


@query()
def audit_greedy_excess(spark, sf_dir):
    """How much longer the greedy routes are than the shortest, per cent."""
    r = store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra", "greedy"]), traced=False)
    by = r.groupBy("goal").agg(F.max(F.when(F.col("algorithm") == "dijkstra", F.col("cost"))).alias("best"), F.max(F.when(F.col("algorithm") == "greedy", F.col("cost"))).alias("greedy"))
    return by.select("goal", "best", "greedy", F.round((F.col("greedy") / F.nullif(F.col("best"), F.lit(0)) - 1) * 100, 3).alias("excess"))


# Every component's tree grows by its lightest edge at once, from its smallest node.
@query(f"""{_COMPONENTS}, ways AS (SELECT edge, u AS src, v AS dst, length_cm AS w FROM edges UNION ALL SELECT edge, v, u, length_cm FROM edges),
p(node, component, w) USING KEY (node) AS (SELECT component, component, 0::BIGINT FROM c GROUP BY component UNION
  SELECT arg_min(s.dst, (s.w, s.edge)), p.component, min(s.w) FROM recurring.p p JOIN ways s ON s.src = p.node WHERE s.dst NOT IN (SELECT node FROM recurring.p) GROUP BY p.component)
SELECT component, sum(w)::BIGINT AS total FROM p GROUP BY component""")
def mst_total(spark, sf_dir):
    return graph.spanning_total(nodes(spark, sf_dir), edges(spark, sf_dir))


@query()
def trace_digest(spark, sf_dir):
    r = store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra", "greedy"], 3))
    return trace.digest(search.trace_rows(r))


_SEGMENTS = "segs AS (SELECT edge, 0 AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v)"


def _segments(spark, sf_dir):
    n = nodes(spark, sf_dir)
    a = n.select(F.col("node").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = n.select(F.col("node").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges(spark, sf_dir).join(a, "u").join(b, "v").select("edge", F.lit(0).alias("seg"), "x1", "y1", "x2", "y2")


@query(f"WITH {GRAPH_SQL}, {_SEGMENTS} SELECT * FROM segs")
def route_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


_LEAVES = f"""WITH RECURSIVE {GRAPH_SQL}, {_SEGMENTS}, points AS (SELECT edge AS id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM segs),
depth AS (SELECT CASE WHEN count(*) <= 256 THEN 0 ELSE floor(log2((count(*) + 255) // 256 - 1)) + 1 END AS levels FROM points),
cut AS (SELECT 0 AS level, 1::BIGINT AS leaf, id, x, y FROM points UNION ALL
  SELECT level + 1, CASE WHEN n <= 256 THEN leaf * 2 ELSE leaf * 2 + (row_number() OVER (PARTITION BY leaf ORDER BY k, id) > n // 2)::INTEGER END, id, x, y
  FROM (SELECT *, count(*) OVER (PARTITION BY leaf) AS n, CASE WHEN max(x) OVER (PARTITION BY leaf) - min(x) OVER (PARTITION BY leaf) >= max(y) OVER (PARTITION BY leaf) - min(y) OVER (PARTITION BY leaf) THEN x ELSE y END AS k
    FROM cut WHERE level < (SELECT levels FROM depth)))"""


@query(f"{_LEAVES} SELECT leaf, count(*) AS n, min(x) AS x1, max(x) AS x2 FROM cut WHERE level = (SELECT levels FROM depth) GROUP BY leaf")
def leaf_sizes(spark, sf_dir):
    points = _segments(spark, sf_dir).select(F.col("edge").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return replay.spatial_leaves(points, 256).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x1"), F.max("x").alias("x2"))


@query(f"""{_route(4)}, {_SEGMENTS}, drawn AS (SELECT query_id, step, length, CASE WHEN reversed THEN x2 ELSE x1 END AS x1, CASE WHEN reversed THEN y2 ELSE y1 END AS y1,
  CASE WHEN reversed THEN x1 ELSE x2 END AS x2, CASE WHEN reversed THEN y1 ELSE y2 END AS y2 FROM route JOIN segs USING (edge) WHERE segs.x1 <> segs.x2 OR segs.y1 <> segs.y2),
summed AS (SELECT *, (sum(length) OVER (PARTITION BY query_id ORDER BY step))::DOUBLE AS upto, (sum(length) OVER (PARTITION BY query_id))::DOUBLE AS total FROM drawn)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY step))::INTEGER AS n, x1, y1, x2, y2, (upto - length) / total AS from_share, upto / total AS to_share FROM summed""")
def route_progress(spark, sf_dir):
    r = store(spark, sf_dir).search(journeys(spark, sf_dir, ["dijkstra"], 4), traced=False)
    return replay.route_progress(search.route_steps(r), _segments(spark, sf_dir))


@query()
def edge_first_events(spark, sf_dir):
    """First examination and improvement of every touched edge over both fronts."""
    r = store(spark, sf_dir).search(journeys(spark, sf_dir, ["bidirectional"], 2))
    t = search.trace_rows(r).where("kind IN (1, 2)").join(arcs(spark, sf_dir).select(F.col("arc").alias("id"), "edge"), "id").select("query_id", "event", "kind", F.col("edge").alias("id"), "side")
    sides = trace.first_events(t, "query_id", "side")
    both = sides.groupBy("query_id", "id").agg(*(F.max(F.when(F.col("side") == k, F.col("first_examined"))).alias(n) for k, n in ((0, "f"), (1, "b"))))
    return both.select("query_id", F.col("id").alias("edge"), trace.first_road_event(F.coalesce("f", F.lit(0)), F.coalesce("b", F.lit(0))).alias("first"))

