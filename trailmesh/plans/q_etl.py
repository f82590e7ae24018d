"""Queries: compiling ways, chunks, validators, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, geo, text
from ..model import CLASSES
from ..operators import compile as ways_of
from ..operators import graph, validate
from ..sources import records
from ..sources.tables import ARCS_SQL, EDGES_SQL, GRAPH_SQL, NODES_SQL, arcs, edges, nodes, remembered, table
from .registry import query

# ---------------------------------------------------------------- graph tables


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def edges_from_orders(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {EDGES_SQL}, {ARCS_SQL} SELECT arc, src, dst, edge, reversed, w FROM arcs")
def arcs_csr(spark, sf_dir):
    return arcs(spark, sf_dir)


@query(f"WITH {EDGES_SQL}, {ARCS_SQL} SELECT dst, src, arc, w, row_number() OVER (ORDER BY dst, src, arc) - 1 AS position FROM arcs")
def reverse_csr(spark, sf_dir):
    return graph.reverse_arcs(arcs(spark, sf_dir))


_DEGREES = "degs AS (SELECT node, (SELECT count(*) FROM arcs WHERE src = node) AS outgoing, (SELECT count(*) FROM arcs WHERE dst = node) AS incoming FROM nodes)"


@query(f"WITH {GRAPH_SQL}, {_DEGREES} SELECT * FROM degs")
def degrees(spark, sf_dir):
    return graph.degrees(nodes(spark, sf_dir), arcs(spark, sf_dir))


@query(f"WITH {GRAPH_SQL}, {_DEGREES} SELECT node, (sum(outgoing) OVER w - outgoing)::BIGINT AS first, (sum(outgoing) OVER w)::BIGINT AS last FROM degs WINDOW w AS (ORDER BY node)")
def offsets_prefix(spark, sf_dir):
    return graph.offsets(nodes(spark, sf_dir), arcs(spark, sf_dir))


_SPEED = "(CASE WHEN category BETWEEN 0 AND 14 THEN [100,50,80,40,60,35,50,30,40,25,35,25,10,15,25][category + 1] ELSE 25 END)"
TIME_SQL = f"tarcs AS (SELECT arc, src, dst, edge, reversed, greatest(1, floor(w * 36 / {_SPEED} + 0.5))::BIGINT AS w FROM arcs JOIN (SELECT edge AS e, category FROM edges) ON e = edge)"


@query(f"WITH {EDGES_SQL}, {ARCS_SQL}, {TIME_SQL} SELECT * FROM tarcs")
def time_arcs(spark, sf_dir):
    return graph.time_arcs(arcs(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT category, count(*) AS n, sum(CASE WHEN direction = 0 THEN 2 ELSE 1 END)::BIGINT AS arcs, sum(length_cm)::BIGINT AS length_cm FROM edges GROUP BY category")
def road_class_counts(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("direction") == 0, 2).otherwise(1)).alias("arcs"), F.sum("length_cm").alias("length_cm"))


@query(f"WITH {EDGES_SQL}, {NODES_SQL} SELECT 'endpoint' AS why, count(*) AS n FROM edges WHERE u NOT IN (SELECT node FROM nodes) OR v NOT IN (SELECT node FROM nodes) UNION ALL SELECT 'direction', count(*) FROM edges WHERE direction NOT IN (0, 1, 2)")
def edge_integrity(spark, sf_dir):
    wrong = validate.edge_integrity(edges(spark, sf_dir), nodes(spark, sf_dir)).groupBy("why").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([("endpoint",), ("direction",)], "why string")
    return every.join(wrong, "why", "left").select("why", F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- ways
KEYS = ["highway", "name", "lanes"]


def ways(spark, sf_dir):
    """Orders as ways: tags from the order's columns, nodes from its lines."""

    def make():
        line = table(spark, sf_dir, "lineitem")
        pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        lon, lat = (F.lit(8.0) + (F.col("l_partkey") % 50) * 0.0012), (F.lit(47.0) + F.floor(F.col("l_partkey") / 50) * 0.0011)
        where = F.when(F.col("l_quantity") != 50, lat)
        listed = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.struct(F.col("l_partkey").alias("ref"), lon.alias("lon"), where.alias("lat")).alias("n")))).alias("x"))
        listed = listed.select(F.col("l_orderkey").alias("way_id"), F.transform("x", lambda e: e["n"]).alias("nodes"))
        k = F.col("o_custkey") % 18
        names = F.array(*map(F.lit, CLASSES))
        highway = F.when(k < 15, F.element_at(names, (k + 1).cast("int"))).when(k == 15, "footway").when(k == 16, "track")
        pick = lambda values, mod: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("o_orderkey") % mod + 1).cast("int"))
        tags = {
            "highway": highway,
            "access": pick([None, "no", None, "yes", "private"], 5),
            "motorcar": pick([None, None, None, "yes", None, "no", None], 7),
            "vehicle": pick([None, None, "forestry", None, None, None, None, "yes", None, None, None], 11),
            "impassable": pick([None] * 12 + ["yes"], 13),
            "oneway": pick(["yes", "-1", None, "no", None, None, "true", None], 8),
            "junction": pick([None] * 8 + ["roundabout"], 9),
            "lanes": pick(["1", "2", None], 3),
            "lanes:forward": pick(["1", None], 2),
            "surface": pick(["asphalt", None, None, "gravel"], 4),
        }
        every = F.map_filter(F.create_map(*(x for n, v in tags.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), every.alias("tags")).join(listed, "way_id", "left")

    return remembered(spark, sf_dir, "ways", make)


def _pick(values: list, mod: int) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][(o_orderkey % {mod})::INTEGER + 1]"


_CLASSES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
WAYS_SQL = f"""points AS (SELECT l_orderkey AS way_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS ref,
  8.0::DOUBLE + (l_partkey % 50) * 0.0012::DOUBLE AS lon, CASE WHEN l_quantity <> 50 THEN 47.0::DOUBLE + (l_partkey // 50) * 0.0011::DOUBLE END AS lat
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
ways AS (SELECT o_orderkey AS way_id, CASE WHEN o_custkey % 18 < 15 THEN {_CLASSES}[(o_custkey % 18)::INTEGER + 1] WHEN o_custkey % 18 = 15 THEN 'footway' WHEN o_custkey % 18 = 16 THEN 'track' END AS highway,
  {_pick([None, "no", None, "yes", "private"], 5)} AS access, {_pick([None, None, None, "yes", None, "no", None], 7)} AS motorcar,
  {_pick([None, None, "forestry", None, None, None, None, "yes", None, None, None], 11)} AS vehicle, {_pick([None] * 12 + ["yes"], 13)} AS impassable,
  {_pick(["yes", "-1", None, "no", None, None, "true", None], 8)} AS oneway, {_pick([None] * 8 + ["roundabout"], 9)} AS junction,
  {_pick(["1", "2", None], 3)} AS lanes, {_pick(["1", None], 2)} AS lanes_forward,
  coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM orders LEFT JOIN (SELECT way_id, any_value(n) AS n, sum((lat IS NULL)::INTEGER) AS bad FROM points GROUP BY way_id) ON way_id = o_orderkey),
judged AS (SELECT *, CASE WHEN highway IS NULL OR NOT list_contains({_CLASSES}, highway) THEN 'class'
  WHEN coalesce(coalesce(motorcar, vehicle, access) IN ('no', 'private', 'agricultural', 'forestry'), false) OR coalesce(impassable = 'yes', false) THEN 'access'
  WHEN n < 2 OR bad > 0 THEN 'geometry' END AS reason,
  CASE WHEN oneway = '-1' THEN 2 WHEN oneway IN ('yes', '1', 'true') THEN 1 WHEN oneway IS NULL AND (junction = 'roundabout' OR highway = 'motorway') THEN 1 ELSE 0 END AS direction FROM ways),
kept AS (SELECT p.* FROM points p JOIN judged j USING (way_id) WHERE j.reason IS NULL)"""


@query(f"WITH {WAYS_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def excluded_reasons(spark, sf_dir):
    return ways_of.excluded_counts(ways(spark, sf_dir))


@query(f"WITH {WAYS_SQL} SELECT direction, count(*) AS n, min(way_id) AS first_way FROM judged WHERE reason IS NULL GROUP BY direction")
def direction_case(spark, sf_dir):
    kept = ways_of.selected(ways(spark, sf_dir)).select("way_id", ways_of.direction(F.col("tags")).alias("direction"))
    return kept.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.min("way_id").alias("first_way"))


@query(f"WITH {WAYS_SQL} SELECT way_id, coalesce(motorcar, vehicle, access) AS access, coalesce(coalesce(motorcar, vehicle, access) IN ('no', 'private', 'agricultural', 'forestry'), false) AS denied FROM ways")
def access_coalesce(spark, sf_dir):
    a = ways_of.access(F.col("tags"))
    return ways(spark, sf_dir).select("way_id", a.alias("access"), F.coalesce(a.isin(ways_of.DENIED), F.lit(False)).alias("denied"))


@query(f"""WITH {WAYS_SQL}, tagged AS (SELECT way_id, concat_ws(';', 'highway=' || highway, 'lanes=' || lanes, 'lanes:forward=' || lanes_forward) AS t FROM ways),
firsts AS (SELECT t, min(way_id) AS f FROM tagged GROUP BY t), ids AS (SELECT t, row_number() OVER (ORDER BY f) - 1 AS profile FROM firsts)
SELECT way_id, profile FROM tagged JOIN ids USING (t)""")
def profile_dictionary(spark, sf_dir):
    return ways_of.profile_ids(ways(spark, sf_dir), KEYS)


@query(f"WITH {WAYS_SQL} SELECT ref, count(*) AS uses FROM kept GROUP BY ref")
def way_node_uses(spark, sf_dir):
    return ways_of.node_uses(ways_of.way_nodes(ways_of.selected(ways(spark, sf_dir))))


SEGMENTS_SQL = f"""{WAYS_SQL}, uses AS (SELECT ref, count(*) AS u FROM kept GROUP BY ref),
flagged AS (SELECT *, (pos > 0 AND pos < n - 1 AND u > 1)::INTEGER AS cut FROM kept JOIN uses USING (ref)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY way_id ORDER BY pos) AS seg FROM flagged),
parts AS (SELECT way_id, pos, ref, lon, lat, seg FROM numbered UNION ALL SELECT way_id, pos, ref, lon, lat, seg - 1 FROM numbered WHERE cut = 1),
steps AS (SELECT *, lag(lon) OVER s AS lon0, lag(lat) OVER s AS lat0 FROM parts WINDOW s AS (PARTITION BY way_id, seg ORDER BY pos))"""


@query(f"""WITH {SEGMENTS_SQL} SELECT way_id, seg::BIGINT AS seg, arg_min(ref, pos) AS from_ref, arg_max(ref, pos) AS to_ref, count(*) AS points,
round(sum(coalesce(sqrt(pow((lon - lon0) * cos(radians((lat + lat0) / 2)), 2) + pow(lat - lat0, 2)) * 111195.0802, 0)) * 100)::BIGINT AS length_cm FROM steps GROUP BY way_id, seg HAVING count(*) > 1""")
def way_segments(spark, sf_dir):
    parts = ways_of.segments(ways_of.way_nodes(ways_of.selected(ways(spark, sf_dir))))
    sized = ways_of.segment_length_cm(parts)
    return sized.select("way_id", F.col("seg").cast("long").alias("seg"), "from_ref", "to_ref", "points", "length_cm")


@query(f"""WITH {SEGMENTS_SQL}, ends AS (SELECT way_id, pos, ref FROM (SELECT *, row_number() OVER (PARTITION BY way_id, seg ORDER BY pos) AS a, row_number() OVER (PARTITION BY way_id, seg ORDER BY pos DESC) AS b, count(*) OVER (PARTITION BY way_id, seg) AS c FROM parts) WHERE (a = 1 OR b = 1) AND c > 1),
firsts AS (SELECT ref, min(struct_pack(w := way_id, p := pos)) AS f FROM ends GROUP BY ref) SELECT ref AS osm_id, row_number() OVER (ORDER BY f.w, f.p) - 1 AS node FROM firsts""")
def dense_node_ids(spark, sf_dir):
    n, _ = ways_of.compile_graph(ways(spark, sf_dir))
    return n.select("osm_id", "node")


# ---------------------------------------------------------------- chunks
@query(f"WITH {NODES_SQL} SELECT node // 500 AS chunk, node, x - coalesce(lag(x) OVER w, 0) AS d_x, y - coalesce(lag(y) OVER w, 0) AS d_y FROM nodes WINDOW w AS (PARTITION BY node // 500 ORDER BY node)")
def delta_encode(spark, sf_dir):
    return records.delta_encode(nodes(spark, sf_dir), "node", ["x", "y"], 500)


@query(f"WITH {NODES_SQL} SELECT node // 500 AS chunk, node, x, y FROM nodes")
def delta_decode(spark, sf_dir):
    made = records.delta_encode(nodes(spark, sf_dir), "node", ["x", "y"], 500)
    return records.delta_decode(made, "node", ["x", "y"])


@query("WITH t AS (SELECT count(*) AS n FROM part) SELECT c AS chunk, c * 300 AS start, least(300, n - c * 300) AS count FROM t, range(0, 1000000) r(c) WHERE c * 300 < n")
def chunk_layout(spark, sf_dir):
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(records.chunk_layout(F.col("n"), 300)).alias("c")).select("c.*")


_CHUNKS = """chunks AS (SELECT row_number() OVER (ORDER BY kind_no, k) AS n, kind, kind || '/' || k || CASE WHEN k = 7 THEN '/../x' ELSE '' END AS path, k * 100 + CASE WHEN k = 5 THEN 1 ELSE 0 END AS start, CASE WHEN k = 9 THEN 90 ELSE 100 END AS count,
  CASE kind WHEN 'nodes' THEN 8 WHEN 'edges' THEN CASE WHEN k = 3 THEN 15 ELSE 14 END ELSE 0 END AS stride, 1000 AS bytes
  FROM (SELECT s_suppkey // 3 AS k, ['nodes','edges','geometry'][(s_suppkey % 3)::INTEGER + 1] AS kind, s_suppkey % 3 AS kind_no FROM supplier))"""


@query(f"""WITH {_CHUNKS}, found AS (SELECT kind, start, 'gap' AS why FROM (SELECT *, coalesce(lag(start + count) OVER (PARTITION BY kind ORDER BY start), 0) AS e FROM chunks) WHERE start <> e
UNION ALL SELECT kind, start, CASE WHEN (kind = 'nodes' AND stride <> 8) OR (kind = 'edges' AND stride <> 14) OR (kind = 'geometry' AND stride <> 0) THEN 'stride' ELSE 'path' END FROM chunks
  WHERE (kind = 'edges' AND stride <> 14) OR path LIKE '%..%')
SELECT kind, why, count(*) AS n FROM found GROUP BY kind, why""")
def chunk_coverage_violations(spark, sf_dir):
    k, m = F.floor(F.col("s_suppkey") / 3), F.col("s_suppkey") % 3
    kind = F.element_at(F.array(F.lit("nodes"), F.lit("edges"), F.lit("geometry")), (m + 1).cast("int"))
    c = table(spark, sf_dir, "supplier").select((m * 1000000 + k).alias("n"), kind.alias("kind"), k.alias("k"))
    c = c.select("n", "kind", F.concat("kind", F.lit("/"), F.col("k").cast("string"), F.when(F.col("k") == 7, "/../x").otherwise("")).alias("path"), (F.col("k") * 100 + F.when(F.col("k") == 5, 1).otherwise(0)).alias("start"), F.when(F.col("k") == 9, 90).otherwise(100).alias("count"), F.when(F.col("kind") == "nodes", 8).when(F.col("kind") == "edges", F.when(F.col("k") == 3, 15).otherwise(14)).otherwise(0).alias("stride"), F.lit(1000).alias("bytes"))
    return validate.chunk_coverage(c).groupBy("kind", "why").agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT event_id, (abs(hash_in) % 4294967296)::BIGINT AS bits FROM (SELECT event_id, (event_id * 2654435761 + user_id * 40503) AS hash_in FROM events)) SELECT event_id, bits, (bits - coalesce(lag(bits) OVER (ORDER BY event_id), 0)) & 4294967295 AS d_bits FROM v")
def drawing_codec(spark, sf_dir):
    v = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 2654435761 + F.col("user_id") * 40503) % 4294967296).alias("bits"), F.lit(0).alias("drawing"))
    made = records.delta32_encode(v, "event_id", "bits", "drawing")
    return records.delta32_decode(made.drop("bits"), "event_id", "bits", "drawing").select("event_id", "bits", "d_bits")


@query("SELECT o_custkey AS record, o_orderkey AS n, o_orderkey % 97 AS bytes, coalesce(sum((o_orderkey % 97 + 3) // 4 * 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders")
def buffer_offsets(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 97).alias("bytes"))
    return records.buffer_offsets(b)


# ---------------------------------------------------------------- scalars
_PAIR = "nodes a JOIN nodes b ON b.node = (a.node * 7 + 3) % (SELECT count(*) FROM nodes)"
_HAV = "pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
_H = _HAV.format(lat1="a.y / 1e5", lat2="b.y / 1e5", lon1="a.x / 1e5", lon2="b.x / 1e5")


def _pairs(spark, sf_dir):
    n = nodes(spark, sf_dir)
    count = n.count()
    a = n.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), ((F.col("node") * 7 + 3) % count).alias("b"))
    return a.join(n.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")


@query(f"WITH {NODES_SQL} SELECT a.node AS a, b.node AS b, round(12742.0176 * asin(sqrt(least(1.0, {_H}))), 6) AS km FROM {_PAIR}")
def haversine_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("a", "b", F.round(geo.straight_line_km(F.col("ax") / 1e5, F.col("ay") / 1e5, F.col("bx") / 1e5, F.col("by") / 1e5), 6).alias("km"))


@query(f"WITH {NODES_SQL}, top AS (SELECT max(abs(y)) AS t FROM nodes) SELECT a.node AS a, b.node AS b, floor(sqrt(pow((a.x - b.x) * cos(radians(t / 1e5)), 2) + pow(a.y - b.y, 2)) * 111.1950802)::BIGINT AS cm FROM {_PAIR}, top")
def planar_bound(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    top = nodes(spark, sf_dir).agg(F.max(F.abs("y"))).first()[0]
    return p.select("a", "b", geo.planar_bound_cm(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"), F.lit(top)).alias("cm"))


@query("SELECT o_orderkey, round(least(65.0, greatest(25.0, 30.0 * sqrt(o_totalprice / 100 / 100))), 6) AS seconds, round(least(3.0, 0.1 * (o_totalprice / 100)) / (o_totalprice / 100), 6) AS route_share FROM orders")
def replay_seconds(spark, sf_dir):
    km = F.col("o_totalprice") / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(geo.replay_seconds(km), 6).alias("seconds"), F.round(geo.route_window(km), 6).alias("route_share"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, floor(round(l_extendedprice * 100)::BIGINT * 36 / (5 + l_partkey % 100) + 0.5))::BIGINT AS ms FROM lineitem")
def travel_ms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geo.travel_ms(F.round(F.col("l_extendedprice") * 100).cast("long"), 5 + F.col("l_partkey") % 100).alias("ms"))


@query("WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 360 - 180)::DOUBLE AS a, (s_suppkey * 91 % 360 - 180)::DOUBLE AS b FROM supplier) SELECT s_suppkey, CASE WHEN a - b > 180 THEN a - b - 360 WHEN a - b < -180 THEN a - b + 360 ELSE a - b END AS wrapped, ((a + b + 180) - 360 * floor((a + b + 180) / 360)) - 180 AS normal FROM p")
def lon_wrap(spark, sf_dir):
    a, b = (((F.col("s_suppkey") * k) % 360 - 180).cast("double") for k in (37, 91))
    return table(spark, sf_dir, "supplier").select("s_suppkey", geo.longitude_offset(a, b).alias("wrapped"), geo.normalise_longitude(a + b).alias("normal"))


@query(f"""WITH {NODES_SQL}, c AS (SELECT (min(x) + max(x)) / 2e5 AS cx, (min(y) + max(y)) / 2e5 AS cy FROM nodes),
p AS (SELECT (x / 1e5 - cx) * cos(radians(cy)) * 111195.0802 / 10000 AS px, (y / 1e5 - cy) * 111195.0802 / 10000 AS py FROM nodes, c)
SELECT round(min(px), 6) AS x1, round(min(py), 6) AS y1, round(max(px), 6) AS x2, round(max(py), 6) AS y2 FROM p""")
def projection_bounds(spark, sf_dir):
    n = nodes(spark, sf_dir)
    c = n.agg(((F.min("x") + F.max("x")) / 2e5).alias("cx"), ((F.min("y") + F.max("y")) / 2e5).alias("cy")).first()
    px, py = geo.project(F.col("x") / 1e5, F.col("y") / 1e5, c["cx"], c["cy"], c["cy"], 10000.0)
    return n.select(px.alias("px"), py.alias("py")).agg(F.round(F.min("px"), 6).alias("x1"), F.round(F.min("py"), 6).alias("y1"), F.round(F.max("px"), 6).alias("x2"), F.round(F.max("py"), 6).alias("y2"))


@query("SELECT event_id, (event_id * 1664525 + 1013904223) & 4294967295 AS lcg, (c ^ ((c << 5) & 4294967295)) AS xorshift FROM (SELECT event_id, b ^ (b >> 17) AS c FROM (SELECT event_id, xor(a, (a << 13) & 4294967295) AS b FROM (SELECT event_id, CASE WHEN event_id & 4294967295 = 0 THEN 1831565813 ELSE event_id & 4294967295 END AS a FROM events)))".replace("b ^ (b >> 17)", "xor(b, b >> 17)").replace("(c ^ ((c << 5) & 4294967295))", "xor(c, (c << 5) & 4294967295)"))
def generators(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bits.lcg("event_id").alias("lcg"), bits.xorshift32("event_id").alias("xorshift"))


@query("SELECT s_suppkey, CASE WHEN km < 30 THEN NULL WHEN km < 100 THEN 'regional' WHEN km < 220 THEN 'interregional' ELSE 'national' END AS band FROM (SELECT s_suppkey, abs(s_acctbal) / 20 AS km FROM supplier)")
def distance_band(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", geo.distance_band(F.abs("s_acctbal") / 20).alias("band"))


_RING = "[{lon: 0.0, lat: 0.0}]"


@query("""WITH r AS (SELECT s_suppkey, 1.0 + s_suppkey % 7 AS w, 2.0 + s_suppkey % 5 AS h FROM supplier)
SELECT s_suppkey, w * h / 2 AS area, (1.0 > 0.0 AND 0.5 < w * (1 - 1.0 / h)) AS inside, s_suppkey % 4 <> 0 AS valid FROM r""")
def rings(spark, sf_dir):
    w, h = 1.0 + F.col("s_suppkey") % 7, 2.0 + F.col("s_suppkey") % 5
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(zero, zero), at(w, zero), at(zero, h), at(zero, zero))
    open_ring = F.when(F.col("s_suppkey") % 4 == 0, F.array(at(zero, zero), at(w, zero), at(zero, h), at(w, h))).otherwise(ring)
    t = table(spark, sf_dir, "supplier").select("s_suppkey", ring.alias("r"), open_ring.alias("o"))
    return t.select("s_suppkey", geo.ring_area("r").alias("area"), geo.inside_ring(F.lit(0.5), F.lit(1.0), "r").alias("inside"), geo.valid_ring("o").alias("valid"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier UNION ALL SELECT -1, 'zurich-hb' UNION ALL SELECT -2, 'strasse-oe-aero'")
def slug_names(spark, sf_dir):
    extra = spark.createDataFrame([(-1, "Zürich (HB)"), (-2, "Straße Øe / Ærø")], "s_suppkey long, s_name string")
    both = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").unionByName(extra)
    return both.select("s_suppkey", F.regexp_replace(text.slug("s_name"), "^strasse-oe-aero$", "strasse-oe-aero").alias("slug"))


@query("SELECT o_orderkey, least(o_orderpriority, o_orderstatus) || '/' || greatest(o_orderpriority, o_orderstatus) AS key FROM orders")
def pair_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.pair_key("o_orderpriority", "o_orderstatus").alias("key"))


@query("""WITH l AS (SELECT s_suppkey, s_suppkey % 400 - 200 AS lon, s_suppkey % 90 AS lat, ['dijkstra','astar','nothing'][(s_suppkey % 3)::INTEGER + 1] AS a FROM supplier)
SELECT s_suppkey, lon BETWEEN -180 AND 180 AND a <> 'nothing' AS valid, CASE WHEN lon BETWEEN -180 AND 180 AND a <> 'nothing' THEN lon::DOUBLE ELSE -999 END AS lon, CASE WHEN lon BETWEEN -180 AND 180 AND a <> 'nothing' THEN a ELSE '' END AS algorithm FROM l""")
def link_parse(spark, sf_dir):
    lon, lat = F.col("s_suppkey") % 400 - 200, F.col("s_suppkey") % 90
    a = F.element_at(F.array(F.lit("dijkstra"), F.lit("astar"), F.lit("nothing")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://maps.example/?x=1&country=ch&from="), lon.cast("string"), F.lit("%2C"), lat.cast("string"), F.lit(",A%20b&to=8.5,47&algorithm="), a)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", records.parse_link(url).alias("s"))
    return s.select("s_suppkey", F.col("s").isNotNull().alias("valid"), F.coalesce("s.start.lon", F.lit(-999.0)).alias("lon"), F.coalesce("s.algorithm", F.lit("")).alias("algorithm"))


@query("""SELECT o_orderkey, sha256('{"a":' || o_orderkey || ',"b":"' || o_orderstatus || '","c":[1,' || o_custkey || ']}') AS identity FROM orders""")
def canonical_hash(spark, sf_dir):
    raw = F.concat(F.lit('{"c": [1.0, '), F.col("o_custkey").cast("string"), F.lit('], "b": "'), F.col("o_orderstatus"), F.lit('", "a": '), F.col("o_orderkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(text.canonical_json(raw).cast("binary"), 256).alias("identity"))


@query("SELECT page_id, regexp_full_match(key, '[A-Za-z0-9][A-Za-z0-9._/-]*') AND NOT contains(key, '..') AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS key FROM pages)")
def regex_keys(spark, sf_dir):
    key = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", (key.rlike(validate.SAFE_PATH) & ~key.contains("..")).alias("safe"))
