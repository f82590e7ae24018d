"""Queries: snapping, journeys, ranges, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, replay, sampler, search, validate
from ..sources.tables import GRAPH_SQL, arcs, edges, nodes, table
from .q_etl import WAYS_SQL, ways
from .q_graph import _COMPONENTS, store
from .registry import query


def points(spark, sf_dir):
    """Suppliers as named points over the graph."""
    s, n = F.col("s_suppkey"), nodes(spark, sf_dir).count()
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.lit(8.0) + (s * 37 % 64) / 1000).alias("lon"), (F.lit(47.0) + (s * 53 % (n // 50 + 1)) * 0.0011).alias("lat"))


_POINTS = "points AS (SELECT s_name AS name, 8.0::DOUBLE + (s_suppkey * 37 % 64) / 1000 AS lon, 47.0::DOUBLE + (s_suppkey * 53 % ((SELECT count(*) FROM nodes) // 50 + 1)) * 0.0011::DOUBLE AS lat FROM supplier)"
_SNAP = f"""{_COMPONENTS}, halves AS (SELECT u AS src, v AS dst FROM edges WHERE direction <> 2 UNION ALL SELECT v, u FROM edges WHERE direction <> 1), {_POINTS},
good AS (SELECT * FROM nodes WHERE node IN (SELECT u FROM edges WHERE category <= 11 UNION SELECT v FROM edges WHERE category <= 11) AND node IN (SELECT src FROM halves) AND node IN (SELECT dst FROM halves)),
near AS (SELECT p.name, c.component, g.node, sqrt(pow((g.x / 1e5 - p.lon) * cos(radians(p.lat)), 2) + pow(g.y / 1e5 - p.lat, 2)) * 111195.0802 AS metres FROM points p JOIN good g ON abs(g.y / 1e5 - p.lat) < 0.03 JOIN c USING (node)),
cand AS (SELECT name, component, arg_min(node, struct_pack(m := metres, n := node)) AS node, min(metres) AS metres FROM near WHERE metres <= 2000 GROUP BY name, component)"""


def _candidates(spark, sf_dir):
    s = store(spark, sf_dir)
    return search.snap_candidates(points(spark, sf_dir), search.eligible_nodes(s.nodes, s.edges, s.arcs), s.components)


@query(f"{_SNAP} SELECT name, component, node, round(metres, 4) AS metres FROM cand")
def snap_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("name", "component", "node", F.round("metres", 4).alias("metres"))


@query(f"""{_SNAP}, two AS (SELECT name FROM points ORDER BY name LIMIT 2), sums AS (SELECT component, sum(metres) AS s, list_sort(list(node)) AS ns FROM cand WHERE name IN (SELECT name FROM two) GROUP BY component HAVING count(*) = 2),
best AS (SELECT component FROM sums WHERE ns[1] <> ns[2] ORDER BY s, ns LIMIT 1)
SELECT name, node, round(metres, 4) AS metres FROM cand WHERE name IN (SELECT name FROM two) AND component IN (SELECT component FROM best)""")
def snap_pair(spark, sf_dir):
    names = [r["name"] for r in points(spark, sf_dir).orderBy("name").limit(2).collect()]
    return search.snap(_candidates(spark, sf_dir), names).select("name", "node", F.round("metres", 4).alias("metres"))


# ---------------------------------------------------------------- journeys
def places(spark, sf_dir):
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), F.col("s_name").alias("id"), (F.lit(6.0) + (s * 37 % 1000) / 300).alias("lon"), (F.lit(46.0) + (s * 53 % 800) / 300).alias("lat"), (s % 3).cast("string").alias("region"))


_PLACES = "places AS (SELECT s_nationkey AS pool, s_name AS id, 6.0::DOUBLE + (s_suppkey * 37 % 1000) / 300 AS lon, 46.0::DOUBLE + (s_suppkey * 53 % 800) / 300 AS lat, (s_suppkey % 3)::VARCHAR AS region FROM supplier)"


def _km(a: str, b: str) -> str:
    return f"round(12742.0176 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))), 6)"


@query(f"""WITH {_PLACES}, pairs AS (SELECT a.pool, a.id AS a, b.id AS b, {_km("a", "b")} AS km FROM places a JOIN places b ON a.pool = b.pool AND a.region = b.region AND a.id < b.id)
SELECT pool, a || '/' || b AS key, a, b, km, round(km * 1.25, 6) AS estimate, CASE WHEN km * 1.25 < 100 THEN 'regional' WHEN km * 1.25 < 220 THEN 'interregional' ELSE 'national' END AS band FROM pairs WHERE km >= 30""")
def journey_candidates(spark, sf_dir):
    return sampler.journey_candidates(places(spark, sf_dir)).withColumn("estimate", F.round("estimate", 6))


@query(f"""WITH {_PLACES}, t AS (SELECT a.pool, a.id AS a, b.id AS b, c.id AS c, {_km("a", "b")} AS ab, {_km("b", "c")} AS bc, {_km("a", "c")} AS ac FROM places a JOIN places b ON a.pool = b.pool AND a.region = b.region AND a.id < b.id JOIN places c ON c.pool = a.pool AND c.region = a.region AND b.id < c.id)
SELECT pool, a, b, c, least(ab, bc, ac) AS separation FROM t WHERE least(ab, bc, ac) >= 30 AND least(ab, bc, ac) >= 0.2 * greatest(ab, bc, ac)""")
def triple_candidates(spark, sf_dir):
    return sampler.triple_candidates(places(spark, sf_dir))


_HOMES = "homes AS (SELECT c_custkey AS id, c_mktsegment AS pool, 6.0::DOUBLE + (c_custkey * 37 % 1000) / 300 AS lon, 46.0::DOUBLE + (c_custkey * 53 % 800) / 300 AS lat FROM customer)"


@query(f"""WITH {_HOMES}, pairs AS (SELECT a.pool, {_km("a", "b")} AS km FROM homes a JOIN homes b ON a.pool = b.pool AND a.id < b.id)
SELECT pool, CASE WHEN km < 30 THEN 'near' WHEN km * 1.25 < 100 THEN 'regional' WHEN km * 1.25 < 220 THEN 'interregional' ELSE 'national' END AS band, count(*) AS pairs FROM pairs GROUP BY ALL""")
def band_counts(spark, sf_dir):
    """Pairs of homes of one pool by the band of a journey between them, counted by pairs of cells."""
    c = F.col("c_custkey")
    homes = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("pool"), (F.lit(6.0) + (c * 37 % 1000) / 300).alias("lon"), (F.lit(46.0) + (c * 53 % 800) / 300).alias("lat"))
    return sampler.band_counts(homes, ["pool"]).select("pool", "band", "pairs")


@query()
def sampled_journeys(spark, sf_dir):
    """60 journeys of one pool by seeded draws; every seventh place's roads are too long for the band, so their pairs are drawn anew."""
    return sampler.sample_pairs_of(spark, places(spark, sf_dir).withColumn("pool", F.lit(0)), 7, 60, lambda r: r["estimate"] * (2.5 if r["b"].endswith(("7", "0")) else 1.0))


@query()
def sampled_triples(spark, sf_dir):
    c = sampler.triple_candidates(places(spark, sf_dir).withColumn("pool", F.lit(0)))
    return sampler.sample_triples(spark, c, 7, 20)


@query(f"""WITH {_PLACES}, pairs AS (SELECT a.id AS a, b.id AS b, {_km("a", "b")} AS km FROM places a JOIN places b ON a.pool = b.pool AND a.id < b.id), e AS (SELECT a AS place, km FROM pairs UNION ALL SELECT b, km FROM pairs)
SELECT place, count(*) AS uses, round(min(km), 6) AS nearest, round(max(km), 6) AS furthest FROM e GROUP BY place""")
def endpoint_use_counts(spark, sf_dir):
    from ..functions.geo import straight_line_km

    p = places(spark, sf_dir)
    a, b = (p.select("pool", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "lon", "lat"))) for k in "ab")
    pairs = a.join(b, "pool").where("a_id < b_id").withColumn("km", straight_line_km("a_lon", "a_lat", "b_lon", "b_lat"))
    ends = pairs.select(F.explode(F.array("a_id", "b_id")).alias("place"), "km")
    return ends.groupBy("place").agg(F.count(F.lit(1)).alias("uses"), F.round(F.min("km"), 6).alias("nearest"), F.round(F.max("km"), 6).alias("furthest"))


# ---------------------------------------------------------------- ranges
_BOXES = """boxes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 1000 AS b_x1, l_suppkey * 7 % 1000 AS b_y1, l_partkey % 1000 + l_linenumber * 3 AS b_x2, l_suppkey * 7 % 1000 + l_linenumber * 2 AS b_y2 FROM lineitem),
views AS (SELECT s_suppkey AS view, s_suppkey * 13 % 1000 AS v_x1, s_suppkey * 29 % 1000 AS v_y1, s_suppkey * 13 % 1000 + 20 AS v_x2, s_suppkey * 29 % 1000 + 20 AS v_y2 FROM supplier)"""


@query(f"WITH {_BOXES} SELECT view, count(*) AS boxes, sum(l_partkey)::BIGINT AS parts FROM views JOIN boxes ON v_x1 - 1 <= b_x2 AND v_x2 + 1 >= b_x1 AND v_y1 - 1 <= b_y2 AND v_y2 + 1 >= b_y1 GROUP BY view")
def viewport_cull(spark, sf_dir):
    x, y, n = F.col("l_partkey") % 1000, F.col("l_suppkey") * 7 % 1000, F.col("l_linenumber")
    boxes = table(spark, sf_dir, "lineitem").select("l_partkey", x.alias("b_x1"), y.alias("b_y1"), (x + n * 3).alias("b_x2"), (y + n * 2).alias("b_y2"))
    vx, vy = F.col("s_suppkey") * 13 % 1000, F.col("s_suppkey") * 29 % 1000
    views = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("view"), vx.alias("v_x1"), vy.alias("v_y1"), (vx + 20).alias("v_x2"), (vy + 20).alias("v_y2"))
    return joins.viewport_sums(views, boxes, 40.0, "view", "l_partkey").select("view", F.col("n").alias("boxes"), F.col("total").alias("parts"))


@query(f"WITH {GRAPH_SQL}, chunks AS (SELECT k AS chunk, k * 100 AS first, k * 100 + 99 AS last FROM range(0, 1000000) r(k) WHERE k * 100 < (SELECT count(*) FROM edges)) SELECT chunk, count(*) AS n, sum(length_cm)::BIGINT AS length_cm FROM edges JOIN chunks ON edge BETWEEN first AND last GROUP BY chunk")
def range_chunk_lookup(spark, sf_dir):
    e = edges(spark, sf_dir)
    n = e.count()
    chunks = spark.range((n + 99) // 100).select(F.col("id").alias("chunk"), (F.col("id") * 100).alias("first"), (F.col("id") * 100 + 99).alias("last"))
    return joins.range_lookup(e, chunks, "edge", "first", "last", 100).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("length_cm").alias("length_cm"))


@query(f"WITH {GRAPH_SQL}, chunks AS (SELECT k AS chunk, k * 50 AS first, k * 50 + 49 AS last FROM range(0, 1000000) r(k) WHERE k * 50 < (SELECT count(*) FROM edges)) SELECT chunk FROM chunks WHERE EXISTS (SELECT 1 FROM edges WHERE category = 0 AND direction = 1 AND edge BETWEEN first AND last)")
def chunk_needed(spark, sf_dir):
    e = edges(spark, sf_dir)
    chunks = spark.range((e.count() + 49) // 50).select(F.col("id").alias("chunk"), (F.col("id") * 50).alias("first"), (F.col("id") * 50 + 49).alias("last"))
    reached = e.where("category = 0 AND direction = 1")
    return replay.chunks_needed(chunks, reached, reached.limit(0), 50).select("chunk")


# ---------------------------------------------------------------- semi, anti and set operations
@query("SELECT l_partkey AS ref, count(*) AS uses FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) GROUP BY 1")
def ref_anti_check(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("ref"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref"))
    return refs.join(known, "ref", "left_anti").groupBy("ref").agg(F.count(F.lit(1)).alias("uses"))


_MEMBERS = f"""{WAYS_SQL}, ids AS (SELECT way_id, row_number() OVER (ORDER BY way_id) - 1 AS dense FROM judged WHERE reason IS NULL),
members AS (SELECT o_custkey AS id, o_orderkey AS way_id FROM orders WHERE o_orderstatus = 'F')"""


@query(f"WITH {_MEMBERS} SELECT id, count(*) AS members, count(*) - count(dense) AS unresolved, coalesce(min(dense), -1) AS first FROM members LEFT JOIN ids USING (way_id) GROUP BY id HAVING count(dense) > 0")
def restriction_resolution(spark, sf_dir):
    from ..operators import compile as ways_of
    from .ids import numbered

    kept = numbered(ways_of.selected(ways(spark, sf_dir)).select("way_id"), ["way_id"], "edge").select("way_id", "edge")
    member = F.struct(F.lit("w").alias("type"), F.col("o_orderkey").alias("ref"), F.lit("via").alias("role"))
    restrictions = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(member).alias("members"))
    nowhere = kept.limit(0).select(F.col("way_id").alias("ref"), F.col("edge").alias("node"))
    members, _ = ways_of.resolve_members(ways_of.restrictions_kept(restrictions, kept), kept, nowhere)
    return members.groupBy("id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("dense").isNull()).alias("unresolved"), F.coalesce(F.min("dense"), F.lit(-1)).alias("first"))


@query("SELECT c_nationkey AS key, 'both' AS kind FROM customer UNION SELECT s_nationkey, 'both' FROM supplier")
def union_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    return c.unionByName(s).dropDuplicates(["key"]).withColumn("kind", F.lit("both"))


@query("(SELECT o_custkey AS path, 'unexpected' AS side FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) UNION ALL (SELECT c_custkey, 'missing' FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders))")
def listing_diff(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")).distinct()
    expected = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("path"))
    return validate.listing_difference(found, expected)


@query(f"WITH {GRAPH_SQL} SELECT src AS node FROM arcs INTERSECT SELECT dst FROM arcs")
def reachable_intersect(spark, sf_dir):
    a = arcs(spark, sf_dir)
    return a.select(F.col("src").alias("node")).intersect(a.select(F.col("dst").alias("node")))


@query("SELECT coalesce(n_regionkey, -1) AS region, coalesce(n_nationkey, -1) AS nation, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def coverage_rollup(spark, sf_dir):
    """Beyond the inventory: places by region and nation with subtotals."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").rollup("n_regionkey", "n_nationkey").agg(F.count("s_suppkey").alias("suppliers")).select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("n_nationkey", F.lit(-1)).alias("nation"), "suppliers")


# ---------------------------------------------------------------- geography, slugs, replay rules
@query("""WITH b AS (SELECT n_nationkey AS id, n_nationkey % 5 * 3.0 AS x, n_nationkey // 5 * 3.0 AS y, 2.0 + n_nationkey % 3 AS w FROM nation),
p AS (SELECT s_suppkey AS p, (s_suppkey * 37 % 1600) / 100.0 + 0.005 AS x, (s_suppkey * 53 % 1600) / 100.0 + 0.005 AS y FROM supplier)
SELECT p, id FROM p JOIN b ON p.x > b.x AND p.x < b.x + w AND p.y > b.y AND p.y < b.y + w AND NOT (p.x > b.x + 0.5 AND p.x < b.x + 1 AND p.y > b.y + 0.5 AND p.y < b.y + 1)""")
def points_in_polygons(spark, sf_dir):
    from ..sources import geography

    k = F.col("n_nationkey")
    x, y, w = k % 5 * 3.0, F.floor(k / 5) * 3.0, 2.0 + k % 3

    def square(a, b, s):
        at = lambda u, v: F.struct(u.cast("double").alias("x"), v.cast("double").alias("y"))
        return F.array(at(a, b), at(a + s, b), at(a + s, b + s), at(a, b + s), at(a, b))

    land = table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), F.array(F.array(square(x, y, w), square(x + 0.5, y + 0.5, F.lit(0.5)))).alias("polygons"))
    s = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(s.alias("p"), ((s * 37 % 1600) / 100.0 + 0.005).alias("x"), ((s * 53 % 1600) / 100.0 + 0.005).alias("y"))
    return geography.points_in(points, land, 2.0).select("p", "id")


@query("SELECT s_name AS slug, s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def slug_lookup(spark, sf_dir):
    from ..sources import geography

    s = table(spark, sf_dir, "supplier")
    named = s.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_name").alias("slug"), F.col("s_suppkey").alias("id"), "s_suppkey", "n_name")
    return geography.place_of_slug(s.select(F.col("s_name").alias("slug")), named).drop("id")


@query("SELECT o_orderkey, CASE WHEN t < d THEN 'replay' WHEN t < d + 6 THEN 'hold' WHEN t < d + 8 THEN 'fade' ELSE 'next' END AS phase FROM (SELECT o_orderkey, (o_orderkey % 80)::DOUBLE AS t, 25.0 + o_custkey % 40 AS d FROM orders)")
def replay_phase(spark, sf_dir):
    from ..operators import view

    return table(spark, sf_dir, "orders").select("o_orderkey", view.phase_at((F.col("o_orderkey") % 80).cast("double"), 25.0 + F.col("o_custkey") % 40).alias("phase"))


@query("SELECT o_orderkey, round(CASE WHEN part < 1 THEN least(1.0, p / (1 - part)) ELSE 1.0 END, 9) AS search, round(greatest(0.0, (p - (1 - part)) / part), 9) AS route FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS p, least(3.0, 0.1 * (25.0 + o_custkey % 40)) / (25.0 + o_custkey % 40) AS part FROM orders)")
def replay_clock(spark, sf_dir):
    from ..operators import view

    clock = view.replay_clock((F.col("o_orderkey") % 101) / 100.0, 25.0 + F.col("o_custkey") % 40, F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.alias("c")).select("o_orderkey", F.round("c.search", 9).alias("search"), F.round("c.route", 9).alias("route"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'multisource' ELSE ['dijkstra','bidirectional','astar','bidirectional-astar','greedy'][((c_custkey - c_custkey // 5) % 5)::INTEGER + 1] END AS algorithm FROM customer")
def journey_cycle(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sampler.algorithm_of_journey(F.col("c_custkey")).alias("algorithm"))


@query()
def simplified_ways(spark, sf_dir):
    """Points of each way before and after simplification at 5 and 15 metres."""
    from ..operators import compile as ways_of

    w = ways_of.selected(ways(spark, sf_dir)).select("way_id", F.transform("nodes", lambda n: F.struct(n["lon"].alias("x"), n["lat"].alias("y"))).alias("p"))
    made = w.select("way_id", F.size("p").alias("points"), F.size(ways_of.simplify(F.col("p"), 5.0)).alias("at_5"), F.size(ways_of.simplify(F.col("p"), 15.0)).alias("at_15"))
    return made


@query()
def sampler_audit(spark, sf_dir):
    """Accepted draws, those that repeat one of the six accepted before them (none is expected), and those found once each tenth is planted again."""
    from ..functions.geo import normalise_longitude

    wide = places(spark, sf_dir).withColumns({"pool": F.lit(0), "lon": normalise_longitude(F.col("lon") * 3)})
    drawn = sampler.sample_pairs_of(spark, wide, 11, 60).where("accepted").select("n", "key")
    planted = drawn.unionByName(drawn.where("n % 10 = 9").select((F.col("n") + 0.5).alias("n"), "key"))
    count = lambda df, name: sampler.repeats(df, "key", "n", 6).agg(F.count(F.lit(1)).alias(name))
    return drawn.agg(F.count(F.lit(1)).alias("draws")).crossJoin(count(drawn, "repeats")).crossJoin(count(planted, "found"))  # one row each
