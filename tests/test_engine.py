"""DataFrame operators: fixpoints, snapping, search, traces, compile, records, streaming."""

import pickle
import math
import random
import time
from collections import Counter
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmesh.functions import bits, geo, text
from trailmesh.model import EDGES, REQUESTS, Algorithm
from trailmesh.operators import compile as ways_of
from trailmesh.operators import graph, joins, kernels, replay, sampler, search, trace, validate
from trailmesh.operators.search import GraphStore
from trailmesh.sources import records
from trailmesh.streaming import replay as streams

from .test_kernels import build, lcg, relax


def tables(spark, edges, xy=None, n=None, categories=None):
    n = n or 1 + max(max(e[:2]) for e in edges)
    xy = xy or [(i, i) for i in range(n)]
    e = spark.createDataFrame([(i, u, v, w, d, categories[i] if categories else 0) for i, (u, v, w, d) in enumerate(edges)], EDGES)
    return spark.createDataFrame([(i, x, y, i) for i, (x, y) in enumerate(xy)], "node long, x int, y int, osm_id long"), e


def random_edges(seed, n=40, m=90):
    r = lcg(seed)
    return [(r() % n, r() % n, 1 + r() % 500, r() % 3) for _ in range(m)]


@pytest.fixture(scope="module")
def store(spark):
    edges = random_edges(11)
    r = lcg(5)
    xy = [(800000 + r() % 3000, 4700000 + r() % 3000) for _ in range(40)]
    s = GraphStore(*tables(spark, edges, xy, 40))
    s.local = build(edges, xy, 40)
    return s


def test_compact_arrays_are_the_arcs(store):
    g = store.arrays().value
    assert g.src.tolist() == store.local.src.tolist() and g.edge.tolist() == store.local.edge.tolist() and g.back.tolist() == store.local.back.tolist()


def test_the_driver_holds_no_arrays(store):
    assert len(pickle.dumps(store.arrays())) < 1000 and len(pickle.dumps(store.landmarks())) < 1000
    want, got = kernels.landmarks(store.local), store.landmarks().value
    assert got.nodes == want.nodes
    for ours, theirs in ((got.away, want.away), (got.towards, want.towards)):
        assert [a.tolist() for a in ours] == [a.tolist() for a in theirs]


def test_requests_without_events(spark, store):
    asked = spark.createDataFrame([(k, "dijkstra", 3, k, None) for k in range(8)], REQUESTS)
    full, bare = (store.search(asked, traced=t).orderBy("query_id").collect() for t in (True, False))
    assert [r[:-1] for r in full] == [r[:-1] for r in bare] and all(r["words"] is None for r in bare)
    assert all(len(r["words"]) == r["settled"] + r["examined"] + r["improved"] for r in full)


def test_fixpoints_equal_kernels(spark, store):
    start = spark.createDataFrame([(3,)], "node long")
    assert {r["node"]: r["dist"] for r in graph.shortest(store.arcs, start).collect()} == kernels.costs(store.local, 3)
    assert {r["node"]: r["hops"] for r in graph.hops(store.arcs, start).collect()} == kernels.breadth_first(store.local, 3, None).dist
    h = {r["node"]: r["h"] for r in graph.repaired_bound(store.nodes, store.arcs, 7).collect()}
    assert [h[i] for i in range(40)] == kernels.repair(store.local, kernels.planar(store.local, 7))[0]
    both = {r["node"] for r in graph.mutually_reachable(store.arcs, start).collect()}
    assert both == set(kernels.costs(store.local, 3)) & set(kernels.costs(store.local, 3, True))


def test_large_graphs_use_the_fixpoint(spark, store):
    small = GraphStore(store.nodes, store.edges, limit=1)
    assert {r["node"]: r["dist"] for r in small.costs(3).collect()} == relax(store.local, 3)
    with pytest.raises(ValueError):
        small.search(spark.createDataFrame([(0, "dijkstra", 0, 1, None)], REQUESTS))


def test_components_and_trees(store):
    parent = list(range(40))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(r["u"], r["v"], r["length_cm"]) for r in store.edges.collect()]
    for u, v, _ in pairs:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert {r["node"]: r["component"] for r in store.components.collect()} == {i: find(i) for i in range(40)}
    totals = {r["component"]: r["total"] for r in graph.spanning_total(store.nodes, store.edges).collect()}
    assert sum(totals.values()) == sum(kernels.spanning_tree(store.local, i).cost for i in range(40) if find(i) == i)


def test_offsets_and_degrees(store):
    got = {r["node"]: (r["first"], r["last"]) for r in graph.offsets(store.nodes, store.arcs, 7).collect()}
    at = 0
    for i in range(40):
        n = len(store.local.out[i])
        assert got[i] == (at, at + n)
        at += n
    d = {r["node"]: (r["outgoing"], r["incoming"]) for r in graph.degrees(store.nodes, store.arcs).collect()}
    assert d == {i: (len(store.local.out[i]), len(store.local.into[i])) for i in range(40)}


def test_every_algorithm_through_the_store(spark, store):
    names = [a.value for a in Algorithm if a not in (Algorithm.MULTISOURCE, Algorithm.TIME)]
    req = spark.createDataFrame([(i * 100 + t, n, 3, t, None) for i, n in enumerate(names) for t in (0, 9, 17, 25)], REQUESTS)
    r = store.search(req).persist()
    want = relax(store.local, 3)
    for row in r.collect():
        if row["algorithm"] in ("dijkstra", "bidirectional", "astar", "bidirectional-astar", "alt"):
            assert row["cost"] == want.get(row["goal"])
    assert search.route_violations(r.where("algorithm != 'spanning-tree'"), store.edges).count() == 0
    assert search.agreement(r).count() == 0
    t = search.trace_rows(r.where("algorithm IN ('dijkstra', 'astar', 'bidirectional', 'greedy')"))
    assert trace.trace_violations(t, store.arcs).count() == 0
    again = {x["query_id"]: x["digest"] for x in trace.digest(search.trace_rows(store.search(req))).collect()}
    assert again == {x["query_id"]: x["digest"] for x in trace.digest(search.trace_rows(r)).collect()}
    three = store.request("multisource", 3, None, [3, 9, 17])
    assert three["cost"] is None and three["settled"] > 0
    for bad in (("nothing", 0, 1, None), ("multisource", 0, None, [1])):
        with pytest.raises(ValueError):
            store.search(spark.createDataFrame([(0, *bad)], REQUESTS))
    with pytest.raises(ValueError):
        store.search(spark.createDataFrame([(0, "alt", 0, 1, None)], REQUESTS), "time")


def test_time_objective(spark):
    s = GraphStore(*tables(spark, [(0, 2, 100000, 1), (0, 1, 150000, 1), (1, 2, 150000, 1)], categories=[13, 0, 0]))
    t = s.request("time-dijkstra", 0, 2, objective="time")
    assert t["route_nodes"] == [0, 1, 2] and t["cost"] == 108000
    d = s.time_result(s.search(spark.createDataFrame([(0, "dijkstra", 0, 2, None)], REQUESTS))).first()
    assert d["cost"] == 100000 and d["route_ms"] == 240000


def test_travel_time_rounds_and_checks(spark):
    one = spark.range(1)
    assert one.select(geo.travel_ms(F.lit(100000), F.lit(100)).alias("a"), geo.travel_ms(F.lit(0), F.lit(25)).alias("b")).first() == (36000, 1)
    with pytest.raises(Exception, match="positive"):
        one.select(geo.travel_ms(F.lit(1), F.lit(0))).collect()


# ---------------------------------------------------------------- snapping
def snapping(spark, xs, edges, points, categories=None):
    n, e = tables(spark, edges, [(x, 4700000) for x in xs], len(xs), categories)
    s = GraphStore(n, e)
    p = spark.createDataFrame(points, "name string, lon double, lat double")
    got = {r["name"]: r["node"] for r in s.snap(p, [x[0] for x in points]).collect()}
    return [got[x[0]] for x in points]


A, B = ("A", 8.0, 47.0), ("B", 8.05, 47.0)
BOTH = [(0, 1, 10000, 0), (2, 3, 10000, 0), (4, 5, 10000, 0)]


def test_snapping_prefers_a_shared_component(spark):
    xs = [800010, 804990, 800000, 800001, 805000, 805001]
    assert snapping(spark, xs, BOTH, [A, B]) == [0, 1] and snapping(spark, xs, BOTH, [B, A]) == [1, 0]


def test_snapping_apart_and_ties(spark):
    assert snapping(spark, [800000, 800001, 805000, 805001], BOTH[:2], [A, B]) == [0, 2]
    assert snapping(spark, [800000, 805000, 800000, 805000], [(2, 3, 100, 0), (0, 1, 100, 0)], [A, B]) == [0, 1]


def test_snapping_needs_a_road(spark):
    with pytest.raises(ValueError, match="No road within 2 km of A"):
        snapping(spark, [800000, 800001, 805000, 805001], BOTH[:2], [A, B], [12, 0])


# ---------------------------------------------------------------- traces
def log(spark, kinds):
    return spark.createDataFrame([(i + 1, k, i % 50) for i, k in enumerate(kinds)], "event long, kind int, id long")


def test_checkpoints_and_seeks(spark):
    r = lcg(7)
    kinds = [r() % 4 for _ in range(9001)]
    t = log(spark, kinds).persist()
    marks = trace.checkpoints(t).persist()
    for cursor in (0, 1, 4095, 4096, 4097, 8192, 9001, 2000):
        got = trace.seek(t, marks, cursor).first()
        assert tuple(got) == tuple(sum(k == x for k in kinds[:cursor]) for x in (0, 1, 2))


def test_kinds_pack_losslessly(spark):
    r = lcg(3)
    kinds = [r() % 4 for _ in range(1003)]
    back = trace.unpack_kinds(trace.pack_kinds(log(spark, kinds)), 1003).orderBy("event").collect()
    assert [x["kind"] for x in back] == kinds


def test_archive_verifies_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(q, i + 1, (i * 7919) % 2**32) for q in (0, 1) for i in range(2500)], "query_id long, event long, word long")
    a = trace.TraceArchive(spark, f"{tmp_path}/a", 1000)
    a.write(rows)
    assert [r["word"] for r in a.read(1, 2).collect()] == [(i * 7919) % 2**32 for i in range(2000, 2500)]
    assert a.violations().count() == 0
    with pytest.raises(ValueError):
        a.read(1, 9)
    with pytest.raises(Exception, match="exist"):
        a.write(rows)


def test_words(spark):
    w = spark.createDataFrame([(2, 2**27, 1)], "kind int, id long, side int").select(bits.pack_word("kind", "id", "side").alias("w"))
    got = w.select(bits.word_kind("w"), bits.word_id("w"), bits.word_side("w")).first()
    assert tuple(got) == (2, 2**27, 1)
    x = sampler.Xorshift(0)
    x()
    assert spark.range(1).select(bits.xorshift32(F.lit(0).cast("long")).alias("x")).first()["x"] == x.x


# ---------------------------------------------------------------- joins
@pytest.mark.parametrize("stretch", [None, 10])
def test_asof(spark, stretch):
    left = [(k, i) for k in "ab" for i in range(0, 60, 3)]
    right = [("a", 5, 50), ("a", 31, 310), ("b", 40, 400), ("c", 1, 1)]
    got = joins.asof(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), "t", ["k"], ["v"], stretch).collect()
    want = {(k, t): max(((u, v) for q, u, v in right if q == k and u <= t), default=(0, None))[1] for k, t in left}
    assert {(r["k"], r["t"]): r["v"] for r in got} == want and len(got) == len(left)


def test_ranges_and_views(spark):
    r = lcg(2)
    views = [(i, x := r() % 100, y := r() % 100, x + 15, y + 9) for i in range(6)]
    boxes = [(i, x := r() % 100, y := r() % 100, x + r() % 30, y + r() % 30) for i in range(80)]
    got = joins.viewport_cull(spark.createDataFrame(views, "v long, v_x1 long, v_y1 long, v_x2 long, v_y2 long"), spark.createDataFrame(boxes, "b long, b_x1 long, b_y1 long, b_x2 long, b_y2 long"), 10.0)
    rows = [(x["v"], x["b"]) for x in got.collect()]
    want = {(v[0], b[0]) for v in views for b in boxes if v[1] - 1 <= b[3] and v[3] + 1 >= b[1] and v[2] - 1 <= b[4] and v[4] + 1 >= b[2]}
    assert set(rows) == want and len(rows) == len(want)


# ---------------------------------------------------------------- compile
def way(id, refs, **tags):
    return (id, tags, [{"ref": r, "lon": 8 + r / 1000, "lat": 47.0} for r in refs])


WAY = "way_id long, tags map<string,string>, nodes array<struct<ref:long,lon:double,lat:double>>"


def test_compile_splits_ways(spark):
    w = spark.createDataFrame([way(1, [10, 11, 12, 13], highway="primary"), way(2, [12, 20], highway="residential", oneway="-1"), way(3, [1, 2], highway="footway"), way(4, [1, 2], highway="road", access="no"), way(5, [9], highway="road")], WAY)
    nodes, edges = ways_of.compile_graph(w)
    e = [(r["u"], r["v"], r["direction"], r["category"], r["way_id"]) for r in edges.orderBy("edge").collect()]
    assert e == [(0, 1, 0, 4, 1), (1, 2, 0, 4, 1), (1, 3, 2, 11, 2)]
    assert [r["osm_id"] for r in nodes.orderBy("node").collect()] == [10, 12, 13, 20]
    assert {r["reason"]: r["n"] for r in ways_of.excluded_counts(w).collect()} == {"class": 1, "access": 1, "geometry": 1}
    want = round(math.hypot(0.002 * math.cos(math.radians(47)), 0) * 111195.0802 * 100)
    assert edges.orderBy("edge").first()["length_cm"] == want
    stop = spark.createDataFrame([(11,)], "ref long")
    assert ways_of.compile_graph(w, stop)[1].count() == 4


def test_tags(spark):
    rows = [({"motorcar": "yes", "access": "no"}, "yes"), ({"vehicle": "no"}, "no"), ({}, None)]
    t = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], "i long, tags map<string,string>")
    assert [r["a"] for r in t.orderBy("i").select(ways_of.access(F.col("tags")).alias("a")).collect()] == [a for _, a in rows]
    d = [({"oneway": "-1"}, 2), ({"oneway": "1"}, 1), ({"junction": "roundabout"}, 1), ({"highway": "motorway", "oneway": "no"}, 0), ({"highway": "motorway"}, 1), ({}, 0)]
    t = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(d)], "i long, tags map<string,string>")
    assert [r["d"] for r in t.orderBy("i").select(ways_of.direction(F.col("tags")).alias("d")).collect()] == [x for _, x in d]
    p = spark.createDataFrame([({"lanes": "2", "lanes:forward": "1", "surface": "x"},)], "tags map<string,string>")
    assert p.select(ways_of.project_tags(F.col("tags"), ["lanes"]).alias("t")).first()["t"] == {"lanes": "2", "lanes:forward": "1"}


def test_simplify(spark):
    assert ways_of.simplify_points([0, 1, 2, 3], [0, 0.1, 0, 5], 0.5) == [0, 2, 3]
    assert ways_of.simplify_points([0, 1, 2], [0, 1, 0], 1.0) == [0, 2] and ways_of.simplify_points([0, 1, 2], [0, 1.01, 0], 1.0) == [0, 1, 2]
    assert len(ways_of.simplify_ring([0, 1, 1, 0], [0, 0, 1, 0], 100)) == 4
    df = spark.createDataFrame([([(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert len(df.select(ways_of.simplify(F.col("p"), 5.0).alias("p")).first()["p"]) == 2


def test_restrictions_and_sources(spark):
    r = spark.createDataFrame([(1, [{"type": "w", "ref": 7, "role": "from"}, {"type": "n", "ref": 3, "role": "via"}]), (2, [{"type": "w", "ref": 99, "role": "to"}])], "id long, members array<struct<type:string,ref:long,role:string>>")
    assert [x["id"] for x in ways_of.restrictions_kept(r, spark.createDataFrame([(7,)], "way_id long")).collect()] == [1]
    _, lost = ways_of.resolve_members(r, spark.createDataFrame([(7, 0)], "way_id long, edge long"), spark.createDataFrame([(3, 0)], "ref long, node long"))
    assert {x["type"]: (x["unresolved"], x["members"]) for x in lost.collect()} == {"w": (1, 2), "n": (0, 1)}
    s = "way_id long, version int, nodes array<struct<ref:long,lon:double,lat:double>>"
    a = spark.createDataFrame([(1, 1, [{"ref": 1, "lon": 1.0, "lat": 1.0}, {"ref": 2, "lon": None, "lat": None}]), (2, 1, [{"ref": 9, "lon": 50.0, "lat": 1.0}])], s)
    kept, missing = ways_of.composite([a, a], (0, 0, 10, 10))
    assert kept.count() == 1 and [x["ref"] for x in missing.collect()] == [2]


# ---------------------------------------------------------------- functions and records
def test_scalars(spark):
    row = spark.range(1).select(
        *(geo.longitude_offset(F.lit(a), F.lit(b)).alias(f"w{i}") for i, (a, b) in enumerate([(-176.5, 175.0), (174.5, 175.0), (179.0, -175.0)])),
        *(geo.replay_seconds(F.lit(float(x))).alias(f"s{x}") for x in (50, 100, 200, 10000)),
        geo.goal_proximity(F.lit(50), F.lit(100)).alias("p"),
        geo.round_half_even(F.lit(2.5)).alias("e"),
        geo.round_half_up(F.lit(-2.5)).alias("u"),
        geo.ease(F.lit(0.5)).alias("t"),
        geo.point_segment_squared(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)).alias("d"),
    ).first()
    assert row[:3] == (8.5, -0.5, -6.0) and row["s50"] == 25 and row["s100"] == 30 and abs(row["s200"] - 42.4264) < 1e-4 and row["s10000"] == 65
    assert (row["p"], row["e"], row["u"], row["t"], row["d"]) == (128, 2.0, -2, 0.5, 10.0)


def test_slugs(spark):
    names = ["Zürich HB", "São  Paulo!", "Ærøskøbing", "Reykjavík (Þing)", "plain"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.slug("n")).collect()
    assert [r[0] for r in got] == ["zurich-hb", "sao-paulo", "aeroskobing", "reykjavik-thing", "plain"]


def test_links_round_trip(spark):
    base = "https://maps.example/app?keep=1&from=old#x"
    study = F.struct(F.lit("ch").alias("country"), F.struct(F.lit("A b").alias("name"), F.lit(8.5).alias("lon"), F.lit(47.25).alias("lat")).alias("start"), F.struct(F.lit("C").alias("name"), F.lit(6.1).alias("lon"), F.lit(46.2).alias("lat")).alias("goal"), F.lit("astar").alias("algorithm"), F.lit("time").alias("objective"), F.lit(0.25).alias("progress"), F.lit(40.0).alias("duration"))
    url = spark.range(1).select(records.write_link(F.regexp_replace(F.lit(base), "#x", ""), study).alias("u"))
    got = url.select("u", records.parse_link(F.col("u")).alias("s")).first()
    assert "keep=1" in got["u"] and "old" not in got["u"]
    s = got["s"]
    assert (s["country"], s["start"]["name"], s["start"]["lon"], s["goal"]["lat"], s["algorithm"], s["objective"], s["progress"]) == ("ch", "A b", 8.5, 46.2, "astar", "time", 0.25)
    bad = ["https://x/?country=ch&from=1,2&to=1,2&algorithm=astar", "https://x/?country=ch&from=181,2&to=1,2&algorithm=astar", "https://x/?country=ch&from=1,2&to=3,4&algorithm=none", "https://x/", "https://x/?country=ch&from=1e1,2&to=3,4&algorithm=astar"]
    assert all(r[0] is None for r in spark.createDataFrame([(b,) for b in bad], "u string").select(records.parse_link(F.col("u"))).collect())
    assert spark.range(1).select(text.without_params(F.lit(base), ["from"])).first()[0] == "https://maps.example/app?keep=1#x"


def test_chunks(spark):
    import gzip
    import hashlib

    raw = bytes(range(256)) * 4
    packed = gzip.compress(raw)
    assert records.decode_chunk(packed, 1024, hashlib.sha256(packed).hexdigest()) == raw
    for data, size, digest in ((packed, 1023, None), (packed, 1025, None), (packed[:-20], 1024, None), (packed, 1024, "0")):
        with pytest.raises(ValueError):
            records.decode_chunk(data, size, digest)
    files = spark.createDataFrame([("a", bytearray(packed))], "path string, content binary")
    listed = spark.createDataFrame([("a", 1024, hashlib.sha256(packed).hexdigest())], "path string, decodedBytes long, sha256 string")
    assert bytes(records.verified_chunks(files, listed).first()["data"]) == raw
    meta, buffers = records.import_record(records.export_record({"a": 1}, {"x": b"abc", "y": b"12345678"}))
    assert meta == {"a": 1} and buffers == {"x": b"abc", "y": b"12345678"}


def test_canonical_json():
    assert text.canonical({"b": [1.0, 0.5], "a": None}) == '{"a":null,"b":[1,0.5]}'


def test_validators(spark):
    good = [(0, "nodes", "n/0", 0, 10, 8, 5), (1, "nodes", "n/1", 10, 5, 8, 5), (2, "edges", "e/0", 0, 3, 14, 5)]
    schema = "n long, kind string, path string, start long, count long, stride int, bytes long"
    assert validate.chunk_coverage(spark.createDataFrame(good, schema), {"nodes": 15, "edges": 3}).count() == 0
    bad = [(0, "edges", "e/0", 0, 3, 14, 5), (1, "nodes", "../n", 1, 10, 8, 5), (2, "nodes", "e/0", 11, 5, 9, 0)]
    why = {r["why"] for r in validate.chunk_coverage(spark.createDataFrame(bad, schema), {"geometry": 4}).collect()}
    assert why >= {"gap", "order", "path", "stride", "path repeated", "coverage"}
    n, e = tables(spark, [(0, 1, 5, 0)], n=2)
    assert validate.edge_integrity(e, n.where("node = 0")).first()["why"] == "endpoint"
    assert validate.manifest_limits(spark.createDataFrame([("nodes", 12_000_000), ("edges", 1)], "name string, value long")).count() == 1


# ---------------------------------------------------------------- replay and samplers
def test_replay_buckets_and_leaves(spark):
    t = spark.createDataFrame([(0, 90, 10), (1, 95, 20), (2, 0, 70), (3, 0, 0), (4, 40, 0)], "edge long, forward long, backward long")
    segs = spark.createDataFrame([(i, 0, float(i), 0.0, float(i + 1), 1.0) for i in range(5)], "edge long, seg int, x1 double, y1 double, x2 double, y2 double")
    hit = replay.reached_segments(segs, t, 100)
    assert {r["edge"]: r["time"] for r in hit.collect()} == {0: 10, 1: 20, 2: 70, 4: 40}
    assert tuple(replay.bounds(hit).first()) == (0.0, 0.0, 5.0, 1.0)
    r = lcg(1)
    points = spark.createDataFrame([(i, r() % 1000, r() % 700) for i in range(500)], "id long, x long, y long")
    leaves = replay.spatial_leaves(points, 40).groupBy("leaf").count().collect()
    assert sum(x["count"] for x in leaves) == 500 and max(x["count"] for x in leaves) <= 40


def test_route_progress(spark):
    route = spark.createDataFrame([(0, 0, 5, False, 300), (0, 1, 6, True, 100)], "query_id long, step long, edge long, reversed boolean, length long")
    shapes = spark.createDataFrame([(5, 0, 0.0, 0.0, 1.0, 0.0), (5, 1, 1.0, 0.0, 1.0, 0.0), (5, 2, 1.0, 0.0, 3.0, 0.0), (6, 0, 5.0, 0.0, 3.0, 0.0)], "edge long, seg int, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r)[1:] for r in replay.route_progress(route, shapes).orderBy("n").collect()]
    assert [g[0] for g in got] == [1, 2, 3] and [round(g[5], 6) for g in got] == [0, 0.25, 0.75] and got[-1][1:3] == (3.0, 0.0) and got[-1][6] == 1


def some_places(spark, n, seed, wide=9000):
    r = lcg(seed)
    rows = [(0, f"p{i:04d}", 6 + (r() % wide) / 1000, 40 + (r() % wide) / 1000, str(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "pool long, id string, lon double, lat double, region string")


def test_candidates_are_of_one_region_and_far_enough(spark):
    rows = [(0, "a", 8.0, 47.0, "x"), (0, "b", 8.0, 47.25, "x"), (0, "c", 8.0, 47.3, "x"), (0, "d", 8.0, 49.0, "y")]
    places = spark.createDataFrame(rows, "pool long, id string, lon double, lat double, region string")
    # a to b is 27.8 km: its road is over 30 km, but not the straight line; d is of another region
    assert [(r["a"], r["b"], r["band"]) for r in sampler.journey_candidates(places).collect()] == [("a", "c", "regional")]
    corner = places.unionByName(spark.createDataFrame([(0, "e", 9.0, 47.1, "x"), (0, "f", 9.0, 47.1, "y"), (0, "g", 9.5, 48.0, "y")], places.schema))
    assert {(r["a"], r["b"], r["c"]) for r in sampler.triple_candidates(corner).collect()} == {("a", "c", "e"), ("d", "f", "g")}


def test_samplers_do_not_repeat(spark):
    places = some_places(spark, 20, 9, 4000)
    drawn = sampler.sample_pairs(spark, sampler.journey_candidates(places), 7, 25)
    assert sampler.repeats(drawn.where("accepted"), "key", "n", 6).count() == 0
    assert drawn.collect() == sampler.sample_pairs(spark, sampler.journey_candidates(places), 7, 25).collect()
    triples = sampler.sample_triples(spark, sampler.triple_candidates(places), 7, 30).collect()
    keys = [tuple(sorted(t["sources"])) for t in triples]
    assert all(k not in keys[max(0, i - 3) : i] for i, k in enumerate(keys))
    names = [x[0] for x in spark.range(10).select(sampler.algorithm_of_journey(F.col("id"))).collect()]
    assert names[4] == names[9] == "multisource" and len(set(names)) == 6


def test_draws_from_more_candidates_than_are_gathered(spark):
    pairs = sampler.journey_candidates(some_places(spark, 950, 5))
    assert pairs.count() > 200_000
    drawn = sampler.sample_pairs(spark, pairs, 7, 8)
    assert drawn.count() == 8 and sampler.repeats(drawn, "key", "n", 6).count() == 0
    triples = sampler.triple_candidates(some_places(spark, 160, 5))
    assert triples.count() > 100_000
    assert sampler.sample_triples(spark, triples, 7, 4).count() == 4


def test_triples_are_drawn_from_all_pools(spark, sf):
    from trailmesh.plans import q_places

    d = sf.replace("sf0.001", "sf0.01")
    pools = dict(q_places.places(spark, d).select("id", "pool").collect())
    drawn = {pools[p] for t in q_places.sampled_triples(spark, d).collect() for p in t["sources"]}
    assert max(drawn) >= 5 and len(drawn) > 5


@pytest.mark.parametrize("rejected", [0, 3])
def test_draws_are_by_running_weight(spark, rejected):
    """Against a walk over all ordered pairs of places, with exact fractions; some roads are too long for their band."""
    places = some_places(spark, 12, 3, 5000)
    pairs = sampler.journey_candidates(places)
    known = {r["key"]: r for r in pairs.collect()}
    every = sorted(((s, t), r) for r in known.values() for s, t in ((r["a"], r["b"]), (r["b"], r["a"])))
    road = lambda r: r["estimate"] * (9 if rejected and (int(r["a"][1:]) + int(r["b"][1:])) % rejected == 0 else 1)
    rng, used, history, want = sampler.Xorshift(11), Counter(), [], []
    for n in range(15):
        band, attempted = sampler.band_of_draw(rng()), set()
        for attempt in range(5):
            left = [(e, r) for e, r in every if r["band"] == band and r["key"] not in attempted and r["key"] not in history[-6:]]
            weights = [Fraction(1, 1 + used[s] + used[t]) for (s, t), _ in left]
            goal = Fraction(rng()) * sum(weights)
            if not left:
                break
            (s, t), r = next(x for x, run in zip(left, accumulate(weights), strict=True) if run > goal)
            attempted.add(r["key"])
            good = sampler.band_of_km(road(r)) == band
            want.append((n, attempt, r["key"], s, t, good))
            if good:
                history.append(r["key"])
                used.update((s, t))
                break
    got = [(x["n"], x["attempt"], x["key"], x["start"], x["goal"], x["accepted"]) for x in sampler.sample_pairs(spark, pairs, 11, 15, road).orderBy("n", "attempt").collect()]
    assert got == want and (not rejected or not all(x[-1] for x in want))


@pytest.mark.parametrize("name", ["reverse_distance", "bfs_hops", "multisource_distance", "potential_repair"])
def test_cost_queries_without_arrays(spark, sf, name, monkeypatch):
    from trailmesh.plans import q_graph

    want = sorted(map(tuple, getattr(q_graph, name)(spark, sf).collect()))
    known = q_graph.store(spark, sf)
    large = GraphStore(known.nodes, known.edges, limit=0)
    large.arcs = known.arcs
    monkeypatch.setitem(q_graph._stores, (spark.sparkContext.applicationId, sf), large)
    assert sorted(map(tuple, getattr(q_graph, name)(spark, sf).collect())) == want


def test_views_over_equal_boxes_are_summed_once(spark):
    """Half of the boxes at one place, views that are the same, a view beside every box, a null value."""
    r = lcg(3)
    boxes = [(5, 5, 9, 9, None if k % 7 == 0 else k) if k % 2 else ((x := r() % 200), (y := r() % 200), x + r() % 60, y + r() % 60, k) for k in range(400)]
    views = [(k, v, v, v + 20, v + 20) for k, v in enumerate([0, 0, 0, 40, 90, 150, 5000])]
    names = ["x1", "y1", "x2", "y2"]
    b = spark.createDataFrame(boxes, ", ".join(f"b_{c} long" for c in names) + ", part long")
    v = spark.createDataFrame(views, "view long, " + ", ".join(f"v_{c} long" for c in names))
    want = {}
    for k, x1, y1, x2, y2 in views:
        met = [p for bx1, by1, bx2, by2, p in boxes if x1 - 1 <= bx2 and x2 + 1 >= bx1 and y1 - 1 <= by2 and y2 + 1 >= by1]
        if met:
            want[k] = (len(met), sum(p for p in met if p is not None))
    assert {r["view"]: (r["n"], r["total"]) for r in joins.viewport_sums(v, b, 40.0, "view", "part").collect()} == want
    assert joins.viewport_sums(v, b, 40.0, "view", "part").count() == len(want) == 6


def test_pairs_of_large_regions_are_many_tasks(spark, monkeypatch):
    places = some_places(spark, 300, 1)
    want = {(r["key"], r["km"], r["band"]) for r in sampler.journey_candidates(places).collect()}
    monkeypatch.setattr(sampler, "SLICE_PLACES", 40)
    made = sampler.journey_candidates(places)
    sizes = [n for n in made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4
    got = [(r["key"], r["km"], r["band"]) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---------------------------------------------------------------- streaming
def test_streamed_blocks_equal_the_batch(spark, tmp_path):
    r = lcg(8)
    rows = spark.createDataFrame([(i + 1, r() % 4, i % 9) for i in range(10000)], "event long, kind int, id long")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    q = streams.stream_blocks(streams.trace_stream(spark, f"{tmp_path}/in", rows.schema)).writeStream.outputMode("complete").format("memory").queryName("blocks").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("blocks").orderBy("block").collect()
    want = rows.groupBy(F.floor((F.col("event") - 1) / 4096).alias("block")).agg(F.count(F.lit(1)).alias("events")).orderBy("block").collect()
    assert [(g["block"], g["events"]) for g in got] == [(w["block"], w["events"]) for w in want]


def writes_of(times, gap):
    """Instant by instant: a write at once if the last one is a gap ago, else when it is."""
    last, pending, out = -(10**9), None, []
    for now in range(max(times) + gap + 1):
        if pending is not None and now - last >= gap:
            out.append((now, str(pending)))
            last, pending = now, None
        if now in times:
            if now - last >= gap:
                out.append((now, str(now)))
                last = now
            else:
                pending = now
    return out


def test_throttle(spark, tmp_path):
    r = lcg(4)
    for gap in (1, 7, 50):
        times = sorted({r() % 300 for _ in range(40)})
        assert streams.throttle_times(times, gap) == [at for at, _ in writes_of(times, gap)]
    changes = [("a", t, str(t)) for t in (0, 100, 200, 700, 2000, 2100)] + [("b", 5, "5")]
    table = spark.createDataFrame(changes, "client string, at long, value string")
    want = writes_of([0, 100, 200, 700, 2000, 2100], 500)
    assert want[-1] == (2500, "2100")  # a pending write isn't lost
    assert [(x["at"], x["value"]) for x in streams.throttled(table).where("client = 'a'").orderBy("at").collect()] == want
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = streams.throttled(s).writeStream.outputMode("append").format("memory").queryName("throttled").start()
    for _ in range(60):  # the gap passes; a later batch without data releases what is pending
        if spark.table("throttled").where("client = 'a'").count() == len(want):
            break
        time.sleep(0.5)
    q.stop()
    assert [(x["at"], x["value"]) for x in spark.table("throttled").where("client = 'a'").orderBy("at").collect()] == want


def test_numbers_are_written_as_browsers_write_them():
    for x, want in ((1e-5, "0.00001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (123456.789, "123456.789"), (1e21, "1e+21"), (1e20, "1" + "0" * 20), (-0.0, "0"), (-2.5e30, "-2.5e+30"), (5e-324, "5e-324"), (0.1, "0.1"), (100.0, "100")):
        assert text.canonical(x) == want and float(want) == x
    assert text.canonical({"b": [1, None, True, float("nan")], "a": {"é": "x"}, "c": 2**60}) == '{"a":{"é":"x"},"b":[1,null,true,null],"c":1152921504606846976}'.replace("1152921504606846976", "1152921504606847000")


def kept_by_definition(points, tolerance):
    """Douglas-Peucker as it is defined, on plain tuples."""

    def off(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length)) if length else 0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    def walk(a, b):
        inner = [(off(points[i], points[a], points[b]), -i) for i in range(a + 1, b)]
        if not inner or max(inner)[0] <= tolerance:
            return []
        i = -max(inner)[1]
        return walk(a, i) + [i] + walk(i, b)

    return sorted({0, len(points) - 1} | set(walk(0, len(points) - 1))) if points else []


def test_simplified_points_equal_the_definition():
    r = lcg(12)
    for n in (0, 1, 2, 3, 10, 60):
        for tolerance in (0.0, 5.0, 40.0):
            points = [(r() % 200, r() % 50) for _ in range(n)]
            got = ways_of.simplify_points([p[0] for p in points], [p[1] for p in points], tolerance)
            assert got == kept_by_definition(points, tolerance)
    assert ways_of.simplify_ring([0, 1, 1, 0], [0, 0, 1, 0], 9.0) == [0, 1, 2, 3]


def test_controls(spark):
    nodes = spark.createDataFrame([(1, {"barrier": "gate"}), (2, {"highway": "stop"}), (3, {"highway": "crossing"}), (4, {"highway": "motorway_junction"}), (5, None), (6, {})], "ref long, tags map<string,string>")
    assert {r["ref"] for r in ways_of.control_nodes(nodes).collect()} == {1, 2, 4}


def test_chunks_of_another_layout_are_found(spark):
    from trailmesh.sources import chunks

    row = (0, 0, 2, [0, 1], [1, 1], [5, 5], [0, 3], [1, 1])
    c = spark.createDataFrame([row, (1, 2, 2, [0], [1, 1], [5, 5], [0, 0], [1, 1])], "chunk long, start long, count int, d_from array<long>, rel array<long>, length_cm array<long>, direction array<int>, category array<int>")
    assert {(r["chunk"], r["why"]) for r in chunks.edge_chunk_violations(c, 4, 10).collect()} == {(0, "connection"), (1, "layout")}
    rows = spark.createDataFrame([("geometry", 0, 2, 2 * 2 + 3 * 8, 10), ("geometry", 0, 2, 2 * 2 + 3 * 8 + 1, 10), ("nodes", 0, 2, 28, 10), ("geometry", 0, 0, 0, 0)], "kind string, start long, count long, bytes long, drawn long")
    got = [r[0] for r in rows.select(chunks.road_range(*(F.col(x) for x in ("kind", "start", "count", "bytes", "drawn")))).collect()]
    assert got[0] == (0, 2) and got[1:] == [None, None, None]


def test_late_results_and_windows(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "client string, request_id long, value string")
    assert tuple(streams.latest_results(r).first()) == ("a", "z", 3)
    e = spark.sql("SELECT timestamp'2020-01-01 00:00:10' AS ts, 'v' AS event_type UNION ALL SELECT timestamp'2020-01-01 00:01:10', 'v'")
    assert streams.stream_windows(e, "1 minute", "10 seconds").count() == 2


# ---------------------------------------------------------------- what caches keep, chunks needed
def brute_kept(rows, budget, most):
    kept = []
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (r[4], r[2], r[1]), reverse=True)
        total, names = mine[0][3], [mine[0][1]]
        for r in mine[1:]:
            if len(names) < most and total + r[3] <= budget:
                names.append(r[1])
                total += r[3]
        kept += [(user, n) for n in names]
    return sorted(kept)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_kept_releases_take_the_next_that_fits(spark, most):
    rng = random.Random(most)
    rows = [(f"u{k % 7}", f"r{k}", rng.randrange(5), rng.choice([10, 40, 60, 99, 250]), k in (3, 11)) for k in range(60)]
    rows += [("one", "x", 1, 10_000, False)]  # a current release stays, whatever its size
    df = spark.createDataFrame(rows, "user string, name string, used int, bytes long, now boolean")
    got = sampler.kept_releases(df, 150, most, ("user",), F.col("now"))
    assert sorted((r["user"], r["name"]) for r in got.collect()) == brute_kept(rows, 150, most)
    unfit = spark.createDataFrame([("a", 9, 100), ("b", 8, 60), ("c", 7, 40)], "name string, used int, bytes long")
    assert {r["name"] for r in sampler.kept_releases(unfit, 150).collect()} == {"a", "c"}


def test_chunks_needed_keeps_unknown_layouts(spark):
    chunks = spark.createDataFrame([(0, 0, 9), (1, 10, 19), (2, 20, 29), (3, None, None)], "chunk long, first long, last long")
    edge = lambda *x: spark.createDataFrame([(e,) for e in x], "edge long")
    assert {r["chunk"] for r in replay.chunks_needed(chunks, edge(3, 4), edge(29), 10).collect()} == {0, 2, 3}


def test_sweep_leaves_what_is_no_record(spark, tmp_path):
    from trailmesh.sources import exports

    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.txt").write_text("x")
    spark.range(2).write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError, match="no record"):
        exports.lease(spark, f"{tmp_path}/notes", "me")
    assert exports.sweep(spark, str(tmp_path)) == ["old"] and (tmp_path / "notes" / "a.txt").exists()
    with pytest.raises(ValueError, match="no record"):
        exports.lease(spark, f"{tmp_path}/old", "me")


@pytest.mark.parametrize("in_task", [0, 40, 150])
def test_leaves_selected_by_histograms_equal_ranked_ones(spark, in_task):
    rng = random.Random(in_task)
    rows = [(k, rng.choice([0.5, rng.random() * 9, rng.random() * 1e-7]), rng.choice([2.0, rng.gauss(0, 3)])) for k in range(700)]
    points = spark.createDataFrame(rows, "id long, x double, y double").repartition(4)
    want = {(r["id"], r["leaf"]) for r in replay.spatial_leaves(points, 30).collect()}
    got = replay.spatial_leaves(points, 30, in_task=in_task)
    assert {(r["id"], r["leaf"]) for r in got.collect()} == want and len(want) == 700


def test_kth_rows_of_many_leaves(spark):
    rng = random.Random(9)
    rows = [(leaf, rng.choice([0, 0, rng.randrange(10**9)]), rng.randrange(10**12)) for leaf in range(5) for _ in range(400 * (leaf + 1))]
    df = spark.createDataFrame(rows, "leaf long, key long, id long").repartition(3)
    wanted = [(leaf, 1 + 97 * leaf) for leaf in range(5)]
    got = replay.kth_rows(df, spark.createDataFrame(wanted, "leaf long, k long"), least=3, bins=8)
    assert {(r["leaf"], r["cut"]["key"], r["cut"]["id"]) for r in got.collect()} == {(leaf, *sorted((float(k), i) for v, k, i in rows if v == leaf)[n - 1]) for leaf, n in wanted}


def test_growing_tables_are_not_broadcast(spark, sf):
    """Their files are small and their rows many: a broadcast of nodes or parts goes whole through the driver."""
    from trailmesh.catalogue import QUERIES

    plan = QUERIES["geometry_roundtrip"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join [u#" in plan and "BroadcastHashJoin [u#" not in plan and "BroadcastHashJoin [v#" not in plan


def test_rounds_do_not_hold_the_plan_of_the_arcs(spark, monkeypatch):
    """The driver would plan and keep it with every round."""
    from trailmesh.plans import fixpoint as loop

    plans, whole = [], loop.settle

    def settle(df, eager=True):
        plans.append(df)
        return whole(df, eager)

    monkeypatch.setattr(loop, "settle", settle)
    nodes, edges = tables(spark, [(i, i + 1, 5, 0) for i in range(6)])
    arcs = graph.build_arcs(edges)
    got = {r["node"]: r["dist"] for r in graph.shortest(arcs, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: 5 * i for i in range(7)} and len(plans) > 6
    for df in plans[1:]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan


def test_searches_that_share_rounds(spark):
    edges = random_edges(29)
    arcs = graph.build_arcs(tables(spark, edges)[1]).persist()
    starts = [[3], [17], [3, 17, 30]]
    got = {(r["k"], r["node"], r["dist"]) for r in graph.shortest_each(arcs, starts).collect()}
    one = lambda some: graph.shortest(arcs, spark.createDataFrame([(x,) for x in some], "node long")).collect()
    assert got == {(k, r["node"], r["dist"]) for k, some in enumerate(starts) for r in one(some)}
    both = {r["node"] for r in graph.mutually_reachable(arcs, spark.createDataFrame([(3,)], "node long")).collect()}
    ahead = {r["node"] for r in one([3])}
    back = {r["node"] for r in graph.shortest(graph.backward(arcs), spark.createDataFrame([(3,)], "node long")).collect()}
    assert both == ahead & back
    arcs.unpersist()


def test_arrays_are_mapped_from_files(store):
    """Workers of a machine share the pages of the arrays; nothing of the graph's size is made in each of them."""
    import mmap

    from trailmesh.operators.kernels import Compact

    def whole(x):
        while isinstance(x, np.ndarray) and x.base is not None:
            x = x.base
        return x

    g, marks = store.arrays().value, store.landmarks().value
    assert all(isinstance(whole(x), mmap.mmap) for x in (g.x, g.src, g.dst, g.w, g.first, g.into.first, g.into.order, *g.sides, *marks.away))
    own = Compact(g.x, g.y, g.src, g.dst, g.edge, g.back, g.w, g.sides)
    assert all(own.into[u] == g.into[u] and own.out[u] == g.out[u] for u in range(0, g.n, 7))


def test_traces_come_in_slices(spark, store, monkeypatch):
    from trailmesh.operators import search

    monkeypatch.setattr(search, "SLICE", 5)
    start = graph.seed_node(store.arcs)
    requests = spark.createDataFrame([(0, "dijkstra", start, None, None), (1, "bidirectional", start, (start + 5) % store.nodes.count(), None)], REQUESTS)
    found = store.traces(requests)
    rows = found.collect()
    assert max(len(r["words"]) for r in rows) == 5 and len(rows) > 4
    want = sorted(search.trace_rows(store.search(requests)).collect())
    assert sorted(search.trace_rows(found).collect()) == want


def test_current_nodes_do_not_depend_on_blocks(spark, monkeypatch):
    r = lcg(5)
    rows = [(q, e, r() % 3, r() % 90) for q in range(3) for e in range(1, 60 + 7 * q)]
    log = spark.createDataFrame(rows, "q long, event long, kind int, id long")
    want = sorted(tuple(x) for x in trace.current_settled(log, "q").collect())
    monkeypatch.setattr(trace, "BLOCK", 4)
    found = trace.current_settled(log, "q")
    assert found.columns == [*log.columns, "settled_node", "last_examined"] and sorted(map(str, (tuple(x) for x in found.collect()))) == sorted(map(str, want))
    state = {}
    for q, e, kind, i in sorted(rows):
        state[q, kind] = i
        assert next(x for x in want if x[:2] == (q, e))[4:] == (state.get((q, 0)), state.get((q, 1)))


def test_draws_do_not_list_candidates(spark, monkeypatch):
    """Draws from places are those from their listed candidates; some places share a spot, some rows an id."""
    rows = [tuple(r) for r in some_places(spark, 12, 3, 5000).collect()]
    rows += [(0, f"q{i}", *rows[i][2:]) for i in range(3)] + [(0, "p0001", 9.0, 42.0, "1"), (0, "p0001", 6.5, 44.0, "0"), (0, None, 9.5, 44.0, "0")]
    places = spark.createDataFrame(rows, "pool long, id string, lon double, lat double, region string")
    pairs = sampler.journey_candidates(places)
    want = Counter((r["band"], p) for r in pairs.collect() for p in (r["a"], r["b"]))
    assert {(r["band"], r["place"]): r["n"] for r in sampler.end_counts(places).collect()} == want
    road = lambda r: r["estimate"] * (9 if r["a"].endswith("2") else 1)
    listed = sampler.sample_pairs(spark, pairs, 5, 5, road).collect()
    monkeypatch.setattr(sampler, "journey_candidates", None)
    assert sampler.sample_pairs_of(spark, places, 5, 5, road).collect() == listed and len(listed) >= 5


def test_triples_look_their_distances_up(spark):
    """Each distance is made for a place, not for a triple; rows of one id are no pair."""
    rows = [tuple(r) for r in some_places(spark, 26, 4, 5000).collect()] + [(0, "p0001", 9.0, 42.0, "1"), (0, "p0001", 6.5, 44.0, "0"), (0, None, 9.5, 44.0, "0")]
    places = spark.createDataFrame(rows, "pool long, id string, lon double, lat double, region string")
    found = sampler.triple_candidates(places)
    x, y, z = (places.select("region", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "lon", "lat"))) for k in "xyz")
    km = lambda a, b: F.round(geo.straight_line_km(f"{a}_lon", f"{a}_lat", f"{b}_lon", f"{b}_lat"), 6)
    t = x.join(y, "region").where("x_id < y_id").join(z, "region").where("y_id < z_id").select("x_id", "y_id", "z_id", F.sort_array(F.array(km("x", "y"), km("y", "z"), km("x", "z"))).alias("s"))
    want = t.where("s[0] >= 30 AND s[0] >= 0.2 * s[2]").select("x_id", "y_id", "z_id", "s")
    assert sorted((r["a"], r["b"], r["c"], r["separation"]) for r in found.collect()) == sorted((*r[:3], r["s"][0]) for r in want.collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [line for line in plan if "ASIN" in line]
    assert made and all("lambdafunction" in line for line in made)  # none where triples meet
