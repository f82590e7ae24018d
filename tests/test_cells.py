"""Pairs by cells and nodes by cells against all pairs; filters of chunks; table functions."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailmesh.functions import tables
from trailmesh.functions.bits import pack_word
from trailmesh.operators import cells, search
from trailmesh.sources import chunksource


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return round(12742.0176 * math.asin(min(1.0, math.sqrt(h))), 6)


def all_pairs(rows, steps):
    found = Counter()
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0]:
                found[a[0], sum(km(a[1:], b[1:]) >= s for s in steps)] += 1
    return dict(found)


def test_pair_counts(spark):
    draw = random.Random(5)
    rows = [("a", draw.uniform(5, 9), draw.uniform(46, 48)) for _ in range(500)]
    rows += [("a", 7.5, 47.0)] * 150 + [("a", 7.5 + draw.gauss(0, 1e-4), 47.3) for _ in range(150)]  # a hot place, a hot cell
    rows += [(None, draw.choice([179.9, -179.9]) + draw.gauss(0, 0.3), draw.uniform(-17, -16)) for _ in range(60)]  # over the date line
    rows += [("poles", draw.uniform(-180, 180), draw.choice([-1, 1]) * draw.uniform(89, 90)) for _ in range(40)] + [("one", 0.0, 0.0)]
    steps = [30.0, 80.0, 176.0]
    nowhere = [("a", None, 47.0), ("a", 7.0, float("nan")), (None, None, None)]
    points = spark.createDataFrame(rows + nowhere, "g string, lon double, lat double").withColumn("step", F.lit(9)).repartition(3)
    for few in (16, 10**9):
        got = cells.pair_counts(points, ["g"], steps, few=few).collect()
        assert {(r["g"], r["step"]): r["pairs"] for r in got} == all_pairs(rows, steps)
        a = [r for r in got if r["g"] == "a"]
        if few == 16:
            assert sum(r["expanded"] for r in a) < 0.25 * sum(r["pairs"] for r in a)
    assert cells.pair_counts(points.limit(0), ["g"], steps).count() == 0


def test_expanded_pairs_are_few(spark):
    place = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) / 100_000.0
    points = spark.range(20_000).select(F.lit(0).alias("g"), (6 + 4 * place(1)).alias("lon"), (46 + 2 * place(2)).alias("lat"))
    got = cells.pair_counts(points, ["g"], [30.0]).agg(F.sum("pairs").alias("p"), F.sum("expanded").alias("e")).first()
    assert got["p"] == 20_000 * 19_999 // 2 and 0 < got["e"] < got["p"] / 20


def test_thresholds_belong_to_the_upper_step(spark):
    rows = [(0.0, 0.0), (0.0, 1.0)]
    exact = km(*rows)
    points = spark.createDataFrame([(1, *r) for r in rows], "g int, lon double, lat double")
    for step, want in ((exact, 1), (exact + 1e-6, 0), (exact - 1e-6, 1)):
        assert [r["step"] for r in cells.pair_counts(points, ["g"], [step]).collect()] == [want]


def test_snapping_by_cells(spark):
    draw = random.Random(8)
    spots = [(round(draw.gauss(8, 0.02) * 1e5), round(draw.gauss(47, 0.02) * 1e5)) for _ in range(1500)] + [(round(draw.uniform(-180, 180) * 1e5), round(draw.gauss(89.95, 0.02) * 1e5)) for _ in range(200)]
    nodes = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "node long, x int, y int")
    parts = spark.createDataFrame([(i, i % 7 if i % 3 == 0 else 0) for i in range(len(spots))], "node long, component long")
    asked = [(f"p{i}", draw.gauss(8, 0.03), draw.gauss(47, 0.03)) for i in range(40)] + [("pole", 10.0, 89.96), ("far", 100.0, 0.0), ("same", spots[3][0] / 1e5, spots[3][1] / 1e5)]
    points = spark.createDataFrame(asked, "name string, lon double, lat double")
    want = {}
    for name, lon, lat in asked:
        for i, (x, y) in enumerate(spots):
            d = math.hypot((x / 1e5 - lon) * math.cos(math.radians(lat)), y / 1e5 - lat) * 111195.0802
            key = name, i % 7 if i % 3 == 0 else 0
            if d <= 2000 and (round(d, 6), i) < want.get(key, (9e9, 0)):
                want[key] = round(d, 6), i
    got = search.snap_candidates(points, nodes, parts)
    assert {(r["name"], r["component"]): (round(r["metres"], 6), r["node"]) for r in got.collect()} == want
    # nodes all around the globe at the same latitudes are never met
    around = spark.range(36_000).select((F.col("id") + 10_000).alias("node"), ((F.col("id") - 18_000) * 1000).cast("int").alias("x"), F.lit(4_700_000).alias("y")).where("abs(x - 800000) > 50000")
    more = search.snap_pairs(points, nodes.unionByName(around), parts.unionByName(around.select("node", F.lit(0).cast("long").alias("component"))))
    met = search.snap_pairs(points, nodes, parts).count()
    assert more.count() == met < 0.2 * 40 * 1500


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("é"), F.col("id"))).alias("s"))


def test_filters_leave_chunks_closed(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    m = chunksource.write_chunked(rows, path, "k", 500, ["v", "s"])
    assert len(m["chunks"]) == 8
    wanted = [r["v"] for r in rows.where("k IN (20, 21, 3999)").collect()]
    report = {r["n"]: r for r in chunksource.filter_report(spark, path, "v", [*wanted, None]).collect()}
    assert sum(r["held"] for r in report.values()) == 3 and all(r["lost"] == 0 and r["claimed"] >= r["held"] for r in report.values())
    false = chunksource.filter_report(spark, path, "v", list(range(2_000_000, 2_005_000))).agg(F.sum("claimed"), F.sum("held")).first()
    assert false[1] == 0 and false[0] < 0.02 * 8 * 5000
    for c in m["chunks"]:
        if not report[c["n"]]["claimed"]:
            os.remove(f"{path}/{c['path']}")  # a chunk that is opened would raise
    read = lambda *where: sorted(r["k"] for r in chunksource.read_chunked(spark, path, where=where).collect())
    assert read(("v", "in", [*wanted, None])) == [20, 21, 3999]
    assert read(("s", "=", "é21"), ("k", "<", 400)) == [21]
    assert read(("s", "=", "none"), ("k", "<", 400)) == read(("s", "=", "é21"), ("v", "=", -5)) == read(("v", "in", [])) == []
    with pytest.raises(Exception, match="No such file"):
        read(("k", ">=", 0))


def test_a_damaged_filter_raises(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    m = chunksource.write_chunked(rows, path, "k", 1000, ["v"])
    with open(f"{path}/{m['chunks'][0]['blooms']['v']['path']}", "r+b") as f:
        f.write(b"\0\0\0\0")
    with pytest.raises(Exception, match="hash differs"):
        chunksource.read_chunked(spark, path, where=[("v", "=", 7919)]).count()
    assert chunksource.read_chunked(spark, path, where=[("k", "=", 1)]).count() == 1
    with pytest.raises(Exception, match="no filter is made"):
        chunksource.write_chunked(rows.withColumn("d", F.lit(0.5)), f"{tmp_path}/u", "k", 1000, ["d"])


def test_table_functions(spark):
    tables.register(spark)
    made = spark.createDataFrame([(7, [4 + 1, 8 + 2 + 2**31]), (8, []), (9, None)], "query_id long, words array<long>")
    got = spark.sql("SELECT * FROM word_events(TABLE(SELECT * FROM {t}), 'words')", t=made)
    assert got.columns == ["query_id", "event", "kind", "id", "side"]
    assert sorted(map(tuple, got.collect())) == [(7, 1, 1, 1, 0), (7, 2, 2, 2, 1)]
    words = spark.range(50).select(F.lit("x").alias("q"), F.array(pack_word(F.col("id") % 4, "id", F.col("id") % 2)).alias("w"))
    back = spark.sql("SELECT kind, id, side FROM word_events(TABLE(SELECT * FROM {t}), 'w')", t=words)
    assert sorted(map(tuple, back.collect())) == sorted((i % 4, i, i % 2) for i in range(50))
    points = spark.createDataFrame([("a", j, float(j), 0.0) for j in range(5)] + [("b", 1, 2.0, 2.0), ("c", 0, 1.0, 1.0), ("c", 1, None, 1.0), ("c", 2, 3.0, 3.0)], "edge string, j int, x double, y double").repartition(4)
    segments = spark.sql("SELECT * FROM shape_segments(TABLE(SELECT * FROM {t}) PARTITION BY (edge) ORDER BY (j), 'edge')", t=points).collect()
    assert sorted(map(tuple, segments)) == [("a", j, float(j), 0.0, j + 1.0, 0.0) for j in range(4)] + [("c", 0, 1.0, 1.0, 3.0, 3.0)]
    for text, why in (("word_events(TABLE(SELECT * FROM {t}), 'none')", "names the table's column"), ("word_events(TABLE(SELECT * FROM {t}), 'query_id')", "isn't an array"), ("shape_segments(TABLE(SELECT * FROM {t}), 'query_id')", "no number x")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {text}", t=made).count()
