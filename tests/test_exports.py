"""Side files, packages, folders' life, and what iterative queries leave behind."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from trailmesh.operators import graph, joins
from trailmesh.operators.compile import simplify_points
from trailmesh.operators.search import GraphStore
from trailmesh.plans import fixpoint
from trailmesh.sources import exports, geography

from .test_engine import random_edges, tables


def lines(path, opened=open):
    return [json.loads(x) for f in sorted(os.listdir(path)) if f.startswith("part-") for x in opened(f"{path}/{f}", "rt")]


def test_size_variants(spark, tmp_path):
    line = [(8.0 + i / 1000, 47.0 + (i % 3) / 5000) for i in range(9)]
    shapes = spark.createDataFrame([(1, line), (2, line[:2]), (3, line[:3])], "edge long, points array<struct<x:double,y:double>>")
    got = exports.size_variants(shapes, f"{tmp_path}/out")
    assert got["0"]["interior_vertices"] == 7 + 0 + 1
    kept = [simplify_points([p[0] for p in x], [p[1] for p in x], 15.0, sum(p[1] for p in x) / len(x)) for x in (line, line[:2], line[:3])]
    assert got["15"]["interior_vertices"] == sum(len(k) - 2 for k in kept)
    plain, packed = lines(f"{tmp_path}/out/geometry-0m/json"), lines(f"{tmp_path}/out/geometry-0m/gzip", gzip.open)
    assert sorted(plain, key=lambda r: r["edge"]) == sorted(packed, key=lambda r: r["edge"])
    first = next(r for r in plain if r["edge"] == 1)["deltas"]
    x, y, back = 800000, 4700000, []
    for d in first:
        x, y = x + d["dx"], y + d["dy"]
        back.append((x, y))
    assert back == [(round(a * 100000), round(b * 100000)) for a, b in line[1:-1]]
    with pytest.raises(Exception, match="already exists"):
        exports.save_sized(shapes, f"{tmp_path}/out/geometry-0m")


def test_side_tables_and_reports(spark, tmp_path):
    made = exports.write_side_tables(f"{tmp_path}/side", {"ids": spark.range(250_001).coalesce(1), "none": spark.range(0)})
    files = [f for f in os.listdir(tmp_path / "side" / "ids") if f.startswith("part-")]
    assert made["ids"]["rows"] == 250_001 and made["none"]["rows"] == 0 and len(files) == 3
    exports.write_report(spark, f"{tmp_path}/report.json", {"b": 1, "a": [1e-7]})
    assert (tmp_path / "report.json").read_text().startswith('{"a"')
    with pytest.raises(Exception, match="already exists"):
        exports.write_report(spark, f"{tmp_path}/report.json", {})


def outlines(spark, rows):
    made = spark.createDataFrame(rows, "region string, kind string, payload string").withColumn("payload", F.col("payload").cast("binary"))
    return made.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256)})


def test_outline_packages(spark):
    whole = outlines(spark, [("xa", "border", "b"), ("xa", "lakes", "")])
    a, b = (exports.outline_packages(whole, d).first() for d in ("20240131", "20250131"))
    assert a["identity"] == b["identity"] and a["id"].startswith("geo-xa-20240131-") and a["lakes"]["bytes"] == 0
    with pytest.raises(ValueError, match="date"):
        exports.outline_packages(whole, "2024-1-1")
    faults = [whole.withColumn("bytes", F.lit(9).cast("long")), whole.withColumn("sha256", F.lit(None).cast("string")), whole.limit(1), whole.unionByName(whole)]
    for bad in faults:
        with pytest.raises(Exception, match="unverified outline of xa"):
            exports.outline_packages(bad, "20240131").collect()


def test_leases(spark, tmp_path):
    for name in ("held", "left"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    exports.lease(spark, f"{tmp_path}/held", "me")
    with pytest.raises(Exception, match="already exists"):
        exports.lease(spark, f"{tmp_path}/held", "you")
    assert exports.sweep(spark, str(tmp_path)) == ["left"] and spark.read.parquet(f"{tmp_path}/held").count() == 3
    exports.release(spark, f"{tmp_path}/held")
    assert exports.sweep(spark, str(tmp_path)) == ["held"]


def test_first_source_with_a_lake_on_land_wins(spark):
    ring = lambda x, y: [[[(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y)]]]
    kind = "id string, properties map<string,string>, polygons array<array<array<struct<x:double,y:double>>>>"
    land = spark.createDataFrame([("l", {}, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]]])], kind)
    one = spark.createDataFrame([("a", {"name": "one"}, ring(2.0, 2.0)), ("b", {"name": "far"}, ring(50.0, 50.0))], kind)
    two = spark.createDataFrame([("a", {"name": "two"}, ring(3.0, 3.0)), ("b", {"name": "near"}, ring(4.0, 4.0))], kind)
    got = geography.lakes_on_land([one, two], land)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [("a", "one"), ("b", "near")]


def test_first_of(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "a"), (2, "z"), (2, "y"), (None, "n")], "id int, v string")
    got = {(r["id"], r["v"], r["source"]) for r in joins.first_of([a, b], "id", "source").collect()}
    assert got == {(1, "x", 0), (2, "y", 1), (None, "n", 1)}


def test_fixpoint_leaves_one_round(spark, monkeypatch):
    nodes, edges = tables(spark, random_edges(3))
    kept, made = [], fixpoint.settle
    monkeypatch.setattr(fixpoint, "settle", lambda df: kept.append(made(df)) or kept[-1])
    arcs = graph.build_arcs(edges)
    got = graph.shortest(arcs, spark.createDataFrame([(graph.seed_node(arcs),)], "node long"))
    there = [os.path.exists(k._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")) for k in kept]
    assert len(kept) > 2 and there == [False] * (len(kept) - 1) + [True] and got.count() > 1


def test_store_closes(spark):
    nodes, edges = tables(spark, random_edges(3))
    s = GraphStore(nodes, edges)
    before = s.components.collect()
    s.close()
    assert not s._parts and not s.arcs.storageLevel.useMemory and sorted(s.components.collect()) == sorted(before)
