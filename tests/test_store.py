"""Publishing and loading graphs, geography, small rules."""

import json

import pytest
from pyspark.sql import functions as F

from trailmesh.operators import view
from trailmesh.sources import geography, store

from .test_engine import random_edges, tables


def test_publish_and_load(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS", {"nodes": 15, "edges": 30})
    nodes, edges = tables(spark, random_edges(4), n=40)
    path = f"{tmp_path}/g"
    m = store.publish(nodes, edges, path)
    assert m["counts"]["nodes"] == 40 and [c["start"] for c in m["chunks"] if c["kind"] == "nodes"] == [0, 15, 30]
    n, e, _ = store.load_graph(spark, path, m["identity"])
    assert n.exceptAll(nodes).count() == 0 and e.exceptAll(edges).count() == 0 and e.count() == edges.count()
    with pytest.raises(ValueError, match="identity"):
        store.load_graph(spark, path, "other")
    with pytest.raises(Exception, match="(?i)exist"):
        store.publish(nodes, edges, path)
    text = open(f"{path}/manifest.json").read()
    for change in (lambda x: x["chunks"].pop(), lambda x: x["counts"].update(nodes=99_000_000), lambda x: x.update(schema="else")):
        bad = json.loads(text)
        change(bad)
        bad["identity"] = store.identity({"chunks": bad["chunks"], "bounds": bad["bounds"], "profile": bad["profile"]})
        with open(f"{path}/manifest.json", "w") as f:
            json.dump(bad, f)
        (tmp_path / "g" / ".manifest.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            store.load_manifest(spark, path)


def test_damaged_chunks_are_found(spark, tmp_path):
    nodes, edges = tables(spark, random_edges(5), n=40)
    path = f"{tmp_path}/g"
    m = store.publish(nodes, edges, path)
    n, e, _ = store.load_graph(spark, path)  # sound
    assert n.count() == 40 and e.exceptAll(edges).count() == 0
    flip(f"{path}/{m['chunks'][-1]['path']}")
    with pytest.raises(ValueError, match="differs"):
        store.load_graph(spark, path)
    n, e, _ = store.load_graph(spark, path, verify=False)
    assert n.count() == 40
    with pytest.raises(Exception, match="hash differs"):
        e.count()


def flip(path, at=40):
    """Change one bit of a file."""
    data = bytearray(open(path, "rb").read())
    data[at] ^= 1
    with open(path, "wb") as f:
        f.write(data)


def test_source_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert bytes(store.verified_source(spark, f"{tmp_path}/a.bin", hashlib.sha256(b"abc").hexdigest()).first()["content"]) == b"abc"
    with pytest.raises(ValueError):
        store.verified_source(spark, f"{tmp_path}/a.bin", "0")


def square(x, y, size):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


def feature(id, *polygons, name="n"):
    return {"type": "Feature", "properties": {"id": id, "name": name}, "geometry": {"type": "MultiPolygon", "coordinates": list(polygons)}}


def test_geography(spark, tmp_path):
    land = {"type": "FeatureCollection", "features": [feature("land", [square(0, 0, 10), square(4, 4, 2)]), feature("isle", [square(20, 0, 1)])]}
    (tmp_path / "land.json").write_text(json.dumps(land))
    f = geography.read_features(spark, f"{tmp_path}/land.json").persist()
    assert geography.ring_violations(f).count() == 0
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.5, 0.5), (4, 15.0, 5.0)], "p long, x double, y double")
    assert {(r["p"], r["id"]) for r in geography.points_in(p, f, 2.0).collect()} == {(1, "land"), (3, "isle")}
    lakes = {"type": "FeatureCollection", "features": [feature("l1", [square(1, 1, 1)], name="One"), feature("l2", [square(40, 40, 1)]), feature("l1", [square(1, 1, 1)], name="One")]}
    (tmp_path / "lakes.json").write_text(json.dumps(lakes))
    k = geography.read_features(spark, f"{tmp_path}/lakes.json")
    got = geography.lakes_on_land([k, k], f).collect()
    assert [(r["id"], r["name"]) for r in got] == [("l1", "One")] and 12_300 < got[0]["area_km2"] < 12_400
    bad = {"type": "FeatureCollection", "features": [feature("b", [[[0, 0], [1, 0], [1, 1], [0, 1]]])]}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    assert geography.ring_violations(geography.read_features(spark, f"{tmp_path}/bad.json")).count() == 1
    inside = spark.range(1).select(geography.covered(F.lit(-179.5), F.lit(-40.0), F.lit(170.0), F.lit(-50.0), F.lit(-175.0), F.lit(-30.0), F.lit(175.0)).alias("a"), geography.covered(F.lit(0.0), F.lit(-40.0), F.lit(170.0), F.lit(-50.0), F.lit(-175.0), F.lit(-30.0), F.lit(175.0)).alias("b")).first()
    assert inside["a"] and not inside["b"]


def test_slug_lookup(spark):
    places = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "slug string, id long")
    want = spark.createDataFrame([("a",), ("z",)], "slug string")
    assert [r["id"] for r in geography.place_of_slug(want, places).collect()] == [1]
    with pytest.raises(ValueError, match="b names"):
        geography.place_of_slug(spark.createDataFrame([("b",)], "slug string"), places)


def test_rules(spark):
    v = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("zoom"))
    r = spark.range(1).select(view.shared_view(v(0.0), v(1e-7)).alias("a"), view.shared_view(v(1.0), v(0.0)).alias("b"), view.opening_progress(F.lit(True), F.lit(0.3), F.lit(False)).alias("p"), view.phase_at(F.lit(31.0), F.lit(30.0)).alias("h"), view.replay_clock(F.lit(0.95), F.lit(30.0), F.lit(True)).alias("c")).first()
    assert r["a"] is None and r["b"]["x"] == 1.0 and r["p"] == 0.3 and r["h"] == "hold" and r["c"]["search"] == 1.0 and abs(r["c"]["route"] - 0.5) < 1e-9
