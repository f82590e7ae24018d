"""Tables in chunks: round trips, pruning, damage, failed writes; hash trees."""

import glob
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from trailmesh.functions import digest
from trailmesh.functions.text import canonical
from trailmesh.sources import chunksource

from .test_store import flip


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("x"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("é"), F.col("id"))).alias("s"), F.array(F.col("id")).alias("l"))
    return r.unionByName(r.where("k < 90")).repartition(5)


def test_round_trip_and_manifest(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    m = chunksource.write_chunked(rows, path, "k", 500)
    assert [c["n"] for c in m["chunks"]] == list(range(6)) and m["count"] == rows.count() == sum(c["count"] for c in m["chunks"])
    got = chunksource.read_chunked(spark, path, m["root"])
    assert got.schema == rows.schema and not got.exceptAll(rows).count() and not rows.exceptAll(got).count()
    for c in m["chunks"]:
        assert hashlib.sha256(open(f"{path}/{c['path']}", "rb").read()).hexdigest() == c["sha256"]
    with pytest.raises(Exception, match="exists already"):
        chunksource.write_chunked(rows, path, "k", 500)
    with pytest.raises(Exception, match="root differs"):
        chunksource.read_chunked(spark, path, "0").count()


@pytest.mark.parametrize(
    "where,cond,needed",
    [
        ([("k", ">=", 600), ("k", "<=", 900)], "k BETWEEN 600 AND 900", [1]),
        ([("k", ">", 2400)], "k > 2400", [4, 5]),
        ([("k", "in", [3, 2997, None])], "k IN (3, 2997)", [0, 5]),
        ([("k", "=", 1500)], "k = 1500", [3]),
        ([("k", ">=", 1000), ("k", "<", 1001)], "k >= 1000 AND k < 1001", [2]),
        ([("k", ">", 1000), ("k", "<", 900)], "k > 1000 AND k < 900", []),
        ([("k", "in", [])], "false", []),
        ([("x", "=", 3)], "x = 3", [0, 1, 2, 3, 4, 5]),
        ([("s", ">", "é2")], "s > 'é2'", [0, 1, 2, 3, 4, 5]),
    ],
)
def test_conditions_open_only_their_chunks(spark, rows, tmp_path, where, cond, needed):
    path = f"{tmp_path}/t"
    m = chunksource.write_chunked(rows, path, "k", 500)
    for c in m["chunks"]:
        if c["n"] not in needed:
            os.remove(f"{path}/{c['path']}")  # a chunk that is opened would raise
    got = chunksource.read_chunked(spark, path, where=where)
    assert not got.exceptAll(rows.where(cond)).count() and got.count() == rows.where(cond).count()


def test_a_frame_read_again_is_whole(spark, rows, tmp_path):
    """Filters of one use of a frame leave the others whole, also where the session lets filters reach sources."""
    path, name = f"{tmp_path}/t", "spark.sql.python.filterPushdown.enabled"
    chunksource.write_chunked(rows, path, "k", 500, ["x"])
    before = spark.conf.get(name)
    try:
        for on in ("true", "false"):
            spark.conf.set(name, on)
            got = chunksource.read_chunked(spark, path)
            for cond in ("k < 100", "true", "k >= 2900", "k % 2 = 0", "x = 3", "k < 100 OR k > 2900"):
                assert got.where(cond).count() == rows.where(cond).count()
            assert got.where("k < 100").unionByName(got.where("k > 2900")).count() == rows.where("k < 100 OR k > 2900").count()
            assert got.where("k = 3").join(got.where("x = 3"), "x").count() == rows.where("k = 3").join(rows.where("x = 3"), "x").count()
            part = chunksource.read_chunked(spark, path, where=[("k", "<", 100)])
            assert part.where("k = 3").count() == 2 and part.count() == rows.where("k < 100").count() and got.count() == rows.count()
    finally:
        spark.conf.set(name, before)


def test_conditions_are_checked(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    chunksource.write_chunked(rows, path, "k", 500)
    for where in ([("k", "like", 3)], [("k", "=", 0.5)], [("k", "=", "3")], [("s", "in", [3])], [("k", "=", None)], [("l", "=", 3)]):
        with pytest.raises(ValueError, match="not "):
            chunksource.read_chunked(spark, path, where=where)


def test_damage_raises(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    m = chunksource.write_chunked(rows, path, "k", 500)
    assert chunksource.damaged_chunks(spark, path).count() == 0
    flip(f"{path}/{m['chunks'][2]['path']}")
    os.truncate(f"{path}/{m['chunks'][4]['path']}", 30)
    assert {r["path"] for r in chunksource.damaged_chunks(spark, path).collect()} == {m["chunks"][k]["path"] for k in (2, 4)}
    assert chunksource.read_chunked(spark, path, where=[("k", "<", 500)]).count() == rows.where("k < 500").count()
    with pytest.raises(Exception, match="hash differs"):
        chunksource.read_chunked(spark, path).count()
    text = json.load(open(f"{path}/manifest.json"))
    text["chunks"].pop()
    with open(f"{path}/manifest.json", "w") as f:
        json.dump(text, f)
    with pytest.raises(Exception, match="root differs"):
        chunksource.read_chunked(spark, path).count()


def test_failed_write_leaves_nothing(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    bad = rows.withColumn("x", F.when(F.col("k") == 1800, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="killed"):
        chunksource.write_chunked(bad, path, "k", 500)
    assert not glob.glob(f"{path}/*")
    chunksource.write_chunked(rows, path, "k", 500)  # the place is free
    for wrong in (rows.orderBy(F.desc("k")).coalesce(1), rows.withColumn("k", F.lit(None).cast("long")).coalesce(1)):
        with pytest.raises(Exception, match="order of k"):
            wrong.write.format(chunksource.FORMAT).mode("append").option("key", "k").save(f"{tmp_path}/u")
    with pytest.raises(Exception, match="two tasks"):
        rows.repartition(4).sortWithinPartitions("k").write.format(chunksource.FORMAT).mode("append").option("key", "k").save(f"{tmp_path}/u")
    assert not glob.glob(f"{tmp_path}/u/*")


def test_empty_table_and_large_keys(spark, rows, tmp_path):
    m = chunksource.write_chunked(rows.limit(0), f"{tmp_path}/e", "k")
    assert m["chunks"] == [] and chunksource.read_chunked(spark, f"{tmp_path}/e").collect() == []
    large = spark.createDataFrame([(2**60 + 1, "a"), (-5, "b")], "k long, s string")
    chunksource.write_chunked(large, f"{tmp_path}/l", "k")
    assert sorted(map(tuple, chunksource.read_chunked(spark, f"{tmp_path}/l", where=[("k", "=", 2**60 + 1)]).collect())) == [(2**60 + 1, "a")]


def test_inexact_integers_raise():
    assert canonical({"a": 2**53, "b": 2**60}) == '{"a":9007199254740992,"b":1152921504606847000}'
    for x in (2**53 + 1, -(2**60) - 1, 10**400):
        with pytest.raises(ValueError, match="exact"):
            canonical([x])


# ---------------------------------------------------------------- hash trees
def log(spark, n=2000, by=2):
    return spark.range(n * by).select((F.col("id") % by).alias("q"), (F.floor(F.col("id") / by) + 1).alias("event"), (F.col("id") * 7 % 31).alias("word"))


def hashed(rows, block=64):
    return digest.chunk_hashes(rows, ["q"], F.floor((F.col("event") - 1) / block), "event", ["word"])


def roots(rows):
    return {r["q"]: r["hash"] for r in digest.tree(hashed(rows), ["q"])[-1].collect()}


def test_tree_equals_its_definition(spark):
    h = hashed(log(spark))
    by = {}
    for r in sorted(h.collect(), key=lambda r: r["chunk"]):
        by.setdefault(r["q"], []).append(r["hash"])
    assert roots(log(spark)) == {q: digest.root_of(x) for q, x in by.items()} and all(len(x) == 32 for x in by.values())
    few = [hashlib.sha256(b"%d" % k).hexdigest() for k in range(300)]
    for n in (1, 2, 16, 17, 256, 257, 300):
        df = spark.createDataFrame([(0, k, x) for k, x in enumerate(few[:n])] + [(1, 0, few[0])], "q int, chunk long, hash string")
        levels = digest.tree(df, ["q"])
        assert {r["q"]: r["hash"] for r in levels[-1].collect()} == {0: digest.root_of(few[:n]), 1: few[0]}
        bad = digest.proofs(levels, ["q"]).join(df, ["q", "chunk"]).where(~digest.folded(F.col("hash"), F.col("path")).eqNullSafe(F.col("root")))
        assert digest.proofs(levels, ["q"]).count() == n + 1 and bad.count() == 0


def test_every_change_is_found(spark):
    sound = roots(log(spark))
    twice = log(spark).unionByName(log(spark).where("q = 0 AND event IN (5, 6)")).unionByName(log(spark).where("q = 0 AND event IN (5, 6)"))
    swapped = log(spark).withColumn("event", F.when((F.col("q") == 0) & F.col("event").isin(100, 101), 201 - F.col("event")).otherwise(F.col("event")))
    bit = log(spark).withColumn("word", F.when((F.col("q") == 0) & (F.col("event") == 999), F.col("word").bitwiseXOR(1)).otherwise(F.col("word")))
    for changed in (twice, swapped, bit, log(spark).where("NOT (q = 0 AND event = 2000)"), log(spark).withColumn("word", F.when((F.col("q") == 0) & (F.col("event") == 3), None).otherwise(F.col("word")))):
        found = roots(changed)
        assert found[0] != sound[0] and found[1] == sound[1]


def test_one_chunk_is_verified_alone(spark):
    proofs = digest.proofs(digest.tree(hashed(log(spark)), ["q"]), ["q"]).persist()
    one = log(spark).where("q = 1 AND event BETWEEN 641 AND 704")
    for rows, good in ((one, True), (one.withColumn("word", F.col("word") + 1), False), (one.where("event <> 650"), False)):
        met = hashed(rows).join(proofs, ["q", "chunk"])
        assert [r[0] for r in met.select(digest.folded(F.col("hash"), F.col("path")).eqNullSafe(F.col("root"))).collect()] == [good]
