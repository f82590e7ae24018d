"""Validators: each returns the violations as a DataFrame, empty when all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMITS = {"nodes": 11_000_000, "edges": 16_000_000, "arcs": 32_000_000, "vertices": 64_000_000, "bytes": 256 * 1024 * 1024}
PHASES = ["nodes", "edges", "geometry"]
STRIDES = {"nodes": 8, "edges": 14, "geometry": 0}
SAFE_PATH = r"\A[A-Za-z0-9][A-Za-z0-9._/-]*\z"


def chunk_coverage(chunks: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """kind, start, why: gaps, overlaps, short coverage, wrong strides, unsafe or repeated paths, out-of-order phases.

    chunks: n (position), kind, path, start, count, stride, bytes.
    """
    w = Window.partitionBy("kind").orderBy("start")
    expected = F.coalesce(F.lag(F.col("start") + F.col("count")).over(w), F.lit(0))
    gap = chunks.withColumn("e", expected).where("start != e").select("kind", "start", F.lit("gap").alias("why"))
    phase = F.array_position(F.array(*map(F.lit, PHASES)), F.col("kind"))
    strides = F.create_map(*(F.lit(x) for kv in STRIDES.items() for x in kv))
    each = chunks.select("kind", "start", F.when(phase == 0, "kind").when(F.element_at(strides, F.col("kind")) != F.col("stride"), "stride").when(~F.col("path").rlike(SAFE_PATH) | F.col("path").contains(".."), "path").when((F.col("count") <= 0) | (F.col("bytes") <= 0), "size").alias("why")).where("why IS NOT NULL")
    order = chunks.withColumn("p", phase).withColumn("before", F.max("p").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))).where("before > p").select("kind", "start", F.lit("order").alias("why"))
    twice = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.first("kind").alias("kind"), F.max("start").alias("start")).where("c > 1").select("kind", "start", F.lit("path repeated").alias("why"))
    out = gap.unionByName(each).unionByName(order).unionByName(twice)
    if counts:
        whole = chunks.sparkSession.createDataFrame(list(counts.items()), "kind string, whole long")
        short = chunks.groupBy("kind").agg(F.max(F.col("start") + F.col("count")).alias("end")).join(whole, "kind", "right").where("end IS NULL OR end != whole")
        out = out.unionByName(short.select("kind", F.coalesce("end", F.lit(0)).cast("long").alias("start"), F.lit("coverage").alias("why")))
    return out


def manifest_limits(manifest: DataFrame) -> DataFrame:
    """Rows (name, value) over a limit."""
    most = manifest.sparkSession.createDataFrame(list(LIMITS.items()), "name string, most long")
    return manifest.join(F.broadcast(most), "name").where("value > most")  # five rows


def edge_integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge, why: endpoints that aren't nodes, directions other than 0, 1, 2, negative lengths."""
    ends = edges.select("edge", F.explode(F.array("u", "v")).alias("node"))
    lost = ends.join(nodes.select("node"), "node", "left_anti").select("edge", F.lit("endpoint").alias("why")).distinct()
    wrong = edges.select("edge", F.when(~F.col("direction").isin(0, 1, 2), "direction").when(F.col("length_cm") < 0, "length").alias("why")).where("why IS NOT NULL")
    return lost.unionByName(wrong)


def listing_difference(found: DataFrame, expected: DataFrame, name: str = "path") -> DataFrame:
    """path, side: what only one listing has."""
    a, b = found.select(name), expected.select(name)
    return a.exceptAll(b).withColumn("side", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def bound_violations(bound: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs on which h(u) > w + h(v)."""
    hu, hv = bound.select(F.col("node").alias("src"), F.col("h").alias("hu")), bound.select(F.col("node").alias("dst"), F.col("h").alias("hv"))
    return arcs.join(hu, "src").join(hv, "dst").where("hu > w + hv")
