"""What is written beside a graph: sized shapes, side tables, outline packages, reports, and the life of record folders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators.compile import simplify
from .store import _files, _write_text

SCALE = 100_000  # units of a degree
SIDE_ROWS = 100_000  # rows of a side table's file, at most
LEASE, RECORD = "_lease", "_SUCCESS"


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _files(spark, path)
    return fs.getContentSummary(p).getLength()


def save_sized(rows: DataFrame, path: str) -> dict:
    """Write rows as JSON lines, plain and gzip, and say the bytes of both. Nothing is overwritten."""
    sizes = {}
    for name, codec in (("json", "none"), ("gzip", "gzip")):
        rows.write.option("compression", codec).mode("errorifexists").json(f"{path}/{name}")
        sizes[f"{name}_bytes"] = stored_bytes(rows.sparkSession, f"{path}/{name}")
    return sizes


def interior_deltas(points) -> F.Column:
    """Points between the ends of a line, in units, each as its difference to the one before."""
    units = F.transform(points, lambda p: F.struct(F.round(p["x"] * SCALE).cast("int").alias("x"), F.round(p["y"] * SCALE).cast("int").alias("y")))
    inner = F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0)))
    after = F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0)))
    step = lambda q, p: F.struct((q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))
    return F.zip_with(after, F.slice(inner, 1, F.size(after)), step)


def size_variants(shapes: DataFrame, path: str, tolerances=(0, 5, 15)) -> dict[str, dict]:
    """Write (edge, points in degrees) simplified at each tolerance in metres; bytes and interior points of each variant."""
    found = {}
    for metres in tolerances:
        points = simplify(F.col("points"), float(metres)) if metres else F.col("points")
        out = f"{path}/geometry-{metres}m"
        sizes = save_sized(shapes.select("edge", points.alias("points")).select("edge", interior_deltas(F.col("points")).alias("deltas")), out)
        back = shapes.sparkSession.read.schema("edge long, deltas array<struct<dx:int,dy:int>>").json(f"{out}/json")
        found[str(metres)] = sizes | {"interior_vertices": back.agg(F.coalesce(F.sum(F.size("deltas")), F.lit(0))).first()[0]}
    return found


def write_side_tables(path: str, tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Write evidence tables as gzip JSON lines, in files of SIDE_ROWS rows at most; their rows and bytes."""
    found = {}
    for name, rows in tables.items():
        rows.write.option("compression", "gzip").option("maxRecordsPerFile", SIDE_ROWS).mode("errorifexists").json(f"{path}/{name}")
        spark = rows.sparkSession
        found[name] = {"rows": spark.read.text(f"{path}/{name}").count(), "bytes": stored_bytes(spark, f"{path}/{name}")}
    return found


def outline_packages(outlines: DataFrame, date: str) -> DataFrame:
    """region, id, identity, border, lakes of (region, kind, payload, bytes, sha256): an identity for each region's two assets.

    An asset whose bytes or hash aren't as listed, one that is missing or there twice, and a
    date that isn't eight digits raise. The identity is the hash of the payload's JSON, so the
    same assets have the same one on any date.
    """
    if not re.fullmatch(r"\d{8}", date):
        raise ValueError(f"not a date: {date}")
    digest = F.sha2("payload", 256)
    bad = (F.octet_length("payload") != F.col("bytes")) | (digest != F.col("sha256"))
    whole = F.coalesce(~bad, F.lit(False))
    asset = F.struct(F.concat("kind", F.lit("-"), F.left(digest, F.lit(12)), F.lit(".json")).alias("path"), F.col("bytes").cast("long").alias("bytes"), F.col("sha256"))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("asset"))).alias(kind)
    each = outlines.select("region", "kind", asset.alias("asset"), whole.alias("whole"))
    fit = (F.count_if(F.col("kind") == "border") == 1) & (F.count_if(F.col("kind") == "lakes") == 1) & (F.count(F.lit(1)) == 2) & F.bool_and("whole")
    made = each.groupBy("region").agg(of("border"), of("lakes"), fit.alias("fit"))
    made = made.where(F.when(F.col("fit"), True).otherwise(F.raise_error(F.concat(F.lit("unverified outline of "), F.coalesce("region", F.lit("null")))).cast("boolean")))
    made = made.withColumn("identity", F.sha2(F.to_json(F.struct("region", "border", "lakes")), 256))
    return made.select("region", F.concat(F.lit("geo-"), "region", F.lit(f"-{date}-"), F.left("identity", F.lit(12))).alias("id"), "identity", "border", "lakes")


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """Write an audit's figures as one canonical JSON file, where nothing is yet."""
    _write_text(spark, path, canonical(report))


# ---------------------------------------------------------------- life of record folders
def lease(spark: SparkSession, path: str, holder: str) -> None:
    """Keep a record's folder from sweep() until the holder releases it; one holder at a time. Raises if there is no record (any more)."""
    fs, p = _files(spark, f"{path}/{RECORD}")
    if not fs.exists(p):
        raise ValueError(f"no record at {path}")
    _write_text(spark, f"{path}/{LEASE}", holder)
    if not fs.exists(p):  # swept meanwhile, so the lease stands in an empty folder
        fs.delete(p.getParent(), True)
        raise ValueError(f"no record at {path}")


def release(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, f"{path}/{LEASE}")
    fs.delete(p, False)


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete the record folders under root that nobody holds; their names.

    A record is a folder whose write was committed (RECORD); others stay. A folder is first renamed aside and looked at
    again: a lease that was taken meanwhile keeps it.
    """
    fs, p = _files(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = []
    for at in fs.listStatus(p):
        here = at.getPath()
        if not at.isDirectory() or here.getName().startswith(".") or not fs.exists(path(here, RECORD)) or fs.exists(path(here, LEASE)):
            continue
        aside = path(here.getParent(), f".swept-{uuid.uuid4().hex}")
        if not fs.rename(here, aside):
            continue
        if fs.exists(path(aside, LEASE)):
            fs.rename(aside, here)
            continue
        fs.delete(aside, True)
        gone.append(here.getName())
    return sorted(gone)
