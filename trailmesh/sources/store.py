"""Publishing and loading graphs: chunks first, manifest last, everything verified on the way in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, identity
from ..model import EDGES, NODES
from ..operators.validate import chunk_coverage, edge_integrity, manifest_limits
from .chunksource import damaged_chunks, read_chunked, read_manifest, write_chunked

SCHEMA = "trailmesh-graph/1"
ROWS = {"nodes": 250_000, "edges": 200_000}  # rows of a chunk
STRIDE = {"nodes": 8, "edges": 14}


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, value: str) -> None:
    fs, p = _files(spark, path)
    out = fs.create(p, False)  # never overwrites
    out.write(bytearray(value.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _listed(kind: str, table: dict) -> list[dict]:
    """The chunks of a table as the graph's manifest lists them; bytes are those of the decoded columns."""
    return [{"n": {"nodes": 0, "edges": 1}[kind] * 10**9 + c["n"], "kind": kind, "path": f"{kind}/{c['path']}", "start": int(c["start"]), "count": c["count"], "stride": STRIDE[kind], "bytes": c["count"] * STRIDE[kind], "sha256": c["sha256"]} for c in table["chunks"]]


def publish(nodes: DataFrame, edges: DataFrame, path: str, profile: str = "road/1") -> dict:
    """Write a graph where nothing is yet: chunks of sorted rows with their hashes, then its manifest with its identity.

    Bounds and arcs are observed while the rows are written, so no row is read twice. A failed
    write leaves no manifest.
    """
    spark = nodes.sparkSession
    fs, p = _files(spark, path)
    if fs.exists(p):
        raise ValueError(f"something exists already: {path}")
    box, degree = Observation("bounds"), Observation("arcs")
    seen = {
        "nodes": nodes.observe(box, *(f(c).alias(f"{c}{k}") for k, f in ((1, F.min), (2, F.max)) for c in "xy")),
        "edges": edges.observe(degree, F.coalesce(F.sum(F.when(F.col("direction") == 0, 2).otherwise(1)), F.lit(0)).alias("arcs")),
    }
    chunks, roots = [], {}
    for kind, key, schema in (("nodes", "node", NODES), ("edges", "edge", EDGES)):
        rows = seen[kind].select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        table = write_chunked(rows, f"{path}/{kind}", key, ROWS[kind])
        chunks += _listed(kind, table)
        roots[kind] = table["root"]
    counts = {k: sum(c["count"] for c in chunks if c["kind"] == k) for k in ROWS} | {"arcs": degree.get["arcs"]}
    own = {"schema": SCHEMA, "profile": profile, "counts": counts, "bounds": box.get, "chunks": chunks, "roots": roots}
    manifest = own | {"identity": identity({"chunks": chunks, "bounds": box.get, "profile": profile})}
    _write_text(spark, f"{path}/manifest.json", canonical(manifest))
    return manifest


def load_manifest(spark: SparkSession, path: str, expected: str | None = None) -> dict:
    """The manifest, after its schema, identity, limits and chunk coverage are checked."""
    m = json.loads(_read_text(spark, f"{path}/manifest.json"))
    if m.get("schema") != SCHEMA:
        raise ValueError(f"unknown schema {m.get('schema')}")
    if identity({"chunks": m["chunks"], "bounds": m["bounds"], "profile": m["profile"]}) != m["identity"] or expected not in (None, m["identity"]):
        raise ValueError("manifest identity differs")
    sizes = spark.createDataFrame([(k, int(v)) for k, v in m["counts"].items()], "name string, value long")
    if over := manifest_limits(sizes).collect():
        raise ValueError(f"over a limit: {[r['name'] for r in over]}")
    if m["chunks"]:
        c = spark.createDataFrame([(x["n"], x["kind"], x["path"].replace("=", "-"), x["start"], x["count"], x["stride"], x["bytes"]) for x in m["chunks"]], "n long, kind string, path string, start long, count long, stride int, bytes long")
        if wrong := chunk_coverage(c, {k: m["counts"][k] for k in ROWS}).limit(5).collect():
            raise ValueError(f"chunks: {[r['why'] for r in wrong]}")
    return m


def load_graph(spark: SparkSession, path: str, expected: str | None = None, verify: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, manifest). A chunk is verified by the task that reads it; with ``verify`` all of them now, and edges against nodes."""
    m = load_manifest(spark, path, expected)
    out = []
    for kind in ("nodes", "edges"):
        if verify and (bad := damaged_chunks(spark, f"{path}/{kind}").limit(5).collect()):
            raise ValueError(f"{kind}: a chunk differs from the manifest: {[r['why'] for r in bad]}")
        if _listed(kind, read_manifest(f"{path}/{kind}", m["roots"][kind])) != [c for c in m["chunks"] if c["kind"] == kind]:
            raise ValueError(f"{kind}: its chunks differ from the manifest's")
        out.append(read_chunked(spark, f"{path}/{kind}", m["roots"][kind]))
    if verify and edge_integrity(out[1], out[0]).take(1):
        raise ValueError("edges don't fit the nodes")
    return out[0], out[1], m


def verified_source(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A source file as path, content; raises unless its content has that hash."""
    files = spark.read.format("binaryFile").load(path).withColumn("sha256", F.sha2("content", 256))
    if files.where(F.col("sha256") != sha256).take(1) or not files.take(1):
        raise ValueError("source hash differs")
    return files.select("path", "content")
