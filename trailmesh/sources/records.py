"""Study links, record containers, delta chunks: parse, write and verify."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import MASK32
from ..functions.text import query_map, strict_number, without_params
from ..model import Algorithm

LINK_PARAMS = ["country", "from", "to", "algorithm", "objective", "progress", "duration"]
LINK_LIMIT = 4000
NAME_LIMIT = 200


# ---------------------------------------------------------------- links
def parse_link(url: Column) -> Column:
    """A struct of a study link's values, null where any is missing or out of range.

    ``from`` and ``to`` are ``lon,lat`` with an optional ``,name``; duration is in seconds, progress from 0 to 1.
    """
    p = query_map(url)
    get = lambda k: F.element_at(p, k)

    def point(k: str) -> Column:
        parts = F.split(get(k), ",", 3)
        lon, lat = strict_number(F.get(parts, F.lit(0)), -180, 180), strict_number(F.get(parts, F.lit(1)), -90, 90)
        name = F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
        return F.when(lon.isNotNull() & lat.isNotNull() & (F.length(name) <= NAME_LIMIT), F.struct(name.alias("name"), lon.alias("lon"), lat.alias("lat")))

    algorithm = F.when(get("algorithm").isin([a.value for a in Algorithm]), get("algorithm"))
    objective = F.when(F.coalesce(get("objective"), F.lit("distance")).isin("distance", "time"), F.coalesce(get("objective"), F.lit("distance")))
    progress, duration = F.coalesce(strict_number(get("progress"), 0, 1), F.lit(0.0)), F.coalesce(strict_number(get("duration"), 1, 3600), F.lit(30.0))
    study = F.struct(get("country").alias("country"), point("from").alias("start"), point("to").alias("goal"), algorithm.alias("algorithm"), objective.alias("objective"), progress.alias("progress"), duration.alias("duration"))
    good = (F.length(url) <= LINK_LIMIT) & get("country").rlike(r"\A[a-z]{2,3}\z") & point("from").isNotNull() & point("to").isNotNull() & algorithm.isNotNull() & objective.isNotNull() & (get("from") != get("to"))
    return F.when(good, study)


def write_link(base: Column, study: Column) -> Column:
    """The base URL, its own parameters kept, with the study's."""
    rest = without_params(base, LINK_PARAMS)
    point = lambda s: F.concat_ws(",", s["lon"].cast("decimal(9,5)").cast("string"), s["lat"].cast("decimal(9,5)").cast("string"), s["name"])
    values = {"country": study["country"], "from": point(study["start"]), "to": point(study["goal"]), "algorithm": study["algorithm"], "objective": study["objective"], "progress": study["progress"].cast("string"), "duration": study["duration"].cast("string")}
    query = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in values.items()))
    return F.concat(rest, F.when(rest.contains("?"), "&").otherwise("?"), query)


# ---------------------------------------------------------------- delta chunks
def delta_encode(rows: DataFrame, order: str, columns: list[str], size: int) -> DataFrame:
    """Rows with chunk number and differences to the row before, anew in every chunk."""
    chunked = rows.withColumn("chunk", F.floor(F.col(order) / size))
    w = Window.partitionBy("chunk").orderBy(order)
    return chunked.select("chunk", order, *((F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"d_{c}") for c in columns))


def delta_decode(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("chunk", order, *(F.sum(f"d_{c}").over(w).alias(c) for c in columns))


def delta32_encode(rows: DataFrame, order: str, column: str, *by: str) -> DataFrame:
    """Bit patterns (0 to 2**32 - 1) as differences modulo 2**32; decoded by a running sum modulo 2**32."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn(f"d_{column}", (F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0))).bitwiseAND(MASK32))


def delta32_decode(rows: DataFrame, order: str, column: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.sum(f"d_{column}").over(w).bitwiseAND(MASK32))


def chunk_layout(total: Column, size: int) -> Column:
    """array<struct<chunk, start, count>> that covers so many rows."""
    last = F.floor((total - 1) / size)
    return F.when(total > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(k.alias("chunk"), (k * size).alias("start"), F.least(F.lit(size).cast("long"), total - k * size).alias("count"))))


def write_chunks(rows: DataFrame, order: str, path: str, size: int) -> None:
    """Delta-friendly Parquet: ranges of the order, sorted, at most ``size`` rows a file; never overwrites."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", size).option("compression", "gzip").mode("errorifexists").parquet(path)


def decode_chunk(payload: bytes, decoded: int, sha256: str | None = None) -> bytes:
    """A gzip chunk checked against its declared hash and size; truncated or longer data raises."""
    if sha256 is not None and hashlib.sha256(payload).hexdigest() != sha256:
        raise ValueError("chunk hash differs")
    try:
        with gzip.GzipFile(fileobj=__import__("io").BytesIO(payload)) as f:
            out = f.read(decoded + 1)
    except EOFError as e:
        raise ValueError("chunk is truncated") from e
    if len(out) != decoded:
        raise ValueError("chunk size differs")
    return out


def verified_chunks(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, data: files (path, content) that a manifest (path, decodedBytes, sha256) lists, verified and decoded; a bad one raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "data": [decode_chunk(c, int(n), s) for c, n, s in zip(b["content"], b["decodedBytes"], b["sha256"], strict=True)]})

    return files.join(manifest, "path").select("path", "content", "decodedBytes", "sha256").mapInPandas(run, "path string, data binary")


# ---------------------------------------------------------------- record container
MAGIC = b"TMREC001"


def buffer_offsets(buffers: DataFrame, by: str = "record", order: str = "n", size: str = "bytes") -> DataFrame:
    """Buffers with their offset: sizes padded to four bytes, one after the other."""
    padded = F.floor((F.col(size) + 3) / 4) * 4
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return buffers.withColumn("offset", F.coalesce(F.sum(padded).over(w), F.lit(0)).cast("long"))


def export_record(metadata: dict, buffers: dict[str, bytes]) -> bytes:
    """Magic, length of the JSON, JSON with the buffers' places, buffers padded to four bytes; compressed."""
    places, at = [], 0
    for name, data in buffers.items():
        places.append({"name": name, "offset": at, "bytes": len(data)})
        at += (len(data) + 3) // 4 * 4
    head = json.dumps({"metadata": metadata, "buffers": places}, sort_keys=True).encode()
    head += b" " * (-len(head) % 4)
    body = b"".join(d + bytes(-len(d) % 4) for d in buffers.values())
    return gzip.compress(MAGIC + struct.pack("<I", len(head)) + head + body, mtime=0)


def import_record(data: bytes) -> tuple[dict, dict[str, bytes]]:
    raw = gzip.decompress(data)
    if raw[:8] != MAGIC:
        raise ValueError("not a record")
    n = struct.unpack_from("<I", raw, 8)[0]
    head, start = json.loads(raw[12 : 12 + n]), 12 + n
    return head["metadata"], {b["name"]: raw[start + b["offset"] : start + b["offset"] + b["bytes"]] for b in head["buffers"]}
