"""Tables in verified chunks: a data source whose tasks write and read one chunk at a time.

``df.write.format("trailmesh_chunks").option("key", "node").save(path)`` writes rows that are
sorted by a key, dealt so that no chunk is in two tasks, and a manifest last; ``spark.read.format(
"trailmesh_chunks").load(path)`` reads them back, one partition a chunk. ``write_chunked`` and
``read_chunked`` do both. Paths are folders or URIs that pyarrow opens, shared by all machines.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructType

from ..functions.digest import root_of
from ..functions.text import canonical
from ..shipping import ship
from .records import decode_chunk

FORMAT = "trailmesh_chunks"
BLOOM_BITS, BLOOM_HASHES = 10, 7  # for each distinct value; about one value in a hundred is claimed wrongly
BLOOM_TYPES = (ByteType(), ShortType(), IntegerType(), LongType(), StringType())  # equal values have equal text
SCHEMA = "trailmesh-chunks/1"
ROWS = 200_000  # rows of a chunk, unless the option ``rows`` says otherwise
MANIFEST = "manifest.json"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    found, inner = pafs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _there(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


def _read(files: pafs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def read_manifest(path: str, root: str | None = None) -> dict:
    """A table's manifest; raises unless its schema is known and its root is that of its chunks (and ``root``, if given)."""
    files, top = _at(path)
    m = json.loads(_read(files, f"{top}/{MANIFEST}"))
    if m.get("schema") != SCHEMA:
        raise ValueError(f"unknown schema {m.get('schema')}")
    if root_of([c["sha256"] for c in m["chunks"]]) != m["root"] or root not in (None, m["root"]):
        raise ValueError("the manifest's root differs")
    return m


def _places(values: Iterable, bits: int) -> np.ndarray:
    """Rows of the bits that stand for each value: two halves of a hash, the second added again and again."""
    halves = np.frombuffer(b"".join(hashlib.blake2b(str(v).encode("utf-8", "surrogatepass"), digest_size=16).digest() for v in values), "<u8").reshape(-1, 2)
    return (halves[:, :1] + np.arange(BLOOM_HASHES, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom(values: Sequence) -> bytes:
    """A Bloom filter of distinct values that aren't null, of a size that follows from their number."""
    bits = 8 * max(8, -(-len(values) * BLOOM_BITS // 8))
    flags = np.zeros(bits, bool)
    if len(values):
        flags[_places(values, bits).ravel()] = True
    return np.packbits(flags).tobytes()


def claimed(data: bytes, values: Sequence) -> list[bool]:
    """Which values a filter claims: all that it was made of, and a few others."""
    if not len(values):
        return []
    flags = np.unpackbits(np.frombuffer(data, np.uint8))
    return flags[_places(values, len(flags))].all(1).tolist()


def verified_bytes(path: str, chunk: dict) -> bytes:
    """The stored bytes of a chunk (or of a filter), read again once if they aren't of the size and hash that the manifest lists."""
    files, top = _at(path)
    why = ""
    for _ in range(2):
        try:
            data = _read(files, f"{top}/{chunk['path']}")
        except OSError as e:
            why = str(e)
            continue
        if len(data) == chunk["bytes"] and hashlib.sha256(data).hexdigest() == chunk["sha256"]:
            return data
        why = "its size or hash differs"
    raise ValueError(f"chunk {chunk['path']}: {why}")


# ---------------------------------------------------------------- writing
@dataclass
class Written(WriterCommitMessage):
    """The chunks of one task: number, least and greatest key, count, sizes, hash, place."""

    chunks: list = field(default_factory=list)


class ChunkWriter(DataSourceArrowWriter):
    """Tasks write chunks into a folder of this write's own; the manifest, written last and never over another, makes them a table."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.key, self.rows, self.own = options["path"], options["key"], int(options.get("rows", ROWS)), f"chunks-{uuid.uuid4().hex}"
        self.fields = schema.json()
        self.blooms = [c for c in options.get("blooms", "").split(",") if c]
        for c in self.blooms:
            if schema[c].dataType not in BLOOM_TYPES:
                raise ValueError(f"no filter is made of {c}: only of integers and texts")
        files, top = _at(self.path)
        if _there(files, f"{top}/{MANIFEST}"):
            raise ValueError(f"a table exists already: {self.path}")

    def _flush(self, n: int, held: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        raw = sink.getvalue().to_pybytes()
        data = gzip.compress(raw, 6, mtime=0)
        digest = hashlib.sha256(data).hexdigest()
        keys, (files, top) = table.column(self.key), _at(self.path)
        files.create_dir(f"{top}/{self.own}")
        name = f"{self.own}/{n}-{digest[:16]}.chunk"

        def put(name: str, data: bytes) -> None:
            draft = f"{top}/{self.own}/draft-{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as f:
                f.write(data)
            files.move(draft, f"{top}/{name}")

        put(name, data)
        listed = {}
        for i, c in enumerate(self.blooms):
            made = bloom(table.column(c).drop_null().unique().to_pylist())
            at = f"{self.own}/{n}-{digest[:16]}-{i}.bloom"
            put(at, made)
            listed[c] = {"path": at, "bytes": len(made), "sha256": hashlib.sha256(made).hexdigest()}
        return {**({"blooms": listed} if listed else {}), "n": n, "start": str(keys[0]), "end": str(keys[-1]), "count": len(table), "bytes": len(data), "decodedBytes": len(raw), "sha256": digest, "path": name}

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, at, last, held = [], None, None, []
        for b in batches:
            keys = b.column(self.key).to_pylist()
            begun = 0
            for i, k in enumerate(keys):
                if k is None or last is not None and k < last:
                    raise ValueError(f"rows aren't in the order of {self.key}")
                last = k
                if k // self.rows != at:
                    if i > begun:
                        held.append(b.slice(begun, i - begun))
                    if held:
                        done.append(self._flush(at, held))
                    at, held, begun = k // self.rows, [], i
            if len(keys) > begun:
                held.append(b.slice(begun))
        if held:
            done.append(self._flush(at, held))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        chunks = sorted((c for m in messages if m for c in m.chunks), key=lambda c: c["n"])
        if any(a["n"] == b["n"] for a, b in zip(chunks, chunks[1:], strict=False)):
            raise ValueError("a chunk was dealt to two tasks")
        manifest = {"schema": SCHEMA, "key": self.key, "rows": self.rows, "fields": json.loads(self.fields), "count": sum(c["count"] for c in chunks), "chunks": chunks, "root": root_of([c["sha256"] for c in chunks])}
        files, top = _at(self.path)
        text = canonical(manifest).encode()
        if isinstance(files, pafs.LocalFileSystem):
            os.makedirs(top, exist_ok=True)
            with open(f"{top}/{MANIFEST}", "xb") as f:
                f.write(text)
            return
        if _there(files, f"{top}/{MANIFEST}"):
            raise ValueError(f"a table exists already: {self.path}")
        with files.open_output_stream(f"{top}/{MANIFEST}") as f:
            f.write(text)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove all that this write's tasks have written, also those that failed; other writes' chunks stay."""
        files, top = _at(self.path)
        if _there(files, f"{top}/{self.own}"):
            files.delete_dir(f"{top}/{self.own}")


# ---------------------------------------------------------------- reading
@dataclass
class ChunkPart(InputPartition):
    chunk: dict
    wanted: dict = field(default_factory=dict)


class ChunkReader(DataSourceReader):
    """One partition a chunk, but for those that the option ``where``, a JSON list of (column, comparison, value), rules out.

    Conditions on the key leave chunks out by their range. Where another column is held equal to some values, the reading task asks
    the chunk's filter of that column, a small file beside it, and doesn't open the chunk if no value is claimed. Neither chunks
    nor filters are read on the driver. Spark must filter the rows as well, as ``read_chunked`` does.

    Filters that Spark offers aren't taken: it keeps what they left for all later reads of the same frame.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.root = options["path"], options.get("root")
        self.manifest = read_manifest(self.path, self.root)
        self.low, self.high, self.among = None, None, None
        self.wanted: dict[str, set] = {}
        for column, op, v in json.loads(options.get("where", "[]")):
            found = set(v) if op == "in" else {v}
            if column != self.manifest["key"]:
                if op in ("=", "in"):
                    self.wanted[column] = self.wanted[column] & found if column in self.wanted else found
            elif op in (">", ">="):
                self.low = v if self.low is None else max(self.low, v)
            elif op in ("<", "<="):
                self.high = v if self.high is None else min(self.high, v)
            else:
                self.among = found if self.among is None else self.among & found

    def _needed(self, c: dict) -> bool:
        start, end = int(c["start"]), int(c["end"])  # text, as JSON's numbers are doubles
        inside = self.among is None or any(v is not None and start <= v <= end for v in self.among)
        return inside and (self.low is None or end >= self.low) and (self.high is None or start <= self.high)

    def partitions(self) -> Sequence[InputPartition]:
        wanted = {c: sorted(v for v in found if v is not None) for c, found in self.wanted.items()}
        return [ChunkPart(c, {w: v for w, v in wanted.items() if w in c.get("blooms", {})}) for c in self.manifest["chunks"] if self._needed(c)]

    def read(self, partition: ChunkPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is needed
            return
        c = partition.chunk
        for name, values in partition.wanted.items():
            if not any(claimed(verified_bytes(self.path, c["blooms"][name]), values)):
                return
        raw = decode_chunk(verified_bytes(self.path, c), c["decodedBytes"])
        with pa.ipc.open_stream(raw) as found:
            n = 0
            for b in found:
                n += b.num_rows
                yield b
        if n != c["count"]:
            raise ValueError(f"chunk {c['path']}: {n} rows, {c['count']} are listed")


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(read_manifest(self.options["path"])["fields"])

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        if overwrite:
            raise ValueError("a table in chunks is never overwritten; append mode writes a new one")
        return ChunkWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(ChunkSource)


def write_chunked(rows: DataFrame, path: str, key: str, size: int = ROWS, blooms: Sequence[str] = ()) -> dict:
    """Write rows as chunks of ``size`` consecutive values of an integer key, where no table is yet; the manifest.

    A chunk is one task's, as a range of keys; keys that repeat stay in one chunk. Null keys raise.
    A write that fails leaves no manifest and removes its chunks. Each of the columns ``blooms`` (integers or texts) gets a
    Bloom filter a chunk, for readers that look values up.
    """
    register(rows.sparkSession)
    # ranges of whole chunks: equal values are never dealt to two tasks
    dealt = rows.repartitionByRange(F.floor(F.col(key) / F.lit(size))).sortWithinPartitions(key)
    dealt.write.format(FORMAT).mode("append").option("key", key).option("rows", size).option("blooms", ",".join(blooms)).save(path)
    return read_manifest(path)


def _holds(column: str, op: str, value) -> Column:
    c = F.col(column)
    if op == "in":
        return c.isin([v for v in value if v is not None])
    return {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def read_chunked(spark: SparkSession, path: str, root: str | None = None, where: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """The rows of a chunked table; reading a chunk checks its size, hash and count. ``root`` is what the manifest's must be.

    Only rows that meet every condition of ``where``: a column, one of = < <= > >= in, and an integer or a text (for ``in`` a list).
    Only chunks that may hold such rows are opened. Nulls never meet a condition. Filters on the frame itself
    are Spark's own and open all chunks that are left.
    """
    register(spark)
    where = [(c, op, sorted({x for x in v if x is not None}) if op == "in" else v) for c, op, v in where]
    for column, op, v in where:
        if op not in ("=", "<", "<=", ">", ">=", "in") or any(not isinstance(x, (int, str)) or isinstance(x, bool) for x in (v if op == "in" else [v])):
            raise ValueError(f"not a condition of integers or texts: {column} {op} {v!r}")
    reader = spark.read.format(FORMAT).option("where", json.dumps(where))
    rows = (reader.option("root", root) if root else reader).load(path)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for column, op, v in where:
        if any(isinstance(x, str) != (kinds[column] == StringType()) for x in (v if op == "in" else [v])) or kinds[column] not in BLOOM_TYPES:
            raise ValueError(f"not of the type of {column}: {v!r}")
        rows = rows.where(_holds(column, op, v))
    return rows


def damaged_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, why): chunks whose stored bytes aren't what the manifest lists; each is read in a task, none is decoded."""
    ship(spark)
    m = read_manifest(path)
    listed = spark.createDataFrame([(c["path"], json.dumps(c)) for c in m["chunks"]], "path string, chunk string")

    def run(batches):
        for b in batches:
            bad = []
            for p, c in zip(b.column("path").to_pylist(), b.column("chunk").to_pylist(), strict=True):
                try:
                    verified_bytes(path, json.loads(c))
                except ValueError as e:
                    bad.append((p, str(e)))
            yield pa.RecordBatch.from_pylist([{"path": p, "why": w} for p, w in bad], pa.schema([("path", pa.string()), ("why", pa.string())]))

    return listed.repartition(max(1, min(len(m["chunks"]), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "path string, why string")


def filter_report(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """n, claimed, held, lost: how many of the values a chunk's filter claims, how many the chunk holds, how many of these aren't claimed.

    What is claimed and not held is claimed wrongly; none may be lost. Each chunk is decoded in a task. Nulls are passed over.
    """
    ship(spark)
    m = read_manifest(path)
    asked = sorted({v for v in values if v is not None})
    listed = spark.createDataFrame([(json.dumps(c),) for c in m["chunks"]], "chunk string")

    def run(batches):
        for b in batches:
            found = []
            for text in b.column("chunk").to_pylist():
                c = json.loads(text)
                with pa.ipc.open_stream(decode_chunk(verified_bytes(path, c), c["decodedBytes"])) as rows:
                    there = set(rows.read_all().column(column).unique().to_pylist())
                said = claimed(verified_bytes(path, c["blooms"][column]), asked)
                found.append({"n": c["n"], "claimed": sum(said), "held": sum(v in there for v in asked), "lost": sum(v in there and not s for v, s in zip(asked, said, strict=True))})
            yield pa.RecordBatch.from_pylist(found, pa.schema([(k, pa.int64()) for k in ("n", "claimed", "held", "lost")]))

    return listed.repartition(max(1, min(len(m["chunks"]), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "n long, claimed long, held long, lost long")
