"""What the corpus operators share: null-safe text, the shared folder, written tables, hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import hashlib
import re
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.shipping import shared_folder, ship

#: Bytes of the batches that go to Python workers, unless the application sets its own.
BATCH = "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The column's whole text; null counts as empty."""
    return F.coalesce(docs[quoted(name)], F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ready(spark: SparkSession) -> None:
    """Send the package to the executors and bound the bytes of Arrow batches."""
    ship(spark)
    if not spark.sparkContext.getConf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, BATCH)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no column called so (in any case of letters)."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clean then
        pass


class Workspace:
    """Tables that an operator writes to the shared folder and reads again.

    A written table cuts the lineage and survives a lost executor. The folder is
    removed with the session; ``drop`` removes a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """The table, written and read again; in a folder for each value of ``by``."""
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _drop(self.spark, self.path(name))

    def tidy(self) -> None:
        """Let finished shuffles go: their files stay until the driver's JVM collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, table: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join with a broadcast if the written table's counted rows are within the bound, else by shuffle."""
    return big.join(F.broadcast(table) if table.count() <= rows else table, on, how)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _trim() -> None:
    """Give what a task has freed back to the system: workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def made_by(start: Callable[[], Callable], made: dict[str, str], value: Column) -> Column:
    """A struct column with the fields ``made``, from one column's values, batch by batch.

    ``start()`` runs once in a worker's task and gives a function from a list of values to one
    list (or array) for each field. Only ``value`` goes to Python and only the struct comes back.
    It isn't deterministic to Spark, so that it is made once a row, however often it is read.
    """
    types, names = [ARROW[v] for v in made.values()], list(made)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = start()
        try:
            for b in batches:
                out = f(b.to_pylist()) if len(b) else [[] for _ in names]
                yield pa.StructArray.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)
                del b, out
        finally:
            _trim()

    return F.arrow_udf(run, "struct<" + ", ".join(f"{k}: {v}" for k, v in made.items()) + ">").asNondeterministic()(value)


def map_rows(df: DataFrame, inputs: list[str], start: Callable[[], Callable], made: dict[str, str]) -> DataFrame:
    """Add columns made in Python, batch by batch; all but the input columns pass unchanged through Arrow.

    ``start()`` runs once in a worker's task and gives a function from the inputs' lists to
    one list (or array) for each made column.
    """
    ready(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in inputs]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{k}` {v}" for k, v in made.items())])
    names, types = [f.name for f in keep], [ARROW[v] for v in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        try:
            for b in batches:
                if b.num_rows:
                    out = f(*(b.column(x).to_pylist() for x in inputs))
                    yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], [*names, *made])
        finally:
            _trim()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- hashing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16  # bytes that are hashed at once
_LONG = 1 << 12  # words over so many bytes are hashed one by one
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.zeros(256, bool)
_IS_GAP[list(SPACE.encode())] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


#: Powers of the base and of its inverse, modulo 2**64, for a block and a word that begins in it.
_POWER = _powers(_BASE, _BLOCK + _LONG + 2)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + _LONG + 2)


def _hashed(block: np.ndarray) -> np.ndarray:
    """Hashes of the block's words, none over _LONG bytes."""
    gap = np.concatenate(([True], _IS_GAP[block], [True]))
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block + np.uint64(1)) * _POWER[: len(block)], out=total[1:])
    return mix64((total[end] - total[start]) * _INVERSE[start] ^ ((end - start).astype(np.uint64) * _M2))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in order.

    The text is hashed in blocks that end at white space, so that memory is that of the text and of its hashes.
    """
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    if len(data) <= _LONG:
        return _hashed(np.frombuffer(data, np.uint8)) if data else np.empty(0, np.uint64)
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + _BLOCK, n)
        if end < n and not _IS_GAP[data[end]]:
            # back to a gap, so that no word is cut
            back = next((i for i in range(end - 1, max(at, end - _LONG) - 1, -1) if _IS_GAP[data[i]]), None)
            if back is None:
                m = _GAP.search(data, end)
                end = m.start() if m else n
            else:
                end = back
        block = data[at:end]
        if len(block) > _BLOCK or (longest := max(map(len, block.split()), default=0)) > _LONG:
            for word in _GAP.split(block):  # a few words of any length
                if word:
                    out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64) if len(word) > _LONG else _hashed(np.frombuffer(word, np.uint8)))
        else:
            out.append(_hashed(np.frombuffer(block, np.uint8)))
        at = end + 1 if end < n and _IS_GAP[data[end]] else end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@functools.cache
def _step(j: int) -> int:
    return pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        h += words[j : j + n] * np.uint64(_step(j))
    h = mix64(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
