"""Operator 12: vectors as codes of codebook entries, one codebook for each part of a vector."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, _trim
from .vectors import integer_vectors, spread

#: Entries of a leaf, which are all compared.
LEAF = 16
#: Labels whose sums are broadcast (some 40 bytes each); beyond, the join shuffles.
BROADCAST_LABELS = 50_000


class KdTree:
    """The entries of a codebook, split at the median of their widest dimension; each node knows its box."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.entries = entries if index is None else entries[index]
        self.index = np.arange(len(entries)) if index is None else index
        self.low, self.high = self.entries.min(0), self.entries.max(0)
        self.children: list[KdTree] = []
        if len(self.index) > LEAF and (self.high > self.low).any():
            order = np.argsort(self.entries[:, int(np.argmax(self.high - self.low))], kind="stable")
            half = len(order) // 2
            self.children = [KdTree(entries, np.sort(self.index[o])) for o in (order[:half], order[half:])]

    def bound(self, points: np.ndarray) -> np.ndarray:
        """Squared distances to the box: no entry of the node is nearer."""
        gap = np.maximum(np.maximum(self.low - points, points - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) nearest to each point; the lowest entry of those that are equally near."""
        entry, best = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), np.iinfo(np.int64).max)
        self._search(points, np.arange(len(points)), entry, best)
        return entry, best

    def _search(self, points: np.ndarray, who: np.ndarray, entry: np.ndarray, best: np.ndarray) -> None:
        if not len(who):
            return
        if not self.children:
            apart = points[who][:, None, :] - self.entries[None, :, :]
            d = np.einsum("ijk,ijk->ij", apart, apart)
            k = d.argmin(1)  # the first of equals, and a leaf's entries ascend
            d, e = d[np.arange(len(who)), k], self.index[k]
            better = (d < best[who]) | (d == best[who]) & (e < entry[who])
            best[who[better]], entry[who[better]] = d[better], e[better]
            return
        one, two = self.children
        a, b = one.bound(points[who]), two.bound(points[who])
        first = a <= b
        for child, bound, mine in ((one, a, first), (two, b, ~first), (two, b, first), (one, a, ~first)):
            # an equal bound is visited too: a lower entry may be as near
            go = mine & (bound <= best[who])
            child._search(points, who[go], entry, best)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(trees: list[KdTree], v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tree.nearest(part) for tree, part in zip(trees, np.split(v, len(trees), axis=1), strict=True)]


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s): how many parts have the entry nearest, and their sums by position."""
    spark = vectors.sparkSession
    shared, (parts, size, width) = spark.sparkContext.broadcast(books), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [KdTree(book) for book in shared.value]
        n, s = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        try:
            for b in batches:
                v = _matrix(b.column("v"), parts * width)
                for p, (entry, _) in enumerate(_assigned(trees, v)):
                    np.add.at(s[p], entry, v[:, p * width : (p + 1) * width])
                    n[p] += np.bincount(entry, minlength=size)
        finally:
            _trim()
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "s": pa.array(list(s[p, e]), pa.list_(pa.int64()))})

    found = vectors.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(width))).alias("s"))


def learn_codebooks(vectors: DataFrame, width: int, parts: int = 4, size: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks (parts x entries x width of a part) from the ``size`` smallest ids and rounds of nearest assignment.

    ``vectors`` has (id, v) with integer components. Ids that tie are ordered by their vector, null
    ids come last. What goes to the driver and to the tasks is the codebooks and their entries' sums,
    whose size depends on the parameters alone.
    """
    first = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(size).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        if not books.size:
            break
        for r in _sums(vectors, books).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["s"]]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with ``code`` (two hex digits a part, in their order) and ``error`` (squared distances, summed) instead of v."""
    spark = vectors.sparkSession
    shared, (parts, size, width) = spark.sparkContext.broadcast(books), books.shape
    digits = max(2, len(f"{max(0, size - 1):x}"))
    keep = [f for f in vectors.schema.fields if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [KdTree(book) for book in shared.value]
        try:
            for b in batches:
                found = _assigned(trees, _matrix(b.column("v"), parts * width))
                code = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(entry.tolist() for entry, _ in found), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], [*(f.name for f in keep), "code", "error"])
        finally:
            _trim()

    return vectors.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "code string", "error long"]))


def compress(rows: DataFrame, scale: int = 1024, parts: int = 4, size: int = 256, rounds: int = 4, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every usable vector.

    A component x is the integer floor(scale * x); parts are equal and consecutive. Rows whose
    vector is null or holds null or non-finite components are left out. Vectors of unequal
    length are filled with zeros at their end; fewer rows than ``size`` make smaller codebooks.
    Repeated rows are encoded each and count each in the sums; null ids and null labels pass
    (null labels are summed together). An empty table gives an empty one. Other columns aren't
    read, whatever they are called.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "codes")
    found, width = integer_vectors(rows, scale, parts, id, vector, {label: "label"})
    vectors = work.write(spread(found), "vectors")
    books = learn_codebooks(vectors, width, parts, size, rounds)
    if not books.size:
        return spark.createDataFrame([], f"{id} long, code string, error long, label_error long, codebooks_sha256 string")
    coded = work.write(encode(vectors, books), "coded")
    sums = work.write(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "sums")
    both = coded.join(F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums, coded["label"].eqNullSafe(sums["of"]))
    return both.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
