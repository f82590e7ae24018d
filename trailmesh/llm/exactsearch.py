"""Operator 13: exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, _trim
from .vectors import integer_vectors, spread

#: Rows that pivots are fitted on, and how many pivots; annuli of a pivot.
SAMPLE, PIVOTS, ANNULI = 4096, 64, 64
#: Rows of a block, which one task holds, and the queries that it meets at most.
BLOCK, QUERIES = 16_384, 131_072
#: Annuli that a query visits in its first round; each later round takes so many times more.
FIRST, MORE = 4, 8
#: Queries whose scores with a block are made at once.
TOGETHER = 256
#: Distances are rounded numbers; bounds give way by this share of them.
SLACK = 1e-9
NO_ID = np.iinfo(np.int64).max


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample, rounded to integers: farthest-first starts, then rounds of means."""
    x = sample.astype(np.float64)
    chosen, apart = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(x)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen]
    for _ in range(rounds):
        near = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1) if len(x) * centres.size < 1 << 24 else np.concatenate([((b[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1) for b in np.array_split(x, len(x) // 256 + 1)])
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = x[near == k].mean(0)
    return np.unique(np.rint(centres).astype(np.int64), axis=0)


def squared_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x pivots) of integer vectors."""
    return np.einsum("ij,ij->i", v, v)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * _inner(v, pivots)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where all sums are whole numbers below 2**53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b.T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _keyed(batches: Iterator[pa.RecordBatch], pivots, width: int) -> Iterator[pa.RecordBatch]:
    try:
        for b in batches:
            v = _matrix(b.column("v"), width)
            d = squared_distances(v, pivots.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array(np.einsum("ij,ij->i", v, v))], [*b.schema.names, "pivot", "d2", "norm"])
    finally:
        _trim()


class PivotIndex:
    """Every row under its nearest pivot, in annuli of ascending distance to it, in blocks of bounded size.

    Pivots are fitted on at most SAMPLE rows (those of the smallest hashes of their ids); all rows
    are keyed. A pivot's annuli are cut at approximate quantiles of its distances, so there are
    PIVOTS x ANNULI at most, whatever the input; each annulus knows its exact least and greatest
    distance and its greatest norm. Neighbouring annuli share a block of up to BLOCK rows; an annulus
    with more is dealt to several.
    """

    def __init__(self, work: Workspace, rows: DataFrame, width: int, block: int = BLOCK, pivots: int = PIVOTS, annuli: int = ANNULI):
        spark = self.spark = work.spark
        self.work, self.width = work, width
        sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
        self.pivots = fit_pivots(np.array([r["v"] for r in sample], np.int64).reshape(len(sample), width), pivots) if sample else np.zeros((0, width), np.int64)
        shared = spark.sparkContext.broadcast(self.pivots)
        self.annuli: list = []
        if not sample:
            return
        keyed = work.write(rows.mapInArrow(partial(_keyed, pivots=shared, width=width), "id long, v array<int>, pivot int, d2 long, norm long"), "keyed")
        cut = keyed.groupBy("pivot").agg(F.percentile_approx("d2", [k / annuli for k in range(1, annuli)], 10_000).alias("cuts"))
        ring = F.size(F.filter("cuts", lambda c: c < F.col("d2")))
        ringed = keyed.join(F.broadcast(cut), "pivot").select("id", "v", "d2", "norm", "pivot", (F.col("pivot") * annuli + ring).alias("annulus"))
        #: At most PIVOTS x ANNULI rows, so they fit on the driver and into a broadcast.
        self.annuli = ringed.groupBy("annulus", "pivot").agg(F.min("d2").alias("least"), F.max("d2").alias("most"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).orderBy("annulus").collect()
        at, filled, plan = 0, 0, []
        for a in self.annuli:
            if filled and filled + a["n"] > block:
                at, filled = at + 1, 0
            chunks = max(1, math.ceil(a["n"] / block))
            plan.append((a["annulus"], at, chunks))
            filled += a["n"]
            if chunks > 1:
                at, filled = at + chunks, 0
        self.first_block, self.chunks = np.array([p[1] for p in plan]), np.array([p[2] for p in plan])
        placed = spark.createDataFrame([(int(a), int(f), int(c)) for a, f, c in plan], "annulus int, first int, chunks int")
        chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("chunks"))
        self.rows = work.write(ringed.join(F.broadcast(placed), "annulus").select((F.col("first") + chunk).cast("int").alias("block"), "annulus", "id", "v"), "placed")
        work.drop("keyed")

    def bounds(self) -> tuple[np.ndarray, ...]:
        """(pivot, least and greatest distance, greatest norm) of each annulus."""
        pick = lambda name: np.array([a[name] for a in self.annuli], np.int64)
        return pick("pivot"), np.sqrt(pick("least")), np.sqrt(pick("most")), pick("norm")


def greatest_scores(v: np.ndarray, pivots: np.ndarray, bounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Upper bounds (queries x annuli) of inner products, by the triangle inequality.

    A row of the annulus is apart from the query by |distance of the query to the pivot - distance of
    the row to it| at least, and by half of what its pivot is farther from the query than the
    nearest one; and 2 q.v = |q|^2 + |v|^2 - |q - v|^2.
    """
    pivot, least, most, norm = bounds
    to = np.sqrt(squared_distances(v, pivots).astype(np.float64))
    q = to[:, pivot]
    gap = np.maximum(np.maximum(q - most, least - q), (q - to.min(1)[:, None]) / 2)
    gap = np.maximum(gap - SLACK * (q + most + 1), 0)
    return (np.einsum("ij,ij->i", v, v)[:, None] + norm[None, :] - gap * gap) / 2 + 0.5


def _plan(batches: Iterator[pa.RecordBatch], shared, width: int, chosen: int, upto: int | None) -> Iterator[pa.RecordBatch]:
    """For each query the blocks that hold its next annuli, by descending bound, while a bound reaches its k-th score."""
    pivots, bounds, first, chunks, number = shared.value
    try:
        for b in batches:
            out = {"block": [], "id": [], "v": [], "floor": [], "annuli": []}
            v, floor = _matrix(b.column("v"), width), b.column("floor").to_pylist()
            reach = greatest_scores(v, pivots, bounds)
            order = np.argsort(-reach, axis=1, kind="stable")
            for i, (who, f) in enumerate(zip(b.column("id").to_pylist(), floor, strict=True)):
                mine = order[i, chosen:upto]
                if f is not None:
                    mine = mine[reach[i, mine] >= f]
                by: dict[int, list[int]] = {}
                for a in np.sort(mine).tolist():
                    for c in range(chunks[a]):
                        by.setdefault(int(first[a] + c), []).append(int(number[a]))
                for block, annuli in by.items():
                    for name, x in zip(out, (block, who, v[i], f, annuli), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), pa.array(out["id"], pa.int64()), pa.array(out["v"], pa.list_(pa.int32())), pa.array(out["floor"], pa.int64()), pa.array(out["annuli"], pa.list_(pa.int32()))], list(out))
    finally:
        _trim()


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, ties to smaller ids."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _met(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """A block's rows come first and are held; its queries follow, in batches, and meet their annuli."""
    block, held, ready = None, [], None
    try:
        for b in batches:
            of, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(of)] if len(of) else [0]
            out = {"id": [], "found": [], "score": []}
            for s, e in zip(edges, edges[1:], strict=False):
                if of[s] != block:
                    block, held, ready = of[s], [], None
                part = b.slice(s, e - s)
                if not asks[s]:
                    held.append(part)
                    continue
                if ready is None:
                    v = np.concatenate([_matrix(h.column("v"), width) for h in held]) if held else np.zeros((0, width), np.int64)
                    ids = np.concatenate([_ids(h.column("id")) for h in held]) if held else np.zeros(0, np.int64)
                    ring = np.concatenate([h.column("annuli").flatten().to_numpy() for h in held]) if held else np.zeros(0, np.int32)
                    order = np.argsort(ring, kind="stable")
                    held, ready = [], (v[order], ids[order], ring[order])
                v, ids, ring = ready
                asked, names, wanted, floors = _matrix(part.column("v"), width), part.column("id").to_numpy(), part.column("annuli").to_pylist(), part.column("floor").to_pylist()
                for a in range(0, len(names), TOGETHER):
                    here = np.flatnonzero(np.isin(ring, np.unique(np.concatenate(wanted[a : a + TOGETHER]))))
                    near, near_ids = ring[here], ids[here]
                    for i, score in enumerate(_inner(asked[a : a + TOGETHER], v[here]), a):
                        lo, hi = np.searchsorted(near, wanted[i], "left"), np.searchsorted(near, wanted[i], "right")
                        at = np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True)])
                        at = at[near_ids[at] != names[i]]
                        if floors[i] is not None:
                            at = at[score[at] >= floors[i]]
                        at = at[_best(score[at], near_ids[at], k)]
                        out["id"] += [names[i]] * len(at)
                        out["found"] += near_ids[at].tolist()
                        out["score"] += score[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array([None if x == NO_ID else x for x in out["found"]], pa.int64()), pa.array(out["score"], pa.int64())], list(out))
    finally:
        _trim()


def top_k(rows: DataFrame, queries=None, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS, annuli: int = ANNULI, queries_a_task: int = QUERIES) -> DataFrame:
    """query_id, rank, id, score: the k rows of the highest integer inner product with each query, ties to smaller ids.

    ``queries`` is a condition on the id column under its name ``id`` (all rows if None). A component x is the
    integer floor(scale * x). Rows whose vector is null or holds null or non-finite components take
    no part; vectors of unequal length are filled with zeros at their end. A query's candidates are all rows of
    other ids: repeated rows count each, a row of null id is a candidate after all others
    that tie with it, and asks nothing. Of a query id with several vectors the smallest asks. Other columns aren't read,
    whatever they are called. An empty table gives an empty one.

    Rounds: each query visits its annuli by descending upper bound, FIRST of them, then MORE times
    as many, and stops when no bound reaches its k-th score. A round deals queries to the blocks that they need;
    a task holds one block's rows and lets its queries pass in batches.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "search")
    found, width = integer_vectors(rows, scale, 1, id, vector)
    vectors = work.write(spread(found.select("id", "v")), "vectors")
    index = PivotIndex(work, vectors, width, block, pivots, annuli)
    empty = f"query_id long, rank int, {id} long, score long"
    if not index.annuli:
        return spark.createDataFrame([], empty)
    asking = vectors.where(F.col("id").isNotNull() if queries is None else queries & F.col("id").isNotNull())
    asking = work.write(asking.groupBy("id").agg(F.min("v").alias("v")), "queries")
    shares = max(1, math.ceil(asking.count() / queries_a_task))
    number = np.array([a["annulus"] for a in index.annuli])
    shared = spark.sparkContext.broadcast((index.pivots, index.bounds(), index.first_block, index.chunks, number))
    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")
    data = index.rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("long").alias("floor"), F.array("annulus").alias("annuli"))
    state, step, chosen, best = asking.withColumn("floor", F.lit(None).cast("long")), FIRST, 0, None
    ranked = Window.partitionBy("id").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    while chosen < len(number):
        upto = chosen + step
        plan = partial(_plan, shared=shared, width=width, chosen=chosen, upto=upto)
        wanted = state.mapInArrow(plan, "block int, id long, v array<int>, floor long, annuli array<int>")
        wanted = work.write(wanted.select("block", share.alias("share"), F.lit(True).alias("asks"), "id", "v", "floor", "annuli"), f"wanted{chosen}")
        if not wanted.take(1):
            break
        needed = data.join(wanted.select("block", "share").distinct(), ["block", "share"], "left_semi")
        met = needed.unionByName(wanted).withColumn("block", F.col("block") * shares + F.col("share")).drop("share")
        met = met.repartition("block").sortWithinPartitions("block", "asks")
        hits = met.mapInArrow(partial(_met, width=width, k=k), "id long, found long, score long")
        hits = hits if best is None else hits.unionByName(best)
        best = work.write(hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), f"best{chosen}").drop("rank")
        known = best.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        state, chosen, step = asking.join(known, "id", "left").select("id", "v", "floor"), upto, step * MORE
    return best.select(F.col("id").alias("query_id"), F.row_number().over(ranked).cast("int").alias("rank"), F.col("found").alias(id), "score")
