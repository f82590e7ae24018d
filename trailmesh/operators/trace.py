"""Event logs: counters, checkpoints, first events, current nodes, buckets, packing, archive, digest.

An event log has ``event`` (1-based), ``kind`` (0 settle, 1 examine, 2 improve, 3 return) and ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digest import chunk_hashes, folded, proofs, tree
from ..model import CHECKPOINT
from ..plans.fixpoint import forget, settle

KINDS = (("settled", 0), ("examined", 1), ("improved", 2))
BLOCK_EVENTS = 2_097_152  # 8 MiB of four-byte words
BLOCK = 65_536  # events of a log that a task sorts


def _count(kind: int) -> Column:
    return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("long")


def counters(trace: DataFrame, *by: str) -> DataFrame:
    return trace.groupBy(*by).agg(*(_count(k).alias(n) for n, k in KINDS))


def counts_at(trace: DataFrame, share: float, total: int) -> DataFrame:
    """Counters of the first floor(share * total) events; the filter reaches the scan."""
    return counters(trace.where(F.col("event") <= int(share * total)))


def checkpoints(trace: DataFrame, stride: int = CHECKPOINT) -> DataFrame:
    """block, events, settled, examined, improved: running counters at the end of every block.

    Partial counts of each block, then a running sum over blocks (one row each).
    """
    blocks = trace.groupBy(F.floor((F.col("event") - 1) / stride).alias("block")).agg(F.count(F.lit(1)).alias("events"), *(_count(k).alias(n) for n, k in KINDS))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("block", *(F.sum(c).over(w).alias(c) for c in ("events", *(n for n, _ in KINDS))))


def seek(trace: DataFrame, marks: DataFrame, cursor: int, stride: int = CHECKPOINT) -> DataFrame:
    """Counters after ``cursor`` events: the last whole block's checkpoint and the rest of one block."""
    whole = cursor // stride
    before = marks.where(F.col("block") == whole - 1).select(*(n for n, _ in KINDS))
    tail = counters(trace.where((F.col("event") > whole * stride) & (F.col("event") <= cursor)))
    both = before.unionByName(tail)
    return both.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n, _ in KINDS))


def first_events(trace: DataFrame, *by: str) -> DataFrame:
    """For each id (and ``by``) the first examination and improvement, 0 for never."""
    first = lambda k: F.coalesce(F.min(F.when(F.col("kind") == k, F.col("event"))), F.lit(0)).cast("long")
    return trace.where("kind IN (1, 2)").groupBy("id", *by).agg(first(1).alias("first_examined"), first(2).alias("first_improved"))


def first_road_event(forward: Column, backward: Column) -> Column:
    """The earlier of two times of which 0 means never."""
    return F.coalesce(F.least(F.nullif(forward, F.lit(0)), F.nullif(backward, F.lit(0))), F.lit(0))


def current_settled(trace: DataFrame, *by: str) -> DataFrame:
    """Every event with the node that is settled when it happens and the last examined id."""
    block = F.floor((F.col("event") - 1) / BLOCK)
    rows = trace.withColumn("__block", block)
    known = lambda k: F.max(F.when(F.col("kind") == k, F.struct("event", "id")))
    # a task sorts one block of a log; what was last before it comes from a row a block
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "__block").agg(known(0).alias("__0"), known(1).alias("__1"))
    ends = ends.select(*by, "__block", *(F.max(f"__{k}").over(before)["id"].alias(f"__before{k}") for k in (0, 1)))
    w = Window.partitionBy(*by, "__block").orderBy("event").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.coalesce(F.last(F.when(F.col("kind") == k, F.col("id")), ignorenulls=True).over(w), F.col(f"__before{k}"))
    met = rows.join(ends, [*by, "__block"], "left").withColumns({"settled_node": last(0), "last_examined": last(1)})
    return met.drop("__block", "__before0", "__before1").select(*trace.columns, "settled_node", "last_examined")


def trace_violations(trace: DataFrame, arcs: DataFrame) -> DataFrame:
    """Events of one-front traces that break its invariants (for the backward front, an arc's destination is current)."""
    at = current_settled(trace, "query_id", "side")
    named = at.join(arcs.select(F.col("arc"), "src", "dst"), (F.col("id") == F.col("arc")) & F.col("kind").isin(1, 2), "left")
    own = F.when(F.col("side") == 0, F.col("src")).otherwise(F.col("dst"))
    wrong = named.where(((F.col("kind") == 1) & ~own.eqNullSafe(F.col("settled_node"))) | ((F.col("kind") == 2) & ~F.col("id").eqNullSafe(F.col("last_examined"))))
    twice = trace.where("kind = 0").groupBy("query_id", "side", "id").agg(F.count(F.lit(1)).alias("n"), F.max("event").alias("event")).where("n > 1")
    return wrong.select("query_id", "event", F.lit("order").alias("why")).unionByName(twice.select("query_id", "event", F.lit("settled twice").alias("why")))


def replay_buckets(times: DataFrame, total: int, buckets: int = 64) -> DataFrame:
    """bucket, n, reached: histogram of event times over equal parts of the log and its running sum."""
    b = F.least(F.lit(buckets - 1), F.floor(F.col("time") * buckets / total)).cast("int")
    n = times.where("time > 0").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = times.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(F.broadcast(n), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return full.withColumn("reached", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def pack_kinds(trace: DataFrame) -> DataFrame:
    """byte, packed: four two-bit kinds in a byte, the first lowest."""
    i = F.col("event") - 1
    return trace.groupBy(F.floor(i / 4).alias("byte")).agg(F.sum(F.shiftleft(F.col("kind").cast("long"), 0) * F.pow(F.lit(4), i % 4).cast("long")).cast("int").alias("packed"))


def unpack_kinds(packed: DataFrame, total: int) -> DataFrame:
    rows = packed.select((F.col("byte") * 4).alias("base"), "packed", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    kind = F.floor(F.col("packed") / F.pow(F.lit(4), F.col("k"))).cast("int").bitwiseAND(3)
    return rows.select((F.col("base") + F.col("k") + 1).alias("event"), kind.alias("kind")).where(F.col("event") <= total)


def digest(trace: DataFrame, block: int = 65536) -> DataFrame:
    """query_id, digest: SHA-256 over the hashes of blocks of words, in order; no group holds a whole log."""
    blocks = trace.groupBy("query_id", F.floor((F.col("event") - 1) / block).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event", "word"))), lambda x: x["word"].cast("string")), ",").cast("binary"), 256).alias("h"))
    return blocks.groupBy("query_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",").cast("binary"), 256).alias("digest"))


class TraceArchive:
    """Words in Parquet by block; blocks first, then a catalogue with each one's hash and proof: without it nothing is committed.

    A block's hash is that of its pages of CHECKPOINT events in order, and blocks are the leaves of a hash tree for each
    log, so one block is verified alone against its log's root.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK_EVENTS):
        self.spark, self.path, self.block = spark, path, block

    def _hashes(self, rows: DataFrame) -> DataFrame:
        return chunk_hashes(rows, ["query_id"], F.floor((F.col("event") - 1) / self.block), "event", ["word"], F.floor((F.col("event") - 1) / CHECKPOINT))

    def write(self, trace: DataFrame) -> None:
        rows = trace.select("query_id", "event", "word", F.floor((F.col("event") - 1) / self.block).alias("block"))
        rows.repartition("query_id", "block").sortWithinPartitions("event").write.partitionBy("query_id", "block").mode("errorifexists").parquet(f"{self.path}/blocks")
        hashes = settle(self._hashes(self._blocks()))
        proven = hashes.join(proofs(tree(hashes, ["query_id"]), ["query_id"]), ["query_id", "chunk"])
        proven.select("query_id", F.col("chunk").alias("block"), F.col("rows").alias("events"), "hash", "path", "root").write.mode("errorifexists").parquet(f"{self.path}/catalogue")
        forget(hashes)

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema("event long, word long, query_id long, block long").parquet(f"{self.path}/blocks")

    def _kept(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/catalogue")

    def roots(self) -> DataFrame:
        """query_id, root of every log: what a reader keeps to verify any block later."""
        return self._kept().groupBy("query_id").agg(F.min("root").alias("root"))

    def read(self, query_id: int, block: int, root: str | None = None) -> DataFrame:
        """One block, after its hash and its proof lead to the log's root (``root``, if given); only its folder is scanned."""
        rows = self._blocks().where((F.col("query_id") == query_id) & (F.col("block") == block))
        kept = self._kept().where((F.col("query_id") == query_id) & (F.col("block") == block))
        met = self._hashes(rows).join(kept.drop("hash"), (F.col("chunk") == F.col("block")) & (F.col("rows") == F.col("events")))
        led = met.where(folded(F.col("hash"), F.col("path")) == (F.lit(root) if root else F.col("root")))
        if not led.take(1):
            raise ValueError(f"block {block} of {query_id} is damaged or not committed")
        return rows.orderBy("event")

    def violations(self) -> DataFrame:
        """Blocks (query_id, block, events, hash) that are only stored or only listed as they are, or whose proof leads elsewhere."""
        kept = self._kept()
        found = self._hashes(self._blocks()).select("query_id", F.col("chunk").alias("block"), F.col("rows").alias("events"), "hash")
        listed = kept.select("query_id", "block", "events", "hash")
        astray = kept.where(~folded(F.col("hash"), F.col("path")).eqNullSafe(F.col("root"))).select("query_id", "block", "events", "hash")
        return found.exceptAll(listed).unionByName(listed.exceptAll(found)).unionByName(astray)


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Values at floor(share * n) (0-based) of each sorted group: not interpolated."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(value)) - 1, "__n": F.count(F.lit(1)).over(w)})
    at = lambda s: F.max(F.when(F.col("__i") == F.least(F.floor(F.col("__n") * s), F.col("__n") - 1), F.col(value)))
    return ranked.groupBy(*by).agg(*(at(s).alias(n) for n, s in shares.items()))
