"""Operator 11: for each row, the rows of a smaller slot and a strictly larger level."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, _trim, quoted

#: Rows of a range, which one task sweeps: about 40 bytes each.
ROWS = 1_000_000
#: Rows that are asked together; they are compared with each other directly.
TOGETHER = 256


def slot_of(at: Column, kind: str, seconds: int = 60) -> Column:
    """floor(whole seconds since 1970 / seconds) of a timestamp; one without a zone is taken as UTC in any session zone."""
    if kind == "timestamp":
        whole = F.unix_seconds(at)
    else:
        whole = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.floor(whole / F.lit(seconds)).cast("long") if seconds != 1 else whole


def level_of(value: Column, step: int = 1) -> Column:
    """floor(floor(100 * value + 0.5) / step) in double arithmetic; null if the value is null or not finite."""
    known = F.when(~F.isnan(value) & (F.abs(value) < F.lit(9e16)), value)
    return F.floor(F.floor(known * 100.0 + 0.5) / F.lit(float(step))).cast("long")


def earlier_smaller(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, the sums of ``values`` (n x c) over the rows before it whose key is smaller.

    A Fenwick tree over the ranks of the keys holds the rows of earlier blocks; rows of one
    block are compared with each other. O(n log n) and vectorised.
    """
    out = np.zeros(values.shape, np.int64)
    distinct, rank = np.unique(key, return_inverse=True)
    tree = np.zeros((len(distinct) + 1, values.shape[1]), np.int64)
    for a in range(0, len(key), TOGETHER):
        r, v, acc = rank[a : a + TOGETHER], values[a : a + TOGETHER], out[a : a + TOGETHER]
        at = r.copy()  # ranks below r are the tree's first r places
        while at.any():
            acc += tree[at]
            at &= at - 1
        acc += np.tril(r[None, :] < r[:, None], -1) @ v
        at, v = r + 1, v
        while len(at):
            np.add.at(tree, at, v)
            at = at + (at & -at)
            inside = at <= len(distinct)
            at, v = at[inside], v[inside]
    return out


def _swept(df: DataFrame, key: str, values: tuple[str, str], made: tuple[str, str]) -> DataFrame:
    """Add to the rows of each sorted partition the sums of ``values`` over its earlier rows of a smaller key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        try:
            read = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            sums, at = earlier_smaller(read(key), np.stack([read(v) for v in values], 1)), 0
            for b in held:
                part = sums[at : at + b.num_rows]
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part[:, 0]), pa.array(part[:, 1])], [*b.schema.names, *made])
        finally:
            _trim()

    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {made[0]} long, {made[1]} long")


def _dealt(df: DataFrame, ranges: int, order: list[Column], name: str) -> DataFrame:
    """The rows in so many ranges of the order, sorted in each, with the range's number."""
    return df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id())


def dominance_counts(rows: DataFrame, slot: Column, level: Column, weight: Column, id: str = "sale_id", rows_a_task: int = ROWS) -> DataFrame:
    """id, slot, level, n_above, weight_above: how many rows have a smaller slot and a strictly larger level, and their weights' sum.

    Rows are dealt by ranges of descending level, and of descending slot within a level, so that
    rows of an equal level that come earlier have no smaller slot: they can't be counted, as if
    they were inserted after querying, and a level with any number of rows is split among tasks.
    A task sweeps its range with a Fenwick tree over slots. To that come the cumulative slot
    histograms of the higher ranges: the histogram (range, slot) is dealt by ranges of slots,
    each swept over range numbers, and what lies in both a higher range and an earlier slot
    range is a two-dimensional running sum over the grid of their totals. No task sees more
    than its range or one line of the grid; nothing goes to the driver but counts.

    Rows of a null slot or level are above none and get null counts. A null weight counts as 0.
    Repeated rows count each and come back each; rows that tie in slot and level get equal
    counts. A null id passes. An empty table gives an empty one. Other columns aren't read,
    whatever they are called.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "dominance")
    asked = rows.select(rows[quoted(id)].alias("id"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight.cast("long"), F.lit(0)).alias("weight"))
    points = asked.where("slot IS NOT NULL AND level IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, math.ceil(points.count() / rows_a_task))
    dealt = _dealt(points, ranges, [F.desc("level"), F.desc("slot"), F.col("row")], "range").drop("row").withColumn("one", F.lit(1).cast("long"))
    inside = work.write(_swept(dealt, "slot", ("one", "weight"), ("n_in", "w_in")).drop("one"), "inside")

    slots = inside.groupBy("range", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    dealt = _dealt(slots, ranges, [F.col("slot"), F.desc("range")], "block")
    beside = work.write(_swept(dealt, "range", ("n", "w"), ("n_beside", "w_beside")), "beside")

    size = beside.agg(F.coalesce(F.max("range") + 1, F.lit(0)).alias("r"), F.coalesce(F.max("block") + 1, F.lit(0)).alias("b")).first()
    grid = spark.range(size["r"] * size["b"]).select(F.floor(F.col("id") / F.lit(max(1, size["b"]))).cast("int").alias("range"), (F.col("id") % F.lit(max(1, size["b"]))).cast("int").alias("block"))
    totals = beside.groupBy("range", "block").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    before = lambda by, order: Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = grid.join(totals, ["range", "block"], "left")
    for by, order in (("range", "block"), ("block", "range")):
        known = known.select("range", "block", *(F.coalesce(F.sum(c).over(before(by, order)), F.lit(0)).alias(c) for c in ("n", "w")))
    corner = known.select("range", "block", F.col("n").alias("n_corner"), F.col("w").alias("w_corner"))
    higher = beside.join(corner, ["range", "block"]).select("range", "slot", (F.col("n_beside") + F.col("n_corner")).alias("n_higher"), (F.col("w_beside") + F.col("w_corner")).alias("w_higher"))
    counted = inside.join(higher, ["range", "slot"]).select("id", "slot", "level", (F.col("n_in") + F.col("n_higher")).alias("n_above"), (F.col("w_in") + F.col("w_higher")).alias("weight_above"))
    nothing = asked.where("slot IS NULL OR level IS NULL").select("id", "slot", "level", F.lit(None).cast("long").alias("n_above"), F.lit(None).cast("long").alias("weight_above"))
    return counted.unionByName(nothing).withColumnRenamed("id", id)
