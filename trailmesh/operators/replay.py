"""Drawing data of replays: segments, buckets, spatial leaves, route progress, chunk needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import forget, settle
from ..sources.chunks import should_compact
from .joins import range_lookup
from .trace import first_road_event

LEAF = 16384
IN_TASK = 1_000_000  # points of a leaf that one task may rank


def reached_segments(segments: DataFrame, times: DataFrame, total: int, buckets: int = 64) -> DataFrame:
    """Segments (edge, seg, x1, y1, x2, y2) of reached edges with their event and bucket."""
    hit = times.select("edge", first_road_event(F.col("forward"), F.col("backward")).alias("time")).where("time > 0")
    return segments.join(hit, "edge").withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("time") * buckets / total)).cast("int"))


def bounds(segments: DataFrame) -> DataFrame:
    return segments.agg(F.min(F.least("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), F.max(F.greatest("x1", "x2")).alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2"))


def kth_rows(rows: DataFrame, wanted: DataFrame, least: int = 1024, bins: int = 1024) -> DataFrame:
    """(leaf, cut): the k-th smallest (key, id) of each leaf, for rows (leaf, key, id) and wanted (leaf, k).

    All leaves at once, by histograms: each round counts the bins of what is left of a leaf (with partials), keeps the bin that
    holds the k-th, and goes on in its exact bounds, by key and then by id, until at most ``least`` rows are left to be ranked.
    No task sees more of a leaf than its bins.
    """
    item = rows.select("leaf", F.struct(F.col("key").cast("double").alias("key"), F.col("id").alias("id")).alias("r"))
    left = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).join(wanted, "leaf")
    ends = item.groupBy("leaf").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    state = settle(left.join(ends, "leaf").select("leaf", "k", "c", "lo", "hi"))
    while state.where((F.col("c") > least) & (F.col("lo") != F.col("hi"))).take(1):
        inside = item.join(state, "leaf").where((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi")))
        d = lambda e, f: F.col(f"{e}.{f}").cast("double")
        share = lambda f: F.try_divide(d("r", f) - d("lo", f), d("hi", f) - d("lo", f))
        part = F.coalesce(share("key"), share("id"), F.lit(0.0))  # by id where keys are equal
        counted = inside.groupBy("leaf", F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin"), "k").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
        state, before = settle(found.select("leaf", (F.col("k") - F.col("upto") + F.col("c")).alias("k"), "c", "lo", "hi")), state
        forget(before)
    few = item.join(state, "leaf").where((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi")) & (F.col("lo") != F.col("hi")))
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy("leaf").orderBy("r"))).where(F.col("nth") == F.col("k"))
    return ranked.select("leaf", F.col("r").alias("cut")).unionByName(state.where(F.col("lo") == F.col("hi")).select("leaf", F.col("lo").alias("cut")))


def spatial_leaves(points: DataFrame, limit: int = LEAF, levels: int | None = None, in_task: int = IN_TASK) -> DataFrame:
    """Points (id, x, y) with a leaf of at most ``limit``: medians split the wider axis, level by level.

    Which point of several at the median goes left is decided by id. While a leaf has more than ``in_task`` points, medians are selected by
    histograms; smaller leaves are ranked in a window each. Points that agree in place and id may then be on different sides of a median.
    """
    at = points.withColumn("leaf", F.lit(1).cast("long"))
    count = points.count()
    levels = levels if levels is not None else max(0, (max(1, -(-count // limit)) - 1).bit_length())
    for level in range(levels):
        if count > in_task:
            at = before = settle(at) if not level else at
            spans = at.groupBy("leaf").agg(F.count(F.lit(1)).alias("__n"), ((F.max("x") - F.min("x")) >= (F.max("y") - F.min("y"))).alias("__wide"))
            known = at.join(spans, "leaf").withColumn("__k", F.when(F.col("__wide"), F.col("x")).otherwise(F.col("y")).cast("double"))
            cuts = kth_rows(known.where(F.col("__n") > limit).select("leaf", F.col("__k").alias("key"), "id"), spans.where(F.col("__n") > limit).select("leaf", F.floor(F.col("__n") / 2).alias("k")))
            right = F.coalesce((F.struct(F.col("__k").alias("key"), F.col("id").alias("id")) > F.col("cut")).cast("long"), F.lit(0))
            at = known.join(cuts, "leaf", "left").withColumn("leaf", F.col("leaf") * 2 + right).drop("__n", "__wide", "__k", "cut")
            at = settle(at)
            forget(before)
            count = at.groupBy("leaf").count().agg(F.max("count")).first()[0]
            continue
        part = Window.partitionBy("leaf")
        wide = (F.max("x").over(part) - F.min("x").over(part)) >= (F.max("y").over(part) - F.min("y").over(part))
        at = at.withColumns({"__k": F.when(wide, F.col("x")).otherwise(F.col("y")), "__n": F.count(F.lit(1)).over(part)})
        nth = F.row_number().over(part.orderBy("__k", "id"))
        at = at.withColumn("leaf", F.when(F.col("__n") <= limit, F.col("leaf") * 2).otherwise(F.col("leaf") * 2 + F.when(nth <= F.floor(F.col("__n") / 2), 0).otherwise(1))).drop("__k", "__n")
    return at


def bucket_ends(reached: DataFrame, buckets: int = 64) -> DataFrame:
    """leaf, bucket, ends: running number of vertices (two a segment) at the end of each bucket."""
    n = reached.groupBy("leaf", "bucket").agg((F.count(F.lit(1)) * 2).alias("v"))
    return n.withColumn("ends", F.sum("v").over(Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).select("leaf", "bucket", "ends")


def vertex_count(ends: DataFrame, event: int, total: int, buckets: int = 64) -> DataFrame:
    """leaf, vertices to submit at a cursor."""
    now = min(buckets - 1, event * buckets // total)
    return ends.groupBy("leaf").agg(F.coalesce(F.max(F.when(F.col("bucket") <= now, F.col("ends"))), F.lit(0)).alias("vertices"))


def route_progress(route: DataFrame, shapes: DataFrame) -> DataFrame:
    """query_id, n, x1..y2, from_share, to_share: the oriented polyline of a route; segments without length are dropped.

    route: query_id, step, edge, reversed, length; shapes: edge, seg, x1, y1, x2, y2.
    """
    turned = route.join(shapes, "edge")
    swap = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a))
    turned = turned.select("query_id", "step", "length", F.when(F.col("reversed"), -F.col("seg")).otherwise(F.col("seg")).alias("o"), swap("x1", "x2").alias("x1"), swap("y1", "y2").alias("y1"), swap("x2", "x1").alias("x2"), swap("y2", "y1").alias("y2"))
    turned = turned.withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("d > 0")
    edge, order = Window.partitionBy("query_id", "step"), Window.partitionBy("query_id").orderBy("step", "o")
    share = F.col("d") / F.sum("d").over(edge) * F.col("length")
    turned = turned.withColumn("cm", share)
    total = F.sum("cm").over(Window.partitionBy("query_id"))
    upto = F.sum("cm").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return turned.select("query_id", F.row_number().over(order).alias("n"), "x1", "y1", "x2", "y2", ((upto - F.col("cm")) / total).alias("from_share"), (upto / total).alias("to_share"))


def chunks_needed(chunks: DataFrame, reached: DataFrame, route: DataFrame, width: int) -> DataFrame:
    """Chunks (chunk, first, last; null where the layout is unknown) that hold a reached or routed edge.

    Edges and ranges meet in cells of ``width`` edges, best a chunk's usual number.
    """
    edges = reached.select("edge").unionByName(route.select("edge")).distinct()
    known = F.col("first").isNotNull() & F.col("last").isNotNull()
    hit = range_lookup(edges, chunks.where(known), "edge", "first", "last", width).select("chunk").distinct()
    return chunks.where(known).join(hit, "chunk", "left_semi").unionByName(chunks.where(~known))


def compact_rows(reached: DataFrame, total: int, order: str = "edge") -> tuple[DataFrame, bool]:
    """(edge, row) of reached edges, and whether the compact form pays (``should_compact``)."""
    from ..plans.ids import numbered

    rows = reached.select(order).distinct()
    n = rows.count()
    pays = rows.sparkSession.range(1).select(should_compact(F.lit(total).cast("long"), F.lit(n).cast("long"))).first()[0]
    return numbered(rows, [order], "row"), pays


def texture_bytes(rows: Column, width: int = 4096, per: int = 8) -> Column:
    return F.ceil(rows / width) * width * per


def meeting_flash(cursors: DataFrame, meeting: int, *by: str) -> DataFrame:
    """Cursor rows (t, cursor, playing) of each viewer (``by``) at which the meeting event is passed forwards while playing."""
    before = F.lag("cursor").over(Window.partitionBy(*by).orderBy("t"))
    return cursors.withColumn("before", before).where((F.col("before") < meeting) & (F.col("cursor") >= meeting) & F.col("playing"))
