"""Queries: published graphs, verified logs, logs and phases as streams, observed loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import digest, tables
from ..functions.bits import pack_word
from ..shipping import shared_folder
from ..sources import chunksource, store
from ..sources.tables import GRAPH_SQL, TRACE_SQL, edges, events_trace, nodes, table
from ..streaming import log_source, phases
from ..streaming.replay import stream_blocks
from .registry import query

BLOCK = 256
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a streaming query until it has taken all there is."""
    q = writer.option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@query(f"""WITH {GRAPH_SQL} SELECT 'node' AS kind, node AS id, x::BIGINT AS a, y::BIGINT AS b, osm_id AS c FROM nodes
UNION ALL SELECT 'edge', edge, u, v, length_cm * 1000 + direction * 100 + category FROM edges""")
def published_graph(spark, sf_dir):
    """The graph published in verified chunks, loaded again with every chunk, identity and edge checked."""
    path = _folder(spark, "graph")
    m = store.publish(nodes(spark, sf_dir), edges(spark, sf_dir), path)
    n, e, _ = store.load_graph(spark, path, m["identity"])
    of_nodes = n.select(F.lit("node").alias("kind"), F.col("node").alias("id"), F.col("x").cast("long").alias("a"), F.col("y").cast("long").alias("b"), F.col("osm_id").alias("c"))
    return of_nodes.unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge").alias("id"), F.col("u").alias("a"), F.col("v").alias("b"), (F.col("length_cm") * 1000 + F.col("direction") * 100 + F.col("category")).alias("c")))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT n_nationkey FROM nation) AND o_orderstatus = 'F'")
def filtered_orders(spark, sf_dir):
    """Finished orders of some customers from verified chunks; tasks ask the chunks' filters before they open them."""
    path = _folder(spark, "orders")
    chunksource.write_chunked(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_orderkey", 65_536, ["o_custkey", "o_orderstatus"])
    asked = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # the search's own values
    return chunksource.read_chunked(spark, path, where=[("o_custkey", "in", asked), ("o_orderstatus", "=", "F")])


@query(f"WITH {TRACE_SQL} SELECT block, event - block * {BLOCK} AS event, kind, id, (event % 2)::INTEGER AS side FROM (SELECT (event - 1) // {BLOCK} AS block, * FROM trace)")
def sql_word_events(spark, sf_dir):
    """The event log packed into words, an array a block, and unpacked again by a table function in SQL alone."""
    tables.register(spark)
    log = events_trace(spark, sf_dir).withColumn("word", pack_word("kind", "id", F.col("event") % 2)).withColumn("block", F.floor((F.col("event") - 1) / BLOCK))
    words = log.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("event", "word"))), lambda w: w["word"]).alias("words"))
    return spark.sql("SELECT block, event, kind, id, side FROM word_events(TABLE(SELECT * FROM {words}), 'words')", words=words)


@query(f"""WITH {GRAPH_SQL}, p AS (SELECT node // 10 AS road, node, x, y FROM nodes)
SELECT road, seg, x1, y1, x2, y2 FROM (SELECT road, row_number() OVER w - 1 AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY road ORDER BY node)) WHERE x2 IS NOT NULL""")
def sql_shape_segments(spark, sf_dir):
    """Segments between the points of each ten nodes' road, by a table function over partitions in SQL alone."""
    tables.register(spark)
    points = nodes(spark, sf_dir).withColumn("road", F.floor(F.col("node") / 10))
    return spark.sql("SELECT * FROM shape_segments(TABLE(SELECT road, node, x, y FROM {points}) PARTITION BY (road) ORDER BY (node), 'road')", points=points)


_JSON = """'{"event":' || event || ',"kind":' || kind || ',"id":' || id || '}'"""


@query(f"""WITH RECURSIVE {TRACE_SQL}, b AS (SELECT (event - 1) // {BLOCK} AS block, count(*) AS events, sha256(string_agg(sha256({_JSON}), '' ORDER BY event)) AS hash FROM trace GROUP BY 1),
up AS (SELECT list(hash ORDER BY block) AS l FROM b UNION ALL SELECT list_transform(range(0, len(l), {digest.FAN}), lambda i: sha256(array_to_string(l[i + 1:i + {digest.FAN}], ''))) FROM up WHERE len(l) > 1)
SELECT block, events, hash, (SELECT l[1] FROM up WHERE len(l) = 1) AS root, true AS proven FROM b""")
def trace_proofs(spark, sf_dir):
    """Every block of the event log with its hash, its log's root, and whether its proof leads there."""
    log = events_trace(spark, sf_dir)
    hashes = digest.chunk_hashes(log, [], F.floor((F.col("event") - 1) / BLOCK), "event", ["kind", "id"])
    proven = digest.proofs(digest.tree(hashes, []), []).join(hashes, "chunk")
    return proven.select(F.col("chunk").alias("block"), F.col("rows").alias("events"), "hash", "root", digest.folded(F.col("hash"), F.col("path")).eqNullSafe(F.col("root")).alias("proven"))


@query(f"WITH {TRACE_SQL} SELECT (event - 1) // 4096 AS block, count(*) AS events, sum((kind = 0)::INTEGER)::BIGINT AS settled, sum((kind = 1)::INTEGER)::BIGINT AS examined, sum((kind = 2)::INTEGER)::BIGINT AS improved FROM trace GROUP BY 1")
def streamed_counters(spark, sf_dir):
    """Counters of each block of the event log, streamed from its verified chunks in batches, with state between them."""
    path = _folder(spark, "log")
    chunksource.write_chunked(events_trace(spark, sf_dir).select("event", "kind", "id"), path, "event", 65_536)
    last = chunksource.read_manifest(path)["count"]
    blocks = stream_blocks(log_source.log_stream(spark, path, f"{path}-progress", most=max(10_000, last // 4)))

    def keep(changed: DataFrame, n: int) -> None:
        changed.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}-out/batch={n}")  # a batch that runs again replaces its rows

    _run(blocks.writeStream.outputMode("update").foreachBatch(keep), f"{path}-checkpoint")
    made = spark.read.schema("block long, events long, settled long, examined long, improved long, batch int").parquet(f"{path}-out")
    latest = made.groupBy("block").agg(F.max_by(F.struct("events", "settled", "examined", "improved"), "batch").alias("x"))
    return latest.select("block", "x.*")


@query()
def phase_transitions(spark, sf_dir):
    """Phases of each user's replays, from actions that stand for the event types, as a stream with timers. Tested against a clock."""
    path, name = _folder(spark, "phases"), "spark.sql.streaming.stateStore.providerClass"
    action = F.expr("CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'pause' ELSE 'resume' END")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that one file is a stream too
    actions = events.select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), action.alias("action"))
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        _run(phases.phase_log(actions).writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(phases.SCHEMA).parquet(f"{path}/out")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS priced, max(o_orderkey) AS last FROM orders")
def observed_load(spark, sf_dir):
    """What a load saw, from its own job: rows, priced rows, the last key; observed while the table is written."""
    seen = Observation("load")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    o.observe(seen, F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("priced"), F.max("o_orderkey").alias("last")).write.parquet(_folder(spark, "load"))
    return spark.createDataFrame([tuple(seen.get[k] for k in ("n", "priced", "last"))], "n long, priced long, last long")
