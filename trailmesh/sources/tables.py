"""Driver tables, and a road-like graph derived from orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ids import numbered
from ..shipping import ship

_kept: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remembered(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table that many queries share, persisted once for an application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or not _kept[key].storageLevel.useMemory:
        _kept[key] = make().persist()
    return _kept[key]


def release(spark: SparkSession) -> None:
    """Unpersist the derived tables of an application."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        _kept.pop(key).unpersist()


def unsent(df: DataFrame) -> DataFrame:
    """A table that grows, never broadcast by Spark's estimate: few columns of a small Parquet file pass as small, however many their rows are."""
    return df.hint("merge")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y in 1e-5 degrees, osm_id: a grid of parts with a little scatter."""

    def make():
        p = F.col("p_partkey")
        part = table(spark, sf_dir, "part").select(p.cast("long").alias("node"))
        n = F.col("node")
        return part.select("node", (F.lit(800000) + (n % 50) * 120 + (n * 31) % 37).cast("int").alias("x"), (F.lit(4700000) + F.floor(n / 50) * 110 + (n * 17) % 29).cast("int").alias("y"), (n + 1000000).alias("osm_id"))

    return unsent(remembered(spark, sf_dir, "nodes", make))


NODES_SQL = """nodes AS (SELECT p_partkey::BIGINT AS node, (800000 + (p_partkey % 50) * 120 + (p_partkey * 31) % 37)::INTEGER AS x,
  (4700000 + (p_partkey // 50) * 110 + (p_partkey * 17) % 29)::INTEGER AS y, (p_partkey + 1000000)::BIGINT AS osm_id FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge, u, v, length_cm, direction, category: consecutive lines of an order whose parts are near."""

    def make():
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        lines = table(spark, sf_dir, "lineitem").select(*order, "l_returnflag")
        part = table(spark, sf_dir, "part")
        near = part.count() // 25
        follows = Window.partitionBy("l_orderkey").orderBy(*order[1:])
        pairs = lines.withColumn("v", F.lead("l_partkey").over(follows)).where(f"v IS NOT NULL AND abs(l_partkey - v) <= {near}")
        made = numbered(pairs, order, "edge")
        sizes = part.select(F.col("p_partkey").alias("u"), (F.col("p_size") % 15).cast("int").alias("category"))
        made = made.select("edge", F.col("l_partkey").alias("u"), "v", F.round(F.col("l_extendedprice") * 100).cast("long").alias("length_cm"), F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END").alias("direction"))
        return made.join(unsent(sizes), "u").select("edge", "u", "v", "length_cm", "direction", "category")

    return remembered(spark, sf_dir, "edges", make)


EDGES_SQL = """pairs AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v FROM lineitem),
edges AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS edge, l_partkey AS u, v,
  round(l_extendedprice * 100)::BIGINT AS length_cm, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END::INTEGER AS direction, (p_size % 15)::INTEGER AS category
  FROM pairs JOIN part ON p_partkey = l_partkey WHERE v IS NOT NULL AND abs(l_partkey - v) <= (SELECT count(*) // 25 FROM part))"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import build_arcs

    return remembered(spark, sf_dir, "arcs", lambda: build_arcs(edges(spark, sf_dir)))


ARCS_SQL = """halves AS (SELECT u AS src, v AS dst, edge, false AS reversed, length_cm AS w FROM edges WHERE direction <> 2
  UNION ALL SELECT v, u, edge, true, length_cm FROM edges WHERE direction <> 1),
arcs AS (SELECT (row_number() OVER (ORDER BY src, edge, reversed) - 1)::BIGINT AS arc, * FROM halves)"""

GRAPH_SQL = f"{NODES_SQL},\n{EDGES_SQL},\n{ARCS_SQL}"
#: The node of greatest total degree, lowest id.
SEED_SQL = """seed AS (SELECT node FROM (SELECT src AS node, count(*) AS d FROM arcs GROUP BY 1 UNION ALL SELECT dst, count(*) FROM arcs GROUP BY 1) GROUP BY node ORDER BY sum(d) DESC, node LIMIT 1)"""


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an event log: event (1-based by time), kind 0-3, id."""

    def make():
        e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
        kind = F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 ELSE 3 END")
        return numbered(e, ["ts", "event_id"], "event", 1).select("event", kind.alias("kind"), F.col("user_id").alias("id"), "event_id", "value")

    return remembered(spark, sf_dir, "trace", make)


TRACE_SQL = """trace AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS event,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 0 ELSE 3 END AS kind, user_id AS id, event_id, value FROM events)"""
