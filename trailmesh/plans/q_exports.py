"""Queries: outline packages, merged sources, places, one step of adjacency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.joins import first_of
from ..sources import exports
from ..sources.tables import GRAPH_SQL, arcs, nodes, table
from .registry import query


@query("""WITH a AS (SELECT n_name AS region, n_name || ' border ' || n_nationkey AS b, 'lakes of ' || n_regionkey AS l FROM nation),
j AS (SELECT region, '{"region":"' || region || '","border":{"path":"border-' || left(sha256(b), 12) || '.json","bytes":' || strlen(b) || ',"sha256":"' || sha256(b) || '"},"lakes":{"path":"lakes-' || left(sha256(l), 12) || '.json","bytes":' || strlen(l) || ',"sha256":"' || sha256(l) || '"}}' AS doc FROM a)
SELECT region, 'geo-' || region || '-20240131-' || left(sha256(doc), 12) AS id, sha256(doc) AS identity FROM j""")
def outline_identities(spark, sf_dir):
    """Identities of packages of a border and lakes, by the payload's hash."""
    n = table(spark, sf_dir, "nation")
    border = n.select(F.col("n_name").alias("region"), F.lit("border").alias("kind"), F.concat("n_name", F.lit(" border "), F.col("n_nationkey").cast("string")).alias("payload"))
    lakes = n.select(F.col("n_name").alias("region"), F.lit("lakes").alias("kind"), F.concat(F.lit("lakes of "), F.col("n_regionkey").cast("string")).alias("payload"))
    both = border.unionByName(lakes).withColumn("payload", F.col("payload").cast("binary"))
    both = both.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256)})
    return exports.outline_packages(both, "20240131").select("region", "id", "identity")


@query("SELECT id, arg_min(name, source) AS name, min(source) AS source FROM (SELECT c_custkey AS id, c_name AS name, 0 AS source FROM customer UNION ALL SELECT s_suppkey * 3, s_name, 1 FROM supplier UNION ALL SELECT p_partkey * 2, p_name, 2 FROM part) GROUP BY id")
def merged_sources(spark, sf_dir):
    """Three sources by id; the first source that has an id gives its row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"), F.col("p_name").alias("name"))
    return first_of([c, s, p], "id", "source")


@query("SELECT n_name AS name, 'manual' AS origin, n_regionkey AS region FROM nation UNION ALL SELECT s_name, 'ambient', n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def place_list(spark, sf_dir):
    """Places given by hand and those of the ambient pools, in one list."""
    n = table(spark, sf_dir, "nation")
    manual = n.select(F.col("n_name").alias("name"), F.lit("manual").alias("origin"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return manual.unionByName(s.select(F.col("s_name").alias("name"), F.lit("ambient").alias("origin"), F.col("n_regionkey").alias("region")))


@query(f"WITH {GRAPH_SQL}, front AS (SELECT s_suppkey % (SELECT count(*) FROM nodes) AS node, s_suppkey * 100 AS cost FROM supplier) SELECT dst AS node, min(cost + w)::BIGINT AS cost FROM front JOIN arcs ON src = node GROUP BY dst")
def adjacency_step(spark, sf_dir):
    """Least costs one arc away from a frontier."""
    n = nodes(spark, sf_dir).count()
    front = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % n).alias("node"), (F.col("s_suppkey") * 100).cast("long").alias("cost"))
    return graph.expand(front, arcs(spark, sf_dir))
