"""Queries: edge and geometry chunks, drawing layouts, provenance, throttled writes, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources import chunks
from ..sources.tables import EDGES_SQL, NODES_SQL, TRACE_SQL, edges, events_trace, nodes, table
from ..streaming import replay as streams
from .q_graph import _COMPONENTS, store
from .registry import query

SIZE = 500
_BASE = f"WITH {NODES_SQL}, {EDGES_SQL}"
_SHAPES = """shapes AS (SELECT edge, [struct_pack(x := n.x + (edge * 7 + j * 13) % 50, y := n.y - (edge * 5 + j * 11) % 40) FOR j IN range(1, 1 + (edge % 4)::BIGINT)] AS points FROM edges JOIN nodes n ON n.node = u WHERE edge % 4 > 0)"""


def shapes(spark, sf_dir):
    """Up to three points between the ends of a road."""
    at = edges(spark, sf_dir).join(nodes(spark, sf_dir).select(F.col("node").alias("u"), "x", "y"), "u").where("edge % 4 > 0")
    e = F.col("edge")
    point = lambda j: F.struct((F.col("x") + (e * 7 + j * 13) % 50).cast("int").alias("x"), (F.col("y") - (e * 5 + j * 11) % 40).cast("int").alias("y"))
    return at.select("edge", F.transform(F.sequence(F.lit(1).cast("long"), e % 4), point).alias("points"))


def _geometry(spark, sf_dir):
    return chunks.geometry_chunks(shapes(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir), SIZE)


@query(f"{_BASE} SELECT edge, u, v, length_cm, direction, category FROM edges")
def edge_chunk_roundtrip(spark, sf_dir):
    """Edges packed into column chunks and read back."""
    return chunks.read_edge_chunks(chunks.edge_chunks(edges(spark, sf_dir), SIZE))


@query(f"{_BASE}, e AS (SELECT *, edge // {SIZE} AS chunk FROM edges), d AS (SELECT *, u - coalesce(lag(u) OVER (PARTITION BY chunk ORDER BY edge), 0) AS d FROM e) SELECT chunk, min(edge) AS start, count(*) AS count, sum(abs(d))::BIGINT AS differences, sum(abs(v - u))::BIGINT AS spans, sum(length_cm)::BIGINT AS length_cm, count(*) * 14 AS bytes FROM d GROUP BY chunk")
def edge_chunk_sizes(spark, sf_dir):
    c = chunks.edge_chunks(edges(spark, sf_dir), SIZE)
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + F.abs(x))
    return c.select("chunk", "start", F.col("count").cast("long").alias("count"), total("d_from").alias("differences"), total("rel").alias("spans"), total("length_cm").alias("length_cm"), (F.col("count") * chunks.EDGE_BYTES).cast("long").alias("bytes"))


@query(f"{_BASE} SELECT edge // {SIZE} AS chunk, 'connection' AS why FROM edges WHERE edge % 1000 = 7")
def edge_chunk_audit(spark, sf_dir):
    """Chunks with a planted road to a node that isn't there."""
    e = edges(spark, sf_dir)
    n = nodes(spark, sf_dir).count()
    bad = e.withColumn("v", F.when(F.col("edge") % 1000 == 7, F.lit(n)).otherwise(F.col("v")))
    return chunks.edge_chunk_violations(chunks.edge_chunks(bad, SIZE), e.count(), n)


@query(f"""{_BASE}, {_SHAPES}, line AS (SELECT e.edge, list_concat([struct_pack(x := a.x, y := a.y)], coalesce(points, []), [struct_pack(x := b.x, y := b.y)]) AS p FROM edges e JOIN nodes a ON a.node = e.u JOIN nodes b ON b.node = e.v LEFT JOIN shapes s ON s.edge = e.edge)
SELECT edge, (i - 1)::INTEGER AS j, p[i].x::BIGINT AS x, p[i].y::BIGINT AS y FROM (SELECT edge, p, unnest(range(1, len(p) + 1)) AS i FROM line)""")
def geometry_roundtrip(spark, sf_dir):
    """Shapes packed into geometry chunks and read back as points with the roads' ends."""
    return chunks.read_geometry_chunks(_geometry(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir))


@query(f"""{_BASE}, c AS (SELECT edge // {SIZE} AS chunk, min(edge) AS start, count(*) AS n, sum(edge % 4)::BIGINT AS points FROM edges GROUP BY 1)
SELECT chunk, (points + n) * 2 AS vertices, n * 2 + points * 8 AS bytes, CASE WHEN chunk % 5 <> 3 THEN start END AS start, CASE WHEN chunk % 5 <> 3 THEN n END AS count FROM c""")
def drawing_road_ranges(spark, sf_dir):
    """Vertices and bytes of each geometry chunk, and the roads that its drawing holds; every fifth drawing has another layout."""
    c = _geometry(spark, sf_dir).select("chunk", "start", F.size("counts").cast("long").alias("n"), F.size("dx").alias("points"), chunks.vertices(F.col("counts")).alias("vertices"))
    size = F.col("n") * chunks.COUNT_BYTES + F.col("points") * chunks.POINT_BYTES
    c = c.withColumns({"bytes": size, "drawn": F.col("vertices") + (F.col("chunk") % 5 == 3).cast("long")})
    r = chunks.road_range(F.lit("geometry"), F.col("start"), F.col("n"), F.col("bytes"), F.col("drawn"))
    return c.select("chunk", "vertices", "bytes", r["start"].alias("start"), r["count"].alias("count"))


@query("SELECT o_orderkey, reached, least(2048, greatest(1, reached)) * greatest(1, ceil(reached / least(2048, greatest(1, reached)))) * 2 < rows AS compact FROM (SELECT o_orderkey, o_custkey * 37 % 9000 AS reached, 1000 + o_orderkey % 12000 AS rows FROM orders)")
def texture_compaction(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 37 % 9000).alias("reached"), (F.lit(1000) + F.col("o_orderkey") % 12000).alias("rows"))
    return o.select("o_orderkey", "reached", chunks.should_compact(F.col("rows"), F.col("reached")).alias("compact"))


@query("SELECT o_orderkey, n_name AS identity, CASE WHEN n_nationkey IS NOT NULL THEN 'c' || n_regionkey END AS compiler FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30")
def result_provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edition"), F.col("n_name").alias("identity"), F.concat(F.lit("c"), F.col("n_regionkey")).alias("compiler"), F.lit("road/1").alias("profile"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("edition"))
    return chunks.with_provenance(o, n).select("o_orderkey", "dataset.identity", "dataset.compiler")


@query("SELECT o_orderkey, id, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') END AS date, id LIKE 'ch-%' AS pinned FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'ch-' || strftime(o_orderdate::DATE, '%Y%m%d') || '-6a17' WHEN 1 THEN 'uk-' || strftime(o_orderdate::DATE, '%Y%m%d') ELSE 'nz-20249931' END AS id FROM orders)")
def edition_ids(spark, sf_dir):
    """Dates in edition ids, and which ids are of the region with landmarks; the last kind has no such day."""
    day, k = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 3
    id = F.when(k == 0, F.concat(F.lit("ch-"), day, F.lit("-6a17"))).when(k == 1, F.concat(F.lit("uk-"), day)).otherwise("nz-20249931")
    o = table(spark, sf_dir, "orders").select("o_orderkey", id.alias("id"))
    return o.select("o_orderkey", "id", F.date_format(text.id_date("id"), "yyyy-MM-dd").alias("date"), text.pinned_id("id").alias("pinned"))


GAP = 5000
_CHANGES = f"""{TRACE_SQL}, ch AS (SELECT id::VARCHAR AS client, event * 7 AS "at", kind::VARCHAR || event AS value FROM trace)"""


@query(f"""WITH RECURSIVE {_CHANGES}, w(client, "at", late) AS (SELECT client, min("at"), false FROM ch GROUP BY client UNION ALL
  SELECT client, CASE WHEN a - b >= {GAP} THEN a ELSE b + {GAP} END, a - b < {GAP} FROM (SELECT w.client, w."at" AS b, min(ch."at") AS a FROM w JOIN ch ON ch.client = w.client AND (ch."at" > w."at" OR w.late AND ch."at" = w."at") GROUP BY w.client, w."at"))
SELECT w.client, w."at", CASE WHEN late THEN max_by(value, ch."at") FILTER (WHERE ch."at" < w."at") ELSE max_by(value, ch."at") END AS value FROM w JOIN ch ON ch.client = w.client AND ch."at" <= w."at" GROUP BY w.client, w."at", late""")
def throttled_writes(spark, sf_dir):
    """Coalesced writes of each client, by the stateful operator."""
    t = events_trace(spark, sf_dir)
    changes = t.select(F.col("id").cast("string").alias("client"), (F.col("event") * 7).alias("at"), F.concat(F.col("kind").cast("string"), F.col("event").cast("string")).alias("value"))
    return streams.throttled(changes, GAP)


@query(f"{_COMPONENTS}, n AS (SELECT count(*) AS n FROM nodes), big AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), p AS (SELECT s_suppkey AS place, s_suppkey % n AS node, s_suppkey * 37 % 720 - 360.0 AS lon FROM supplier, n) SELECT place, component = (SELECT component FROM big) AS mainland, lon - 360 * floor((lon - 175 + 180) / 360) AS unwrapped FROM p JOIN c USING (node)")
def island_audit(spark, sf_dir):
    """Places on the largest component or not, and their longitudes unwrapped around 175 degrees."""
    n, c = nodes(spark, sf_dir).count(), store(spark, sf_dir).components
    big = c.groupBy("component").count().orderBy(F.desc("count"), "component").first()["component"]
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % n).alias("node"), (F.col("s_suppkey") * 37 % 720 - F.lit(360.0)).alias("lon"))
    lon = F.col("lon") - 360 * F.floor((F.col("lon") - 175 + 180) / 360)
    return p.join(c, "node").select("place", (F.col("component") == big).alias("mainland"), lon.alias("unwrapped"))
