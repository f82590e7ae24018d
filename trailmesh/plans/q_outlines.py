"""Queries: unions of outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlines
from ..sources.tables import table
from .registry import query


def grounds(spark, sf_dir):
    """A square of whole units for each client, in strips that get more with the clients, as polygons of their nation."""
    k = F.col("client_id")
    x, y, w = k * 37 % 97, k * 53 % 61 + F.floor(k / 100) * 20, 5 + k % 20
    corner = lambda i, j: F.struct((x + i * w).cast("double").alias("x"), (y + j * w).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return table(spark, sf_dir, "clients").select(F.col("nation_id").alias("nation"), F.array(F.array(ring)).alias("polygons"))


@query("""WITH s AS (SELECT coalesce(nation_id, -1) AS nation, client_id * 37 % 97 AS x, client_id * 53 % 61 + client_id // 100 * 20 AS y, 5 + client_id % 20 AS w FROM clients),
cells AS (SELECT DISTINCT nation, x, y + unnest(range(w)) AS y FROM (SELECT nation, x + unnest(range(w)) AS x, y, w FROM s)),
beside AS (SELECT nation, count(*) AS n FROM (SELECT nation, x + 1 AS x, y FROM cells UNION ALL SELECT nation, x, y + 1 FROM cells) JOIN cells USING (nation, x, y) GROUP BY 1),
places AS (SELECT nation, sum(bit) AS bits, count(*) AS n FROM (SELECT nation, x + i AS x, y + j AS y, 1 << (i + 2 * j) AS bit FROM cells, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) GROUP BY nation, x, y),
turns AS (SELECT nation, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) AS corners, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) AS net FROM places GROUP BY 1)
SELECT nullif(nation, -1) AS nation, count(*) AS area, (4 * count(*) - 2 * any_value(b.n))::BIGINT AS perimeter, any_value(corners)::BIGINT AS corners, (any_value(net) // 4)::BIGINT AS net_rings
FROM cells JOIN beside b USING (nation) JOIN turns USING (nation) GROUP BY nation""")
def outline_union(spark, sf_dir):
    """Area, perimeter, corners, and outer rings less holes of the union of each nation's squares."""
    sides = outlines.union_outlines(grounds(spark, sf_dir), ["nation"], 1.0)
    rings = outlines.ring_sums(sides, ["nation"])
    return rings.groupBy("nation").agg(F.sum("area").cast("long").alias("area"), F.sum("perimeter").cast("long").alias("perimeter"), F.sum("corners").alias("corners"), F.sum(F.signum("area")).cast("long").alias("net_rings"))
