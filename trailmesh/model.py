"""Schemas, names and fixed values of the graph engine. Costs are integers: centimetres or milliseconds."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Algorithm(str, Enum):
    DIJKSTRA = "dijkstra"
    BIDIRECTIONAL = "bidirectional"
    ASTAR = "astar"
    BIDIRECTIONAL_ASTAR = "bidirectional-astar"
    WEIGHTED_ASTAR = "weighted-astar"
    ALT = "alt"
    GREEDY = "greedy"
    DEPTH_FIRST = "depth-first"
    BREADTH_FIRST = "breadth-first"
    BIDIRECTIONAL_BREADTH_FIRST = "bidirectional-breadth-first"
    SPANNING_TREE = "spanning-tree"
    MULTISOURCE = "multisource"
    TIME = "time-dijkstra"


#: Algorithms that minimise the cost they are given; the others find a first or a fewest-connections route.
OPTIMAL = frozenset({Algorithm.DIJKSTRA, Algorithm.BIDIRECTIONAL, Algorithm.ASTAR, Algorithm.BIDIRECTIONAL_ASTAR, Algorithm.ALT, Algorithm.TIME, Algorithm.MULTISOURCE, Algorithm.SPANNING_TREE})
GUARANTEE = {Algorithm.WEIGHTED_ASTAR: "first-found", Algorithm.GREEDY: "first-found", Algorithm.DEPTH_FIRST: "first-found", Algorithm.BREADTH_FIRST: "fewest-connections", Algorithm.BIDIRECTIONAL_BREADTH_FIRST: "fewest-connections"}

# Road classes in category order, and their speeds in km/h with the fallback.
CLASSES = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "road"]
SPEEDS = [100, 50, 80, 40, 60, 35, 50, 30, 40, 25, 35, 25, 10, 15, 25]
FALLBACK_SPEED = 25
#: Categories up to this one may be snapped to.
SNAP_CATEGORY = 11
SNAP_METRES = 2000.0
METRES_PER_DEGREE = 111195.0802
EARTH_RADIUS = 6371008.8
CHECKPOINT = 4096

NODES = T.StructType([T.StructField("node", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("osm_id", T.LongType())])
EDGES = T.StructType([T.StructField("edge", T.LongType()), T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("length_cm", T.LongType()), T.StructField("direction", T.IntegerType()), T.StructField("category", T.IntegerType())])
ARCS = T.StructType([T.StructField("arc", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("edge", T.LongType()), T.StructField("reversed", T.BooleanType()), T.StructField("w", T.LongType())])
TRACE = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("event", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("side", T.IntegerType())])
REQUESTS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("algorithm", T.StringType()), T.StructField("start", T.LongType()), T.StructField("goal", T.LongType()), T.StructField("sources", T.ArrayType(T.LongType()))])
RESULTS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("goal", T.LongType()),
        T.StructField("cost", T.LongType()),
        T.StructField("settled", T.LongType()),
        T.StructField("examined", T.LongType()),
        T.StructField("improved", T.LongType()),
        T.StructField("max_queue", T.LongType()),
        T.StructField("route_nodes", T.ArrayType(T.LongType())),
        T.StructField("route_edges", T.ArrayType(T.LongType())),
        T.StructField("route_reversed", T.ArrayType(T.BooleanType())),
        T.StructField("route_lengths", T.ArrayType(T.LongType())),
        T.StructField("guarantee", T.StringType()),
        T.StructField("meeting_node", T.LongType()),
        T.StructField("meeting_cost", T.LongType()),
        T.StructField("corrected_nodes", T.LongType()),
        T.StructField("words", T.ArrayType(T.LongType())),
    ]
)

SETTLE, EXAMINE, IMPROVE, RETURN = 0, 1, 2, 3
BACKWARD = 1 << 31
SOURCE_SHIFT = 30
