"""Table functions for SQL: the rows of event words, the segments of shapes.

After ``register(spark)``::

    SELECT * FROM word_events(TABLE(results), 'words')
    SELECT * FROM shape_segments(TABLE(points) PARTITION BY (edge) ORDER BY (j), 'edge')

Both take any table; what they return follows from the table's columns and the arguments.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegralType, IntegerType, LongType, NumericType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction
from pyspark.sql.functions import udtf

from ..model import BACKWARD
from ..shipping import ship


def _column(table: AnalyzeArgument, name: AnalyzeArgument, what: str) -> str:
    if not table.isTable:
        raise ValueError("the first argument is a table")
    if not name.isConstantExpression or name.value not in table.dataType.names:
        raise ValueError(f"the second argument names the table's column of {what}")
    return name.value


class WordEvents:
    """Each row's other columns with event (1-based), kind, id and side of every word of an array column; null and empty arrays give none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, words: AnalyzeArgument) -> AnalyzeResult:
        name = _column(table, words, "words")
        kind = table.dataType[name].dataType
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, IntegralType):
            raise ValueError(f"{name} isn't an array of integers")
        made = StructType([f for f in table.dataType.fields if f.name != name])
        for f, t in (("event", LongType()), ("kind", IntegerType()), ("id", LongType()), ("side", IntegerType())):
            if f in made.names:
                raise ValueError(f"the table has a column {f} already")
            made = made.add(f, t)
        return AnalyzeResult(schema=made)

    def eval(self, row: Row, words: str) -> Iterator[tuple]:
        others = [v for f, v in zip(row.__fields__, row, strict=True) if f != words]
        for n, w in enumerate(row[words] or [], 1):
            if w is None:
                raise ValueError("a word is null")
            yield (*others, n, w & 3, (w & BACKWARD - 1) >> 2, int(w & BACKWARD > 0))


class ShapeSegments:
    """key, seg (0-based), x1, y1, x2, y2: the segments between the points (x, y) of each partition, in its order.

    Partition by the key and order by the points' place. A point without coordinates is passed over; one point alone gives no segment.
    Only the last point is held.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        name = _column(table, key, "keys")
        for c in ("x", "y"):
            if c not in table.dataType.names or not isinstance(table.dataType[c].dataType, NumericType):
                raise ValueError(f"the table has no number {c}")
        made = StructType().add(name, table.dataType[name].dataType).add("seg", LongType())
        for c in ("x1", "y1", "x2", "y2"):
            made = made.add(c, table.dataType[c[0]].dataType)
        return AnalyzeResult(schema=made)

    def __init__(self):
        self.before, self.n = None, 0

    def eval(self, row: Row, key: str) -> Iterator[tuple]:
        now = (row["x"], row["y"])
        if None in now:
            return
        if self.before is not None:
            yield (row[key], self.n, *self.before, *now)
            self.n += 1
        self.before = now


def register(spark: SparkSession) -> dict[str, UserDefinedTableFunction]:
    """Make ``word_events`` and ``shape_segments`` known to the session's SQL."""
    ship(spark)
    made = {"word_events": udtf(WordEvents), "shape_segments": udtf(ShapeSegments)}
    for name, f in made.items():
        spark.udtf.register(name, f)
    return made
