"""What the vector operators share: components as integers, exact in any later arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Greatest absolute integer component: sums of squares of differences stay exact.
LIMIT = 1 << 24


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def integer_vectors(rows: DataFrame, scale: int, parts: int, id: str, vector: str, keep: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """(id, v, and the columns ``keep`` under new names) of the usable rows; the length of every v.

    A component x becomes floor(scale * x) in double arithmetic. Vectors of unequal length are
    filled with zeros up to the longest one's, rounded up to a multiple of ``parts``. Integers
    over LIMIT raise an error, as sums over them might not be exact.
    """
    x = rows[quoted(vector)].cast("array<double>")
    made = F.transform(x, lambda c: F.when(F.abs(c) * scale < LIMIT, F.floor(c * float(scale)).cast("int")).otherwise(F.raise_error(F.lit(f"a component is over {LIMIT // scale}"))))
    found = rows.where(usable(x)).select(rows[quoted(id)].cast("long").alias("id"), *(rows[quoted(c)].alias(n) for c, n in (keep or {}).items()), made.alias("v"))
    longest = rows.where(usable(x)).agg(F.max(F.size(x)).alias("n")).first()["n"] or 0
    width = -(-longest // parts) * parts
    filled = F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v"))))
    return found.withColumn("v", filled), width


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as the cluster has cores, where the input has fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
