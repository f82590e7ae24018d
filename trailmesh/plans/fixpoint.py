"""One semi-naive loop for iterative queries over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shared_folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder; our own folder only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt_parts(df: DataFrame, rows: int) -> int:
    """Parts for a table of counted rows that rounds read again: a task each, few for a small table, bounded ones for a large one."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 20_000)), -(-rows // 500_000))


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, value: str, most: int, parts: int) -> DataFrame:
    """Least ``value`` for each ``key`` under ``step(front)``, which proposes rows (key, value) from improved ones.

    ``start`` has every key, with a null value where there is none yet, so a round keeps the state's rows and meets them with
    the least proposals, in ``parts`` parts. Its files go once the next one is settled.
    """
    least = start.repartition(parts, key).groupBy(key).agg(F.min(value).alias(value))
    merged = settle(least.select(key, value, F.col(value).isNotNull().alias("__new")))
    for _ in range(most):
        front = merged.where("__new").select(key, value)
        made = step(front).select(F.col(key).alias("__k"), F.col(value).alias("__v")).repartition(parts, "__k")
        made = made.groupBy("__k").agg(F.min("__v").alias("__v")).hint("shuffle_hash")
        both = merged.join(made, F.col(key) == F.col("__k"), "left")
        better = F.col("__v").isNotNull() & (F.col(value).isNull() | (F.col("__v") < F.col(value)))
        kept, merged = merged, settle(both.select(key, F.when(better, F.col("__v")).otherwise(F.col(value)).alias(value), better.alias("__new")))
        more = merged.where("__new").take(1)
        forget(kept)
        if not more:
            return merged.where(F.col(value).isNotNull()).select(key, value)
    raise RuntimeError(f"no fixpoint after {most} rounds")
