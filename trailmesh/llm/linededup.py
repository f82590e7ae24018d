"""Operator 5: line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Workspace, ascii_lower, fresh, join_small, quoted, text_of

#: Frequent keys are broadcast (12 bytes each) up to this many; beyond, the join shuffles.
BROADCAST_KEYS = 500_000


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.call_function("btrim", line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _ordered(spark: SparkSession):
    """Spark trusts the order of a bucket that is one file meanwhile, so that runs are merged without a sort."""
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before) if before is not None else spark.conf.unset(_ORDERED)


class LineRuns:
    """How many documents hold each line key, as levelled sorted runs in the shared folder.

    A run is a table (h1, h2, n), dealt once to the same buckets as every other run and sorted in
    each. A new batch is merged with the runs by an anti-join that drops keys known to be in
    ``least`` documents, and what is left becomes a run on level 0. Two runs of a level are
    compacted into one of the next by a merge of their orders, bucket by bucket, without a
    shuffle or a sort, so a key is rewritten O(log batches) times. Runs are files: a lost
    executor loses none.
    """

    def __init__(self, work: Workspace, least: int):
        self.work, self.spark, self.least = work, work.spark, least
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.names: list[str] = []
        self.merges = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def _write(self, run: DataFrame) -> str:
        name = f"trailmesh_run_{uuid.uuid4().hex}"
        out = run.select("h1", "h2", "n").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        out.option("path", self.work.path(name)).option("compression", "zstd").saveAsTable(name)
        self.names.append(name)
        return name

    def merge(self, one: str, two: str) -> DataFrame:
        """Both runs' keys in order, with the sums of their counts."""
        a, b = self.spark.table(one), self.spark.table(two).withColumnRenamed("n", "m").hint("merge")
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def _merged(self, one: str, two: str) -> str:
        name = self._write(self.merge(one, two))
        self.merges += 1
        self._drop(one)
        self._drop(two)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.drop(name)
        self.names.remove(name)

    def add(self, counts: DataFrame) -> None:
        """A batch's (h1, h2, n): number of its documents with each key; no document is in two batches."""
        with _ordered(self.spark):
            for run in self.runs():
                counts = counts.join(run.where(F.col("n") >= self.least).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            run, level = self._write(counts), 0
            while level < len(self.levels) and self.levels[level]:
                run, self.levels[level] = self._merged(self.levels[level], run), None
                level += 1
            if level == len(self.levels):
                self.levels.append(None)
            self.levels[level] = run

    def settled(self, name: str) -> DataFrame:
        """Keys found in at least ``least`` documents of all batches; the runs are compacted into one and go."""
        with _ordered(self.spark):
            left = [x for x in self.levels if x]
            while len(left) > 1:
                left = [self._merged(left[0], left[1]), *left[2:]]
            found = self.spark.table(left[0]) if left else self.spark.createDataFrame([], "h1 long, h2 int, n long")
            found = self.work.write(found.where(F.col("n") >= self.least).select("h1", "h2"), name)
        self.levels = []
        for x in list(self.names):
            self._drop(x)
        return found


def line_dedup(docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Drop every line whose key is found in at least ``least`` documents, in all documents.

    Returns the documents with their columns, ``text`` without those lines, and n_lines,
    n_dropped. Keys under ``min_chars`` code points stay. A null text is one empty line and
    comes back as the empty text. A document is a distinct id (all rows of null id count as one
    document); repeated rows of an id count once, and each comes back. Very long texts are split
    whole. Columns called n_lines or n_dropped already are replaced; others pass unchanged,
    whatever they are called. An empty table gives an empty table.
    """
    work = Workspace(docs.sparkSession, "lines")
    t = text_of(docs, text)
    own = docs[quoted(id)]
    key = F.struct(F.xxhash64(own, t).alias("r1"), F.hash(own, t).alias("r2"))
    hashed = F.transform(lines_of(t), lambda x: _hashes(x, min_chars))
    spread = docs.select(own.alias("d"), key.alias("r"), F.posexplode(hashed).alias("p", "h")).where("h IS NOT NULL")
    spread = spread.select("d", F.col("r.r1").alias("r1"), F.col("r.r2").alias("r2"), "p", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), F.pmod(F.hash("d"), F.lit(batches)).alias("batch"))
    keys = work.write(spread, "keys", "batch")

    runs = LineRuns(work, least)
    for b in range(batches):
        mine = keys.where(F.col("batch") == b)  # a folder
        # a document's lines come from few tasks, so most repeats fall away before the shuffle
        runs.add(mine.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    frequent = runs.settled("settled")

    hit = join_small(keys.select("r1", "r2", "p", "h1", "h2"), frequent, ["h1", "h2"], "left_semi", BROADCAST_KEYS)
    r1, r2, drop, x = fresh(docs, "r1", "r2", "drop", "x")
    drops = hit.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.collect_set("p").alias(drop))

    shown = docs.select(*(docs[quoted(c)] for c in docs.columns), F.struct(key.alias("k"), lines_of(t).alias("l")).alias(x))
    both = shown.join(drops, (F.col(f"{x}.k.r1") == F.col(r1)) & (F.col(f"{x}.k.r2") == F.col(r2)), "left")
    lines = F.col(f"{x}.l")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))  # a hash set, so linear
    left = F.when(F.col(drop).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    taken = {"n_lines", "n_dropped"}
    return both.select(
        *((left.alias(text) if c == text else F.col(quoted(c))) for c in docs.columns if c.lower() not in taken),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _hashes(line: Column, min_chars: int) -> Column:
    k = line_key(line)
    return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.hash(k).alias("h2")))
