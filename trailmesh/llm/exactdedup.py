"""Operator 6: exact dedup by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_small, quoted, text_of

PREFIX = 64  # code points of the prefix hash
BROADCAST_GROUPS = 100_000  # surviving (length, prefix hash) groups that are broadcast; beyond, the join shuffles


def normalised(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. The groups are refined by normalised
    length, then by the hash of the first PREFIX code points; only rows of groups that are
    still larger than one are read and hashed whole. Of equal texts the row with the most
    code points, then the smallest id, stays. ``text_sha256`` is null for rows that no
    other row could equal, unless ``digest_all``.

    Null text counts as empty. A null id is the largest of ids; a row repeated with its id is
    in its group once more each time, and all rows of the winning id and length are kept.
    Very long texts are read whole. An empty table gives an empty table. No column but these
    two is read, whatever others are called; ids can be of any type that has an order.
    """
    work = Workspace(docs.sparkSession, "exact")
    t = text_of(docs, text)
    norm = normalised(t)
    head = F.xxhash64(F.substring(norm, 1, PREFIX))
    shape = work.write(docs.select(F.char_length(norm).alias("len"), head.alias("head")), "shape")
    # 1: lengths that occur twice; most rows of these fall away by 2: length and prefix
    lengths = shape.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    heads = join_small(shape, work.write(lengths, "lengths"), ["len"], "left_semi", BROADCAST_GROUPS)
    groups = work.write(heads.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "head", F.lit(True).alias("more")), "heads")
    # 3: whole content of what is left
    seen = docs.select(docs[quoted(id)].alias("id"), F.char_length(t).alias("chars"), norm.alias("norm"), F.char_length(norm).alias("len"), head.alias("head"))
    seen = join_small(seen, groups, ["len", "head"], "left", BROADCAST_GROUPS)
    whole = F.sha2(F.col("norm").cast("binary"), 256)
    more = F.coalesce(F.col("more"), F.lit(False))
    rows = work.write(seen.select("id", "chars", more.alias("more"), (whole if digest_all else F.when(more, whole)).alias("sha")), "rows")
    best = F.min(F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), "id"))
    made = rows.where("more").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1")
    # without rows that are alone (a null key would gather them in one task); the groups are
    # written, so that neither side of the join is an aggregate and a hot group can be split
    both = join_small(rows.where("more"), work.write(made, "made"), "sha", "left", BROADCAST_GROUPS)
    keeps = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id"))
    stays = F.col("n").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.a")))
    win = both.select("id", keeps.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), "sha")
    alone = rows.where("NOT more").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return win.unionByName(alone).withColumnsRenamed({"id": id, "sha": "text_sha256"})
