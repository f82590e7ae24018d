"""Hash trees over ordered chunks: roots, proofs, and one chunk verified alone. SHA-256 in hexadecimal throughout."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a node of the tree.
FAN = 16


def root_of(hashes: list[str], fan: int = FAN) -> str:
    """The root over a list of hashes: a parent is the hash of its children's, joined; of none, the hash of nothing."""
    level = list(hashes)
    while len(level) != 1:
        if not level:
            return hashlib.sha256(b"").hexdigest()
        level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
    return level[0]


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def row_hash(*names: str) -> Column:
    """The hash of a row's canonical text: its fields as JSON in the given order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).cast("binary"), 256)


def chunk_hashes(rows: DataFrame, by: list[str], chunk: Column, order: str, values: list[str], page: Column | None = None) -> DataFrame:
    """(by, chunk, rows, hash): the hash of the rows' hashes in their order; repeated and exchanged rows change it.

    A group is one chunk, so ``chunk`` must bound its rows. With ``page``, which must bound its rows and
    ascend with the order, a chunk's hash is that of its pages' hashes, and no group is larger than a
    page's rows or a chunk's pages. Rows of equal places tie by hash.
    """
    leaf = rows.select(*by, chunk.alias("chunk"), (F.lit(0) if page is None else page).alias("__p"), F.col(order).alias("__o"), row_hash(order, *values).alias("__h"))
    joined = lambda *names: _joined(F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x["__h"]))
    pages = leaf.groupBy(*by, "chunk", "__p").agg(F.count(F.lit(1)).alias("rows"), joined("__o", "__h").alias("__h"))
    if page is None:
        return pages.select(*by, "chunk", "rows", F.col("__h").alias("hash"))
    return pages.groupBy(*by, "chunk").agg(F.sum("rows").alias("rows"), joined("__p", "__h").alias("hash"))


def tree(hashes: DataFrame, by: list[str], fan: int = FAN) -> list[DataFrame]:
    """Levels (by, n, hash) of the trees over chunks 0, 1, ... of each ``by``, the chunks first, the roots last.

    Levels are as many as the longest list needs; a shorter list's root is carried up as it is.
    """
    levels = [hashes.select(*by, F.col("chunk").alias("n"), "hash")]
    most = (hashes.agg(F.max("chunk")).first()[0] or 0) + 1
    while most > 1:
        low = levels[-1]
        listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda x: x["hash"])
        up = low.groupBy(*by, F.floor(F.col("n") / fan).alias("n")).agg(listed.alias("l"), F.max(low["n"]).alias("last"))
        alone = (F.size("l") == 1) & (F.col("n") == 0)
        levels.append(up.select(*by, "n", F.when(alone, F.get("l", F.lit(0))).otherwise(_joined(F.col("l"))).alias("hash")))
        most = -(-most // fan)
    return levels


def proofs(levels: list[DataFrame], by: list[str], fan: int = FAN) -> DataFrame:
    """(by, chunk, path, root): for each chunk its place and its group's hashes on every level, and its tree's root."""
    found = levels[0].select(*by, F.col("n").alias("chunk"), F.array().cast("array<struct<at:int,hashes:array<string>>>").alias("path"), F.col("n").alias("n"))
    for level in levels[:-1]:
        group = level.groupBy(*by, F.floor(F.col("n") / fan).alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "hash"))), lambda x: x["hash"]).alias("hashes"))
        met = found.withColumn("up", F.floor(F.col("n") / fan)).join(group, [*by, "up"])
        step = F.struct((F.col("n") % fan).cast("int").alias("at"), "hashes")
        alone = (F.size("hashes") == 1) & (F.col("up") == 0)
        found = met.select(*by, "chunk", F.when(alone, F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"), F.col("up").alias("n"))
    roots = levels[-1].select(*by, F.col("hash").alias("root"))
    return found.drop("n").join(roots, by) if by else found.drop("n").crossJoin(F.broadcast(roots))


def folded(hash: Column, path: Column) -> Column:
    """The root that a chunk's hash and its proof lead to; null if its place isn't in the proof."""
    put = lambda h, p: F.concat(F.slice(p["hashes"], 1, p["at"]), F.array(h), F.slice(p["hashes"], p["at"] + 2, F.greatest(F.size(p["hashes"]) - p["at"] - 1, F.lit(0))))
    up = lambda h, p: F.when(p["at"] < F.size(p["hashes"]), F.sha2(F.array_join(put(h, p), "").cast("binary"), 256))
    return F.aggregate(path, hash, up)
