"""Operator 7: n-gram Jaccard join by token-combination prefixes, and the groups it links.

Tokens are k-word shingles. They are ordered rare class first, frequent class last, by hash
within a class. Let a set x have n tokens, r of them rare, and let t = ceil(T n) be the least
overlap with any set it links with.

* If the first token that two linked sets share is rare, it is among the first n - t + 1
  tokens of both: these are indexed one by one.
* Otherwise all that they share is frequent, so r <= n - t, and at most a = n - r - t frequent
  tokens of x are unshared. The prefix is extended to the first a + l frequent tokens with
  l = a + floor((1/T - 1) n) + 2: it holds the first l shared ones. At most l - 2 tokens that
  only one of the two sets has can stand between them, so at least one pair of shared tokens
  is adjacent in both sets: pairs of adjacent frequent tokens are indexed. That makes their
  number linear in the set's size, where all pairs would be quadratic.

The argument on pairs needs two shared tokens; sets that differ and link share at least
T / (1 - T) of them. Sets that are equal are one class from the start.

Where more than HOT sets of a key are in other components than its largest, they aren't compared pair by
pair: sets that are joined by such keys are a family, and a set x of it is told by D(x), its difference
to the family's core (the tokens of most members). With d = |D(x)| and the percentage P,

    x and y link if and only if 2 (100 + P) |D(x) & D(y)| >= G(x) + G(y), G = (100 + P) d - (100 - P) n.

As the need is a sum of what each set brings, one star to the member of the least G finds all
components of links that need no common difference; the others share as many differences as they
need, and combinations of these are indexed. A family's sets are classed by G, and a set is indexed for
each class that it may meet by as many differences as all pairs of these two classes need: a few sets
of small G, which need little, don't make the others' combinations short.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, made_by, mix64, quoted, shingles, text_of

#: The frequent class has at most so many tokens, as bits of a map of 8 to 16 bits a token (32 MB at most) that is broadcast. It
#: only sets the order of tokens: links are found whatever is in it, so a token that shares another one's bit does no harm.
FREQUENT = 1 << 26
MAP_BITS = 28
LEAST = 4  # documents that hold a frequent token, at least
BROADCAST_IDS = 1_000_000
_SALT = 0x5851F42D4C957F2D
FIRST = 8  # smallest pair keys that go with a row, to meet two sets under one of the keys that they share
_BLOCK = 1 << 16  # bits of the map that a task packs at once
_FLUSH = 2_000_000  # tokens gathered in a task before they are dealt out
PART = 1_000_000  # tokens of a part that is counted in one task, about
HOT = 32  # sets of one key beside its largest component that are compared pair by pair
COMBINATIONS, LONGEST = 512, 10  # combinations of differences that a set of a family is indexed by, on average; tokens of one


def _tokens(rows: DataFrame, k: int, bits: int) -> DataFrame:
    """(part, once, more, times): every document's tokens, dealt by their first bits, as arrays of the next 32 bits.

    Tokens are counted before they are dealt: those that a task has gathered once are 4 bytes,
    the others 8, however often they occur.
    """
    import pandas as pd

    def run(batches):
        held, size = [], 0

        def out():
            h = np.sort(np.concatenate(held)) >> np.uint64(32 - bits)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n, h = np.diff(np.append(first, len(h))), h[first]
            part, low = (h >> np.uint64(32)).astype(np.int64), h.astype(np.uint32)
            made = []
            for p, at in zip(*_groups(part), strict=True):
                x, times = low[at], n[at]
                made.append((p, x[times == 1].tobytes(), x[times > 1].tobytes(), times[times > 1].astype(np.uint32).tobytes()))
            return pd.DataFrame(made, columns=["part", "once", "more", "times"])

        for b in batches:
            for text in b["text"]:
                held.append(shingles(text, k))
                size += len(held[-1])
                if size >= _FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return rows.select("text").mapInPandas(run, "part int, once binary, more binary, times binary")


def _groups(part: np.ndarray) -> tuple[list[int], list[slice]]:
    """The values of a sorted array and where each is."""
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[cut].tolist(), [slice(a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)]


def frequent_tokens(rows: DataFrame, k: int, work: Workspace, limit: int = FREQUENT) -> tuple[np.ndarray, int]:
    """The most frequent tokens' first bits, sorted, and how many low bits are cut off: what ``frequent_map`` holds, as a list."""
    bits, cut = frequent_map(rows, k, work, limit)
    return np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint64), cut


def frequent_map(rows: DataFrame, k: int, work: Workspace, limit: int = FREQUENT) -> tuple[np.ndarray, int]:
    """A map of bits with those of the most frequent tokens set, by their first bits, and how many low bits are cut off.

    Every token of every document is counted. The count travels as packed arrays, in parts of
    about PART tokens by the texts' counted bytes. The least frequency is the smallest power of
    two from LEAST on at which at most ``limit`` tokens are frequent.
    """
    import pandas as pd

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(20, (size // (6 * PART)).bit_length()))

    def count(key, blobs):
        once = [np.frombuffer(b, np.uint32) for b in blobs["once"]]
        more = [np.frombuffer(b, np.uint32) for b in blobs["more"]]
        low = np.concatenate([*once, *more])
        n = np.concatenate([np.ones(sum(map(len, once)), np.int64), *(np.frombuffer(b, np.uint32).astype(np.int64) for b in blobs["times"])])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        n, low = np.add.reduceat(n, first), low[first]
        on = n >= LEAST
        top = (np.uint64(key[0]) << np.uint64(32)) | low[on].astype(np.uint64)
        return pd.DataFrame({"q": top.astype(np.int64), "n": n[on]})

    found = work.write(_tokens(rows, k, bits).groupBy("part").applyInPandas(count, "q long, n long"), "frequent")
    levels = {r["level"]: r["n"] for r in found.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = 62, 0
    for level in sorted(levels, reverse=True):
        total += levels[level]
        if total > limit:
            break
        least = level

    width = max(16, min(MAP_BITS, (8 * sum(n for level, n in levels.items() if level >= least)).bit_length()))
    at = F.shiftright("q", 32 + bits - width)

    def pack(key, rows):
        blob = np.zeros(_BLOCK, np.uint8)
        blob[rows["low"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "blob": [np.packbits(blob, bitorder="little").tobytes()]})

    chosen = found.where(F.col("n") >= (1 << least)).select(F.floor(at / _BLOCK).alias("block"), (at % _BLOCK).cast("int").alias("low")).distinct()
    out = np.zeros((1 << width) // _BLOCK * (_BLOCK // 8), np.uint8)
    for r in chosen.groupBy("block").applyInPandas(pack, "block long, blob binary").collect():  # the map, 32 MB at most
        out[r["block"] * (_BLOCK // 8) : (r["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(r["blob"], np.uint8)
    return out, 64 - width


def prefix_keys(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The index keys of one sorted set of tokens, single ones first, and how many are single; often: which tokens are frequent."""
    n = len(tokens)
    rare, common = tokens[~often], tokens[often]
    least = -(-percent * n // 100)
    keys = rare[: n - least + 1]
    if len(rare) <= n - least and len(common) > 1:
        spare = n - len(rare) - least
        window = common[: 2 * spare + (100 - percent) * n // percent + 2]
        keys = np.concatenate((keys, mix64(window[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ window[1:])))
    return keys, min(len(rare), n - least + 1)


def _hash(h: np.ndarray, salt: int) -> int:
    return int(mix64(h ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def _profile(rows: DataFrame, k: int, percent: int, frequent: np.ndarray, cut: int) -> DataFrame:
    """id, and of each row's set: size n, hashes v and w, keys, and how many of these are single."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def start():
        often = shared.value

        def f(texts: list[str]):
            n, v, w, keys, singles = [], [], [], [], []
            for text in texts:
                h = shingles(text, k)
                n.append(len(h))
                v.append(_hash(h, 0))
                w.append(_hash(h, _SALT))
                q = h >> np.uint64(cut)
                found, single = prefix_keys(h, (often[q >> np.uint64(3)] >> (q & np.uint64(7)).astype(np.uint8) & 1).astype(bool), percent)
                keys.append(found.view(np.int64))
                singles.append(single)
            return n, v, w, keys, singles

        return f

    made = made_by(start, {"n": "long", "v": "long", "w": "long", "keys": "array<long>", "singles": "long"}, F.col("text"))
    return rows.select("id", made.alias("x")).select("id", "x.*", F.monotonically_increasing_id().alias("row"))


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(v, c): the smallest vertex of each vertex's component, for the vertices of the edges (a, b).

    Alternates large-star and small-star steps until nothing changes; each round is two
    aggregations with map-side partials and two joins, and is written to the shared folder.
    """
    at = work.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{name}0")
    mark, step = None, 0
    while True:
        both = at.select("a", "b").unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        at = work.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}{step}")
        now = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        work.drop(f"{name}{step - 1}")
        if now == mark:
            break
        mark = now
    roots = at.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct()
    return at.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(roots)


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that share as many keys as a link needs; t, a and l as above, o the overlap that their sizes need.

    The first o - max(t) + 1 shared tokens are in both sets' first n - t + 1 tokens. If one of
    them is rare, at least one and at least this number less the frequent ones among those
    tokens are shared single keys. Otherwise the first min(l) shared tokens are frequent and
    each unshared frequent token parts two of them at most: the rest are shared pair keys.
    """
    sides = [prefixes.select(F.col("v").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "singles", "keys"))) for x in ("a", "b")]
    both = pairs.join(sides[1], "b").join(sides[0], "a")
    both = both.withColumn("o", F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"))
    for x in ("a", "b"):
        both = both.withColumn(f"t_{x}", F.expr(f"({percent} * n_{x} + 99) div 100"))
        both = both.withColumn(f"open_{x}", F.expr(f"n_{x} - t_{x} + 1 - singles_{x}"))  # frequent tokens among the first
        both = both.withColumn(f"l_{x}", F.expr(f"n_{x} - singles_{x} - t_{x} + ({100 - percent} * n_{x}) div {percent} + 2"))
    single = F.size(F.array_intersect(F.expr("slice(keys_a, 1, singles_a)"), F.expr("slice(keys_b, 1, singles_b)")))
    double = F.size(F.array_intersect(F.expr("slice(keys_a, singles_a + 1, size(keys_a))"), F.expr("slice(keys_b, singles_b + 1, size(keys_b))")))
    rare = single >= F.expr("greatest(1, o - greatest(t_a, t_b) + 1 - greatest(0, least(open_a, open_b)))")
    common = F.expr("open_a > 0 AND open_b > 0") & (double >= F.expr("greatest(1, least(l_a, l_b) - 1 - (n_a - singles_a - o) - (n_b - singles_b - o))"))
    return both.where(rare | common).select("a", "b")  # no distinct: it would keep a hot first set in one task


def _sets(wanted: DataFrame, rows: DataFrame, reps: DataFrame, k: int, work: Workspace, name: str) -> DataFrame:
    """(v, tokens) of the wanted sets (v), made from the texts of their rows."""
    ids = work.write(wanted.join(reps, "v").select("rep").distinct(), f"{name}-ids")
    some = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, rows["id"] == ids["rep"], "left_semi")

    def sets(texts: list[str]):
        made = [shingles(t, k) for t in texts]
        return [_hash(h, 0) for h in made], [h.view(np.int64) for h in made]

    made = some.select(made_by(lambda: sets, {"v": "long", "tokens": "array<long>"}, F.col("text")).alias("x")).select("x.*")
    return work.write(made.dropDuplicates(["v"]), f"{name}-sets")


def _verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection. Only sets of rows in pairs are made, from their texts."""
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    made = _sets(ends, rows, reps, k, work, name)
    left = made.select(F.col("v").alias("b"), F.col("tokens").alias("tb"))
    right = made.select(F.col("v").alias("a"), F.col("tokens").alias("ta"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("o"))
    return both.where(F.lit(100).cast("long") * F.col("o") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _combined(batches, percent: int):
    """(bucket, level, top, v, g, c, far): combinations of each set's differences, in the order of the family.

    A pair that needs ``level`` of them is found by combinations of that many of all differences; one that needs more than the
    family's longest, by combinations of its first ones: all but as many as it needs beyond.
    """
    scale = 2 * (100 + percent)
    for b in batches:
        out = {"bucket": [], "level": [], "top": [], "v": [], "g": [], "c": [], "far": [], "side": []}
        sides = b.column("side").to_pylist() if "side" in b.schema.names else [0] * b.num_rows
        for fam, v, g, c, far, other, longest, tokens, side in zip(*(b.column(x).to_pylist() for x in ("fam", "v", "g", "c", "far", "other", "longest", "tokens")), sides, strict=True):
            least = max(1, -(-(g + other) // scale))  # differences that any pair of this set shares, if it links
            for level in range(min(least, longest), longest + 1):
                some = tokens if level < longest else tokens[: len(tokens) - max(least, level) + level]
                if len(tokens) < max(least, level) or len(some) < level:
                    continue
                found = np.array(list(combinations(some, level)), np.int64).view(np.uint64)
                h = np.full(len(found), (fam ^ level) & 0xFFFFFFFFFFFFFFFF, np.uint64)
                for j in range(level):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ found[:, j])
                out["bucket"] += h.view(np.int64).tolist()
                for name, x in (("level", level), ("top", longest), ("v", v), ("g", g), ("c", c), ("far", far), ("side", side)):
                    out[name] += [x] * len(found)
        kinds = {"level": pa.int32(), "top": pa.int32(), "far": pa.bool_(), "side": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(name, pa.int64())) for name, x in out.items()], list(out))


def _asked(told: DataFrame, scale: int) -> DataFrame:
    """fam, v, g, c, far, other, longest, tokens, side: each set (fam, v, c, g, low, far, tokens) once for each class of G that it may meet.

    ``fam`` names family and pair of classes, ``other`` is the class's least G, and ``longest`` the tokens of a combination: not more than
    any pair of the two classes needs, and so few that a set has COMBINATIONS combinations in all on average. Sides are opposite numbers, 0 within a class.
    Of a set's tokens those go that no set of the other class has.
    """
    told = told.withColumn("i", F.floor(2 * F.log2(1 + (F.col("g") - F.col("low")) / scale)).cast("int"))  # some 2 log2 of the greatest need
    flat = told.select("fam", "v", "i", F.posexplode("tokens").alias("p", "t"))
    held = flat.groupBy("fam", "t").agg(F.expr("bit_or(shiftleft(1L, i))").alias("held"))  # the classes of sets that have it
    lists = flat.join(held, ["fam", "t"]).groupBy("fam", "v").agg(F.array_sort(F.collect_list(F.struct("p", "t", "held"))).alias("tokens"))
    told = told.drop("tokens").join(lists, ["fam", "v"])
    classes = told.groupBy("fam", "i").agg(F.min("g").alias("other"), F.max("far").alias("any"))
    classes = classes.groupBy("fam").agg(F.count(F.lit(1)).alias("k"), F.collect_list(F.struct(F.col("i").alias("j"), "other", "any")).alias("to"))
    each = told.join(classes, "fam").withColumn("to", F.explode("to")).select("*", "to.*").where("far OR any")  # two sets that aren't far are joined by the star
    each = each.withColumn("tokens", F.expr("transform(filter(tokens, z -> (shiftright(z.held, j) & 1L) = 1L), z -> z.t)"))
    each = each.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("other")) / scale)))
    each = each.where(F.size("tokens") >= F.col("need")).select("*", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    spare = F.size("tokens").cast("double") - F.col("need")
    ways = [reduce(lambda w, n: w * (spare + j - n) / (n + 1), range(j), F.lit(1.0)) for j in range(1, LONGEST + 1)]
    figures = each.groupBy("fam", "x", "y").agg(F.min("need").alias("least"), *(f(w).alias(f"{name}{j}") for j, w in enumerate(ways, 1) for f, name in ((F.avg, "w"), (F.max, "m"))))
    fits = lambda j: (F.col("least") >= j) & (F.col(f"w{j}") * F.col("k") <= COMBINATIONS) & (F.col(f"m{j}") <= COMBINATIONS * 128)
    figures = figures.join(classes.select("fam", "k"), "fam")
    figures = figures.select("fam", "x", "y", F.greatest(*(F.when(fits(j), F.lit(j)).otherwise(1) for j in range(1, LONGEST + 1))).alias("longest"))
    met = each.join(figures, ["fam", "x", "y"])
    return met.select(F.xxhash64("fam", "x", "y").alias("fam"), "v", "g", "c", "far", "other", "longest", "tokens", F.signum(F.col("j") - F.col("i")).cast("int").alias("side"))


def _family_links(hot: DataFrame, labels: DataFrame, rows: DataFrame, reps: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """Links (a, b) that join the components of the sets (key, v) of hot keys: as many as join what is linked, not all of them."""
    ends = hot.groupBy("key").agg(F.min("v").alias("b"))
    fam = components(hot.join(ends, "key").select(F.col("v").alias("a"), "b"), work, "f").select("v", F.col("c").alias("fam"))
    sets = work.write(_sets(fam.select("v"), rows, reps, k, work, "crowd").join(fam, "v").join(labels, "v", "left").select("v", "fam", F.coalesce("c", "v").alias("c"), "tokens"), "family-sets")
    size = sets.groupBy("fam").agg(F.count(F.lit(1)).alias("m"))
    often = sets.select("fam", F.explode("tokens").alias("t")).groupBy("fam", "t").agg(F.count(F.lit(1)).alias("x")).join(size, "fam").where(F.col("x") * 2 > F.col("m"))
    cores = work.write(often.groupBy("fam").agg(F.collect_list("t").alias("core")), "cores")  # twice a mean set at most
    small = (cores.agg(F.sum(F.size("core"))).first()[0] or 0) <= BROADCAST_IDS
    apart = sets.join(F.broadcast(cores) if small else cores, "fam", "left")
    core = F.coalesce("core", F.array().cast("array<long>"))
    differences = F.concat(F.array_except("tokens", core), F.array_except(core, "tokens"))
    g = F.lit(100 + percent).cast("long") * F.size("ds") - F.lit(100 - percent).cast("long") * F.col("n")
    told = apart.select("fam", "v", "c", F.size("tokens").alias("n"), differences.alias("ds")).withColumn("g", g)
    told = work.write(told.select("fam", "v", "c", "g", "ds"), "differences")

    # a star for the links that need nothing in common
    least = told.groupBy("fam").agg(F.min(F.struct("g", "v")).alias("x")).select("fam", F.col("x.g").alias("low"), F.col("x.v").alias("centre"))
    told = told.join(least, "fam").withColumn("far", (F.col("g") + F.col("low") > 0) & (F.col("v") != F.col("centre")))
    star = told.where(~F.col("far") & (F.col("v") != F.col("centre"))).select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b"))

    # differences that two sets of different components can have in common, rare ones first
    each = told.select("fam", "v", "c", F.explode("ds").alias("t"))
    shared = each.groupBy("fam", "t").agg(F.count(F.lit(1)).alias("x"), F.min("c").alias("one"), F.max("c").alias("other")).where("one < other").drop("one", "other")
    tokens = each.drop("c").join(shared, ["fam", "t"]).groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "t"))), lambda z: z["t"]).alias("tokens"))
    told = work.write(told.drop("ds").join(tokens, "v").select("fam", "v", "c", "g", "low", "far", "tokens"), "told")
    scale = 2 * (100 + percent)
    buckets = work.write(_asked(told, scale).mapInArrow(partial(_combined, percent=percent), "bucket long, level int, top int, v long, g long, c long, far boolean, side int"), "buckets")
    # sets of one bucket share ``level`` differences: who needs no more links, by a star
    centres = buckets.groupBy("bucket", "level").agg(F.min(F.struct("g", "v", "c")).alias("y"), F.count(F.lit(1)).alias("m")).where("m > 1")
    within = buckets.join(centres, ["bucket", "level"]).where((F.col("v") != F.col("y.v")) & (F.col("c") != F.col("y.c")) & (F.col("g") + F.col("y.g") <= scale * F.col("level"))).select(F.least("v", "y.v").alias("a"), F.greatest("v", "y.v").alias("b"))
    # who needs more is compared with those of the other class, within the bucket
    one, two = buckets.alias("p"), buckets.alias("q")
    beyond = one.join(two, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.v") < F.col("q.v")) & (F.col("p.side") + F.col("q.side") == 0) & (F.col("p.c") != F.col("q.c")) & (F.col("p.far") | F.col("q.far")) & (F.col("p.g") + F.col("q.g") > scale * F.col("p.level"))).select(F.col("p.v").alias("a"), F.col("q.v").alias("b"))
    pairs = work.write(within.unionByName(beyond).distinct(), "family-pairs")
    side = lambda x: told.select(F.col("v").alias(x), F.col("g").alias(f"g{x}"), F.col("tokens").alias(f"t{x}"))
    exact = pairs.join(side("a"), "a").join(side("b"), "b").where(scale * F.size(F.array_intersect("ta", "tb")) >= F.col("ga") + F.col("gb"))
    return work.write(star.unionByName(exact.select("a", "b")), "family-links")


def _near(x: str, y: str, percent: int):
    """Whether two rows of one key may link, by sizes n and by f, the most tokens that they can share with others."""
    share = F.least(f"{x}f", f"{y}f")
    return F.lit(100) * share >= F.lit(percent) * (F.col(f"{x}n") + F.col(f"{y}n") - share)


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links of Jaccard percent/100 or more.

    Rows with equal sets are one class, named by a 64-bit hash of the set; candidates come from
    the index of prefix keys and are verified exactly. Where many classes share a key, they are
    first compared with two members (the one with the fewest rare tokens, and the one with the
    largest name), and afterwards only members of different components are compared, all of
    them: no link between components is missed, and a group of near copies isn't expanded into
    its pairs. Where a key has more than ``hot`` sets beside its largest component, these are compared by
    their differences to what most of them have in common.

    Null and empty texts have size 0 and are alone. A row with a null id gets component_id
    null and links nothing. A row that is repeated, with its id, gets its result each time, with
    another text too. Very long texts are hashed in blocks. An empty table gives an empty table.
    Extra columns aren't read; ids can be of any type that has an order.
    """
    work = Workspace(docs.sparkSession, "ngram")
    rows = docs.select(docs[quoted(id)].alias("id"), text_of(docs, text).alias("text"))
    often, cut = frequent_map(rows, k, work)
    work.drop("frequent")
    work.tidy()
    seen = work.write(_profile(rows, k, percent, often, cut), "profile")

    known = seen.where("id IS NOT NULL AND n > 0")
    # class: equal sets; only tables without texts and keys are grouped here. One row stands for each
    reps = known.groupBy("v", "w").agg(F.min("id").alias("rep"), F.min_by("row", "id").alias("row"))
    reps = work.write(reps, "reps")
    firsts = known.select("row", "v", "n", "keys", "singles").join(reps.select("row"), "row", "left_semi")
    # made before the keys are exploded: beside them it would be made again for every key
    few = F.expr(f"slice(array_sort(slice(keys, CAST(singles AS INT) + 1, size(keys))), 1, {FIRST})")
    firsts = work.write(firsts.select("v", "n", "keys", "singles", few.alias("few")), "prefixes")
    # a key of two frequent tokens matters only to sets that share no rare token: these share at most
    # f = n - r tokens; a single key says nothing, f = n
    keyed = firsts.select("v", "n", "singles", F.posexplode("keys").alias("p", "key"))
    keyed = keyed.select("key", "v", "n", F.when(F.col("p") < F.col("singles"), F.col("n")).otherwise(F.col("n") - F.col("singles")).alias("f"))
    # keys of a single class go. The aggregate has partials, so that a hot key isn't gathered, and the join
    # can be split. Of a group of near copies the first one is the nearest to what they were made from
    ends = keyed.groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("hi"), F.min_by("v", F.col("n") - F.col("f")).alias("lo")).where("least < hi")
    ends = work.write(ends.select("key", "lo", "hi"), "ends")
    index = work.write(keyed.join(ends, "key"), "index")
    work.drop("ends")
    work.tidy()

    sizes = firsts.select("v", "n")
    edges, tried = None, None
    for step, pivot in enumerate(("lo", "hi")):
        pairs = index.where(F.col("v") != F.col(pivot)).select("v", "n", "f", pivot).groupBy("v", "n", pivot).agg(F.max("f").alias("f"))
        pairs = pairs.join(sizes.select(F.col("v").alias(pivot), F.col("n").alias("m")), pivot)
        pairs = pairs.where(F.lit(100) * F.least("f", "m") >= F.lit(percent) * (F.col("n") + F.col("m") - F.least("f", "m")))
        pairs = pairs.select(F.least("v", pivot).alias("a"), F.greatest("v", pivot).alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = work.write(pairs, f"pairs{step}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = work.write(_promising(pairs, firsts, percent), f"good{step}")
        links = work.write(_verify(good, rows, reps, k, percent, work, f"v{step}"), f"links{step}")
        work.drop(f"v{step}-sets")
        work.tidy()
        edges = links if edges is None else edges.unionByName(links)
    labels = work.write(components(edges, work, "c"), "labels")

    # what is left: members of one key in different components, other than its largest one
    named = index.select("key", "v", "n", "f").join(labels, "v", "left").select("key", "v", "n", "f", F.coalesce("c", "v").alias("c"))
    named = work.write(named, "named")
    share = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    main = share.groupBy("key").agg(F.count(F.lit(1)).alias("cs"), F.max_by("c", F.struct("m", "c")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).where("cs > 1")
    main = work.write(main, "main")
    crowd = named.join(main.where(F.col("others") > hot).select("key"), "key").select("key", "v")
    crowded = bool(crowd.take(1))
    split = named.join(main.where(F.col("others") <= hot), "key").join(firsts.select("v", "singles", "few"), "v")
    split = work.write(split.select("key", "v", "n", "f", F.when(F.col("f") < F.col("n"), F.col("few")).alias("few"), "c", "main"), "split")
    one = split.where("c != main").select("key", F.struct("v", "n", "f", "c", "few").alias("x"))
    two = split.select("key", F.struct("v", "n", "f", "c", "few").alias("y"), "main")
    once = F.coalesce(F.array_min(F.array_intersect("x.few", "y.few")) == one["key"], F.lit(True))
    rest = one.join(two, (one["key"] == two["key"]) & (F.col("x.c") != F.col("y.c")) & _near("x.", "y.", percent) & ((F.col("y.c") == F.col("main")) | (F.col("x.v") < F.col("y.v"))) & once)
    rest = rest.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = work.write(rest, "rest")
    good = work.write(_promising(rest, firsts, percent), "good2")
    links = work.write(_verify(good, rows, reps, k, percent, work, "v2"), "links2")
    work.drop("v2-sets")
    links = links.unionByName(_family_links(crowd, labels, rows, reps, k, percent, work)) if crowded else links
    final = work.write(components(edges.unionByName(links), work, "d"), "final")

    named = work.write(reps.join(final, "v", "left").select("v", "w", "rep", F.coalesce("c", "v").alias("c")), "classes")
    smallest = named.groupBy("c").agg(F.min("rep").alias("comp"))
    named = named.join(smallest, "c").select("v", "w", "comp")
    out = seen.select("id", "n", "v", "w").join(named, ["v", "w"], "left")
    comp = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), comp.alias("component_id"))
