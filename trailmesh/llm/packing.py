"""Operator 2: packing by cutting-stock column generation.

The driver only sees the histogram of piece lengths (at most ``size`` numbers). A linear
program over patterns of lengths is solved by column generation: a knapsack dynamic program
prices columns, rounded-down patterns are repeated, and what rounding leaves (a few pieces
for each length) is packed by best fit. Documents, ranked within their length, are assigned
to the patterns' slots without meeting in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, made_by, map_rows, quoted, text_of
from .tokens import default_path, tokenizer

SIZE = 1024
GAP = 1e-3  # column generation ends when the plan is proven within this share of the optimum
END = 0  # the id that ends every document


def padded(fill: int, size: int = SIZE) -> int:
    """Length of a sequence with so many ids: as it is at a power of two, else ``size``."""
    return fill if fill and fill & (fill - 1) == 0 else size


class _Pricing:
    """Best pattern for given worths of lengths: unbounded knapsack over exact fills."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
        self.costs = np.array([0, *(padded(c, size) for c in range(1, size + 1))], float)

    def best(self, worth: np.ndarray) -> tuple[float, np.ndarray, int, float]:
        """The greatest gain of a pattern's worth over its cost, that pattern, its fill, and the greatest ratio of worth to cost."""
        f, choice = np.full(self.size + 1, -np.inf), np.full(self.size + 1, -1)
        f[0] = 0
        for c in range(1, self.size + 1):
            k = self.upto[c]
            if k:
                gain = worth[:k] + f[c - self.lengths[:k]]
                choice[c] = j = int(gain.argmax())
                f[c] = gain[j]
        ratio = float((f[1:] / self.costs[1:]).max())
        gain = f - self.costs
        gain[0] = -np.inf
        fill = c = int(gain.argmax())
        pattern = np.zeros(len(self.lengths))
        while c:
            pattern[choice[c]] += 1
            c -= self.lengths[choice[c]]
        return gain[fill], pattern, fill, ratio


def _start(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to begin with: patterns by greatest length and exact complements, each using up the length of its row.

    No pattern holds a length that an earlier one has used up, so the basis is triangular.
    """
    m, left = len(lengths), np.zeros(size + 1)
    left[lengths] = counts
    row = {int(k): i for i, k in enumerate(lengths)}
    basis, x, done = np.zeros((m, m)), np.zeros(m), set()
    while len(done) < m:
        live = left > 0
        if not live.any():
            break
        first = int(np.flatnonzero(live)[-1])
        room, items = size - first, [first]
        while room and live[: room + 1].any():
            if not live[room]:
                a = np.flatnonzero(live[: room + 1] & live[room::-1])
                if len(a):  # the pair that lasts longest
                    k = int(a[np.minimum(left[a], left[room - a]).argmax()])
                    items += [k, room - k]
                    break
            items.append(int(np.flatnonzero(live[: room + 1])[-1]))
            room -= items[-1]
        uses = Counter(items)
        times, end = min((left[k] / n, k) for k, n in uses.items())
        for k, n in uses.items():
            left[k] = max(0.0, left[k] - times * n)
            basis[row[k], row[end]] = n
        left[end] = 0
        for k in uses:
            if 0 < left[k] < 1e-9:
                left[k] = 0
        x[row[end]] = times
        done.add(end)
    for k in set(row) - done:  # used up together with another
        basis[row[k], row[k]] = size // k
    return basis, x


def solve(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Basis of patterns (columns), how often each is used (fractions) for least total padded size, and a proven lower bound of it.

    Columns are priced, at least once, until the total is within ``gap`` of the bound, no
    column gains, or 2 columns for each length were priced. The bound is the number of ids or,
    if greater, what the worths prove: scaled down by the greatest ratio of worth to cost, they
    are within every pattern's cost.
    """
    price, m = _Pricing(lengths, size), len(lengths)
    basis, x = _start(lengths, counts, size)
    cost = np.array([padded(int(f), size) for f in lengths @ basis], float)
    inverse = np.linalg.inv(basis)
    bound = float(counts @ lengths)
    for step in range(2 * m):
        if step and step % 256 == 0:
            inverse = np.linalg.inv(basis)
        worth = cost @ inverse
        gain, pattern, fill, ratio = price.best(worth)
        if ratio > 0:
            bound = max(bound, float(worth @ counts) / ratio)
        if cost @ x <= (1 + gap) * bound or gain <= 1e-9:
            break
        d = inverse @ pattern
        on = d > 1e-9
        r = int(np.where(on, x / np.where(on, d, 1), np.inf).argmin())
        times = x[r] / d[r]
        x = np.maximum(x - times * d, 0)
        x[r] = times
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        basis[:, r], cost[r] = pattern, padded(fill, size)
    return basis, x, bound


def _best_fit(left: Counter, size: int) -> list[tuple[int, ...]]:
    """Sequences for what rounding leaves: largest first, exact complements preferred, else best fit."""
    made = []
    while left:
        room, items = size, []
        while left:
            have = sorted(k for k, n in left.items() if n and k <= room)
            if not have:
                break
            take = have[-1]
            if items and take != room:
                for a in have:  # two that fill the room
                    b = room - a
                    if b >= a and left.get(b, 0) > (a == b):
                        take = b
                        break
            items.append(take)
            room -= take
            left[take] -= 1
            if not left[take]:
                del left[take]
        made.append(tuple(items))
    return made


def plan(histogram: dict[int, int], size: int = SIZE, gap: float = GAP) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many such sequences), covering the histogram exactly."""
    kept = {k: n for k, n in sorted(histogram.items()) if 0 < k < size and n > 0}
    if not kept:
        return []
    lengths, counts = np.array(list(kept)), np.array(list(kept.values()))
    basis, x, _ = solve(lengths, counts.astype(float), size, gap)
    out: Counter = Counter()
    left = counts.astype(np.int64)
    for p, times in zip(basis.T, np.floor(x + 1e-7).astype(np.int64), strict=True):
        whole = p.astype(np.int64)
        fits = min((int(left[i] // whole[i]) for i in np.flatnonzero(whole)), default=0)
        if (times := min(int(times), fits)) > 0:
            left -= times * whole
            out[tuple(int(k) for k in np.repeat(lengths, whole)[::-1])] += times
    for items in _best_fit(Counter({int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}), size):
        out[items] += 1
    return sorted(out.items(), reverse=True)


class Slots:
    """Where the piece of a given length and rank goes: (sequence, offset)."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]]):
        self.of: dict[int, list[list[int]]] = {}
        rank, base = Counter(), 0
        for items, times in chosen:
            at = 0
            for k, n in Counter(items).items():
                self.of.setdefault(k, []).append([rank[k], base, n, at])
                rank[k] += n * times
                at += k * n
            base += times
        self.sequences = base
        self.table = {k: np.array(v, np.int64).T for k, v in self.of.items()}

    def place(self, length: int, rank: int) -> tuple[int, int]:
        first, base, each, at = self.table[length]
        j = int(np.searchsorted(first, rank, side="right")) - 1
        q = rank - int(first[j])
        return int(base[j]) + q // int(each[j]), int(at[j]) + q % int(each[j]) * length


def pack(docs: DataFrame, size: int = SIZE, gap: float = GAP, text: str = "text", id: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with END. It is cut after every ``size`` ids; full pieces are
    sequences of their own, and the last pieces are packed whole. Null and empty texts are
    the single id END. Rows are documents: a repeated row and a row with a null id are packed
    too. Rows of a length are ranked by id, then by their ids' checksums; rows that tie in these
    are equal in all that is returned but their places. A very long text has as many pieces as it
    fills. An empty table gives no rows. Other columns aren't read; only texts go to Python.
    """
    path = path or default_path()
    work = Workspace(docs.sparkSession, "pack")

    def start():
        ids_of = tokenizer(path).ids

        def f(texts: list[str]):
            total, crcs = [], []
            for t in texts:
                ids = np.array([*ids_of(t), END], "<u4")
                total.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + size].tobytes()) for i in range(0, len(ids), size)])
            return total, crcs

        return f

    made = docs.select(docs[quoted(id)].alias("id"), made_by(start, {"total": "long", "crcs": "array<long>"}, text_of(docs, text)).alias("x"))
    made = made.select("id", "x.total", "x.crcs", (F.col("x.total") % size).cast("int").alias("rest"))
    made = work.write(made, "pieces")
    found = made.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("crcs")).alias("most")).collect()  # at most ``size`` rows
    histogram = {r["rest"]: r["n"] for r in found}
    slots = Slots(plan(histogram, size, gap))

    # a length's documents are ranked in cells, so that a frequent length isn't one task's
    most, total = max(histogram.values(), default=1), max(1, sum(histogram.values()))
    cells = min(1024, -(-1024 * most // total) + 1)
    made = made.withColumn("cell", F.pmod(F.xxhash64("id", "total", "crcs"), F.lit(cells)).cast("int"))
    counts = made.groupBy("rest", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most size * 1024 rows, whatever the input
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rest").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("rest", "cell", before.alias("before"))
    ranked = made.withColumn("nth", F.row_number().over(Window.partitionBy("rest", "cell").orderBy("id", "crcs")))
    ranked = ranked.join(F.broadcast(counts), ["rest", "cell"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def place():
        def f(rests: list[int], ranks: list[int]):
            found = [slots.place(k, r) if k else (None, None) for k, r in zip(rests, ranks, strict=True)]
            return [s for s, _ in found], [o for _, o in found]

        return f

    first = dict(zip(sorted(histogram), np.concatenate(([0], np.cumsum([histogram[k] for k in sorted(histogram)])))[:-1].tolist(), strict=True)) if histogram else {}
    width = max((r["most"] for r in found), default=1)
    number = F.create_map(*(F.lit(x) for kv in first.items() for x in kv)) if first else F.create_map(F.lit(0), F.lit(0))
    ranked = ranked.select("id", "total", "crcs", "rest", "rank", F.col("rest").alias("r"), (F.element_at(number, F.col("rest")).cast("long") + F.col("rank")).alias("nth"))
    placed = map_rows(ranked, ["r", "rank"], place, {"sequence": "long", "at": "long"})
    piece = placed.select("id", "total", "rest", "sequence", "at", "nth", F.posexplode("crcs").alias("p", "ids_crc32"))
    full = (F.col("p") + 1) * F.lit(size) <= F.col("total")
    return piece.select(
        F.col("id").alias(id),
        (F.col("p").cast("long") * size).alias("start"),
        F.when(full, F.lit(size)).otherwise(F.col("rest")).cast("long").alias("length"),
        "ids_crc32",
        F.col("total").alias("doc_tokens"),
        F.when(full, F.lit(slots.sequences).cast("long") + F.col("nth") * width + F.col("p")).otherwise(F.col("sequence")).alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("at")).cast("long").alias("offset"),
    )
