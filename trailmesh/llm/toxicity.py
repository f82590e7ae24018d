"""Operator 3: toxicity by a character n-gram linear classifier over naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, made_by, map_rows, quoted, ready, text_of

BITS = 18  # n-grams are hashed to 2**BITS features
GRAMS = (3, 4, 5, 6)
FEATURES = 1024  # features with the strongest ratios that enter the classifier
SAMPLE = 12_000  # labelled rows that are learnt from, about, at most
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = [np.uint64(pow(0x100000001B3, i, 1 << 64)) for i in range(max(GRAMS))]


def grams(text: str, bits: int = BITS) -> list[np.ndarray]:
    """Feature numbers of every character n-gram of the whole text, lower-cased, runs of white space as one space."""
    flat = f" {' '.join(text.lower().split())} "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], c
    for i in range(1, max(GRAMS)):
        if len(c) <= i:
            break
        h = h[:-1] + c[i:] * _STEP[i]
        if i + 1 in GRAMS:
            out.append((((h ^ (h >> np.uint64(29)) ^ np.uint64(i)) * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
    return out


class Marks:
    """Which features a text has; one array a worker, cleared after each text."""

    def __init__(self, bits: int = BITS):
        self.seen = np.zeros(1 << bits, bool)

    def of(self, text: str, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sorted features present, or whether each wanted one is."""
        found = grams(text)
        for g in found:
            self.seen[g] = True
        out = np.flatnonzero(self.seen) if wanted is None else self.seen[wanted]
        for g in found:
            self.seen[g] = False
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 150) -> np.ndarray:
    """L2-regularised logistic regression by L-BFGS; the last weight is the bias, which isn't penalised."""
    n, k = x.shape
    sign = np.where(y, 1.0, -1.0)
    penalty = np.append(np.full(k, strength), 0.0) / n

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (x @ w[:-1].astype(x.dtype) + w[-1])
        s = -sign * np.exp(-np.logaddexp(0, z)) / n
        return np.logaddexp(0, -z).mean() + 0.5 * (penalty * w) @ w, np.append(x.T @ s.astype(x.dtype), s.sum()) + penalty * w

    w = np.zeros(k + 1)
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(grad).max() < 1e-6:
            break
        q, alphas = grad.copy(), []
        for s, g in reversed(past):
            alphas.append(a := (s @ q) / (s @ g))
            q -= a * g
        if past:
            s, g = past[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        rate = 1.0 if past else 1 / max(1.0, np.abs(grad).sum())
        for _ in range(30):
            nxt = w - rate * q
            new, slope = f(nxt)
            if new <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        if (nxt - w) @ (slope - grad) > 1e-12:
            past = [*past[-9:], (nxt - w, slope - grad)]
        w, value, grad = nxt, new, slope
    return w


@dataclass
class Model:
    wanted: np.ndarray  # features
    weights: np.ndarray  # their ratios times the classifier's weights
    bias: float

    def scorer(self):
        marks = Marks()

        def score(text: str) -> float:
            z = float(self.weights[marks.of(text, self.wanted)].sum()) + self.bias
            return float(1 / (1 + np.exp(-min(max(z, -500), 500))))

        return score


def train(docs: DataFrame, labels: DataFrame, work: Workspace, sample: int = SAMPLE, text: str = "text", id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from rows of ``docs`` with a label, those with the smallest hashes of their ids if over ``sample``.

    The log-count ratio of each n-gram (documents that hold it, by class) selects and scales
    FEATURES features; a logistic regression weighs them. Without both classes the model
    scores every text near the only label known, near 0 without labels. Null labels and ids
    aren't learnt from; an id with both labels counts as toxic; a row repeated with its id is
    learnt from each time. Null and empty texts have the n-grams of two spaces: none.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    # the sample is bounded, so it is broadcast
    rows = docs.select(docs[id].alias("id"), text_of(docs, text).alias("__text")).join(F.broadcast(known), "id").select("y", "__text")
    rows = work.write(rows.repartition(12), "sample")

    def counts(batches):
        import pandas as pd

        n, marks = np.zeros((2, 1 << BITS), np.int64), Marks()
        for b in batches:
            for y, t in zip(b["y"], b["__text"], strict=True):
                n[y, marks.of(t)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"g": at, "n0": n[0, at], "n1": n[1, at]})

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), 30.0 if sizes.get(1) else -30.0)
    n0, n1 = float(sizes[0]), float(sizes[1])
    found = rows.mapInPandas(counts, "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 5")
    ratio = F.log(((F.col("n1") + 1) / (n1 + 2)) / ((F.col("n0") + 1) / (n0 + 2)))
    spread = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    top = found.select("g", ratio.alias("r"), F.abs(ratio / spread).alias("z")).orderBy(F.desc("z"), "g").limit(FEATURES).toPandas()
    wanted, r = top["g"].to_numpy(np.int64), top["r"].to_numpy(float)

    def start():
        marks = Marks()
        return lambda texts: ([np.packbits(marks.of(t, wanted)).tobytes() for t in texts],)

    seen = map_rows(rows, ["__text"], start, {"bits": "binary"}).toPandas()  # FEATURES / 8 bytes a row
    x = np.unpackbits(np.frombuffer(b"".join(map(bytes, seen["bits"])), np.uint8).reshape(len(seen), -1), axis=1)[:, : len(wanted)]
    w = fit_logistic(x.astype(np.float32) * r.astype(np.float32), seen["y"].to_numpy() > 0)
    return Model(wanted, w[:-1] * r, float(w[-1]))


def held_out(id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_split(docs: DataFrame, labels: DataFrame, work: Workspace, **named) -> Model:
    """A model that has only seen labels outside the held-out fifth."""
    return train(docs, labels.where(~held_out(labels["doc_id"])), work, **named)


def _scores(docs: DataFrame, model: Model, text: str) -> F.Column:
    def start():
        score = model.scorer()
        return lambda texts: ([score(t) for t in texts],)

    return made_by(start, {"score": "double"}, text_of(docs, text))["score"]


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1 of their whole text (null: empty) as one more column.

    No other column is an input; only texts go to Python. Repeated rows and null ids are scored
    like others, very long texts as a whole. An empty table stays empty. A column that is called
    ``name`` already is replaced, others pass whatever they are called.
    """
    ready(docs.sparkSession)
    (own,) = fresh(docs, "score")
    scored = docs.select(*(docs[quoted(c)] for c in docs.columns if c.lower() != name.lower()), _scores(docs, model, text).alias(own))
    return scored.withColumnRenamed(own, name)


def reject_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score under ``limit``, with their columns, whatever these are called."""
    ready(docs.sparkSession)
    (own,) = fresh(docs, "score")
    return docs.select(*(docs[quoted(c)] for c in docs.columns), _scores(docs, model, text).alias(own)).where(F.col(own) < limit).drop(own)
