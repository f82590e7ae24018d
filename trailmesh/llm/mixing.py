"""Operator 9: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, quoted, text_of

DIMENSIONS = ("source", "lang", "topic")
#: A margin's target share is its share of words to this power, normalised: under 1 flattens.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 12  # at most
TOLERANCE = 1e-12  # of all words
BUDGET = 0.7  # of all words
DRIVER_CELLS = 100_000  # cells that are fitted on the driver; more are fitted as tables


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A coarse lexical topic: table, note (under 50 words), long (2,000 and more) or article."""
    return F.when(text.contains(" | "), "table").when(words < 50, "note").when(words >= 2000, "long").otherwise("article")


def shares_of(words: pd.Series, power: float, named: dict[str, float] | None) -> pd.Series:
    """Target shares of a margin's values (index), from the words of each.

    Named values have the shares given; the others share what is left of 1 by their words to the
    power. If nothing else is there, or the named shares are over 1 together, all are scaled to 1.
    """
    share = words.astype(float) ** power
    if named:
        on = share.index.isin(list(named))
        rest, out = max(0.0, 1 - sum(named[v] for v in share.index[on])), share.copy()
        out[on] = [named[v] for v in share.index[on]]
        out[~on] = share[~on] / share[~on].sum() * rest if (~on).any() else 0
        share = out
    return share / share.sum()


def rake(cells: pd.DataFrame, flatten: dict[str, float] = FLATTEN, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> tuple[np.ndarray, float]:
    """Words of each cell raked to the margins' targets, and the greatest difference left between a margin's share and its target.

    ``cells`` has the dimensions and ``t`` (words, over 0). Ends when the margins are met to
    TOLERANCE, after ``rounds`` at most.
    """
    total, w = cells["t"].sum(), cells["t"].to_numpy(float)
    goal = {d: cells[d].map(shares_of(cells.groupby(d)["t"].sum(), power, (targets or {}).get(d)) * total).to_numpy(float) for d, power in flatten.items()}
    error = np.inf
    for _ in range(rounds):
        for d in flatten:
            w = w * goal[d] / pd.Series(w).groupby(cells[d].to_numpy()).transform("sum").to_numpy()
        error = max(float(np.abs(pd.Series(w).groupby(cells[d].to_numpy()).transform("sum").to_numpy() - goal[d]).max() / total) for d in flatten)
        if error <= TOLERANCE:
            break
    return w, error


def fill_level(factor: np.ndarray, t: np.ndarray, budget: float) -> float:
    """The scale s at which the words kept, sum of t min(1, s factor), are ``budget`` of all."""
    order = np.argsort(-factor, kind="stable")
    f, t = factor[order], t[order].astype(float)
    full = np.concatenate(([0.0], np.cumsum(t)[:-1]))
    rest = np.cumsum((t * f)[::-1])[::-1]
    s = np.maximum(budget * t.sum() - full, 0) / rest
    fits = np.flatnonzero(s * f <= 1)
    return float(s[fits[0]]) if len(fits) else float(1 / f[-1])


def _rake_tables(cells: DataFrame, flatten: dict[str, float], rounds: int, budget: float, targets: dict[str, dict[str, float]] | None, work: Workspace) -> DataFrame:
    """The same on tables, for more cells than the driver should hold; the scale by bisection. A margin's values (not their cells) are held by the driver."""
    total = cells.agg(F.sum("t")).first()[0]
    at = cells.withColumn("w", F.col("t").cast("double"))
    for d, power in flatten.items():
        words = cells.groupBy(d).agg(F.sum("t").alias("t")).toPandas().set_index(d)["t"]
        goal = (shares_of(words, power, (targets or {}).get(d)) * total).rename(f"target_{d}").rename_axis(d).reset_index()
        at = at.join(cells.sparkSession.createDataFrame(goal), d)
    at = work.write(at, "rake0")
    for k in range(rounds):
        for d in flatten:
            at = at.join(at.groupBy(d).agg(F.sum("w").alias("now")), d).withColumn("w", F.col("w") * F.col(f"target_{d}") / F.col("now")).drop("now")
        at = work.write(at, f"rake{k + 1}")
        work.drop(f"rake{k}")
        left = [at.groupBy(d).agg((F.abs(F.sum("w") - F.first(f"target_{d}")) / total).alias("e")).agg(F.max("e")).first()[0] for d in flatten]
        if max(left) <= TOLERANCE:
            break
    f = F.col("w") / F.col("t")
    low, high = 0.0, 1 / at.agg(F.min(f)).first()[0]
    for _ in range(60):
        mid = (low + high) / 2
        kept = at.agg(F.sum(F.col("t") * F.least(F.lit(1.0), mid * f))).first()[0]
        low, high = (mid, high) if kept < budget * total else (low, mid)
    return at.select(*flatten, F.least(F.lit(1.0), F.lit(high) * f).alias("probability"))


def mix(
    docs: DataFrame,
    topic: Column | None = None,
    flatten: dict[str, float] = FLATTEN,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    seed: str = "mix",
    text: str = "text",
    id: str = "doc_id",
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """The documents with topic, n_words, probability and kept.

    Words are raked over the cells (source, lang, topic) until each margin has its target
    share: the one that ``targets`` names (margin, value, share), else its share of words to the
    power in ``flatten``. A document is kept with its cell's raked share of its own words, scaled so that
    ``budget`` of all words is expected to stay and no probability is over 1: a cell of which the
    targets want more words than it has stays whole, and its margins fall short then (``achieved``
    says by how much; a lower budget avoids it). The draw is a hash of
    id and seed: repeated rows stay or go together, rows of null id too. Null sources and languages are a value of their own
    (the empty text). Documents without words, of null or empty text, are kept. Very long texts
    are counted whole. An empty table stays empty. Columns called as those made are replaced,
    others pass, whatever they are called.
    """
    work = Workspace(docs.sparkSession, "mix")
    n, own, given, p = fresh(docs, "n", "own", "given", "p")
    # a column of its own, used below more than once, so that words are counted once a row
    counted = docs.select(*(docs[quoted(c)] for c in docs.columns), words_in(text_of(docs, text)).alias(n), *([] if topic is None else [topic.alias(given)]))
    named = topic_of(text_of(counted, text), F.col(n)) if topic is None else F.col(given)
    cell = F.struct(F.coalesce(counted["source"], F.lit("")).alias("source"), F.coalesce(counted["lang"], F.lit("")).alias("lang"), F.coalesce(named, F.lit("")).alias("topic"), F.col(n).alias("t"))
    cells = counted.select(cell.alias("x")).select("x.*").groupBy(*DIMENSIONS).agg(F.sum("t").alias("t")).where("t > 0")
    cells = work.write(cells, "cells")
    count = cells.count()
    if count == 0:
        rates = docs.sparkSession.createDataFrame([], "source string, lang string, topic string, probability double")
    elif count <= DRIVER_CELLS:
        local = cells.toPandas().sort_values([*DIMENSIONS]).reset_index(drop=True)
        factor = rake(local, flatten, rounds, targets)[0] / local["t"].to_numpy(float)
        local["probability"] = np.minimum(1.0, fill_level(factor, local["t"].to_numpy(float), budget) * factor)
        rates = docs.sparkSession.createDataFrame(local[[*DIMENSIONS, "probability"]])
    else:
        rates = work.write(_rake_tables(cells, flatten, rounds, budget, targets, work), "rates")
    taken = {"topic", "n_words", "probability", "kept"}
    passed = [c for c in docs.columns if c.lower() not in taken]
    shown = counted.select(*(counted[quoted(c)] for c in passed), cell.alias(own), counted[quoted(id)].cast("string").alias(n))
    rates = rates.select(F.struct(*DIMENSIONS).alias(given), F.col("probability").alias(p))
    on = [F.col(f"{own}.{d}") == F.col(f"{given}.{d}") for d in DIMENSIONS]
    both = shown.join(F.broadcast(rates), on, "left") if count <= DRIVER_CELLS else shown.join(rates, on, "left")
    chance = F.coalesce(p, F.lit(1.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(n), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return both.select(*(F.col(quoted(c)) for c in passed), F.col(f"{own}.topic").alias("topic"), F.col(f"{own}.t").alias("n_words"), chance.alias("probability"), (draw < chance).alias("kept"))


def achieved(mixed: DataFrame, by: str, flatten: dict[str, float] = FLATTEN, targets: dict[str, dict[str, float]] | None = None) -> pd.DataFrame:
    """A margin's values with their shares of words before, aimed at, expected by the probabilities, and kept; one row a value."""
    kept = F.when(F.col("kept"), F.col("n_words")).otherwise(0)
    found = mixed.groupBy(F.coalesce(by, F.lit("")).alias(by)).agg(F.sum("n_words").alias("before"), F.sum(F.col("n_words") * F.col("probability")).alias("expected"), F.sum(kept).alias("kept")).where("before > 0").toPandas().set_index(by).sort_index()
    aim = shares_of(found["before"], flatten[by], (targets or {}).get(by)) if len(found) else found["before"]
    return (found / found.sum()).assign(target=aim)[["before", "target", "expected", "kept"]]


def sample_mix(docs: DataFrame, **named) -> DataFrame:
    """The documents that ``mix`` keeps, with their own columns, whatever these are called."""
    (own,) = fresh(docs, "row")
    packed = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns)).alias(own), *(docs[quoted(c)] for c in dict.fromkeys((named.get("id", "doc_id"), named.get("text", "text"), "source", "lang"))))
    return mix(packed, **named).where("kept").select(f"{own}.*")
