"""Operator 4: URL filters. Host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, join_small, made_by, quoted

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SAMPLE = 20_000  # labelled URLs that are learnt from, about, at most
BROADCAST_SUFFIXES = 100_000
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "entropy", "parameters", "parameter_length", "hyphens", "longest_label", "fragment", "encoded", "suffix_log_count", "suffix_block_rate")


# ---------------------------------------------------------------- parts and rules
def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.when(url.contains("://"), ascii_lower(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.when(url.contains("://"), F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


# ---------------------------------------------------------------- features
def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    query = url.split("?", 1)[1].split("#", 1)[0] if "?" in url else ""
    n = max(len(url), 1)
    digits = sum(c.isdigit() for c in url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    labels = host.split(".")
    return [len(url), len(host), len(path), sum(map(bool, path.split("/"))), len(labels), digits, digits / n, entropy, query.count("&") + 1 if query else 0, len(query), host.count("-"), max(map(len, labels)), float("#" in url), url.count("%")]


# ---------------------------------------------------------------- trees
@dataclass
class Boosted:
    """Gradient-boosted regression trees for log odds, on features cut at quantiles."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, cut and value of each node of a full tree
    base: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), int)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                right = np.where(f >= 0, b[np.arange(len(x)), np.maximum(f, 0)] > cut[node], False)
                node = 2 * node + 1 + right
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -50, 50)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Boosted:
    """Second-order boosting with logistic loss; equal gains go to the first feature and cut. ``least`` rows, of any weight, are in a leaf."""
    weight = np.ones(len(x)) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    share = min(max(np.average(y, weights=weight), 1e-6), 1 - 1e-6)
    model = Boosted(cuts, [], float(np.log(share / (1 - share))), depth)
    b, odds, size = model.binned(x), np.full(len(x), model.base), 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut, value, node = np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(len(x), int)
        for k in range(2**depth - 1):
            rows = np.flatnonzero(node == k)
            best = (1e-9, -1, 0)
            if len(rows) >= 2 * least:
                all_g, all_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    at = b[rows, j]
                    sums = [np.cumsum(np.bincount(at, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None)]
                    if not len(sums[0]):
                        continue
                    right_g, right_h = all_g - sums[0], all_h - sums[1]
                    gain = sums[0] ** 2 / (sums[1] + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                    gain[(sums[2] < least) | (len(rows) - sums[2] < least)] = -1
                    if gain[i := int(gain.argmax())] > best[0]:
                        best = (gain[i], j, i)
            feature[k], cut[k] = best[1:]
            node[rows] = 2 * k + 1 + ((b[rows, best[1]] > best[2]) if best[1] >= 0 else 0)
        for k in range(2**depth - 1, size):
            rows = node == k
            if rows.any():
                value[k] = rate * g[rows].sum() / (h[rows].sum() + ridge)
        odds += value[node]
        model.trees.append((feature, cut, value))
    return model


# ---------------------------------------------------------------- operator
def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url", id: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """id, host, path, rule, verdict, block_probability of every row.

    A rule's verdict stands; other URLs get the trees'. The trees learn from labelled URLs
    (columns url and block), by default those that the rules decide: of the distinct ones at most
    about ``sample`` by hash, each with the number of its rows as weight and their mean as label.
    Suffix statistics are counted over all rows; what a URL's own rows say is left out of its
    suffix's rate when it is learnt from. Null and malformed URLs have empty parts and are judged
    like others, very long ones as a whole. Null and repeated ids and repeated rows get a row
    each, equal URLs equal results. Without both verdicts among the labelled URLs the trees give
    the only one known, else allow. An empty table gives an empty table. Other columns aren't read.
    """
    work = Workspace(pages.sparkSession, "urls")
    u = pages[quoted(url)]
    host, path = F.coalesce(host_of(u), F.lit("")), F.coalesce(path_of(u), F.lit(""))
    rows = pages.select(pages[quoted(id)].alias("id"), u.alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    suffix = F.substring_index("host", ".", -1)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"), suffix.alias("suffix"))
    if labelled is None:
        known = rows.where("given IS NOT NULL").select("u", "host", "path", "suffix", (F.col("given") == "block").cast("double").alias("y"))
    else:
        v = labelled["url"]
        known = labelled.select(v.alias("u"), F.coalesce(host_of(v), F.lit("")).alias("host"), F.coalesce(path_of(v), F.lit("")).alias("path"), labelled["block"].cast("double").alias("y")).withColumn("suffix", suffix)
    known = known.groupBy("u", "host", "path", "suffix").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("w"))
    known = work.write(known, "known")
    counted = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    rates = known.groupBy("suffix").agg(F.sum("y").alias("b"), F.sum("w").alias("k"))
    stats = counted.join(rates, "suffix", "left").select("suffix", F.log1p("n").alias("s1"), F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("k", F.lit(0)).alias("k"))
    stats = work.write(stats, "suffixes")

    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("u", F.lit(7)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    others = (F.coalesce("b", F.col("y")) - F.col("y") + 1) / (F.coalesce("k", F.col("w")) - F.col("w") + 2)
    learnt = join_small(known, stats, "suffix", "left", BROADCAST_SUFFIXES).select("u", "host", "path", "s1", others.alias("s2"), (F.col("y") / F.col("w")).alias("y"), "w").toPandas()
    learnt = learnt.sort_values(["u", "host", "path"], na_position="first", kind="stable")  # sums don't depend on the order of tasks
    x, y, w = _matrix(*(learnt[c].tolist() for c in ("u", "host", "path", "s1", "s2"))), learnt["y"].to_numpy(float), learnt["w"].to_numpy(float)
    model = boost(x, y, w) if len(y) and 0 < y.mean() < 1 else None
    constant = float(y.mean()) if len(y) else 0.0

    def start():
        def f(rows: list[dict]):
            columns = zip(*((r["u"], r["host"], r["path"], r["s1"], r["s2"]) for r in rows), strict=True)
            return (model.probability(_matrix(*columns)) if model else np.full(len(rows), constant),)

        return f

    both = join_small(rows, stats, "suffix", "left", BROADCAST_SUFFIXES)
    rate = (F.col("b") + 1) / (F.col("k") + 2)
    both = both.select("id", "host", "path", "rule", "given", F.struct("u", "host", "path", "s1", rate.alias("s2")).alias("x"))
    out = both.withColumn("block_probability", made_by(start, {"p": "double"}, F.col("x"))["p"])
    guess = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("given", guess).alias("verdict"), "block_probability")


def _matrix(urls, hosts, paths, s1, s2) -> np.ndarray:
    rows = [[*lexical(u, h, p), a or 0.0, 0.5 if b is None else b] for u, h, p, a, b in zip(urls, hosts, paths, s1, s2, strict=True)]
    return np.nan_to_num(np.array(rows, float).reshape(len(rows), len(NAMES)))
