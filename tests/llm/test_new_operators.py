"""Dominance counts, vector codes and exact search against brute force and odd inputs."""

import datetime
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmesh.llm import dominance, exactsearch, htmlextract, ngramjoin, vectorcodes

from .test_operators import brute_groups

BIG = float("inf")


# ---------------------------------------------------------------- 11 dominance
@pytest.mark.parametrize("n,keys", [(0, 1), (1, 1), (700, 3), (2000, 900)])
def test_fenwick_sweep_equals_its_definition(n, keys):
    rng = np.random.default_rng(n)
    key, values = rng.integers(-keys, keys, n), rng.integers(0, 9, (n, 2))
    want = [values[:i][key[:i] < key[i]].sum(0) for i in range(n)]
    assert np.array_equal(dominance.earlier_smaller(key, values), np.array(want, np.int64).reshape(n, 2))


def brute_dominance(rows):
    out = []
    for i, s, v, w in rows:
        if s is None or v is None:
            out.append((i, s, v, None, None))
        else:
            above = [(w2 or 0) for _, s2, v2, w2 in rows if s2 is not None and v2 is not None and s2 < s and v2 > v]
            out.append((i, s, v, len(above), sum(above)))
    return Counter(out)


@pytest.mark.parametrize("a_task", [40, 10_000])
def test_dominance_with_hot_values_nulls_and_repeats(spark, a_task):
    rng = np.random.default_rng(5)
    rows = [(k, int(s), int(v), int(w)) for k, (s, v, w) in enumerate(zip(rng.integers(-50, 50, 600), rng.integers(0, 40, 600), rng.integers(1, 6, 600), strict=True))]
    rows += [(1000 + k, int(rng.integers(-50, 50)), 7, 2) for k in range(300)] + [(2000 + k, 3, int(rng.integers(0, 40)), 1) for k in range(300)]
    rows += [(3000, 3, 7, 2)] * 200 + [(None, 1, 1, 1), (3001, None, 5, 1), (3002, 5, None, 1), (3003, None, None, None), (3004, 2, 2, None)]
    df = spark.createDataFrame([(*r, r[0], r[0]) for r in rows], "key long, s long, v long, w long, slot long, range long").repartition(5)
    got = dominance.dominance_counts(df, F.col("s"), F.col("v"), F.col("w"), id="key", rows_a_task=a_task)
    assert got.columns == ["key", "slot", "level", "n_above", "weight_above"]
    assert Counter(map(tuple, got.collect())) == brute_dominance(rows)


def test_dominance_of_empty_tables_and_of_nulls_only(spark):
    df = spark.createDataFrame([(1, None, 2, 1)], "sale_id long, s long, v long, w long")
    assert dominance.dominance_counts(df.limit(0), F.col("s"), F.col("v"), F.col("w")).collect() == []
    assert list(map(tuple, dominance.dominance_counts(df, F.col("s"), F.col("v"), F.col("w")).collect())) == [(1, None, 2, None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_slots_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = ["2024-03-10 02:30:59.9", "1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-01-01 00:01:00"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT explode(array(" + ", ".join(f"TIMESTAMP_NTZ'{t}'" for t in times) + ", NULL)) AS t")
        got = [r[0] for r in df.select(dominance.slot_of(F.col("t"), df.schema["t"].dataType.simpleString())).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    epoch = datetime.datetime(1970, 1, 1)
    want = [int((datetime.datetime.fromisoformat(t.split(".")[0]) - epoch).total_seconds() // 60) for t in times]
    assert got == [*want, None]


def test_levels(spark):
    values = [0.0, 0.005, 1.115, -0.5, 23198.23, None, float("nan"), BIG]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(dominance.level_of(F.col("x"))).collect()]
    assert got == [int(np.floor(100 * x + 0.5)) if x is not None and np.isfinite(x) else None for x in values]


# ---------------------------------------------------------------- vectors
ODD = [(None, [1.0, 2.0, 3.0, 4.0], 1), (900, None, 1), (901, [1.0, None, 2.0, 3.0], 1), (902, [float("nan")] * 4, 1), (903, [BIG, 0.0, 0.0, 0.0], None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, r[0], 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id long, v int, code int").repartition(3)


def vector_rows(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in np.float32(rng.normal(0, spread, width))], int(k % 3) if k % 7 else None) for k in range(n)]


def whole(rows, scale):
    ok = [(i, x, lab) for i, x, lab in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    width = max((len(x) for _, x, _ in ok), default=0)
    return [(i, [int(np.floor(scale * c)) for c in x] + [0] * (width - len(x)), lab) for i, x, lab in ok]


# ---------------------------------------------------------------- 12 codes
@pytest.mark.parametrize("n,values", [(1, 3), (16, 2), (250, 2), (256, 90)])
def test_kd_tree_finds_the_lowest_of_the_nearest(n, values):
    rng = np.random.default_rng(n)
    entries, points = rng.integers(-values, values, (n, 5)), rng.integers(-values, values, (400, 5))
    entry, d = vectorcodes.KdTree(entries).nearest(points)
    want = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(entry, want.argmin(1)) and np.array_equal(d, want.min(1))


def brute_codes(rows, parts, size, rounds, scale):
    kept = whole(rows, scale)
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:size]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    nearest = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out, total = [], Counter()
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        total[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, e, total[lab], digest) for i, code, e, lab in out)


@pytest.mark.parametrize("rows", [vector_rows(120, 8, 1) + ODD, vector_rows(9, 8, 2), vector_rows(30, 6, 3) + [(5, [0.5, 0.25], 1)], [(k % 4, [1.0, 2.0, 3.0, 4.0], 0) for k in range(60)] + ODD])
def test_codes_equal_brute_force(spark, rows):
    got = vectorcodes.compress(table(spark, rows), size=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_codes(rows, 4, 16, 3, 1024)


def test_codes_of_nothing(spark):
    df = table(spark, ODD)
    for part in (df.limit(0), df.where("vec_id >= 900")):
        assert vectorcodes.compress(part).collect() == []


# ---------------------------------------------------------------- 13 search
def brute_search(rows, k, scale, every):
    kept = [(i, v) for i, v, _ in whole(rows, scale)]
    out = Counter()
    for q in sorted({i for i, _ in kept if i is not None and i % every == 0}):
        mine = min(v for i, v in kept if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(mine, v, strict=True)), i is None, i or 0) for i, v in kept if i != q))
        for rank, (s, none, i) in enumerate(scored[:k], 1):
            out[(q, rank, None if none else i, -s)] += 1
    return out


CLUSTERS = [(k, [c + (k % 3) * 10.0 for c in x], lab) for k, x, lab in vector_rows(600, 6, 4)]
CASES = {
    "clusters": CLUSTERS + ODD,
    "one hot vector": [(k, [1.0, 2.0, 3.0, 4.0], 0) for k in range(300)] + vector_rows(40, 4, 6, 3.0)[1:],
    "repeats": vector_rows(30, 5, 7) * 3 + [(0, [2.0] * 5, 1)],
    "few": vector_rows(3, 4, 8),
    "one": vector_rows(1, 4, 9),
    "unequal lengths": vector_rows(40, 6, 10) + [(50, [3.0, 1.0], 0), (60, [], 0)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_search_equals_brute_force(spark, name):
    rows = CASES[name]
    got = exactsearch.top_k(table(spark, rows), queries=F.col("id") % 10 == 0, block=64, pivots=6, annuli=5, queries_a_task=9)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, 5, 256, 10)


def test_search_of_nothing(spark):
    df = table(spark, ODD)
    for part in (df.limit(0), df.where("vec_id >= 900")):
        assert exactsearch.top_k(part).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (6, 8))
    v = centres[rng.integers(0, 6, 900)] + rng.integers(-9, 9, (900, 8))
    pivots = exactsearch.fit_pivots(v[:200], 6)
    d = exactsearch.squared_distances(v, pivots)
    assert np.array_equal(d, ((v[:, None] - pivots[None]) ** 2).sum(2))
    near = d.argmin(1)
    least = d[np.arange(900), near]
    bounds = near, np.sqrt(least), np.sqrt(least), (v * v).sum(1)  # each row an annulus
    reach, score = exactsearch.greatest_scores(v[:50], pivots, bounds), v[:50] @ v.T
    assert (reach >= score).all() and (reach < np.sort(score, 1)[:, [-5]]).mean() > 0.5



# ---------------------------------------------------------------- 8 names that classes confirm
@pytest.mark.parametrize("mark", ['id="search"', 'id="notices"', 'id="form"', 'id="related"', 'id="social"', 'id="newsletter"', 'class="side"', 'class="search"'])
def test_names_within_an_article_mark_it_only_if_the_host_confirms(spark, mark):
    part = f"<section {mark}><h2>About</h2><p>own words</p></section>"
    page = lambda k, x: f"<body><nav><a>menu</a></nav><article><h1>Title {k}</h1><p>body {k}</p>{x}<p>end {k}</p></article><footer>foot</footer></body>"
    rows = [(k, "http://alone.com/", page(k, part)) for k in range(1)]
    rows += [(100 + k, "http://once.com/", page(k, part if k == 3 else "")) for k in range(8)]
    rows += [(200 + k, "http://each.com/", page(k, part.replace("own words", f"words {k * k}"))) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in htmlextract.extract_main(df).collect()}
    assert got[0] == ["Title 0", "body 0", "About", "own words", "end 0"]
    assert got[103] == ["Title 3", "body 3", "About", "own words", "end 3"] and got[101] == ["Title 1", "body 1", "end 1"]
    assert all(got[200 + k] == [f"Title {k}", f"body {k}", f"end {k}"] for k in range(8))


@pytest.mark.parametrize("mark", ['class="reader-comments"', 'class="commentlist"', 'id="disqus_thread"', 'id="comments"', 'class="comment-list section"', 'role="comments"', 'class="user-comments"'])
def test_comments_within_an_article_go(mark):
    assert htmlextract.main_text(f"<article><h1>T</h1><p>a</p><div {mark}><p>nice</p></div><p>b</p></article>") == "T\na\nb"


def test_loose_names_in_one_another_are_linear():
    deep = '<article>' + '<div id="search">' * 20_000 + "x" + "</div>" * 20_000 + "</article>"
    assert htmlextract.main_text(deep) == "x"
    own = htmlextract.parse('<article><div id="search"><div id="form">x').loose[1][0]
    assert htmlextract.main_text(deep, frozenset([own])) == ""


# ---------------------------------------------------------------- 7 near misses
def near_misses(n, seed, slots, own, size=60):
    """Texts of the same words with a few of their own, most of them near to each other but not linked."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{i}" for i in range(size)]
        for j, at in enumerate(rng.choice(slots, int(rng.integers(0, own + 1)), replace=False)):
            words[int(at) * (size // slots) + 1] = f"o{k if rng.random() < 0.7 else k % 5}x{j}"
        rows.append((k, " ".join(words[: size - int(rng.integers(0, 4))])))
    return rows


@pytest.mark.parametrize("seed,slots,own,percent,k", [(1, 20, 3, 85, 4), (2, 12, 2, 80, 5)])
def test_near_misses_equal_brute_force(spark, seed, slots, own, percent, k):
    rows = near_misses(150, seed, slots, own) + [(1000 + i, t.replace("w", "q")) for i, t in near_misses(60, seed + 9, slots, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_groups(rows, k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(docs, k, percent, hot=seed - 1).collect()}
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(want)


def test_near_misses_are_not_compared_pair_by_pair(spark, monkeypatch):
    made, write = {}, ngramjoin.Workspace.write

    def counted(self, df, name, *by):
        out = write(self, df, name, *by)
        if name in ("rest", "family-pairs", "buckets"):
            made[n, name] = out.count()
        return out

    monkeypatch.setattr(ngramjoin.Workspace, "write", counted)
    n = 800
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in range(200)]
        for j, at in enumerate(rng.choice(48, 3, replace=False)):
            words[int(at) * 4 + 2] = f"o{i}x{j}"
        rows.append((i, " ".join(words)))
    ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert made[n, "rest"] + made[n, "family-pairs"] < 0.01 * n * (n - 1) / 2 and made[n, "buckets"] < 512 * n


def test_combinations_name_the_longest_level():
    """Who needs more than the longest combination is found without a join of all combinations with their sets."""
    import pyarrow as pa

    from trailmesh.llm.ngramjoin import _combined

    row = {"fam": 1, "v": 2, "g": 0, "c": 2, "far": True, "other": 0, "longest": 2, "tokens": [5, 6, 7]}
    made = [r for b in _combined([pa.RecordBatch.from_pylist([row])], 85) for r in b.to_pylist()]
    assert sorted((r["level"], r["top"]) for r in made) == [(1, 2)] * 3 + [(2, 2)] * 3


def test_classes_of_need_lose_no_link_and_compare_few(spark):
    """Sets of a family meet by as many differences as their classes need; one set of small need doesn't make all combinations short."""
    import random
    from functools import partial
    from itertools import combinations

    from pyspark.sql import functions as F

    rng, percent, scale = random.Random(5), 80, 360
    rows = []
    for v in range(120):
        d = rng.choice((6, 15, 16))
        tokens = rng.sample(range(40), 2) + rng.sample(range(100, 130), d - 2) if v % 3 else rng.sample(range(100, 118), d)
        rows.append((7, v, v, 180 * d - 20 * 30, -500, True, sorted(tokens)))
    rows.append((7, 120, 120, -500, -500, False, [100, 101]))
    told = spark.createDataFrame(rows, "fam long, v long, c long, g long, low long, far boolean, tokens array<long>")
    asked = ngramjoin._asked(told, scale)
    assert asked.agg(F.max("longest")).first()[0] > 2 and asked.where("v = 120").agg(F.max("longest")).first()[0] <= 2
    made = asked.mapInArrow(partial(ngramjoin._combined, percent=percent), "bucket long, level int, top int, v long, g long, c long, far boolean, side int").collect()
    assert all(r["level"] == r["top"] for r in made) and len(made) < ngramjoin.COMBINATIONS * len(rows)
    by = {}
    for r in made:
        by.setdefault(r["bucket"], []).append(r)
    met = {(min(a["v"], b["v"]), max(a["v"], b["v"])) for x in by.values() for a, b in combinations(x, 2) if a["side"] + b["side"] == 0}
    sets = {r[1]: (r[3], set(r[6]), r[5]) for r in rows}
    links = {(a, b) for a, b in combinations(sorted(sets), 2) if (sets[a][2] or sets[b][2]) and scale * len(sets[a][1] & sets[b][1]) >= max(1, sets[a][0] + sets[b][0])}
    assert links and links <= met


def test_frequent_class_holds_all_frequent_tokens(spark):
    """More frequent tokens than a list of 2^18 would hold; a token left out would be a key that unrelated texts share."""
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = spark.createDataFrame([(text,)] * 4 + [("a b c d e f",)], "text string").repartition(2)
    bits, cut = ngramjoin.frequent_map(rows, 2, ngramjoin.Workspace(spark, "t"))
    at = ngramjoin.shingles(text, 2) >> np.uint64(cut)
    assert len(at) == 299_999 and (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all()
    assert np.unpackbits(bits).mean() < 0.13 and len(bits) <= 1 << (ngramjoin.MAP_BITS - 3)


def test_only_differences_of_the_other_class_are_combined(spark):
    rows = [(1, v, v, g, 0, True, tokens) for v, g, tokens in ((1, 0, [1, 2, 3]), (2, 0, [1, 2, 4]), (3, 3000, [*range(20, 40), 3]), (4, 3000, [*range(20, 40), 4]))]
    told = spark.createDataFrame(rows, "fam long, v long, c long, g long, low long, far boolean, tokens array<long>")
    got = {(r["v"], r["side"]): r["tokens"] for r in ngramjoin._asked(told, 370).collect()}
    assert got[1, 0] == [1, 2, 3] and got[3, 0] == [*range(20, 40), 3]
    assert all(side == 0 for _, side in got)  # one common difference isn't what the classes need


def test_differences_of_one_component_are_not_indexed(spark, monkeypatch):
    """What only the sets of one component have in common can't link it with another."""
    made, write = {}, ngramjoin.Workspace.write

    def kept(self, df, name, *by):
        out = write(self, df, name, *by)
        if name == "told":
            made.update({r["v"]: (r["fam"], r["c"], r["tokens"]) for r in out.collect()})
        return out

    monkeypatch.setattr(ngramjoin.Workspace, "write", kept)
    rows = near_misses(150, 1, 20, 3)
    ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85, hot=0).collect()
    of = {}
    for fam, c, tokens in made.values():
        for t in tokens:
            of.setdefault((fam, t), set()).add(c)
    assert of and min(map(len, of.values())) > 1
