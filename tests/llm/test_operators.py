"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmesh.llm import exactdedup, htmlextract, linededup, media, mixing, ngramjoin, packing, tokencount, toxicity, urlfilter
from trailmesh.llm.common import Workspace, shingles, word_hashes
from trailmesh.llm.tokens import default_path, tokenizer

SPACES = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# ---------------------------------------------------------------- 1 media
def test_media_round_trip(documents):
    want = {r["doc_id"]: r["text"] or "" for r in documents.collect() if r["doc_id"] is not None}
    rows = media.media_columns(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = want[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert bytes(r["tile"]).startswith(b"\x93NUMPY") and len(r["feature"]) == 16


@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_area_resize_equals_exact_overlaps(h, w, height, width):
    image = np.random.default_rng(h * 41 + w).integers(0, 256, (h, w))
    got = media.area_resize(image, height, width)

    def weights(n, parts):
        return np.array([[max(0.0, min(i + 1, (k + 1) * n / parts) - max(i, k * n / parts)) for i in range(n)] for k in range(parts)])

    a, b = weights(h, height), weights(w, width)
    want = a @ image @ b.T / np.outer(a.sum(1), b.sum(1))
    assert np.allclose(got, want)


def test_media_against_its_definition(documents):
    want = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    for r in media.media_columns(documents).collect():
        raw = want[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
        if len(rows) % 2:
            stored = b"P5\n64 %d\n255\n" % len(rows) + payload
        else:
            head = b"BM" + (1078 + len(payload)).to_bytes(4, "little") + bytes(4) + (1078).to_bytes(4, "little")
            info = b"".join(x.to_bytes(n, "little") for x, n in ((40, 4), (64, 4), (len(rows), 4), (1, 2), (8, 2), (0, 4), (len(payload), 4), (2835, 4), (2835, 4), (256, 4), (0, 4)))
            stored = head + info + b"".join(bytes((i, i, i, 0)) for i in range(256)) + b"".join(reversed(rows))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["error"] is None

        def mean(parts, across, i, j):
            def cut(n, k, m):
                return [(at, min(at + 1, (k + 1) * n / m) - max(at, k * n / m)) for at in range(int(k * n / m), min(n, math.ceil((k + 1) * n / m)))]

            cells = [(a * b, rows[y][x]) for y, a in cut(len(rows), i, parts) for x, b in cut(64, j, across)]
            return sum(a * v for a, v in cells) / sum(a for a, _ in cells)

        if len(rows) <= 40:
            small = [[round(mean(8, 9, i, j), 6) for j in range(9)] for i in range(8)]
            bits = "".join(str(int(a > b)) for line in small for a, b in zip(line, line[1:], strict=False))
            assert r["feature"] == f"{int(bits, 2):016x}"
            tile = np.frombuffer(bytes(r["tile"])[-1024:], np.uint8).reshape(32, 32)
            assert all(abs(int(tile[i, j]) - mean(32, 32, i, j)) <= 0.5 + 1e-6 for i in range(0, 32, 5) for j in range(0, 32, 5))


def test_unreadable_media_say_why(spark):
    made = spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a")), (3, bytearray(b"P5\n0 0\n255\n")), (4, bytearray(media.encode_pgm(np.zeros((1, 2), np.uint8))))], "id long, media binary")
    got = {r["id"]: r for r in media.media_features(made).collect()}
    assert got[1]["error"] is None and got[1]["media_bytes"] is None
    assert got[2]["error"] and got[2]["media_bytes"] == 6 and got[3]["error"] and got[4]["shape"] == "2x1" and got[4]["error"] is None


def test_media_formats():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_bmp(grey)), grey)
    assert np.array_equal(media.decode(b"P2 # c\n2 2\n9\n1 2\n# d\n3 4"), [[1, 2], [3, 4]])
    assert np.array_equal(media.decode(b"P1\n2 1\n1 0"), [[0, 255]])
    assert np.array_equal(media.decode(b"P4\n3 1\n\xa0"), [[0, 255, 0]])
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert media.decode(b"P5\n1 1\n300\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P5\n2 2\n255\na", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_long_image_is_read_in_blocks(monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, (1000, 8))
    whole = media.area_resize(image, 8, 9)
    monkeypatch.setattr(media, "_BLOCK", 7)
    assert np.allclose(media.area_resize(image, 8, 9), whole)


# ---------------------------------------------------------------- 2 packing
def test_packing_pieces(documents):
    bpe = tokenizer(default_path())
    rows = packing.pack(documents).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    repeats = Counter(r["doc_id"] for r in documents.collect())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for id, pieces in by.items():
        ids = np.array([*bpe.library.encode(texts[id], add_special_tokens=False).ids, 0], "<u4")
        seen = Counter()
        for p in pieces:
            assert p["doc_tokens"] == len(ids) and p["length"] <= 1024
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
            for i in range(p["start"], p["start"] + p["length"]):
                seen[i] += 1
        assert set(seen) == set(range(len(ids))) and set(seen.values()) == {repeats[id]}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_covers_the_histogram(histogram):
    chosen = packing.plan(histogram, 64)
    got = Counter()
    for items, n in chosen:
        assert sum(items) <= 64 and n > 0
        for k in items:
            got[k] += n
    assert got == Counter(histogram)
    slots = packing.Slots(chosen)
    used = {}
    for k, n in histogram.items():
        for rank in range(n):
            s, at = slots.place(k, rank)
            used.setdefault(s, []).append((at, k))
    assert len(used) == slots.sequences
    for parts in used.values():
        end = 0
        for at, k in sorted(parts):
            assert at == end
            end += k


def test_plan_is_near_the_optimum():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 1024, 50_000), return_counts=True)
    chosen = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    total = int(lengths @ counts)
    assert sum(packing.padded(sum(i)) * n for i, n in chosen) < total * 1.005


def test_columns_are_priced_until_a_bound_is_proven(monkeypatch):
    calls, best = [], packing._Pricing.best
    monkeypatch.setattr(packing._Pricing, "best", lambda self, worth: calls.append(1) or best(self, worth))
    # a start of one length a sequence: 36 pads 28, 28 pads 8; together they fill 64
    monkeypatch.setattr(packing, "_start", lambda lengths, counts, size: (np.diag((size // lengths).astype(float)), counts / (size // lengths)))
    lengths, counts = np.array([20, 28, 36, 44]), np.array([50.0, 80, 80, 50])
    basis, x, bound = packing.solve(lengths, counts, 64)
    cost = sum(packing.padded(int(f), 64) * k for f, k in zip(lengths @ basis, x, strict=True))
    assert len(calls) > 2 and bound <= cost <= bound * 1.001 and cost == pytest.approx(130 * 64)
    assert np.allclose(basis @ x, counts)
    calls.clear()
    packing.solve(np.array([64 // 2]), np.array([9.0]), 64)
    assert calls  # an optimal start is priced too


def test_column_generation_improves_a_poor_start():
    # 3 x 20 fill 60 and 2 x 30 fill 60; the start pairs 30 with 30 and 20 with others
    chosen = packing.plan({20: 300, 23: 300, 21: 300, 30: 100}, 64)
    total = sum(k * n for k, n in {20: 300, 23: 300, 21: 300, 30: 100}.items())
    assert sum(packing.padded(sum(i), 64) * n for i, n in chosen) <= total * 1.06


# ---------------------------------------------------------------- 3 toxicity
def test_toxicity_learns_and_ignores_other_columns(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}{'abcde'[i % 5]}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice(vocabulary, 40)) + (" vile idiot " if bad else " ") + " ".join(rng.choice(vocabulary, 40))
        rows.append((i, text, str(i % 3), int(bad)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_split(docs, lab, Workspace(spark, "t"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i, r in got.items() if r["h"]]
    assert held and all((zlib.crc32(str(i).encode()) % 5 == 0) == got[i]["h"] for i in got)
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and all(r["doc_id"] % 4 for r in kept.collect() if r["doc_id"] in held) and kept.count() < 600


def brute_score(text, model):
    """The score from its definition: n-grams one by one, as a set of numbers."""
    flat = f" {' '.join(text.lower().split())} "
    found = set()
    for n in toxicity.GRAMS:
        for i in range(len(flat) - n + 1):
            h = sum(ord(c) * pow(0x100000001B3, j, 1 << 64) for j, c in enumerate(flat[i : i + n])) % (1 << 64)
            found.add(((h ^ h >> 29 ^ n - 1) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.BITS))
    z = model.bias + sum(w for g, w in zip(model.wanted.tolist(), model.weights.tolist(), strict=True) if g in found)
    return 1 / (1 + math.exp(-z))


def test_toxicity_equals_its_definition(spark):
    rows = [(i, f"some words {i} and {'bad vile' if i % 3 else 'good kind'} things to say é", int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(100, None), (101, ""), (102, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, 0), (1, 1)], "doc_id long, toxic int")
    model = toxicity.train_split(docs, labels, Workspace(spark, "t"))
    assert len(model.wanted)
    for r in toxicity.score_toxicity(docs, model).collect():
        assert r["score"] == pytest.approx(brute_score(r["text"] or "", model), abs=1e-9)
    # ratios from their definition, over the labelled rows that may be learnt from
    seen = {0: Counter(), 1: Counter()}
    sizes = Counter()
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 5:
            sizes[y] += 1
            seen[y].update({int(g) for part in toxicity.grams(t) for g in part})
    ratio = {g: math.log((seen[1][g] + 1) / (sizes[1] + 2) / ((seen[0][g] + 1) / (sizes[0] + 2))) for g in model.wanted.tolist()}
    signs = [math.copysign(1, w) == math.copysign(1, ratio[g]) for g, w in zip(model.wanted.tolist(), model.weights.tolist(), strict=True) if abs(w) > 1e-3]
    assert sum(signs) > 0.8 * len(signs)


def test_toxicity_odd_inputs(spark, documents, empty):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(documents, no_labels, Workspace(spark, "t"))
    scores = [r["__s"] for r in toxicity.score_toxicity(documents, model, name="__s").collect()]
    assert len(scores) == documents.count() and all(0 <= s < 0.5 for s in scores)
    one = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.train(documents, one, Workspace(spark, "t")).bias > 0
    assert toxicity.reject_toxic(empty, model).count() == 0


# ---------------------------------------------------------------- 4 URLs
URLS = [None, "", "nothing", "http://Example.COM/en/1", "https://www.example.com/en/x?q=1#f", "http://a.b.net/es/9", "http://notnet/fr/", "http://net/fr/a", "http://x.com", "http://x.com?y=/z", "ftp://h/p#://q", "a://b.example.com/en/", "http://c.org/en/2"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=None)


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for r in urlfilter.filter_urls(pages).collect():
        host, path, rule = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule[0] if rule else None)
        assert r["verdict"] in ("allow", "block") and (not rule or r["verdict"] == rule[1])
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = urlfilter.boost(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_one_tree_equals_a_search_over_all_cuts():
    rng = np.random.default_rng(8)
    x, y, w = rng.integers(0, 9, (120, 3)).astype(float), rng.integers(0, 2, 120).astype(float), rng.integers(1, 4, 120).astype(float)
    model = urlfilter.boost(x, y, w, trees=1, depth=1, rate=1.0, bins=32)
    share = np.average(y, weights=w)
    g, h = w * (y - share), w * share * (1 - share)
    best = max(((sum(g[m]) ** 2 / (sum(h[m]) + 1) + sum(g[~m]) ** 2 / (sum(h[~m]) + 1), j, c) for j in range(3) for c in range(9) if 5 <= (m := x[:, j] <= c).sum() <= 115), key=lambda b: b[0])
    left = x[:, best[1]] <= best[2]
    want = np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1)) + np.log(share / (1 - share))
    assert np.allclose(model.odds(x), want)
    again = urlfilter.boost(np.repeat(x, w.astype(int), axis=0), np.repeat(y, w.astype(int)), trees=1, depth=1, rate=1.0, bins=32)
    assert np.allclose(again.odds(x), model.odds(x))  # a weight is as many rows


def test_lexical_features():
    assert urlfilter.lexical("http://a-b.cc/x/1?q=2&r#f", "a-b.cc", "/x/1")[:6] == [25, 6, 4, 2, 2, 2]
    assert urlfilter.lexical("http://a-b.cc/x/1?q=2&r#f", "a-b.cc", "/x/1")[8:] == [2, 5, 1, 3, 1.0, 0]
    assert urlfilter.lexical("aabb", "", "")[7] == 1.0 and urlfilter.lexical(None, "", "")[0] == 0


def test_url_suffix_rates_leave_a_url_out(spark, monkeypatch):
    got, boost = [], urlfilter.boost
    monkeypatch.setattr(urlfilter, "boost", lambda x, y, w: got.append((x, y, w)) or boost(x, y, w))
    pages = spark.createDataFrame([(1, "http://a.net/es/"), (2, "http://a.net/es/"), (3, "http://b.net/fr/"), (4, "http://c.com/")], "page_id long, url string")
    assert urlfilter.filter_urls(pages).count() == 4
    (x, y, w), rate = got[0], urlfilter.NAMES.index("suffix_block_rate")
    assert sorted(zip(y.tolist(), w.tolist(), x[:, rate].round(6).tolist(), strict=True)) == [(0.0, 1.0, 0.5), (1.0, 1.0, 0.75), (1.0, 2.0, round(2 / 3, 6))]


def test_urls_held_out_accuracy(spark):
    rows = [(f"http://{'spam-offers' if i % 2 else 'library'}{i}.{'org' if i % 3 else 'net'}/{'a1b2c3' if i % 2 else 'page'}/{i}?{'u=1&v=2' if i % 2 else ''}", float(i % 2)) for i in range(400)]
    labelled = spark.createDataFrame(rows[:300], "url string, block double")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[300:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, rules=(), labelled=labelled).collect()}
    assert np.mean([got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows[300:])]) > 0.95


# ---------------------------------------------------------------- 5 lines
def brute_lines(rows, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    found = {}
    for id, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                found.setdefault(key(line), set()).add(id)
    often = {k for k, ids in found.items() if len(ids) >= least}
    out = []
    for id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in often]
        out.append((id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(documents, batches):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = linededup.line_dedup(documents, 10, 1, batches).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(rows, 10)
    assert "source" in got[0].asDict() and any(r["n_dropped"] for r in got)


def test_line_runs_are_merged_by_their_order(spark):
    work = Workspace(spark, "t")
    runs = linededup.LineRuns(work, 3)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, 0, 1) for k in range(4) if b >= k], "h1 long, h2 int, n long"))
        assert len(runs.runs()) == (b + 1).bit_count()
    assert runs.merges == 3  # 0+1, 2+3, 01+23
    with linededup._ordered(spark):
        plan = runs.merge(*[x for x in runs.levels if x])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan
    assert sorted(r["h1"] for r in runs.settled("settled").collect()) == [0, 1, 2] and runs.merges == 4 and not runs.names


def test_line_dedup_empty(empty):
    assert linededup.line_dedup(empty).count() == 0


# ---------------------------------------------------------------- 6 exact
def test_exact_dedup(documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    groups = {}
    for id, t in rows:
        groups.setdefault(SPACES.sub("", t), []).append((id, len(t)))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] if m[0] is not None else math.inf))
        for m in members:
            want[(m[0], best[0], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exactdedup.exact_dedup(documents, digest_all=True).collect())
    assert got == want
    plain = exactdedup.exact_dedup(documents).where("text_sha256 IS NULL").collect()
    assert plain and all(r["kept"] and r["group_size"] == 1 for r in plain)


def test_exact_dedup_empty(empty):
    assert exactdedup.exact_dedup(empty).count() == 0


# ---------------------------------------------------------------- 7 n-gram join
def brute_groups(rows, k, percent):
    sets = {}
    for id, text in rows:
        w = words(text)
        sets[id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join(spark, seed, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LEAST", 4)
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for c in range(12):
        base = [f"v{rng.integers(0, 400)}" for _ in range(int(rng.integers(5, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                at = int(rng.integers(0, len(w)))
                w[at] = f"e{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(5000 + i, " ".join(passage)) for i in range(6)] + [(6000, None), (6001, ""), (6002, " \n"), (6003, "one two"), (6004, "ONE  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(docs, 4, 85).collect()}
    want = brute_groups(rows, 4, 85)
    assert got == want and len({c for _, c in want.values()}) < len(want)
    five = {r["doc_id"]: r["component_id"] for r in ngramjoin.ngram_join(docs, 5, 80).collect()}
    assert five == {i: c for i, (_, c) in brute_groups(rows, 5, 80).items()}


def test_ngram_join_odd_inputs(documents, empty):
    got = ngramjoin.ngram_join(documents).collect()
    assert len(got) == documents.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[5] == 5 and by[6] == 6 and by[None] is None
    assert ngramjoin.ngram_join(empty).count() == 0


@given(st.sets(st.integers(0, 60), min_size=6, max_size=40), st.sets(st.integers(0, 60), max_size=4), st.sets(st.integers(0, 60)))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_key(base, change, frequent):
    a, b = np.array(sorted(base), np.uint64), np.array(sorted(base ^ change), np.uint64)
    if set(a.tolist()) == set(b.tolist()) or not len(b):
        return
    if 100 * len(set(a.tolist()) & set(b.tolist())) < 85 * len(set(a.tolist()) | set(b.tolist())):
        return
    keys = [set(ngramjoin.prefix_keys(x, np.isin(x, np.array(sorted(frequent), np.uint64)), 85)[0].tolist()) for x in (a, b)]
    assert keys[0] & keys[1]


def test_words_of_long_texts_are_hashed_in_blocks():
    long = "w" * 70_000
    text = f"a {long} b\n" + "Some words\x0bhere " * 20_000 + "x" * 5000 + " end"
    h, want = word_hashes(text).tolist(), words(text)
    assert len(h) == len(want)
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(want, h, strict=True)) and len(set(known.values())) == len(known)
    assert h[0] == word_hashes("a").tolist()[0] and h[1] == word_hashes(long.upper()).tolist()[0] and h[-1] == word_hashes("END")[0]


def test_ngram_join_of_repeated_ids_and_text_ids(spark):
    rows = [("b", "one two three four five"), ("b", "six seven eight nine ten"), ("a", "six seven eight nine ten"), ("c", None)]
    got = Counter(tuple(r) for r in ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == Counter([("b", 2, "b"), ("b", 2, "a"), ("a", 2, "a"), ("c", 0, "c")])


def test_frequent_tokens_count_every_token(spark):
    rows = spark.createDataFrame([(f"same words in every text number {i // 2}",) for i in range(40)], "text string").repartition(3)
    often, cut = ngramjoin.frequent_tokens(rows, 2, Workspace(spark, "t"))
    n = Counter(h for i in range(40) for h in (shingles(f"same words in every text number {i // 2}", 2) >> np.uint64(cut)).tolist())
    assert set(often.tolist()) == {h for h, k in n.items() if k >= 4}


def test_shingles():
    for text, n in (("", 0), (None, 0), ("a b", 1), ("a b c d e", 2), ("x x x x x x", 1), ("A\tb\u00a0c  d", 1)):
        assert len(shingles(text, 4)) == n
    assert np.array_equal(shingles("A b  C\nd", 4), shingles("a B c D", 4)) and not np.array_equal(shingles("ab c d e", 4), shingles("a bc d e", 4))


# ---------------------------------------------------------------- 8 HTML
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy</div>%s<div class="comments"><p>First!</p></div><aside>More</aside><form>Mail <input></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    page = PAGE % "<article><h1>A &amp; B</h1><!-- no --><p>One  <b>two</b>\nthree<p>Four &lt;x&gt; caf&eacute;<ul><li>i<li>ii</ul><div class='share'>Share</div></article>"
    assert htmlextract.main_text(page) == "A & B\nOne two three\nFour <x> café\ni\nii"
    head = "<div class='site-header'>Site</div>"
    assert htmlextract.main_text(PAGE % (head + "<article><div class='article-header'><h1>A</h1></div><p>B</article>")) == "A\nB"
    assert htmlextract.main_text(f"<body>{head}<div id=content><p>B</p></div><section id='comments'>no</section><p hidden>x</body>") == "B"
    assert htmlextract.main_text("") == "" and htmlextract.main_text("plain &amp; text") == "plain & text"
    assert htmlextract.main_text("<p>open <b>never closed<br>x") == "open never closed x"


def test_wrappers_of_an_article_do_not_mark_it():
    inner = "<nav>Home</nav><article><h1>A</h1><p>B</p><div class='share-buttons'>Share</div></article><div class='cookie-banner'>Cookies</div>"
    for open_, close in (("<div class='content has-sidebar'>", "</div>"), ("<div class='with-sidebar'>", "</div>"), ("<section id='search-results'>", "</section>"), ("<form method=post>", "</form>"), ("<div class='sidebar'>", "</div>")):
        assert htmlextract.main_text(f"<body>{open_}{inner}{close}</body>") == "A\nB", open_
    flat = "<nav>Home</nav><div id='content'><h1>A</h1><p>B</p></div><form class='x'>Mail</form>"
    assert htmlextract.main_text(f"<body><form action='/'>{flat}</form></body>") == "A\nB"
    assert htmlextract.main_text(f"<body><div class='has-sidebar'>{flat}</div></body>") == "A\nB"
    cards = "<section class='related-posts'><article>Card</article></section><aside><article>Teaser</article></aside>"
    assert htmlextract.main_text(f"<body><article>Text</article>{cards}</body>") == "Text"
    assert htmlextract.main_text(f"<body><div><p>A longer text</p></div>{cards}</body>") == "A longer text"


def test_attributes_and_comments():
    inner = "<p data-hidden>B</p><p data-k2='hidden'>C</p><p hidden>no</p><div class='side-effects'>D</div><div class='related-work'>E</div><article class='comment'>no</article>"
    inner += "".join(f"<div class='{c}'>{c}</div>" for c in ("share-price", "widget-theory", "navigation-history", "promo-code", "notice-board"))
    assert htmlextract.main_text(f"<article class='comment-on-law'><p>A</p></article>") == "A"
    got = htmlextract.main_text(f"<article><p>A</p>{inner}</article><article class='comment'>no</article>")
    assert got.split("\n") == ["A", "B", "C", "D", "E", "share-price", "widget-theory", "navigation-history", "promo-code", "notice-board"]


def test_deep_and_endless_pages():
    deep = htmlextract.parse("<div>" * 20000 + "x" + "</div>" * 20000)
    assert len(deep.tokens) == 20001 and [b[1] for b in deep.blocks] == ["x"]
    assert htmlextract.main_text("<svg>" * 5000 + "<p>a") == "a"  # never closed: left out
    assert htmlextract.main_text("<b>" * 5000 + "<p>a" * 5000).count("a") == 5000


def test_templates_of_a_host(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % f"<div><p>Welcome to our site</p><p>Own text {k}</p></div>") for k in range(6)]
    rows += [(10 + k, "http://same.example/", PAGE % "<div><p>All the same</p></div>") for k in range(5)]
    rows += [(20, None, None), (21, "http://one.example/", "<p>Alone</p>"), (22, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmlextract.extract_main(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["text"] == f"Own text {k}" for k in range(6))
    assert all(got[10 + k]["text"] == "All the same" for k in range(5))
    assert got[20]["text"] == "" and got[21]["text"] == "Alone" and got[21]["n_chars"] == 5 and got[22]["n_chars"] == 0
    assert htmlextract.extract_main(pages.limit(0)).count() == 0


def test_classes_decide_what_is_template(spark):
    def body(k):
        note = "<p>Abstract</p>" if k < 6 else ""  # alone with its vector: no class
        nav = ["<p>North</p>", "<p>South</p>"] if k < 7 else []  # a class on seven pages
        swapped = ["<h2>One</h2>", "<h2>Two</h2>"][:: 1 if k % 2 else -1] if k < 8 else []  # a class without an order
        return f"<div><p>Welcome</p>{''.join(nav)}{note}{''.join(swapped)}<p>Own {k}</p><p>Bye</p></div>"

    pages = spark.createDataFrame([(k, f"http://h.example/{k}", f"<html><body>{body(k)}</body></html>") for k in range(10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in htmlextract.extract_main(pages).collect()}
    for k in range(10):
        heads = (["One", "Two"][:: 1 if k % 2 else -1]) if k < 8 else []
        assert got[k] == (["Abstract"] if k < 6 else []) + heads + [f"Own {k}"]


def test_order_and_containment_of_classes():
    assert htmlextract.order_of([5, 7, 5, 7], 2) == htmlextract.order_of([5, 7], 2) != htmlextract.order_of([7, 5], 2)
    assert htmlextract.order_of([5, 5, 7, 7], 2) == 0 == htmlextract.order_of([5, 7, 5], 2)
    level, sizes = {1: 1, 2: 1, 8: 2, 9: 2}, {1: 2, 2: 2}
    assert htmlextract.gaps_of([1, 8, 9, 8, 9, 2], level, {1: 2, 2: 2}) == {1: 1, 2: 1}
    assert htmlextract.gaps_of([1, 8, 2, 9], level, sizes)[2] == 0 and htmlextract.gaps_of([1, 8, 9, 2, 8, 9], level, sizes)[2] == 0


# ---------------------------------------------------------------- 9 mixing
def test_mixing_meets_its_margins(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 60)), "ab"[int(rng.random() < 0.3)], "xyz"[int(rng.integers(0, 3))]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(docs, budget=0.5).toPandas()
    assert got["probability"].between(0, 1).all()
    assert abs((got["n_words"] * got["probability"]).sum() / got["n_words"].sum() - 0.5) < 1e-6
    kept = got[got["kept"]]
    assert abs(kept["n_words"].sum() / got["n_words"].sum() - 0.5) < 0.03
    before, after = got.groupby("source")["n_words"].sum(), (got["n_words"] * got["probability"]).groupby(got["source"]).sum()
    target = (before / before.sum()) ** 0.7
    if got["probability"].max() < 1:
        assert np.allclose(after / after.sum(), target / target.sum(), atol=1e-3)


def test_mixing_on_tables_agrees(documents, monkeypatch):
    one = {(r["doc_id"], r["n_words"]): round(r["probability"], 5) for r in mixing.mix(documents).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    two = {(r["doc_id"], r["n_words"]): round(r["probability"], 5) for r in mixing.mix(documents, rounds=12).collect()}
    assert one == two


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3], "xy"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.6, "b": 0.1}, "lang": {"x": 0.25, "y": 0.75}}
    mixed = mixing.mix(docs, budget=0.2, targets=targets)
    sources, langs = (mixing.achieved(mixed, d, targets=targets) for d in ("source", "lang"))
    assert np.allclose(sources["target"], [0.6, 0.1, 0.3]) and np.allclose(sources["expected"], sources["target"], atol=1e-9)
    assert np.allclose(langs["expected"], [0.25, 0.75], atol=1e-9) and abs(langs["kept"]["y"] - 0.75) < 0.15
    full = mixing.achieved(mixing.mix(docs, budget=0.9, targets=targets), "source", targets=targets)
    assert full["expected"]["a"] < 0.55  # more than there is: falls short, and says so
    cells = docs.toPandas().assign(t=lambda d: d["text"].str.count("w"), topic="note").groupby(["source", "lang", "topic"], as_index=False)["t"].sum()
    assert mixing.rake(cells)[1] < 1e-9


def test_mixing_odd_inputs(documents, empty):
    assert mixing.mix(documents).count() == documents.count()
    assert mixing.sample_mix(documents).columns == documents.columns
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 10 tokens
def test_token_counts(documents, empty):
    bpe = tokenizer(default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    rows = tokencount.count_tokens(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        want = len(bpe.library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(texts[r["doc_id"]].encode()), want > 512)
    assert tokencount.count_tokens(empty).count() == 0


def test_odd_stretches_go_to_the_library_alone(monkeypatch):
    made, seen = tokencount.WholeTokenCounter(default_path()), []
    monkeypatch.setattr(made, "_by_library", lambda text: seen.append(text) or tokencount.WholeTokenCounter._by_library(made, text))
    for text in ("plain words " * 50 + "🎉🎉 x  y \u4e2d\u6587 and more " + "tail " * 50, "\u3000 a  \u2028b", "a \u0660\u0661 b" * 3):
        assert made.count(text) == len(made.bpe.library.encode(text, add_special_tokens=False).ids)
    assert max(map(len, seen)) < 30
    monkeypatch.setattr(tokencount, "_MEMO", 10)
    for k in range(50):
        made.count(f"zqx{k}zqx {'w' * 300}{k}")
    assert len(made.memo) <= 10 and all(len(p) <= 256 for p in made.memo)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_token_ids_equal_the_library(text):
    bpe = tokenizer(default_path())
    want = bpe.library.encode(text, add_special_tokens=False).ids
    assert bpe.ids(text) == want and tokencount.counter(default_path()).count(text) == len(want)
