"""Every registered corpus query on the smallest tables, against its SQL or a brute-force version."""

import duckdb
import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest

from tests.test_catalogue import rows
from trailmesh.llm import queries
from trailmesh.llm.tokens import default_path, tokenizer

from .test_operators import brute_groups, brute_url


class ArticleReader(HTMLParser):
    """An independent reader of the given pages: what stands in the article element, a block for each h1 and p."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("article", "h1", "p"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "
        else:
            assert tag in ("b", "i", "em", "a") or not self.inside

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("article", "h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def read_article(source):
    reader = ArticleReader()
    reader.feed(source)
    reader.close()
    return "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "sales", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, db, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_op1(spark, sf, texts):
    got = queries.QUERIES["op1_media_columns"](spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(texts.keys())
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op2_and_op10(spark, sf, texts):
    bpe = tokenizer(default_path()).library
    ids = {k: [*bpe.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}
    for r in queries.QUERIES["op10_token_counts"](spark, sf).collect():
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids[r["doc_id"]]) - 1, len(texts[r["doc_id"]].encode()), len(ids[r["doc_id"]]) > 513)
    covered, filled = {}, Counter()
    for r in queries.QUERIES["op2_packing"](spark, sf).collect():
        mine = ids[r["doc_id"]]
        part = b"".join(i.to_bytes(4, "little") for i in mine[r["start"] : r["start"] + r["length"]])
        assert zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(mine)
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        filled[r["sequence_id"]] += r["length"]
    assert all(sorted(covered[k]) == list(range(len(v))) for k, v in ids.items()) and max(filled.values()) <= 1024


def test_op3(spark, sf, db, texts):
    labels = dict(db.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY doc_id").fetchall())
    got = queries.QUERIES["op3_toxicity"](spark, sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(texts.keys())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert held and sum(held) >= 0.85 * len(held)


def test_op4(spark, sf, db):
    urls = dict(db.execute("SELECT page_id, url FROM pages").fetchall())
    got = queries.QUERIES["op4_url_filters"](spark, sf).collect()
    assert {r["page_id"] for r in got} == set(urls)
    for r in got:
        host, path, rule = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None) and (not rule or r["verdict"] == rule[1])


def test_op7(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op7_ngram_jaccard_join"](spark, sf).collect()}
    assert got == brute_groups(list(texts.items()), 4, 85)


def test_op8(spark, sf, db):
    pages = {p: h or "" for p, h in db.execute("SELECT page_id, html FROM pages").fetchall()}
    got = queries.QUERIES["op8_html_extraction"](spark, sf).collect()
    assert {r["page_id"] for r in got} == set(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(r["text"] == read_article(pages[r["page_id"]]) for r in got) and sum(r["n_chars"] > 0 for r in got) > len(got) / 2


def test_pipeline(spark, sf, texts):
    got = queries.QUERIES["pipeline"](spark, sf).collect()
    assert got and {r["doc_id"] for r in got} <= set(texts)
