"""Columns of any name pass through the operators and the pipeline's stages; ids of any type; empty tables."""

import inspect
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmesh.llm import common, exactdedup, htmlextract, linededup, media, mixing, ngramjoin, packing, tokencount, toxicity, urlfilter

MODULES = [common, exactdedup, htmlextract, linededup, media, mixing, ngramjoin, packing, tokencount, toxicity, urlfilter]
#: Every short name that is written in the operators, so every internal column too.
NAMES = sorted({n for m in MODULES for n in re.findall(r'"([a-z_][a-z_0-9]{0,13})"', inspect.getsource(m))} - {"text", "doc_id", "source", "lang", "n_chars"})


@pytest.fixture(scope="module")
def clashing(documents):
    assert {"r1", "drop", "own", "score", "x", "row"} <= set(NAMES)
    odd = ["a b", "d.e", "q`t", "__x", "__text", "__score"]
    docs = documents.select("doc_id", "text", "source", "lang", "n_chars")
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(dict.fromkeys([*NAMES, *odd]))))


def model_of(spark):
    labels = spark.createDataFrame([(100, 1), (101, 0), (102, 0)], "doc_id long, toxic int")
    return lambda docs: toxicity.train(docs, labels, common.Workspace(spark, "names"))


OPERATORS = {
    "line_dedup": (linededup.line_dedup, {"n_lines", "n_dropped"}),
    "mix": (mixing.mix, {"topic", "n_words", "probability", "kept"}),
    "sample_mix": (mixing.sample_mix, None),
    "score": (lambda d: toxicity.score_toxicity(d, model_of(d.sparkSession)(d)), {"score"}),
    "reject": (lambda d: toxicity.reject_toxic(d, model_of(d.sparkSession)(d), limit=2.0), set()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_pass(clashing, name):
    operator, made = OPERATORS[name]
    got = operator(clashing)
    passed = [c for c in clashing.columns if c not in (made or ()) and c != "text"]
    want, have = clashing.select(*map(common.quoted, passed)), got.select(*map(common.quoted, passed))
    assert got.columns == [c for c in clashing.columns if c not in (made or ())] + [c for c in got.columns if c in (made or ())]
    if made is None:
        assert not have.exceptAll(want).count()
    else:
        assert Counter(map(tuple, have.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("operator", [exactdedup.exact_dedup, media.media_columns, packing.pack, ngramjoin.ngram_join, tokencount.count_tokens])
def test_other_columns_do_not_matter(clashing, operator):
    few = clashing.select("doc_id", "text")
    drop = [c for c in operator(few).columns if c in ("sequence_id", "offset")]
    assert Counter(map(tuple, operator(clashing).drop(*drop).collect())) == Counter(map(tuple, operator(few).drop(*drop).collect()))


@pytest.mark.parametrize("operator", [htmlextract.extract_main, urlfilter.filter_urls])
def test_other_columns_of_pages_do_not_matter(spark, operator):
    rows = [(k, f"http://h{k % 2}.net/{'es' if k % 3 else 'x'}/{k}", f"<div><p>Hello</p><p>Own {k}</p><p>Bye</p></div>") for k in range(8)] + [(None, None, None), (3, "http://h1.net/x/3", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = pages.select("*", *(F.lit(1).alias(n) for n in NAMES if n not in ("page_id", "url", "html")))
    assert Counter(map(tuple, operator(wide).collect())) == Counter(map(tuple, operator(pages).collect()))


def test_exact_dedup_of_text_ids(documents):
    named = documents.where("doc_id IS NOT NULL").select(F.format_string("%05d", "doc_id").alias("doc_id"), "text")
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exactdedup.exact_dedup(named).collect()}
    want = {(f"{r['doc_id']:05d}", f"{r['keep_id']:05d}", r["kept"]) for r in exactdedup.exact_dedup(documents.where("doc_id IS NOT NULL")).collect()}
    assert got == want


@pytest.mark.parametrize("operator", [media.media_columns, packing.pack, tokencount.count_tokens, lambda d: urlfilter.filter_urls(d, id="doc_id", url="text"), lambda d: htmlextract.extract_main(d, "doc_id", "source", "text")])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_and_take_odd_rows(spark, clashing, tmp_path, name, stage):
    spark.createDataFrame([(100 + k, 1, int(k == 6)) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing.drop("n_lines", "n_dropped")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and 0 < got.count() <= clashing.count()
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0


def test_run_of_empty_and_repeated_rows(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for k, d in enumerate((docs.limit(0), docs.unionByName(docs))):
        d.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/0").count() == 0
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/1").collect()
    n = Counter((p["doc_id"], p["start"]) for p in pieces)
    assert pieces and set(n.values()) <= {2, 4}  # each row of a repeated id stays or goes with the others
