"""The pipeline against a brute-force version of its stages on a small table."""

import zlib

import numpy as np

import corpus_pipeline
from trailmesh.llm.tokens import default_path, tokenizer

from .test_operators import brute_groups, brute_lines


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(260):
        words = list(rng.choice(vocabulary, int(rng.integers(30, 60))))
        if i % 5 == 0:
            words[3] = "idiot"
            words[9] = "scumbag"
        text = " ".join(words) + ("\nRead more here" if i % 3 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1] + " extra", "en", "s1", 1) for i in range(1, 40, 2) if i % 5] + [(2000, None, None, None, None), (2001, "", "de", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    one = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == docs.columns
    toxic = {i for i in range(260) if i % 5 == 0}
    assert len(set(kept) & toxic) <= 1 and len(set(range(260)) - toxic - set(kept)) <= 2 and 2000 in kept

    two = corpus_pipeline.drop_lines(spark, one, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    want = {id: text for id, _, _, text in brute_lines(list(kept.items()), 10)}
    assert two.columns == docs.columns and got == want

    three = corpus_pipeline.drop_near_copies(spark, two, str(tmp_path))
    firsts = {i for i, (_, c) in brute_groups(list(got.items()), 5, 80).items() if c == i}
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == firsts and len(firsts) < len(got)

    four = corpus_pipeline.mix_sources(spark, three, str(tmp_path))
    left = {r["doc_id"]: r["text"] for r in four.collect()}
    assert four.columns == docs.columns and set(left) <= firsts and len(left) > 0.4 * len(firsts)

    bpe = tokenizer(default_path())
    pieces = corpus_pipeline.pack_documents(spark, four, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    for p in pieces:
        ids = np.array([*bpe.ids(left[p["doc_id"]]), 0], "<u4")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())

    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in run.collect()} == {(p["doc_id"], p["start"], p["ids_crc32"]) for p in pieces}
