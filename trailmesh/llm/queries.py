"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dominance, exactdedup, exactsearch, htmlextract, linededup, media, mixing, ngramjoin, packing, tokencount, toxicity, urlfilter, vectorcodes
from .common import Workspace, load


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_columns(load(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shape", F.sha2("tile", 256).alias("tile_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_split(docs, load(spark, sf_dir, "labels"), Workspace(spark, "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(load(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), least=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(load(spark, sf_dir, "documents"), digest_all=True)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(load(spark, sf_dir, "documents"), k=4, percent=85)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract_main(load(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_words", F.round("probability", 6).alias("probability"), "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(load(spark, sf_dir, "documents"), limit=512)


def op11_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = load(spark, sf_dir, "sales")
    weight = 1 + F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % 5
    slot = dominance.slot_of(F.col("sold_at"), sales.schema["sold_at"].dataType.simpleString(), seconds=60)
    return dominance.dominance_counts(sales, slot, dominance.level_of(F.col("total"), step=1), weight).withColumnsRenamed({"n_above": "n_sales", "weight_above": "n_rows"})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(load(spark, sf_dir, "embeddings"), scale=1024, parts=4, size=256, rounds=4)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactsearch.top_k(load(spark, sf_dir, "embeddings"), queries=F.col("id") % 50 == 0, k=5, scale=256)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_packing, op3_toxicity, op4_url_filters, op5_line_dedup, op6_exact_dedup, op7_ngram_jaccard_join, op8_html_extraction, op9_mixing, op10_token_counts, op11_dominance_counting, op12_vector_codes, op13_exact_top_k, pipeline)}

_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINES = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT r, doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE o.k IS NULL), '') AS t
  FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY r, doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM kept"""

_EXACT = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w"""


def _mixing_sql() -> str:
    power, dims = mixing.FLATTEN, mixing.DIMENSIONS
    parts = [
        """words AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)""",
        "docs AS (SELECT doc_id, source, lang, n, CASE WHEN contains(x, ' | ') THEN 'table' WHEN n < 50 THEN 'note' WHEN n >= 2000 THEN 'long' ELSE 'article' END AS topic FROM words)",
        "cells AS (SELECT source, lang, topic, sum(n)::DOUBLE AS t FROM docs GROUP BY ALL HAVING sum(n) > 0)",
        "total AS (SELECT sum(t) AS total FROM cells)",
    ]
    for d in dims:
        parts.append(f"s_{d} AS (SELECT {d}, pow(sum(t) / any_value(total), {power[d]}) AS x, any_value(total) AS total FROM cells, total GROUP BY {d})")
        parts.append(f"g_{d} AS (SELECT {d}, x / sum(x) OVER () * total AS g FROM s_{d})")
    at = "cells"
    parts.append("r0 AS (SELECT source, lang, topic, t, t AS w, gs.g AS source_g, gl.g AS lang_g, gt.g AS topic_g FROM cells JOIN g_source gs USING (source) JOIN g_lang gl USING (lang) JOIN g_topic gt USING (topic))")
    at, k = "r0", 0
    for _ in range(mixing.ROUNDS):
        for d in dims:
            k += 1
            parts.append(f"r{k} AS (SELECT source, lang, topic, t, w * {d}_g / sum(w) OVER (PARTITION BY {d}) AS w, source_g, lang_g, topic_g FROM {at})")
            at = f"r{k}"
    parts.append(f"f AS (SELECT source, lang, topic, t, w / t AS f FROM {at})")
    parts.append("o AS (SELECT *, row_number() OVER q AS k, sum(t) OVER q - t AS filled, sum(t * f) OVER (ORDER BY f, t DESC, source DESC, lang DESC, topic DESC) AS rest FROM f WINDOW q AS (ORDER BY f DESC, t, source, lang, topic))")
    parts.append(f"s AS (SELECT coalesce((SELECT arg_min(greatest({mixing.BUDGET} * total - filled, 0) / rest, k) FROM o, total WHERE greatest({mixing.BUDGET} * total - filled, 0) / rest * f <= 1), (SELECT 1 / min(f) FROM f)) AS s)")
    parts.append("p AS (SELECT source, lang, topic, least(1.0, s * f) AS p FROM f, s)")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, n AS n_words, round(coalesce(p, 1.0), 6) AS probability,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, 'mix')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(p, 1.0) AS kept
FROM docs LEFT JOIN p USING (source, lang, topic)"""


_DOMINANCE = """
WITH bits AS (SELECT *, list_reduce(flatten(list_transform(string_split(sale_id::VARCHAR, ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END, 4294967295::BIGINT) AS c FROM sales),
s AS (SELECT sale_id, floor(epoch_us(date_trunc('minute', sold_at)) / 60000000)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 1)::BIGINT AS level,
  1 + coalesce(xor(c, 4294967295), 0) % 5 AS w FROM bits),
points AS (SELECT slot, level, count(*) AS n, sum(w) AS w FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
above AS (SELECT a.slot, a.level, sum(b.n) AS n, sum(b.w) AS w FROM points a JOIN points b ON b.slot < a.slot AND b.level > a.level GROUP BY ALL)
SELECT s.sale_id, s.slot, s.level, CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(a.n, 0)::BIGINT END AS n_sales,
  CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(a.w, 0)::BIGINT END AS n_rows
FROM s LEFT JOIN above a ON s.slot = a.slot AND s.level = a.level"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_USABLE})",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {size})",
        "b0 AS MATERIALIZED (SELECT p, e, v FROM cut JOIN first USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT c.vec_id, c.p, c.v, b.e, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut c JOIN b{k} b USING (p))")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min(struct_pack(d := d, e := e)) AS best FROM d{k} GROUP BY vec_id, p)")
        if k < rounds:
            steps.append(f"x{k} AS (SELECT p, e, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, e, i)")
            steps.append(f"m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM x{k} GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN m{k} USING (p, e))")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""


_SEARCH = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


ORACLE_SQL = {"op5_line_dedup": _LINES, "op6_exact_dedup": _EXACT, "op9_mixing": _mixing_sql(), "op11_dominance_counting": _DOMINANCE, "op12_vector_codes": _codes_sql(), "op13_exact_top_k": _SEARCH}
