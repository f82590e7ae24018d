"""A corpus pipeline: toxicity, line dedup, near-duplicate join, source mixing, packing.

Every stage works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.llm.common import Workspace, load, quoted
from trailmesh.llm.linededup import line_dedup
from trailmesh.llm.mixing import sample_mix
from trailmesh.llm.ngramjoin import ngram_join
from trailmesh.llm.packing import pack
from trailmesh.llm.toxicity import reject_toxic, train_split


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from the labels of documents that are there, outside the held-out fifth. A null
    text counts as empty; rows of null id are judged like others, repeated rows stay or go
    together. Without labels every document stays; with labels of toxic documents only, none
    does. An empty table stays empty; columns pass, whatever they are called.
    """
    return reject_toxic(docs, train_split(docs, load(spark, sf_dir, "labels"), Workspace(spark, "toxic")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Documents stay, empty ones too.

    A null text becomes the empty one. Rows of null id count as one document, a repeated row as
    its document once; each comes back. An empty table stays empty; other columns pass, but for
    n_lines and n_dropped, which would be lost.
    """
    kept = line_dedup(docs, least=10, min_chars=1)
    return kept.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Five words, similarity 0.8.

    Documents without words and rows of null id stay. A repeated row stays or goes with the
    others of its id. An empty table stays empty; columns pass, whatever they are called.
    """
    groups = ngram_join(docs, k=5, percent=80)
    first = groups.where("doc_id = component_id OR component_id IS NULL").select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the calibrated probabilities of their source, language and topic.

    Null sources and languages are a value of their own; documents without words stay. A
    repeated row stays or goes with the others of its id, rows of null id together. An empty
    table stays empty; columns pass, whatever they are called.
    """
    return sample_mix(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens.

    A null or empty text is one piece of one id; rows of null id and repeated rows are packed
    like others. An empty table gives no pieces; other columns aren't read.
    """
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("packing", pack_documents)]

#: Scores, n-gram joins and token ids can't be expressed in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(docs, f"stage{k}")
    return docs
