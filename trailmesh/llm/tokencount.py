"""Operator 10: token counts with a whole-token shortcut."""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import made_by, quoted, ready, text_of
from .tokens import PATTERN, default_path, tokenizer

#: Code points whose letter, number and space classes are the same in every Unicode version
#: in use here; a stretch between spaces that has others is counted by the library.
_OTHER = regex.compile(r"[^\x00-\u0557\u2010-\u2027\u2030-\u205e\u20a0-\u20ac]")
#: Places where no pre-token can go on: before a space, after a printable ASCII character.
_CUT = re.compile(r"(?<=[!-~])(?= )")
_MEMO = 8_000_000  # characters of merged pre-tokens remembered in a worker; forgotten all at once beyond
_LONG = 256  # longer pre-tokens aren't remembered


@functools.cache
def proof(path: str) -> bytes:
    """One bit for each vocabulary string, in the file's order: whether it is one pre-token that the library encodes as one token."""
    bpe, split = tokenizer(path), regex.compile(PATTERN)
    at, texts = [], []
    for k, raw in enumerate(bpe.vocab):
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token
        if split.findall(s) == [s]:
            at.append(k)
            texts.append(s)
    bits = np.zeros(len(bpe.vocab), bool)
    for k, e in zip(at, bpe.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        bits[k] = len(e.ids) == 1
    return np.packbits(bits).tobytes()


class WholeTokenCounter:
    """Counts tokens; vocabulary strings proven to encode alone as one token need no merging."""

    def __init__(self, path: str, proven: bytes | None = None):
        self.bpe = tokenizer(path)
        self.split = regex.compile(PATTERN)
        bits = np.unpackbits(np.frombuffer(proven or proof(path), np.uint8))
        self.whole = frozenset(raw.decode() for raw, one in zip(self.bpe.vocab, bits, strict=False) if one)
        self.memo: dict[str, int] = {}
        self.held = 0

    def count(self, text: str) -> int:
        if any(s in text for s in self.bpe.added):
            return self._by_library(text)
        if not _OTHER.search(text):
            return self._plain(text)
        total = 0
        for odd, parts in itertools.groupby(_CUT.split(text), lambda x: _OTHER.search(x) is not None):
            part = "".join(parts)
            total += self._by_library(part) if odd else self._plain(part)
        return total

    def _by_library(self, text: str) -> int:
        return len(self.bpe.library.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> int:
        whole, total = self.whole, 0
        for piece, n in Counter(self.split.findall(text)).items():
            total += n if piece in whole else n * self._merged(piece)
        return total

    def _merged(self, piece: str) -> int:
        size = self.memo.get(piece)
        if size is None:
            size = len(self.bpe.ids(piece))
            if len(piece) <= _LONG:
                if self.held >= _MEMO:
                    self.memo.clear()
                    self.held = 0
                self.memo[piece] = size
                self.held += len(piece)
        return size


@functools.cache
def counter(path: str, proven: bytes | None = None) -> WholeTokenCounter:
    """One a worker process."""
    return WholeTokenCounter(path, proven)


def count_tokens(docs: DataFrame, limit: int = 512, text: str = "text", id: str = "doc_id", path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows give a row each,
    an empty table none. Very long texts are counted whole; what is remembered of them is
    bounded. Other columns aren't read. No shuffle; the vocabulary is proven once, on the driver,
    and only texts go to Python.
    """
    ready(docs.sparkSession)
    path = path or default_path()
    proven = proof(path)

    def start():
        count = counter(path, proven).count
        return lambda texts: ([count(t) for t in texts],)

    t = text_of(docs, text)
    made = docs.select(docs[quoted(id)].alias("id"), F.octet_length(t).cast("long").alias("n_bytes"), made_by(start, {"n": "long"}, t)["n"].alias("n_tokens"))
    return made.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id)
