"""Token ids of a byte-level BPE vocabulary read from a tokenizers JSON file."""

from __future__ import annotations

import functools
import json
import os

import tiktoken
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BYTE_BPE = "byte_bpe_50k.json"
#: How byte-level BPE splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Ids of a text, equal to the tokenizers library's; special strings count as it counts them.

    Ordinary text goes through a rank encoder built from the same file's vocabulary, whose
    ids follow the order of its merges; a text with an added token's string goes to the library.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in set(self.added)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"]["".join(m)] for m in merges]
        self.ranked = ids == sorted(ids)  # ranks and merges agree
        self.library = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.vocab, special_tokens={}) if self.ranked else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def tokenizer(path: str) -> ByteBPE:
    """One a worker process."""
    return ByteBPE(path)
