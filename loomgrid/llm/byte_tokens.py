"""Ids of a byte-level vocabulary."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: the pattern by which byte-level vocabularies cut a text into words (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters whose classes may differ between the libraries' tables
UNSURE = regex.compile(r"[\x1c-\x1f\x85᠎ -‏ -  -⿿ꀀ-\U0010ffff]")


def byte_of_character() -> dict[str, int]:
    """How the vocabulary file writes bytes: printable ones as themselves, the others in order
    from the 256th character on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of the pieces by their bytes, if ids are in the order of the merges."""
    vocabulary = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    if made != list(range(256, 256 + len(made))):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    byte = byte_of_character()
    return {bytes(byte[c] for c in p): i for p, i in vocabulary.items() if p not in special}


class ByteTokens:
    """Ids of texts as little-endian 32-bit numbers, the same as the tokenizers library gives.

    Most texts take the faster of two libraries; one with a special token or a character that
    they might class differently takes the library that the file is made for.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path) as file:
            found = ranks(json.load(file))
        self.fast = found and tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=found, special_tokens={}
        )

    def ids(self, text: str) -> bytes:
        if self.fast and not UNSURE.search(text) and not any(s in text for s in self.special):
            found = self.fast.encode_ordinary(text)
        else:
            found = self.library.encode(text, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes()


@cache
def load(path: str) -> ByteTokens:
    return ByteTokens(path)
