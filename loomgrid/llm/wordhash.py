"""Words of a batch of texts as 64-bit hashes, computed over all their bytes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 500_000
TEXT, UPPER = np.arange(256, dtype=np.uint8), np.arange(ord("A"), ord("Z") + 1)
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(ord("0"), ord("9") + 1), *UPPER, *(UPPER + 32), *range(128, 256)]] = True
LOWER = TEXT.copy()
LOWER[UPPER] += 32


@dataclass
class Words:
    """Raw bytes of some texts, each followed by a line feed, and the words in them."""

    raw: np.ndarray
    doc_start: np.ndarray  # of every text, and the end of the last
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_start) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            steps = np.full(size, BASE, np.uint64)
            back = np.full(size, pow(BASE, -1, 2**64), np.uint64)
            steps[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(steps), np.cumprod(back)
        return cls.up, cls.down


def range_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same for equal bytes wherever they stand."""
    up, down = Powers.of(len(codes) + 1)
    upto = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=upto[1:])
    return mixed((upto[end] - upto[start]) * down[start])


def block_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, by its blocks of eight bytes, each mixed with its place.

    Unlike ``range_hash``, whose powers of an odd base leave patterns in long words, different
    ranges share a hash by chance only.
    """
    size = end - start
    many = (size + 7) // 8
    first = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(first, many)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    window = np.ndarray(len(codes) + 1, "<u8", padded, 0, (1,))
    left = np.repeat(size, many) - 8 * place
    mask = np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
    block = window[np.repeat(start, many) + 8 * place] & mask
    block = mixed(mixed(block + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)))
    out = size.astype(np.uint64) * MIX
    if len(block):
        some = many > 0
        out[some] += np.add.reduceat(block, first[some])
    return mixed(out)


def find_words(
    texts: list[str | None],
    is_word: np.ndarray = IS_WORD,
    fold: bool = True,
    hashed: Callable[..., np.ndarray] = range_hash,
) -> Words:
    """Maximal runs of word bytes (letters, digits and all beyond ASCII unless told otherwise)."""
    data = [(t or "").encode() for t in texts]
    doc_start = np.cumsum([0, *(len(d) + 1 for d in data)])
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[:-1] = is_word[raw]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        turns = np.concatenate([[0], turns])
    start, end = turns[::2], turns[1::2]
    doc = np.searchsorted(doc_start, start, "right") - 1
    codes = LOWER[raw] if fold else raw
    return Words(raw, doc_start, start, end, doc, hashed(codes, start, end))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[str | None]]:
    """The texts in turn, in lists of about ``limit`` characters, a longer text alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part
