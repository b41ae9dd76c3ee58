"""SentencePiece encoding that keeps offsets, and decoding.

The model file gives the pieces, their scores and the compiled character map: a trie of byte
strings with their replacements. Normalisation walks a text by the longest prefix found in the map
and records for every normalised byte which original byte it stands for; merges then join
neighbouring symbols, best score first and leftmost of equals, and every piece is projected to the
original bytes that it covers. No piece of the vocabulary holds a space mark behind another
character (checked when the model is read), so no merge crosses from one word to the next and
each word is encoded once and remembered.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty
text; a character outside the vocabulary becomes its bytes where the model has byte pieces, else
the unknown id. Ids of a text are those of the sentencepiece library without sampling.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from loomgrid.llm.rows import unwrap, wrap
from loomgrid.llm.vocabulary import WordStore

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
BAD = "�"
#: characters of a word up to which pairs are scanned rather than queued
SHORT = 40
NEVER = float("-inf")
#: a word with the space marks before it, or marks at the end
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTER = re.compile(f"[{LETTERS}]")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~\n\t\r"
SEGMENT = re.compile("▁*[^▁]+|▁+")


class CharacterMap:
    """The compiled map of a model: a double-array trie and its replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``data[at:]``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._step(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            # the label of a unit is its lowest byte; leaves have the highest bit set
            if unit & 0x800000FF != data[i]:
                break
            node = self._step(node, unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.strings[start : self.strings.index(b"\0", start)]

    @staticmethod
    def _step(node: int, unit: int) -> int:
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)


class PieceModel:
    """Vocabulary and rules of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            spec = proto.ModelProto.FromString(file.read())
        if spec.trainer_spec.model_type != BPE or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge models with space marks before words are supported")
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.dummy = rules.add_dummy_prefix
        self.squeeze = rules.remove_extra_whitespaces
        self.escape = rules.escape_whitespaces
        self.kinds = [p.type for p in spec.pieces]
        self.pieces = [p.piece for p in spec.pieces]
        self.ids, self.scores = {}, {}
        for i, p in enumerate(spec.pieces):
            if p.type in (NORMAL, USER, UNUSED):
                self.ids[p.piece], self.scores[p.piece] = i, p.score
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.size = {p: len(p.encode()) for p in self.ids}
        if max(self.size.values()) > 255:
            raise ValueError("a piece has more than 255 bytes")
        self.seam = self.seams()
        # a byte piece is named <0x0A>
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        self.plain = not self.map.units and not self.squeeze and self.escape

    def seams(self) -> re.Pattern | None:
        """Places between a letter and a mark of punctuation that no piece has side by side, so no
        merge joins what is on their two sides."""
        joined = set()
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                if bool(LETTER.match(a)) != bool(LETTER.match(b)):
                    joined.update((a, b))
        marks = re.escape("".join(c for c in PUNCTUATION if c not in joined))
        if not marks:
            return None
        return re.compile(f"(?<=[{LETTERS}])(?=[{marks}])|(?<=[{marks}])(?=[{LETTERS}])")

    # -- normalisation -----------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its UTF-8 bytes and its end the original byte."""
        data = text.encode()
        space = (MARK if self.escape else " ").encode()
        out, origin = bytearray(), []

        def put(part: bytes, at: int) -> None:
            out.extend(part)
            origin.extend([at] * len(part))

        at, begun = 0, False
        while self.squeeze and at < len(data):
            length, part = self.prefix(data, at)
            if part.strip(b" "):
                break
            at += length
        if at < len(data) and self.dummy:
            put(space, at)
            begun = self.squeeze
        while at < len(data):
            length, part = self.prefix(data, at)
            if begun:
                part = part.lstrip(b" ")
            if part:
                for byte in part:
                    put(space if byte == 32 else bytes([byte]), at)
                begun = self.squeeze and part.endswith(b" ")
            at += length
        end = len(data)
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            end = origin[len(out)]
            del origin[len(out) :]
        return out.decode(), [*origin, end]

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the next original part and its replacement."""
        found = self.map.longest(data, at)
        if found:
            return found
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return length, data[at : at + length]

    # -- merges ------------------------------------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """Symbols of a word after all merges, the best one first, the leftmost of equals."""
        if len(word) > SHORT:
            return self.merged_long(word)
        symbols, score = list(word), self.scores.get
        joint = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while joint:
            best = max(joint)
            if best == NEVER:
                break
            i = joint.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)
            if i < len(joint):
                joint[i] = score(symbols[i] + symbols[i + 1], NEVER)
        return symbols

    def merged_long(self, word: str) -> list[str]:
        """The same with a queue of pairs, whose work grows hardly faster than the word."""
        symbols: list[str | None] = list(word)
        following = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        queue: list[tuple[float, int, int, str]] = []
        scores = self.scores

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbols[left] + symbols[right]
                if both in scores:
                    heapq.heappush(queue, (-scores[both], left, right, both))

        for left in range(len(symbols) - 1):
            offer(left, left + 1)
        while queue:
            _, left, right, both = heapq.heappop(queue)
            if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            following[left] = following[right]
            if following[left] >= 0:
                before[following[left]] = left
            offer(before[left], left)
            offer(left, following[left])
        return [s for s in symbols if s is not None]

    def symbol_ids(self, symbol: str) -> list[int]:
        if symbol in self.ids:
            return [self.ids[symbol]]
        if self.byte_ids:
            return [self.byte_ids[b] for b in symbol.encode()]
        return [self.unknown]

    # -- encoding and decoding ---------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """Words of the normalised text."""
        if not self.plain or not text:
            return SEGMENT.findall(self.normalise(text)[0])
        return SEGMENT.findall(MARK * self.dummy + text.replace(" ", MARK))

    def alignment(self, text: str) -> tuple[list[str], np.ndarray]:
        """Words of the normalised text, and for each of its UTF-8 bytes and its end the byte of
        the original that it stands for."""
        if not self.plain or not text:
            normal, origin = self.normalise(text)
            return SEGMENT.findall(normal), np.array(origin, np.int64)
        # only spaces change: each becomes the three bytes of a mark, one more stands in front
        data = np.frombuffer(text.encode(), np.uint8)
        origin = np.repeat(np.arange(len(data)), np.where(data == 32, 3, 1))
        ahead = np.zeros(3 * self.dummy, np.int64)
        return self.segments(text), np.concatenate([ahead, origin, [len(data)]])

    def encoded(self, word: str) -> list[tuple[int, int]]:
        """(id, normalised bytes) of the pieces of a word. The bytes of a character that is not in
        the vocabulary have a piece each, of which the last one counts the whole character."""
        out = []
        for symbol in self.merged(word):
            size = len(symbol.encode())
            *rest, last = self.symbol_ids(symbol)
            out += [(i, 0) for i in rest] + [(last, size)]
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every piece in the original text's UTF-8."""
        words, origin = self.alignment(text)
        pieces = [p for word in words for p in self.encoded(word)]
        ends = np.cumsum([0, *(size for _, size in pieces)])
        at = origin[ends].tolist()
        return [(i, a, b) for (i, _), a, b in zip(pieces, at, at[1:])]

    def surface(self, ids: list[int]) -> str:
        """Text of ids inside a sentence: marks become spaces, byte pieces their characters."""
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            parts.append(characters(bytes(run)))
            run.clear()
            if i is not None and self.kinds[i] != CONTROL:
                known = self.kinds[i] != UNKNOWN
                parts.append(self.pieces[i].replace(MARK, " ") if known else self.unknown_text)
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        told = [i for i in ids if self.kinds[i] != CONTROL]
        text = self.surface(told)
        return self.begun(text) if told and self.kinds[told[0]] == NORMAL else text

    def begun(self, text: str) -> str:
        """Without the space that stands for the beginning of a sentence."""
        return text[1:] if text.startswith(" ") and (self.dummy or self.squeeze) else text


def characters(data: bytes) -> str:
    """Characters of bytes; every byte that is part of none is one replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[: bad.start].decode() + BAD)
            data = data[bad.start + 1 :]
    return "".join(out)


@cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Ids, spans and decoded text of whole texts, from remembered words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words = WordStore(self._word)

    def _word(self, word: str) -> tuple[str, bytes, str]:
        """Ids as text, normalised size of every piece, and the text that the ids decode to: the
        bytes of a character stay together, so words decode on their own."""
        model = self.model
        parts = model.seam.split(word) if model.seam else [word]
        if len(parts) > 1:
            found = [self.words[part] for part in parts]
            return ",".join([f[0] for f in found]), b"".join([f[1] for f in found]), "".join([f[2] for f in found])
        symbols = model.merged(word)
        try:
            ids = ",".join([model.id_text[s] for s in symbols])
            return ids, bytes([model.size[s] for s in symbols]), word.replace(MARK, " ")
        except KeyError:  # a character is not in the vocabulary
            pieces = model.encoded(word)
        numbers = [i for i, _ in pieces]
        return ",".join(map(str, numbers)), bytes([n for _, n in pieces]), model.surface(numbers)

    def report(self, text: str | None) -> tuple[int, str, str, int]:
        """Number of ids, digests of ids and decoded text, checksum of the pieces' end bytes."""
        words, origin = self.model.alignment(text or "")
        found = [self.words[word] for word in words]
        sizes = np.frombuffer(b"".join([sizes for _, sizes, _ in found]), np.uint8)
        ends = origin[np.cumsum(sizes, dtype=np.int64)]
        ids = ",".join([ids for ids, _, _ in found])
        decoded = self.model.begun("".join([part for _, _, part in found]))
        return len(sizes), digest(ids), digest(decoded), zlib.crc32(ends.astype("<i8").tobytes())


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def with_pieces(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``ends_crc32``."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")
    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(load(path))
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"]
        for texts in batches:
            yield pd.DataFrame([encoder.report(t) for t in texts], columns=names)

    rows = wrap(df, text=text).withColumn("found", report(F.col("text")))
    return unwrap(rows, **{n: F.col("found")[n] for n in rows.schema["found"].dataType.names})


def with_spans(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``pieces``: id, first and end byte of every piece in the text's UTF-8."""

    @F.pandas_udf("array<struct<id: int, first: long, end: long>>")
    def spans(texts: pd.Series) -> pd.Series:
        model = load(path)
        names = ("id", "first", "end")
        return pd.Series([[dict(zip(names, p)) for p in model.spans(t or "")] for t in texts])

    return unwrap(wrap(df, text=text), pieces=spans(F.col("text")))
