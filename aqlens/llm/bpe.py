"""Byte-level BPE encoding and decoding.

Vocabulary bytes are mapped to Latin-1 characters, so a pyahocorasick
automaton over the tokens reports in one pass over a piece the longest token
that starts at each position.  Encoding walks from longest match to longest
match and steps back to the next shorter token whenever two neighbours could
not stand side by side in a merge order; whether two tokens may be adjacent is
decided from the vocabulary alone and memoised.  Every position is entered a
bounded number of times (positions found to be dead ends are marked), so the
work is linear in the piece, and the result is the exact merge result.

Texts are cut by the pre-tokenising pattern first; each match is encoded
separately.  Nulls count as the empty text.  Empty texts have no ids.
"""

from __future__ import annotations

import base64
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import slices

# Stretches kept in each generation of a worker's memo.
MEMO_PIECES = 300_000
MEMO_PIECE_CHARS = 64
# Characters that are neither letters, numbers nor white space.
SIGNS = string.punctuation
# Letters before this one are letters in every version of Unicode in use.
OLD_LETTERS = "\u0530"
MEMO_PAIRS = 500_000


class _Pairs(dict):
    """Memo of which tokens may stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.stays_apart = vocabulary.stays_apart

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= MEMO_PAIRS:
            self.clear()
        known = self[pair] = self.stays_apart(*pair)
        return known


class Vocabulary:
    """Ranks of a byte-level vocabulary with the tables that encoding needs."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.safe_space = regex.compile(r"(?<=\S) (?=\S)")
        self.odd_space = regex.compile(r"\s\s")
        self.length = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # halves: the two parts whose merge makes a token (itself for one byte);
        # merged: the token that two adjacent parts make; shorter: the longest
        # token that is a proper prefix.
        self.halves = [(r, r) for r in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter = [-1] * len(self.tokens)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                left, right = self._last_merge(token, rank)
                self.halves[rank] = (left, right)
                self.merged[(left, right)] = rank
                for end in range(len(token) - 1, 0, -1):
                    if token[:end] in self.ranks:
                        self.shorter[rank] = self.ranks[token[:end]]
                        break
        self.pairs = _Pairs(self)

    def _last_merge(self, token: bytes, below: int) -> tuple[int, int]:
        """The two parts left when all merges of a lower rank are done."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at, best = -1, below
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    at, best = i, rank
            if at < 0:
                raise ValueError(f"token {below} can't be reached by merges of lower rank")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the merges of the joined bytes keep these two tokens apart."""
        # Undo the merges of both tokens from the latest to the earliest; at
        # each state the facing parts must have no merge that comes before the
        # merge just undone.
        before = len(self.tokens) + 1
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < before:
                return False
            one_a, one_b = self.length[a] == 1, self.length[b] == 1
            if one_a and one_b:
                return True
            if one_b or (not one_a and a > b):
                before, a = a, self.halves[a][1]
            else:
                # on equal rank the left token's merge comes first, so the
                # right token's is undone first
                before, b = b + 1, self.halves[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        # Longest match after longest match; a tiling whose neighbours are all
        # compatible is the encoding.
        out = [rank for _, rank in self.automaton.iter_long(latin)]
        n, apart = len(piece), self.pairs.__getitem__
        if False not in map(apart, zip(out, out[1:])) and sum(map(self.length.__getitem__, out)) == n:
            return out
        longest = [0] * n
        length, shorter = self.length, self.shorter
        for end, rank in self.automaton.iter(latin):
            longest[end + 1 - length[rank]] = rank  # ends rise, so the longest stays
        alive = bytearray(b"\1") * (n + 1)
        out, last, at, token = [], -1, 0, longest[0]
        while True:
            end = at + length[token]
            if alive[end] and (last < 0 or apart((last, token))):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            if token < 0:  # nothing fits here: step back over the last token
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> list[int]:
        """Ids of a text: each match of the pattern separately."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < OLD_LETTERS:  # one match of letters, with the space before it
            return self.encode_piece(text.encode("utf-8"))
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode("utf-8"))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Packed ids of a stretch of text, worked out when first met.

    Two generations bound its size: when the young one is full it becomes the
    old one, from which stretches met again are taken over.
    """

    def __init__(self, vocabulary: Vocabulary, prefix: str, signs: dict[str, bytes] | None = None):
        self.vocabulary, self.prefix, self.signs, self.old = vocabulary, prefix, signs, {}

    def __missing__(self, stretch: str) -> bytes:
        # letters followed by signs are two matches: the word is kept once,
        # whatever stands after it
        word = stretch.rstrip(SIGNS)
        if self.signs is not None and len(word) < len(stretch) and word.isalpha() and max(word) < OLD_LETTERS:
            return self[word] + self.signs[stretch[len(word) :]]
        packed = self.old.get(stretch)
        if packed is None:
            packed = array("i", self.vocabulary.encode(self.prefix + stretch)).tobytes()
        if len(stretch) <= MEMO_PIECE_CHARS:
            if len(self) >= MEMO_PIECES:
                self.old = dict(self)
                self.clear()
            self[stretch] = packed
        return packed


class Encoder:
    """Encodes whole texts, memoising the ids of repeated stretches.

    A single space between two non-space characters always begins a new match
    of the pattern, so the stretches between such spaces are independent.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        signs = _Memo(vocabulary, "")
        self.first, self.spaced = _Memo(vocabulary, "", signs), _Memo(vocabulary, " ", signs)

    def packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or self.vocabulary.odd_space.search(text):
            parts = self.vocabulary.safe_space.split(text)
        else:
            parts = text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))


_LOADED: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary."""
    rank_file, pattern = shared.value
    key = hash((rank_file, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(rank_file, pattern))
    return _LOADED[key]


def _share(df: DataFrame, rank_path: str, pattern: str):
    """The vocabulary is broadcast: its size is that of the rank file."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``ids`` (array of int).

    Null and empty texts have an empty array; null ids and repeated rows are
    kept as they are; other columns are not read.
    """
    shared = _share(df, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in slices(batch, 1):
                packed = [encoder.packed("" if b is None else b.decode("utf-8")) for b in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col``, ``ids_col`` and ``decoded`` (binary).

    A null array counts as empty; an id outside the vocabulary is an error.
    """
    shared = _share(df, rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(shared).vocabulary.tokens
        get = tokens.__getitem__
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                texts = [b"" if x is None else b"".join(map(get, x)) for x in lists.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"]
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})
