"""Exact byte-level BPE in linear time.

The vocabulary's byte strings are mapped to Latin-1 so that one Aho-Corasick automaton finds all tokens in a piece. A
piece is then covered by backtracking: at each position the longest token is taken whose pair with the token before it
is *compatible*, that is, BPE of the two together gives just these two. A sequence whose adjacent pairs are all
compatible is the BPE of the piece, and every prefix has exactly one, so a position that cannot be continued is never
tried again: linear time. Compatibility is worked out by undoing merges and memoised.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.runtime import ship

TOKENIZER_DIR = "/opt/tokenizers"
#: The published pre-tokenisation pattern of this vocabulary: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pieces remembered by a worker before it starts anew: bounds its memory, not the result.
CACHE = 400_000


class ByteBpe:
    """Encoder over a table of ranks (token bytes -> id, ids in order of merging)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.auto = ahocorasick.Automaton()
        for k, v in self.ids.items():
            self.auto.add_word(k, (len(k), v))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.compat: dict[tuple[int, int], bool] = {}
        self._learn()
        self.rx = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _learn(self) -> None:
        """Which two tokens each token was merged from: its only split whose halves are compatible under earlier merges."""
        ids = self.ids
        for tok, t in sorted(ids.items(), key=lambda x: x[1]):
            for cut in range(1, len(tok)):
                a, b = ids.get(tok[:cut]), ids.get(tok[cut:])
                if a is not None and b is not None and a < t and b < t and self._compatible(a, b):
                    self.pairs[a, b] = t
                    self.halves[t] = (a, b)
                    break
        self.compat.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary would have come before the merges inside left and right.

        Walks back in time: always undoes the latest merge that touches the boundary. A pair across the boundary with an
        earlier rank than the merge last undone would have won then, and the two tokens would never have formed.
        """
        pairs, halves, undone = self.pairs, self.halves, 1 << 40
        while True:
            over = pairs.get((left, right))
            if over is not None and over < undone:
                return False
            if left > right:
                split = halves.get(left)
                if split is not None:
                    undone, left = left, split[1]
                    continue
                # a base byte on the left: only the right one can still be undone
                split = halves.get(right)
                if split is None:
                    return True
                undone, right = right + 1, split[0]
            else:
                split = halves.get(right)
                if split is not None:
                    undone, right = right + 1, split[0]
                    continue
                split = halves.get(left)
                if split is None:
                    return True
                undone, left = left, split[1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 of its UTF-8 bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        options: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, t) in self.auto.iter(piece):
            options[end - length + 1].append((length, t))  # ends rise, so each list is in order of length
        compat, compatible = self.compat, self._compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        starts: list[int] = []
        left: list[int] = []  # options not yet tried at each token of out
        at, k = 0, len(options[0])
        while at < n:
            here, took = options[at], False
            while k:
                k -= 1
                length, t = here[k]
                if dead[at + length]:
                    continue
                if out:
                    pair = (out[-1], t)
                    ok = compat.get(pair)
                    if ok is None:
                        ok = compat[pair] = compatible(*pair)
                    if not ok:
                        continue
                out.append(t)
                starts.append(at)
                left.append(k)
                at += length
                k = len(options[at]) if at < n else 0
                took = True
                break
            if not took:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
                at, k = starts.pop(), left.pop()
        if len(compat) > 4_000_000:
            compat.clear()
        return out

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids of a text; what looks like a special token is ordinary text."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def packed(self, text: str) -> bytes:
        """Ids of a text as packed int32."""
        return b"".join(map(self._piece, self.rx.findall(text)))

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
            got = np.array(self.encode_piece(raw), np.int32).tobytes()
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            self.pieces[piece] = got
        return got


#: A blank between two visible characters always begins a pre-token, so a text may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ASCII_EDGE = re.compile(r"[^\s\x1c-\x1f\x85](?:.*[^\s\x1c-\x1f\x85])?\Z", re.S)


class _Words(dict):
    """Remembered ids of words led by a blank; a word with blanks at its edges has no ids of its own."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if not _ASCII_EDGE.match(word):
            raise LookupError
        got = self.bpe.packed(" " + word)
        if len(word) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


class TextEncoder:
    """Whole texts by way of remembered words."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.words = bpe, _Words(bpe)

    def packed(self, text: str) -> bytes:
        parts = text.split(" ")
        try:
            if not parts[0] or not _ASCII_EDGE.match(parts[0]):
                raise LookupError
            return self.bpe.packed(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))
        except LookupError:
            return self._uneven(text)

    def _uneven(self, text: str) -> bytes:
        """A text with runs of white space: cut at the single blanks only."""
        parts = _CUT.split(text)
        out = [self.bpe.packed(parts[0] if len(parts) == 1 else parts[0])]
        for p in parts[1:]:
            try:
                out.append(self.words[p])
            except LookupError:
                out.append(self.bpe.packed(" " + p))
        return b"".join(out)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(ByteBpe.load(path))
    return _encoders[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids): the token ids of every text, in order, without special tokens.

    A null text and an empty text both give an empty list. Every row gives one row, repeated rows too; a null id is kept.
    No shuffle: one pass over the two columns, whatever else the table holds. An empty table gives no rows.
    """
    ship(df.sparkSession)
    path = f"{tokenizer_dir}/{tokenizer}.tiktoken"
    base = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))
    arrow_list = pa.list_(pa.field("element", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                packed = [enc.packed(x) if x else b"" for x in part.column(1).to_pylist()]
                offsets = pa.array(np.array([0, *accumulate(len(p) // 4 for p in packed)], np.int32))
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1].as_py()), [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(offsets, values, type=arrow_list)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    kind = base.schema["k"].dataType.simpleString()
    return base.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(id_col), "ids")
