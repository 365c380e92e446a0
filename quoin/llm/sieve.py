"""A sieve of hashed keys: what it lacks occurs nowhere, so it need not be shuffled to be found missing.

It only saves work, never decides: what passes is joined exactly. Its size follows the number of keys, up to MAX_BITS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most and the fewest bits: 32 MB bound what is collected and broadcast; with more than some 10 million keys more passes.
PER_KEY, MAX_BITS, MIN_BITS = 64, 1 << 28, 1 << 20
_SEGMENT = 16  # a segment is 2 ** 16 bits, built by one task


class Sieve:
    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits >> 5, np.uint32)

    def __contains__(self, key: int) -> bool:
        bit = key & (self.bits - 1)
        return bool(self.words[bit >> 5] >> (bit & 31) & 1)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """For each of many keys whether it may be there."""
        bit = keys.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[int, np.ndarray] = {}
    for b in batches:
        bit = np.asarray(b.column(1))
        order = np.argsort(bit, kind="stable")
        bit = bit[order]
        seg = bit >> _SEGMENT
        cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)] if len(seg) else []
        for a, z in zip(cuts, cuts[1:]):
            own = made.setdefault(int(seg[a]), np.zeros(1 << (_SEGMENT - 5), np.uint32))
            low = bit[a:z] & ((1 << _SEGMENT) - 1)
            np.bitwise_or.at(own, low >> 5, np.uint32(1) << (low & 31).astype(np.uint32))
    yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([w.tobytes() for w in made.values()], pa.binary())], names=["segment", "words"])


def sieve_of(keys: DataFrame, n: int) -> Sieve:
    """A sieve of the one bigint column of keys, of which there are about n. Each segment comes from one task."""
    out = Sieve(min(MAX_BITS, max(MIN_BITS, 1 << (PER_KEY * max(n, 1) - 1).bit_length())))
    bit = F.col(keys.columns[0]).bitwiseAND(F.lit(out.bits - 1))
    rows = keys.select(F.shiftright(bit, _SEGMENT).alias("segment"), bit.alias("bit")).repartition("segment")
    size = 1 << (_SEGMENT - 5)
    for segment, words in rows.mapInArrow(_segments, "segment long, words binary").collect():
        out.words[segment * size : (segment + 1) * size] |= np.frombuffer(words, np.uint32)
    return out


def text_key(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in b.column(0).to_pylist()], pa.int64())], names=["key"])


def sieve_of_texts(texts: DataFrame, n: int) -> Sieve:
    """A sieve of the one string column of texts; ask it with ``text_key``."""
    return sieve_of(texts.mapInArrow(_text_keys, "key long"), n)
