"""Whole-batch word kernels: Arrow string buffers in, numpy arrays out.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Working on
the UTF-8 buffers of an Arrow array splits and hashes millions of words with a
few numpy passes instead of a Python loop per word.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)
LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
LONG_WORD = 256
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a chunk of texts; ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return data[lo:hi], (off - lo if len(off) else np.zeros(1, np.int64))


def release() -> None:
    """Give freed memory back to the system.  Python workers outlive their tasks, and
    what one stage's arrays took would otherwise add to the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at row bounds so that the texts of each stay near ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0).to_numpy()
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def split_words(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words between the bytes for which ``space`` is true."""
    data, off = text_buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, np.zeros(len(off), np.int64))
    word = ~space[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from its bytes and length alone."""
    length = end - start
    out = mix(length.astype(U64) * GOLD + U64(1))
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at = start[live]
    left = length[live]
    while len(live):
        lane = lanes[at] & LANE_MASK[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ lane) * GOLD + U64(0x632BE59BD9B4E019))
        keep = left > 8
        live, at, left = live[keep], at[keep] + 8, left[keep] - 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    return out


def hash_words(words: Words) -> np.ndarray:
    return hash_spans(words.data, words.start, words.end)


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay in one text, and their offsets by text."""
    counts = np.diff(first)
    per = np.maximum(counts - n + 1, 0)
    off = np.concatenate([[0], np.cumsum(per)])
    if not off[-1]:
        return np.zeros(0, U64), off
    at = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], per)
    out = h[at]
    for k in range(1, n):
        out = mix(out * GOLD + h[at + k])
    return out, off


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ``\\n``-pieces of the texts of a chunk: (text index, start, end, trimmed
    start, trimmed end); the trimmed bounds are equal for a blank line."""
    data, off = words.data, words.offsets
    start = np.sort(np.concatenate([off[:-1], np.flatnonzero(data == 0x0A) + 1]))
    doc = np.searchsorted(off, start, "right") - 1
    # a text that ends in \n has an empty last line, which starts where the next text does
    if len(start):
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        per = 1 + breaks[off[1:]] - breaks[off[:-1]]
        doc = np.repeat(np.arange(len(off) - 1), per)
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    end = np.where(last, off[doc + 1], np.concatenate([start[1:], [0]]) - 1) if len(doc) else start
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = b > a
    lo, hi = start.copy(), start.copy()
    lo[full], hi[full] = words.start[a[full]], words.end[b[full] - 1]
    return doc, start, end, lo, hi
