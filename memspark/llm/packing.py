"""Packing by power-of-two decomposition (operator 7).

A document of T tokens, its closing id included, is cut into pieces whose
lengths are powers of two: as many of ``max_len`` as fit, then the binary
digits of the rest from the largest down.  Each piece is one training sequence,
so no sequence crosses documents and none needs padding; batches are drawn from
buckets of equal length.  Nothing is shuffled.

Defined cases: a null or empty text has the closing id alone; an added token
spelt out in a text has its own id, as in ``tokenizers``; texts are read whole; repeated rows are packed each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White-space runs from this length on go to ``tokenizers``: tiktoken's pattern takes a stack entry per
#: character of a run and panics at a million.
LONG_SPACE = 1 << 16
SPACES = re.compile(r"\s+")


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids that ``tokenizers`` gives for a byte-level BPE file whose ids are
    its merge ranks.  tiktoken runs the same merges about four times as fast, but
    knows no added tokens and fails on very long white space: texts with either
    go to ``tokenizers`` itself.  Both are compared when the encoder is built."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    alphabet = byte_alphabet()
    vocab = {word: i for word, i in spec["model"]["vocab"].items() if word not in added}
    ranks = {bytes(alphabet[c] for c in word): i for word, i in vocab.items() if all(c in alphabet for c in word)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        long = len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in SPACES.finditer(text))
        if long or any(t in text for t in added):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    probe = "Größe, it's 12,5 % — été 'll\t\n\n  x9 日本 🙂 " * 3
    if encode(probe) != slow.encode(probe, add_special_tokens=False).ids:
        raise ValueError(f"{path}: its ids are not its merge ranks")
    return encode


def piece_lengths(tokens: int, max_len: int) -> list[int]:
    whole, rest = divmod(tokens, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def token_pieces(text: str, path: str, max_len: int, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece of one text."""
    ids = np.array([*encoder(path)(text), end_id], dtype="<u4")
    at = 0
    for n in piece_lengths(len(ids), max_len):
        yield at, ids[at : at + n]
        at += n


def pack(df: DataFrame, tokenizer: str, max_len: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and ``ids`` if asked for; ``length`` is also the bucket of the sequence.

    ``max_len`` is a power of two.  ``tokenizer`` is a path that every executor has.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces = list(token_pieces(text or "", tokenizer, max_len, end_id))
                n = sum(len(p) for _, p in pieces)
                for at, piece in pieces:
                    doc.append(d)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(piece)
            cols = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(df.sparkSession)
    pieces = df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences (``with_ids``) into one folder per length, ready for batches of equal shape."""
    packed.write.partitionBy("length").parquet(path)
