"""Removal of long repeated byte strings by a family of suffix arrays (operator 11).

A window is ``min_bytes`` consecutive bytes of a text.  Every byte goes that lies
in a window which also starts anywhere else, in the same text or another.

Suffixes are indexed where their content says so: in each window the place of
the smallest hash of PREFIX bytes is its anchor, so equal windows have their
anchors at the same distance, and a text has about one anchor per 140 bytes,
which owns the windows that chose it.  The array of a batch holds the suffixes at
its anchors in the order of their first eight bytes and a fingerprint of the
first PREFIX; suffixes with the same surroundings, as far as the owned windows
reach, are one entry with their number.

New batches are added one after the other.  The array of a batch is merge-joined
with each level of the index; a level is the array of 2^k batches, and two levels
of one size become one of the next, so an entry is rewritten once per doubling.
An entry that is met again with the same surroundings marks all its windows, in
the batch and in the level.  Entries that agree in the prefix only are kept aside
("open"): part of their windows may be equal.

Open suffixes are compared window by window at the end, without pairing them: a
window starts at most 15 bytes before one of the places that lie at multiples of
16 before its anchor.  The fingerprint of the 385 bytes from there on that all 16
windows share, together with the 15 bytes at either side, tells for each window
which others equal it, by grouping.  A passage with a million surroundings is a
million rows spread by their content, never a group that one task must hold.

Defined cases: a null text is empty; texts shorter than a window lose nothing; a
null id is an id; rows that share id and text are copies and lose their windows
in each; fingerprints have 64 bits of two polynomials; an empty table gives an
empty result.  Other columns are kept, but for those named n_bytes, spans and
kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from memspark.llm import textvec as tv
from memspark.llm.common import discard, saved, small_batches

U64 = np.uint64
MIN_BYTES = 400
#: Bytes of an anchor; windows whose starts share one comparison.
PREFIX, GROUP = 128, 16
#: Windows that are looked at together; their places fit into PLACE_BITS.
SEGMENT, PLACE_BITS = 1 << 19, 20
#: Two bases of polynomial fingerprints, and a number for each byte.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
BYTE_VALUE = tv.mix(np.arange(1, 257, dtype=U64) * tv.GOLD)


class Powers(NamedTuple):
    up: np.ndarray
    down: np.ndarray


powers_of: dict[int, Powers] = {}


def powers(base: int, n: int) -> Powers:
    """Powers of a base and of its inverse, modulo 2^64."""
    if base not in powers_of or len(powers_of[base].up) < n:
        size = max(n, SEGMENT + 4096)
        series = lambda b: np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))])
        powers_of[base] = Powers(series(base), series(pow(base, -1, 1 << 64)))
    return powers_of[base]


class Prints:
    """Fingerprints of any spans of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, bases: tuple[int, ...] = BASES) -> None:
        value = BYTE_VALUE[data]
        self.sums = [(np.concatenate([np.zeros(1, U64), np.cumsum(value * powers(b, len(data) + 1).up[: len(data)])]), powers(b, len(data) + 1).down) for b in bases]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - start).astype(U64)
        for total, down in self.sums:
            out = tv.mix(out * tv.GOLD + (total[end] - total[start]) * down[start])
        return out


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by least values to the left and right inside blocks."""
    n = len(v) - width + 1
    blocks = -(-len(v) // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of texts that lie one after the other, ``off`` their bounds: text, place, first
    and last owned window (places within the text), order key, prefix and surroundings."""
    mask = U64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        n = len(part) - length + 1
        # windows that cross a bound
        inner = off[(off > at) & (off < at + len(part))] - at
        crossing = np.zeros(len(part) + 1, np.int32)
        np.add.at(crossing, np.maximum(inner - length + 1, 0), 1)
        np.add.at(crossing, inner, -1)
        whole = np.cumsum(crossing)[:n] == 0
        if not whole.any():
            continue
        prints = Prints(part)
        total, down = prints.sums[0]
        grams = tv.mix((total[PREFIX:] - total[:-PREFIX]) * down[: len(part) - PREFIX + 1])
        least = sliding_least((grams & ~mask) | np.arange(len(grams), dtype=U64), length - PREFIX + 1)
        place = (least & mask).astype(np.int64)
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        ends = np.flatnonzero(whole & np.concatenate([~whole[1:] | (place[1:] != place[:-1]), [True]]))
        q = place[first]
        text = np.searchsorted(off, at + first, "right") - 1
        around = tv.mix(prints.of(first, ends + length) + (q - first).astype(U64))
        lanes = np.ndarray(shape=(len(part) - 7,), dtype=">u8", buffer=np.ascontiguousarray(part), strides=(1,))
        lane = (lanes[q].astype(U64) ^ U64(1 << 63)).view(np.int64)
        shift = at - off[text]
        yield {"text": text, "q": q + shift, "lo": first + shift, "hi": ends + shift, "lane": lane, "prefix": grams[q].view(np.int64), "around": around.view(np.int64)}


#: A place is an anchor q of a text; its windows start from ``first`` to ``last`` bytes before it, and
#: those of its repeats right behind it up to ``run`` bytes later.  Small numbers take little room.
LOC = ("doc_id", "text_hash", "q", "first", "last", "run")
ENTRY = "lane long, prefix long, around long, doc_id long, text_hash long, q long, first int, last int, run int, n long"


def entries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Index entries of texts; neighbours with the same surroundings (a repeated byte, say) are one."""
    for batch in tv.chunks(batches):
        data, off = tv.text_buffers(batch.column("text"))
        ids, hashes = batch.column("doc_id"), batch.column("text_hash")
        for a in anchors(data, off, length):
            head = np.ones(len(a["q"]), bool)
            head[1:] = (a["text"][1:] != a["text"][:-1]) | (a["prefix"][1:] != a["prefix"][:-1]) | (a["around"][1:] != a["around"][:-1])
            at = np.flatnonzero(head)
            tail = np.concatenate([at[1:], [len(head)]]) - 1
            text = pa.array(a["text"][at])
            cols = [a["lane"][at], a["prefix"][at], a["around"][at], ids.take(text), hashes.take(text), a["q"][at], *((x).astype(np.int32) for x in (a["q"][at] - a["lo"][at], a["q"][at] - a["hi"][at], a["hi"][tail] - a["hi"][at])), tail - at + 1]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["lane", "prefix", "around", *LOC, "n"])


class Level(NamedTuple):
    """A suffix array over so many batches: (lane, prefix, around, n) and the LOC of one of the n places."""

    batches: int
    array: DataFrame


KEY, CLASS = ["lane", "prefix"], ["lane", "prefix", "around"]


def ordered(rows: DataFrame) -> DataFrame:
    """Entries as an array in suffix order, as a saved table."""
    return saved(rows.repartitionByRange(*KEY).sortWithinPartitions(*CLASS), "array")


def classes(rows: DataFrame) -> DataFrame:
    """Entries with the same surroundings as one, with any one place of them."""
    return rows.groupBy(*CLASS).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in LOC])  # all of one row


def marked(rows: DataFrame) -> DataFrame:
    """The starts of all windows of places, from lo to hi."""
    return rows.select("doc_id", "text_hash", (F.col("q") - F.col("first")).alias("lo"), (F.col("q") - F.col("last") + F.col("run")).alias("hi"))


class SuffixIndex:
    """Suffix arrays of the batches so far, in levels of geometric size, and what their scans have found."""

    def __init__(self, spark: SparkSession, min_bytes: int = MIN_BYTES) -> None:
        if not PREFIX + GROUP <= min_bytes <= SEGMENT:
            raise ValueError(f"from {PREFIX + GROUP} to {SEGMENT} bytes")
        small_batches(spark)
        self.length = min_bytes
        self.levels: list[Level] = []
        self.marks: list[DataFrame] = []
        self.open: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Index docs(doc_id, text) and scan them against all that is indexed."""
        length = self.length
        source = located(docs).select("doc_id", "text_hash", "text")
        found = saved(source.mapInArrow(lambda it: entries(it, length), ENTRY), "entries")
        own = ordered(classes(found))
        # copies inside the batch
        self.marks.append(saved(marked(found.join(own.where("n > 1").select(*CLASS), CLASS, "left_semi")), "marks"))
        discard(found)
        both, scans = own, []
        keys = own.select(*KEY).distinct().hint("merge")
        for level in self.levels:
            scans.append(saved(level.array.join(keys, KEY, "left_semi"), "scan"))
            both = both.unionByName(scans[-1])
        often = saved(both.groupBy(*KEY).agg(F.sum("n").alias("total"), (F.min("around") != F.max("around")).alias("several")).where("total > 1").drop("total"), "often")
        # of a class at most one entry per level and one of the batch
        place = F.struct(*LOC)
        again = both.join(often, KEY).groupBy(*CLASS, "several").agg(F.sum("n").alias("n"), F.min(place).alias("place"), F.collect_list(F.when(F.col("n") == 1, place)).alias("single"))
        again = saved(again, "again")
        self.marks.append(saved(marked(again.where("n > 1").select(F.explode("single").alias("at")).select("at.*")), "marks"))
        self.open.append(saved(again.where("several").select("place.*"), "open"))
        discard(*scans, often, again)
        self.levels.append(Level(1, own))
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            new, old = self.levels.pop(), self.levels.pop()
            union = old.array.unionByName(new.array)
            merged = ordered(classes(union))
            discard(new.array, old.array)
            self.levels.append(Level(2 * new.batches, merged))

    def drop(self) -> None:
        discard(*[x.array for x in self.levels], *self.marks, *self.open)
        self.levels, self.marks, self.open = [], [], []

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_hash, spans) of the indexed texts that hold repeated bytes, as a saved table; spans(start, end) in order, apart."""
        marks, made = every(self.marks), []
        if self.open:
            partly = partial_windows(docs, every(self.open).distinct(), self.length)
            made.append(partly)
            marks = marks.unionByName(partly)
        length = self.length
        per = marks.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))  # a text's own
        out = saved(per.mapInArrow(lambda it: united(it, length), "doc_id long, text_hash long, spans array<struct<start: long, end: long>>"), "spans")
        discard(*made)
        return out


def every(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with text (empty for null) and text_hash, which with doc_id tells a row."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": text, "text_hash": F.xxhash64(text)})


BLOCK = "core long, before binary, after binary, first int, last int, doc_id long, text_hash long, place long"


def blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The owned windows of open suffixes by GROUP starts: the fingerprint of what all of a group share, and the bytes beside it."""
    core = length - GROUP + 1
    for batch in tv.chunks(batches):
        out: list[tuple] = []
        data, off = tv.text_buffers(batch.column("text"))
        for i, (doc_id, text_hash, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "own")), strict=True)):
            text = data[off[i] : off[i + 1]]
            raw = text.tobytes()
            q, far, near = (np.array([a[c] for a in own], np.int64) for c in ("q", "first", "last"))
            lo, hi = q - far, q - near
            low, high = near // GROUP, far // GROUP
            each = high - low + 1
            j = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
            q, lo, hi = (np.repeat(x, each) for x in (q, lo, hi))
            place = q - GROUP * j
            first, last = np.maximum(place - hi, 0), np.minimum(place - lo, GROUP - 1)
            prints = np.zeros(len(place), U64)
            # long texts by segments, as powers are kept for one
            for at in range(0, len(text), SEGMENT):
                some = np.flatnonzero((place >= at) & (place < at + SEGMENT))
                if len(some):
                    prints[some] = Prints(text[at : at + SEGMENT + core]).of(place[some] - at, place[some] - at + core)
            for s, a, b, f in zip(place.tolist(), first.tolist(), last.tolist(), prints.view(np.int64).tolist(), strict=True):
                out.append((f, raw[s - b : s], raw[s + core : s + length - a], a, b, doc_id, text_hash, s))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["core", "before", "after", "first", "last", "doc_id", "text_hash", "place"])


def partial_windows(docs: DataFrame, suffixes: DataFrame, length: int) -> DataFrame:
    """Marks (doc_id, text_hash, lo, hi) of the owned windows of open suffixes that equal another one's, as a saved table."""
    own = suffixes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("q", "first", "last")).alias("own"))  # a text's own
    texts, small = located(docs).select("doc_id", "text_hash", "text"), own.hint("shuffle_hash")
    some = texts.join(small, texts["doc_id"].eqNullSafe(small["doc_id"]) & (texts["text_hash"] == small["text_hash"])).select(texts["doc_id"], texts["text_hash"], "text", "own")
    rows = saved(some.mapInArrow(lambda it: blocks(it, length), BLOCK), "blocks")
    same = ["core", "before", "after", "first", "last"]
    place = F.struct("doc_id", "text_hash", "place")
    alike = saved(rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("at")), "alike")
    whole = rows.join(alike.where("n > 1").select(*same), same, "left_semi").select("doc_id", "text_hash", (F.col("place") - F.col("last")).alias("lo"), (F.col("place") - F.col("first")).alias("hi"))
    several = alike.groupBy("core").count().where("count > 1").select("core")
    each = alike.join(several, "core", "left_semi").withColumn("i", F.explode(F.sequence("first", "last")))
    content = F.xxhash64("core", "i", F.expr("substring(before, length(before) - i + 1, i)"), F.expr(f"substring(after, 1, {GROUP - 1} - i)"))
    each = saved(each.select(content.alias("window"), "n", "at", "i"), "windows")
    twice = each.groupBy("window").count().where("count > 1").select("window")
    ends = each.where("n = 1").join(twice, "window", "left_semi").select("at.doc_id", "at.text_hash", (F.col("at.place") - F.col("i")).alias("lo"), (F.col("at.place") - F.col("i")).alias("hi"))
    out = saved(whole.unionByName(ends), "marks")
    discard(rows, alike, each)
    return out


def united(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Marked windows of a text as the runs of bytes that they cover."""
    for batch in batches:
        lists = batch.column("marks")
        off = lists.offsets.to_numpy()
        lo, hi = (lists.values.field(k).to_numpy() for k in (0, 1))
        spans = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            order = np.argsort(lo[a:b], kind="stable")
            start, end = lo[a:b][order], np.maximum.accumulate(hi[a:b][order] + length)
            head = np.concatenate([[True], start[1:] > end[:-1]])
            at = np.flatnonzero(head)
            last = np.concatenate([at[1:], [len(start)]]) - 1
            spans.append([{"start": s, "end": e} for s, e in zip(start[at].tolist(), end[last].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(spans, kind)], ["doc_id", "text_hash", "spans"])


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def remove_repeats(df: DataFrame, min_bytes: int = MIN_BYTES, batches: int = 4) -> DataFrame:
    """``df`` with n_bytes, the removed spans(start, end) of each text's UTF-8 bytes, and kept, the bytes that are left."""
    df = df.select(*[c for c in df.columns if c not in ("n_bytes", "spans", "kept")])
    index = SuffixIndex(df.sparkSession, min_bytes)
    for b in range(batches):
        index.add(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b).select("doc_id", "text"))
    spans = index.spans(df)
    index.drop()
    names = df.columns
    # texts are shuffled, but not sorted
    small = spans.hint("shuffle_hash")
    this = df["doc_id"].cast("long").eqNullSafe(small["doc_id"]) & (F.xxhash64(F.coalesce(df["text"], F.lit(""))) == small["text_hash"])
    joined = df.join(small, this, "left").select(*[df[c] for c in names], small["spans"])
    schema = StructType([*joined.schema.fields[:-1], StructField("n_bytes", LongType()), StructField("spans", SPANS), StructField("kept", BinaryType())])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(rows):
            data, off = tv.text_buffers(batch.column("text"))
            raw, kept, spans = memoryview(data.tobytes()), [], []
            for own, a, b in zip(batch.column("spans").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = own or []
                starts = [a, *(a + s["end"] for s in own)]
                ends = [*(a + s["start"] for s in own), b]
                kept.append(b"".join(raw[x:y] for x, y in zip(starts, ends, strict=True)))
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(off)), pa.array(spans, kind), pa.array(kept, pa.binary())], [*names, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, schema)
