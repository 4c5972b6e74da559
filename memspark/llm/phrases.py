"""Phrase collocations per language (operator 13).

Texts are cut into pieces at punctuation and line ends, pieces into words.  A
phrase of 2 to ``longest`` words that lies ``min_count`` times or more inside
pieces is scored by how its count compares with those of its two parts.

Candidates come from sketches: counters of hashed phrases in two rows, whose
smaller one is never below the true count.  The first sketch counts pairs, the
second longer phrases all of whose pairs have passed.  Tasks send their cells in
blocks, blocks are summed apart from each other, and only the bit "reaches
min_count" of each cell goes on.  The rows grow with the texts up to 2^28 cells;
beyond that more phrases pass, but none is missed.  Of the rows that have a
phrase that passes, the one with the smallest hash lists it with its words; only
rows that list something are read for it.

One more pass counts the words and codes the texts: a number for each word that a
phrase has, a delimiter for each piece end and run of words that no phrase can
reach, and for each place the group of the phrases that can start there, which
their first two words tell.  Groups are dealt to shards of about SHARD phrases, and each shard is
compiled into Aho-Corasick automata, one a language, over codes of its words.  A
shard scans the places within reach of its own groups and takes the rest for
delimiters, so no match crosses them, and a code's first letter guards its start;
the automata walk over each place in a few shards only, however many there are.
All matches count, overlapping ones included.  Counts travel in blocks, and their sums are exact; thresholds, cuts, containment and ranks are then joins over them.
Every part of a frequent phrase is at least as frequent, so its count is there.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count each; words and phrases are known by 64-bit hashes while they are
counted; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import discard, saved, small_batches

U64 = np.uint64
#: Bytes that end a word; those that end a piece as well.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True
#: Cells of a sketch row: bits of their number, least and most; cells a block.
MIN_BITS, MAX_BITS, BLOCK = 16, 28, 1 << 16
#: Bytes of text for each cell.
BYTES_PER_CELL = 24
#: Cells that a task keeps before it sends them.
PENDING = 4_000_000
#: Phrases of an automaton shard.
SHARD = 1_000_000
ROWS = 2
LONGEST = 4


class Chunk(NamedTuple):
    """Words of a chunk of texts: their hashes, how many follow in the piece (the own counted), a language each."""

    words: tv.Words
    hash: np.ndarray
    room: np.ndarray
    lang: np.ndarray
    names: list[str]


def lang_seed(name: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(name.encode(), digest_size=8).digest(), "<u8")[0]


def read(batch: pa.RecordBatch) -> Chunk:
    words = tv.split_words(batch.column("text"), lower=True, space=BETWEEN)
    n = len(words.start)
    doc = words.doc
    fresh = np.ones(n, dtype=bool)
    if n:
        ends = np.concatenate([[0], np.cumsum(ENDS[words.data])])
        fresh[1:] = (doc[1:] != doc[:-1]) | (ends[words.start[1:]] != ends[words.end[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:], [n]]) if n else np.zeros(0, np.int64)
    room = last[np.cumsum(fresh) - 1] - np.arange(n) if n else np.zeros(0, np.int64)
    langs = batch.column("lang").dictionary_encode()
    return Chunk(words, tv.hash_words(words), room, np.asarray(langs.indices)[doc], langs.dictionary.to_pylist())


def phrase_hashes(c: Chunk, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place, hash) of the phrases of two words, of three words, and so on."""
    seeds = np.array([lang_seed(x) for x in c.names], dtype=U64)
    at = np.arange(len(c.hash))
    h = tv.mix(c.hash ^ seeds[c.lang]) if len(at) else c.hash
    for n in range(2, longest + 1):
        live = c.room[at] >= n
        at, h = at[live], h[live]
        h = tv.mix(h * tv.GOLD + c.hash[at + n - 1])
        yield n, at, h


class Sketch(NamedTuple):
    """The cells that reach the count, as bits, by row."""

    bits: int
    rows: list[np.ndarray]

    def passes(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for row, cells in enumerate(self.rows):
            c = cell(h, row, self.bits)
            out &= (cells[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out


def cell(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((tv.mix(h ^ U64(row)) if row else h) >> U64(64 - bits)).astype(np.int64)


def passing(c: Chunk, longest: int, pairs: Sketch, more: Sketch | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place, hash) of the phrases whose pairs pass, and whose parts of more words do where ``more`` is given."""
    ok = np.zeros(len(c.hash) + 1, dtype=bool)
    for n, at, h in phrase_hashes(c, longest):
        live = pairs.passes(h) if n == 2 else ok[at] & ok[at + 1]
        if n > 2 and more is not None:
            live[live] = more.passes(h[live])
        ok = np.zeros(len(c.hash) + 1, dtype=bool)
        ok[at[live]] = True
        yield n, at[live], h[live]


def cells_of(texts: DataFrame, hashes, bits: int, least: int) -> DataFrame:
    """(row, block, cells, counts): counts of cells by task; counts stop at ``least``, as higher ones tell nothing more."""
    kind = np.uint8 if least <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(pending)
            pending.clear()
            for row in range(ROWS):
                cells, n = np.unique(cell(h, row, bits), return_counts=True)
                counts = np.minimum(n, least).astype(kind)
                heads = np.flatnonzero(np.concatenate([[True], np.diff(cells // BLOCK) > 0]))
                tails = [*heads[1:].tolist(), len(cells)]
                inner = (cells % BLOCK).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(heads), pa.int32()), pa.array((cells[heads] // BLOCK).astype(np.int32)), pa.array([inner[a:b].tobytes() for a, b in zip(heads, tails, strict=True)]), pa.array([counts[a:b].tobytes() for a, b in zip(heads, tails, strict=True)])],
                    ["row", "block", "cells", "counts"],
                )

        for batch in tv.chunks(batches):
            pending.extend(h for h in hashes(read(batch)) if len(h))
            if sum(map(len, pending)) >= PENDING:
                yield from flush()
        if pending:
            yield from flush()

    return texts.mapInArrow(count, "row int, block int, cells binary, counts binary")


def summed(cells: DataFrame, bits: int, least: int) -> Sketch:
    """Blocks summed each in one task; 8 KB a block come back, at most 64 MB of a sketch."""
    kind = np.uint8 if least <= 255 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["row", "block", "high"])

        for batch in batches:
            for row, block, inner, counts in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "cells", "counts")), strict=True):
                if now != (row, block):
                    if now is not None:
                        yield done()
                    now = (row, block)
                    total[:] = 0
                total[np.frombuffer(inner, "<u2")] += np.frombuffer(counts, kind)
        if now is not None:
            yield done()

    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    dealt = cells.repartition("row", "block").sortWithinPartitions("row", "block")
    for r in dealt.mapInArrow(add, "row int, block int, high binary").toArrow().to_pylist():
        rows[r["row"]][r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["high"], np.uint8)
    return Sketch(bits, rows)


def joined_words(c: Chunk) -> pa.Array:
    """All words of a chunk as one string array."""
    inside = np.repeat(np.arange(len(c.hash)), c.words.end - c.words.start)
    offsets = np.concatenate([[0], np.cumsum(c.words.end - c.words.start)]).astype(np.int64)
    at = np.arange(offsets[-1]) - offsets[inside] + c.words.start[inside]
    return pa.LargeStringArray.from_buffers(len(c.hash), pa.py_buffer(offsets), pa.py_buffer(c.words.data[at].tobytes()))


CANDIDATE = "lang string, key long, phrase string, hashes array<long>, group int"
#: Groups of phrases by their first two words; no group.  Rows that may be broadcast.
GROUPS, NONE = 255, 255
BROADCAST_ROWS = 1_000_000


def group_of(pair: np.ndarray) -> np.ndarray:
    return (pair % U64(GROUPS)).astype(np.uint8)


def least_rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and of each the smallest row."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    return h[head], row[head]


def owned(texts: DataFrame, longest: int, pairs: object, more: object, bits: int) -> DataFrame:
    """(block, n, keys, rows): the passing phrases by hash, and of each the smallest of the rows that
    have it, which will list it; as a saved table of packed blocks."""
    high = U64(64 - max(1, bits - MIN_BITS))

    def packed(h: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        block = (h >> high).astype(np.int32)
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        tails = [*heads[1:].tolist(), len(h)]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(np.diff([*heads, len(h)]), pa.int64()), cut(h), cut(row)], ["block", "n", "keys", "rows"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, row = np.zeros(0, U64), np.zeros(0, U64)
        for batch in tv.chunks(batches):
            c = read(batch)
            rows = batch.column("row").to_numpy().view(U64)[c.words.doc]
            found = [(k, rows[at]) for _, at, k in passing(c, longest, pairs.value, more.value)]
            h, row = least_rows(np.concatenate([h, *(k for k, _ in found)]), np.concatenate([row, *(r for _, r in found)]))
            if len(h) > PENDING:
                yield packed(h, row)
                h, row = h[:0], row[:0]
        if len(h):
            yield packed(h, row)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, rows = None, [], []
        for batch in batches:
            for block, k, r in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "rows")), strict=True):
                if block != now and keys:
                    yield packed(*least_rows(np.concatenate(keys), np.concatenate(rows)))
                    keys, rows = [], []
                now = block
                keys.append(np.frombuffer(k, U64))
                rows.append(np.frombuffer(r, U64))
        if keys:
            yield packed(*least_rows(np.concatenate(keys), np.concatenate(rows)))

    kind = "block int, n long, keys binary, rows binary"
    return saved(texts.mapInArrow(find, kind).repartition("block").sortWithinPartitions("block").mapInArrow(merge, kind), "owned")


def listing(texts: DataFrame, longest: int, pairs: object, more: object, own: DataFrame) -> DataFrame:
    """(lang, key, phrase, hashes, group) of the passing phrases, each by the row that owns it, as a saved table."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in zip(batch.column("keys").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r, np.int64)), pa.array(np.frombuffer(k, np.int64))], ["row", "key"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            c, words = read(batch), None
            if not len(c.hash):
                continue
            each = batch.column("row").to_numpy().view(U64)
            keys = batch.column("keys").flatten().to_numpy().view(U64)
            order = np.argsort(keys)
            rows = np.repeat(each, pc.list_value_length(batch.column("keys")).to_numpy())[order]
            keys, row = keys[order], each[c.words.doc]
            group = np.full(len(c.hash), NONE, np.uint8)
            for n, at, h in passing(c, longest, pairs.value, more.value):
                if n == 2:
                    group[at] = group_of(h)
                first, last = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
                # a key has one owner
                mine = np.flatnonzero((first < last) & (rows[np.minimum(first, len(rows) - 1)] == row[at]))
                h, first = np.unique(h[mine], return_index=True)
                at = at[mine[first]]
                if not len(h):
                    continue
                words = joined_words(c) if words is None else words
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(n)], pa.scalar(" ", pa.large_string())).cast(pa.string())
                hashes = np.stack([c.hash[at + k] for k in range(n)], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * n), pa.array(hashes.ravel()))
                names = pa.array(c.names, pa.string()).take(pa.array(c.lang[at]))
                yield pa.RecordBatch.from_arrays([names, pa.array(h.view(np.int64)), phrase, lists, pa.array(group[at].astype(np.int32))], ["lang", "key", "phrase", "hashes", "group"])

    owners = saved(own.select("keys", "rows").mapInArrow(opened, "row long, key long").groupBy("row").agg(F.collect_list("key").alias("keys")), "owners")
    some = texts.join(F.broadcast(owners.select("row")), "row", "left_semi") if owners.count() <= BROADCAST_ROWS else texts
    # rows that share id and text list twice
    out = saved(some.join(owners, "row").mapInArrow(lists, CANDIDATE).dropDuplicates(["lang", "key"]), "phrases")
    discard(owners)
    return out


def candidates(texts: DataFrame, longest: int, least: int, bits: int) -> tuple[DataFrame, object]:
    """A saved table (lang, key, phrase, hashes, group) of the phrases whose sketched counts reach ``least``, and the sketch of pairs, broadcast."""
    share = texts.sparkSession.sparkContext.broadcast
    pairs = share(summed(cells_of(texts, lambda c: [h for _, _, h in phrase_hashes(c, 2)], bits, least), bits, least))
    longer = lambda c: [h for n, _, h in passing(c, longest, pairs.value, None) if n > 2]
    more = share(summed(cells_of(texts, longer, bits, least), bits, least))
    own = owned(texts, longest, pairs, more, bits)
    out = listing(texts, longest, pairs, more, own)
    discard(own)
    return out, pairs


#: Digits of a word's code.  The first one has letters of its own, so no match starts inside a code;
#: an automaton looks through a node's letters one by one, so they are few.
DIGITS, DELIMITER = 64, 128
#: Matches and words that a task keeps before it counts them.
HITS = 2_000_000


class Automata(NamedTuple):
    """Letters of a code, and an automaton and its keys for each language."""

    width: int
    by_lang: dict[str, tuple[ahocorasick.Automaton, np.ndarray]]


def codes(numbers: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` letters for each number."""
    out = np.empty((len(numbers), width), np.uint8)
    for k in range(width):
        out[:, k] = numbers // DIGITS ** (width - 1 - k) % DIGITS
    out[:, 0] += DIGITS
    return out


#: The automata that this worker has compiled last: its next tasks scan with the same ones.
compiled: dict[str, Automata] = {}


def automata(name: str, phrases: pa.Table, vocabulary: np.ndarray) -> Automata:
    """The automata of phrases(lang, key, hashes), over the codes of their words' numbers in the vocabulary."""
    if name not in compiled:
        compiled.clear()
        flat = phrases["hashes"].combine_chunks()
        width = 1
        while DIGITS**width < len(vocabulary):
            width += 1
        text = codes(np.searchsorted(vocabulary, flat.values.to_numpy().view(U64)), width).tobytes().decode("latin-1")
        off, keys = (flat.offsets.to_numpy() * width).tolist(), phrases["key"].to_numpy()
        langs = phrases["lang"].combine_chunks().dictionary_encode()
        which = np.asarray(langs.indices)
        found = {}
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            own = np.flatnonzero(which == i)
            for at, j in enumerate(own.tolist()):
                machine.add_word(text[off[j] : off[j + 1]], at)
            machine.make_automaton()
            found[lang] = (machine, keys[own])
        compiled[name] = Automata(width, found)
    return compiled[name]


def reached(start: np.ndarray, longest: int) -> np.ndarray:
    """The places within ``longest`` words of a start."""
    out = start.copy()
    for k in range(1, longest):
        out[k:] |= start[:-k]
    return out


def squeezed(number: np.ndarray) -> np.ndarray:
    """Where to keep a sequence so that of each run of delimiters (-1) one stays."""
    keep = number >= 0
    keep[1:] |= number[:-1] >= 0
    return keep


def sequence(number: np.ndarray, width: int) -> str:
    """The codes of words, and a delimiter for each -1."""
    known = number >= 0
    end = np.cumsum(np.where(known, width, 1))
    out = np.full(end[-1] if len(end) else 0, DELIMITER, np.uint8)
    at = end[known] - width
    letters = codes(number[known], width)
    for k in range(width):
        out[at + k] = letters[:, k]
    return out.tobytes().decode("latin-1")


class Tally:
    """Counts of small numbers, added up many at a time."""

    def __init__(self, size: int) -> None:
        self.total, self.waiting, self.n = np.zeros(size, np.int64), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.waiting.append(numbers)
        self.n += len(numbers)
        if self.n > HITS:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            self.total += np.bincount(np.concatenate(self.waiting), minlength=len(self.total))
            self.waiting, self.n = [], 0
        return self.total


COUNTED = "lang string, kind int, block int, keys binary, counts binary"
#: Words of a row of coded texts; more where no delimiter comes.
ROW_WORDS = 2048


def blocks(lang: str, kind: int, keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Counts of a task, packed by blocks of keys: of phrases (kind 2), words (1) or all words (0)."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    block = (keys >> U64(64 - max(1, bits - MIN_BITS))).astype(np.int32)
    heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    tails = [*heads[1:].tolist(), len(keys)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())
    same = lambda v, t: pa.array([v] * len(heads), t)
    return pa.RecordBatch.from_arrays([same(lang, pa.string()), same(kind, pa.int32()), pa.array(block[heads]), cut(keys), cut(n)], ["lang", "kind", "block", "keys", "counts"])


def coded(texts: DataFrame, pairs: object, vocabulary: object, longest: int, bits: int) -> DataFrame:
    """The texts in numbers, as a saved table: rows with numbers of words (-1: delimiter) and the
    group of phrases that start at each place; other rows have counts of words by task."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["lang", "kind", "block", "keys", "counts", "numbers", "groups"]

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.binary())] * 2], names)

    def rows(lang: str, number: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(number < 0)
        at = np.searchsorted(ends, np.arange(ROW_WORDS, len(number), ROW_WORDS))
        cuts = np.unique([0, *(ends[at[at < len(ends)]] + 1).tolist(), len(number)]).tolist()
        packed = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        n = len(cuts) - 1
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *[pa.nulls(n, t) for t in kinds[1:5]], packed(number.astype("<i4")), packed(group)], names)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = vocabulary.value, pairs.value
        word_n: dict[str, Tally] = {}
        all_n: dict[str, int] = {}
        for batch in tv.chunks(batches):
            c = read(batch)
            n = len(c.hash)
            if not n:
                continue
            number = np.full(n, -1)
            if len(words):
                at = np.minimum(np.searchsorted(words, c.hash), len(words) - 1)
                number = np.where(words[at] == c.hash, at, -1)
            group = np.full(n, NONE, np.uint8)
            _, at, h = next(phrase_hashes(c, 2))
            live = sketch.passes(h)
            group[at[live]] = group_of(h[live])
            near = reached(group != NONE, longest)
            for i, lang in enumerate(c.names):
                own = c.lang == i
                total = int(own.sum())
                if not total:
                    continue
                all_n[lang] = all_n.get(lang, 0) + total
                word_n.setdefault(lang, Tally(len(words))).add(number[own & (number >= 0)])
                known = near[own] & (number[own] >= 0)
                # a place for each known word, and one for a delimiter after the others and at piece ends
                cut = ~known | (c.room[own] == 1)
                end = np.cumsum(known + cut.astype(np.int64))
                line, starts = np.full(end[-1], -1, np.int32), np.full(end[-1], NONE, np.uint8)
                place = (end - 1 - cut)[known]
                line[place], starts[place] = number[own][known], group[own][known]
                keep = squeezed(line)
                if keep.any():
                    yield rows(lang, line[keep], starts[keep])
        for lang, total in all_n.items():
            yield counted(blocks(lang, 0, np.zeros(1, U64), np.array([total]), bits))
            tally = word_n[lang].settle()
            some = np.flatnonzero(tally)
            if len(some):
                yield counted(blocks(lang, 1, words[some], tally[some], bits))

    return saved(texts.mapInArrow(code, f"{COUNTED}, numbers binary, groups binary"), "coded")


def scanned(lines: DataFrame, phrases: pa.Table, groups: tuple[int, int], vocabulary: object, longest: int, bits: int) -> DataFrame:
    """Blocks of counts by task of a shard's phrases, which start with the pairs of some groups."""
    name = uuid.uuid4().hex
    sent = lines.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(name, sent.value, vocabulary.value)
        tallies: dict[str, Tally] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which = np.asarray(langs.indices)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in machines.by_lang:
                    continue
                own = pa.array(np.flatnonzero(which == i))
                whole = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in batch.column(c).take(own).to_pylist()])  # noqa: B023, E731
                number, group = whole("numbers", "<i4"), whole("groups", np.uint8)
                number = np.where(reached((group >= groups[0]) & (group <= groups[1]), longest), number, -1)
                machine, keys = machines.by_lang[lang]
                found = machine.iter(sequence(number[squeezed(number)], machines.width))
                tallies.setdefault(lang, Tally(len(keys))).add(np.fromiter((v for _, v in found), np.int64))
        for lang, tally in tallies.items():
            n = tally.settle()
            some = np.flatnonzero(n)
            if len(some):
                yield blocks(lang, 2, machines.by_lang[lang][1].view(U64)[some], n[some], bits)

    return lines.mapInArrow(scan, COUNTED)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, count) from blocks that come in order."""
    now, parts = None, []

    def done() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in parts]))
        same = lambda v, t: pa.array([v] * len(keys), t)
        return pa.RecordBatch.from_arrays([same(now[0], pa.string()), same(now[1], pa.int32()), pa.array(keys.view(np.int64)), pa.array(total)], ["lang", "kind", "key", "count"])

    for batch in batches:
        for lang, kind, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "kind", "block", "keys", "counts")), strict=True):
            if now != (lang, kind, block):
                if parts:
                    yield done()
                now, parts = (lang, kind, block), []
            parts.append((np.frombuffer(keys, U64), np.frombuffer(counts, np.int64)))
    if parts:
        yield done()


def shards_of(sizes: dict[int, int], shard_size: int) -> list[tuple[int, int]]:
    """Runs (first, last) of groups with about ``shard_size`` phrases, one group at least."""
    out, now = [], 0
    for group in sorted(sizes):
        if out and now + sizes[group] <= shard_size:
            out[-1], now = (out[-1][0], group), now + sizes[group]
        else:
            out.append((group, group))
            now = sizes[group]
    return out


def exact_counts(texts: DataFrame, phrases: DataFrame, pairs: object, longest: int, bits: int, shard_size: int) -> DataFrame:
    """(lang, kind, key, count) over all texts, as a saved table."""
    share = texts.sparkSession.sparkContext.broadcast
    words = phrases.select(F.explode("hashes").alias("word")).distinct().toArrow()["word"]  # 8 bytes a word that a frequent phrase has
    vocabulary = share(np.sort(words.to_numpy().view(U64)))
    lines = coded(texts, pairs, vocabulary, longest, bits)
    out = lines.where("kind IS NOT NULL").select("lang", "kind", "block", "keys", "counts")
    sizes = {r["group"]: r["count"] for r in phrases.groupBy("group").count().collect()}
    for first, last in shards_of(sizes, shard_size):
        part = phrases.where(F.col("group").between(first, last)).select("lang", "key", "hashes").toArrow()  # about SHARD phrases, 50 bytes each
        out = out.unionByName(scanned(lines.where("numbers IS NOT NULL").select("lang", "numbers", "groups"), part, (first, last), vocabulary, longest, bits))
    block = ["lang", "kind", "block"]
    counts = saved(out.repartition(*block).sortWithinPartitions(*block).mapInArrow(added, "lang string, kind int, key long, count long"), "counts")
    discard(lines)
    return counts


def mine(df: DataFrame, min_count: int = 30, longest: int = LONGEST, top: int = 2000, swallow: int = 80, shard_size: int = SHARD) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, its count a, the counts l and r of its
    two parts at the cut that scores lowest, n words of the language, score.  A phrase goes if one
    that holds it is at least ``swallow`` hundredths as frequent."""
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, (size // BYTES_PER_CELL).bit_length()))
    found, pairs = candidates(texts, longest, min_count, bits)
    counts = exact_counts(texts, found, pairs, longest, bits, shard_size)
    of = lambda kind: counts.where(F.col("kind") == kind).select("lang", "key", "count")
    rows = found.join(of(2), ["lang", "key"]).where(F.col("count") >= min_count).select("lang", "phrase", "hashes", F.split("phrase", " ").alias("words"), F.col("count").alias("a"))
    rows = saved(rows, "frequent")
    word = rows.select("lang", F.explode(F.arrays_zip("words", "hashes")).alias("w")).select("lang", F.col("w.words").alias("part"), F.col("w.hashes").alias("key")).distinct()
    parts = rows.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count")).unionByName(word.join(of(1), ["lang", "key"]).select("lang", "part", "count"))
    text = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cut = rows.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("head"), text(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    side = lambda part, n: parts.select("lang", F.col("part").alias(part), F.col("count").alias(n))
    both = cut.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)")
    low = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # places and lengths of the shorter phrases inside each
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    longer = rows.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = low.join(longer, ["lang", "phrase"], "left").where(F.expr(f"within IS NULL OR CAST(within AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {swallow}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("low.score").desc(), F.col("a").desc(), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    total = of(0).select("lang", F.col("count").alias("n"))
    out = best.join(total, "lang").select("lang", "rank", "phrase", "a", "low.l", "low.r", "n", "low.score")
    out = saved(out, "collocations")
    discard(found, counts, rows)
    return out
