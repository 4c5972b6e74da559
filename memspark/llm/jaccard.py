"""N-gram Jaccard join, size-aware heavy-light (operator 5).

A text's set holds its distinct n-word shingles.  Two sets link when
|A n B| / |A u B| >= num/den; then |A n B| >= need(A) = ceil(|A| num/den), and
the same for B.  In any one order of all shingles, the l least common shingles
of two linked sets lie among the first |A| - need(A) + l of A and likewise of B.

* Light sets (fewer than ``boundary`` shingles) enumerate the 2-subsets of
  their first |A| - need(A) + 2 shingles; two linked light sets share one.
* Heavy sets, and light ones large enough to link with a heavy set, post their
  first |A| - need(A) + 1 shingles to inverted lists, which are then scanned.
* The boundary is the size at which the subsets of the light sets would cost
  more than scanning lists, summed over the histogram of all set sizes; what a
  posting costs is the mean length of the lists, as counted.

The order puts frequent shingles last.  The most frequent come from one counter
array that grows with the table, filled from all sets; then the lists that this
order would make are counted, and the shingles of lists longer than LONG_LIST go
last too.  Any order gives the same links: what the counters miss costs time only.

Equal sets are one node from the start.  Each list has its
least set as hub, and a set is first paired with the hub it shares most lists
with only, so a group of m near-copies makes m pairs.  While the lists hold
many more pairs from different components than sets, this is repeated with
other hubs; then all sets of a list that are still in different components are
paired, so no link is given up.  A pair is checked by bounds from 256-bin histograms of the
two sets and then by their exact intersection, so the components are those of
all links between different texts.

Defined cases: A-Z are lower-cased; a text of fewer than n words is one shingle;
a null or blank text has the empty set and links with nothing; rows without an
id are returned but stand alone with a null component; repeated rows count as
copies; an empty table gives an empty result; other columns are ignored.
Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import discard, saved, small_batches

#: Least and most counters of the frequency array, in pieces of PIECE; bins of a set's histogram.
MIN_SLOTS, MAX_SLOTS, PIECE, BINS = 1 << 21, 1 << 24, 1 << 18, 256
#: Least and most bits of a filter, bits per value.
MIN_BITS, MAX_BITS, BITS_EACH = 1 << 23, 1 << 28, 8
#: Sets in a list from which its shingle counts as frequent; hub rounds; pairs per set that end them.
LONG_LIST, HUB_ROUNDS, FEW_PAIRS = 12, 3, 16
#: Sets in a block of a list; lists of a set that are known to it.
LIST_BLOCK, FIRST_LISTS = 256, 64


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = tv.split_words(texts, lower=True)
    h = tv.hash_words(words)
    spans, off = tv.windows(h, words.first, n)
    for i, count in enumerate(words.counts.tolist()):
        if count >= n:
            yield np.unique(spans[off[i] : off[i + 1]])
        elif count:
            whole = h[words.first[i] : words.first[i + 1]]
            out = whole[:1].copy()
            for k in range(1, count):
                out = tv.mix(out * tv.GOLD + whole[k : k + 1])
            yield tv.mix(out + np.uint64(count))
        else:
            yield whole_empty


whole_empty = np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    return int(np.add.reduce(tv.mix(s ^ tv.GOLD), dtype=np.uint64).astype(np.int64))


def histogram(s: np.ndarray) -> bytes:
    """How many shingles fall in each of BINS bins, at most 255 each."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def power_of_two(wanted: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(wanted - 1, 0).bit_length()))


def needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def summaries(batches: Iterator[pa.RecordBatch], n: int, slots: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows with the pieces of this task's frequency counters."""
    names = ["doc_id", "n", "set", "hist", "piece", "counts"]
    counts = np.zeros(slots, dtype=np.uint32)
    seen: set[int] = set()
    for batch in tv.chunks(batches):
        size, ids, hist, fresh = [], [], [], []
        for s in shingle_sets(batch.column("text"), n):
            name = set_id(s) if len(s) else None
            size.append(len(s))
            ids.append(name)
            hist.append(histogram(s) if len(s) else None)
            if name is not None and name not in seen:
                seen.add(name)
                fresh.append(s)
        if fresh:
            np.add.at(counts, (np.concatenate(fresh) % np.uint64(slots)).astype(np.int64), np.uint32(1))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids, pa.int64()), pa.array(hist, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
    for at in range(0, slots, PIECE):
        part = counts[at : at + PIECE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([at // PIECE], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum this task's counter pieces; memory is that of one counter array."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32).astype(np.uint64)
            total[piece] = total[piece] + part if piece in total else part
    for piece, part in total.items():
        clipped = np.minimum(part, np.uint64(2**32 - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(clipped.tobytes(), 1)], pa.binary())], ["piece", "counts"])


def frequency_levels(summary: DataFrame, slots: int) -> np.ndarray:
    """For every counter 0, or for those above the noise of collisions a level from 1 up."""
    parts = summary.where(F.col("piece").isNotNull()).select("piece", "counts")
    # two steps, so that no task sees the pieces of all tasks when there are many
    for tasks in (64, 8):
        parts = parts.repartition(tasks, "piece", *([F.crc32("counts") % 8] if tasks > 8 else [])).mapInArrow(add_counts, "piece int, counts binary")
    total = np.zeros(slots, dtype=np.float64)
    for row in parts.collect():  # slots / PIECE rows
        total[row.piece * PIECE : (row.piece + 1) * PIECE] += np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    mean = float(np.median(total))
    return np.log2(np.maximum((total - mean) / (4 * np.sqrt(mean) + 8), 1.0)).astype(np.int8) + (total - mean > 4 * np.sqrt(mean) + 8)


def light_boundary(sizes: dict[int, int], list_scan: float, num: int, den: int) -> int:
    """The set size from which scanning lists is estimated to cost less than 2-subsets.

    A light set of size n costs p(p+1)/2 subset keys with p = n - need(n) + 1;
    as a heavy one it costs p postings, each with ``list_scan`` entries to scan.
    Sets just below a boundary are posted too.
    """
    best, best_cost = 2, float("inf")
    for bound in sorted({2, *[s + 1 for s in sizes if s <= 400]}):
        cost = 0.0
        for n, count in sizes.items():
            p = n - needed(n, num, den) + 1
            if n < bound:
                cost += count * p * (p + 1) / 2
            if n * den >= bound * num:
                cost += count * p * list_scan
        if cost < best_cost:
            best, best_cost = bound, cost
    return best


def in_order(s: np.ndarray, levels: np.ndarray, long: Bits | None) -> np.ndarray:
    """The shingles of a set in the common order: by level, then by hash."""
    level = levels[(s % np.uint64(len(levels))).astype(np.int64)]
    if long is not None:
        level = np.maximum(level, long.has(s))
    return s[np.argsort(level, kind="stable")]


def postings_of(ordered: np.ndarray, boundary: int, num: int, den: int) -> np.ndarray:
    """The list keys of one set, given in the common order."""
    n = len(ordered)
    p = n - needed(n, num, den) + 1
    keys = []
    if n < boundary:
        first = ordered[: p + 1]
        if n == 1:
            keys.append(tv.mix(first + np.uint64(3)))
        else:
            a, b = np.triu_indices(len(first), 1)
            lo, hi = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
            keys.append(tv.mix(tv.mix(lo * tv.GOLD + np.uint64(2)) + hi))
    if n * den >= boundary * num:
        keys.append(tv.mix(ordered[:p] + np.uint64(1)))
    return np.concatenate(keys)


def components(nodes_edges: DataFrame, label: str = "comp") -> DataFrame:
    """(set, comp) for the nodes of edges (a, b): the least node of each component.

    Alternates large-star and small-star steps until no edge changes; a chain of
    m links takes about log2(m) of them.
    """
    edges = saved(nodes_edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link the smaller neighbours and the node itself to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "edges")
        state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        done = state(edges) == state(after)
        discard(edges)
        edges = after
        if done:
            break
    return edges.select(F.col("u").alias("set"), F.col("v").alias(label)).unionByName(edges.select(F.col("v").alias("set"), F.col("v").alias(label)).distinct())


def checked(left: DataFrame, right: DataFrame, columns: list[str], test: Callable[..., bool]) -> DataFrame:
    """Those pairs (a, b) of ``left`` whose rows in ``right`` (set and ``columns``) pass ``test``."""
    for end in ("b", "a"):
        left = left.join(right.select(F.col("set").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
    names = [f"{end}_{c}" for end in ("a", "b") for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [test(*row) for row in zip(*[batch.column(c) for c in names], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return left.select("a", "b", *names).mapInArrow(run, "a long, b long")


@dataclass
class Bits:
    """A set of 64-bit values, one bit of ``packed`` each; others are let through by chance."""

    packed: np.ndarray
    #: Mean length of the lists that are not long, as a posting meets them.
    mean_list: float = 1.0

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (tv.mix(values.view(np.uint64)) % np.uint64(8 * len(self.packed))).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        at = self.slot(values)
        np.bitwise_or.at(self.packed, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, values: np.ndarray) -> np.ndarray:
        at = self.slot(values)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(counted: DataFrame, wanted: int, above: int = 0) -> Bits:
    """The values of counted(rep, count) with a count over ``above``; ``wanted`` is about their number."""
    size = power_of_two(BITS_EACH * wanted, MIN_BITS, MAX_BITS) // 8

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, postings, met = Bits(np.zeros(size, np.uint8)), 0, 0
        for batch in batches:
            n = batch.column("count").to_numpy()
            out.add(batch.column("rep").to_numpy()[n > above])
            short = n[n <= above]
            postings, met = postings + int(short.sum()), met + int((short * short).sum())
        yield packed_row(out.packed, postings, met)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, postings, met = np.zeros(size, dtype=np.uint8), 0, 0
        for batch in batches:
            for raw in batch.column("bits"):
                out |= np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint8)
            postings, met = postings + sum(batch.column("postings").to_pylist()), met + sum(batch.column("met").to_pylist())
        yield packed_row(out, postings, met)

    def packed_row(bits: np.ndarray, postings: int, met: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary()), pa.array([postings], pa.int64()), pa.array([met], pa.int64())], ["bits", "postings", "met"])

    schema = "bits binary, postings long, met long"
    passed, postings, met = np.zeros(size, dtype=np.uint8), 0, 0
    for row in counted.mapInArrow(gathered, schema).repartition(4).mapInArrow(either, schema).collect():  # 4 rows
        passed |= np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
        postings, met = postings + row.postings, met + row.met
    return Bits(passed, met / postings if postings else 1.0)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, num: int, den: int, filtered: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of sets that link, checked on the whole sets.

    Pairs that their histograms rule out go first, unless they have gone
    (``filtered``).  Then the texts of the documents that stand for a set in a pair
    are read again.  A bit filter passes them while its size allows - what it lets
    through by chance finds no pair - and a join beyond that.
    """

    def near(p: pa.Scalar, n_p: pa.Scalar, q: pa.Scalar, n_q: pa.Scalar) -> bool:
        """|A - B| + |B - A| is at least the distance of the histograms."""
        total = n_p.as_py() + n_q.as_py()
        apart = int(np.abs(np.frombuffer(p.as_buffer(), np.uint8).astype(np.int16) - np.frombuffer(q.as_buffer(), np.uint8)).sum())
        return den * (total - apart) >= num * (total + apart)

    hopeful = pairs if filtered else saved(checked(pairs, reps, ["hist", "n"], near), "hopeful")
    wanted = saved(hopeful.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(reps.select("set", "rep"), "set").select("rep"), "wanted")
    many = wanted.count()
    source = docs.where(F.col("doc_id").isNotNull())
    if BITS_EACH * many <= MAX_BITS:
        known = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.withColumn("count", F.lit(1).cast("long")), many))
    else:
        known, source = None, source.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch if known is None else batch.filter(pa.array(known.value.has(batch.column("doc_id").to_numpy())))
            for part in tv.chunks(iter([some])):
                found = [s for s in shingle_sets(part.column("text"), n) if len(s)]
                off = np.cumsum([0, *map(len, found)]).astype(np.int32)
                items = np.concatenate([whole_empty, *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(items))], ["set", "items"])

    items = source.mapInArrow(sets, "set long, items array<long>")
    both = hopeful
    for end in ("b", "a"):
        both = both.join(items.select(F.col("set").alias(end), F.col("items").alias(f"{end}_items")), end)
    common = F.size(F.array_intersect("a_items", "b_items"))
    linked = den * common >= num * (F.size("a_items") + F.size("b_items") - common)
    out = saved(both.where(linked).select("a", "b").distinct(), "links")
    discard(wanted, *([] if filtered else [hopeful]))
    return out


def with_list(rows: DataFrame, per_list: DataFrame) -> DataFrame:
    """Rows (key, members, set, ...) joined with a table that has a row per list.

    The rows of a list are dealt by blocks of about LIST_BLOCK sets and its row is
    copied to each block, so that no task meets a long list whole."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / LIST_BLOCK)).cast("int")
    left = rows.withColumn("part", F.pmod(F.xxhash64("set"), blocks).cast("int"))
    right = per_list.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("list_members") / LIST_BLOCK)).cast("int") - 1))).drop("list_members")
    return left.join(right, ["key", "part"]).drop("part")


def list_pairs(lists: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of sets that share a list, are in different components and may
    link by size and histogram.

    Lists are cut into blocks of about LIST_BLOCK sets and each pair of blocks of
    a list is one row, so no task holds a long list whole.  A pair is left to the
    first list that it shares, as far as the FIRST_LISTS first lists of its sets tell.
    """
    first = lists.groupBy("set").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_LISTS).alias("keys"))
    members = lists.join(reps.select("set", "hist"), "set").join(first, "set")
    block = F.pmod(F.xxhash64("set"), F.ceil(F.col("members") / LIST_BLOCK)).cast("int").alias("block")
    packed = members.groupBy("key", block).agg(F.collect_list(F.struct("set", "n", "comp", "hist", "keys")).alias("rows"), F.first(F.ceil(F.col("members") / LIST_BLOCK)).cast("int").alias("blocks"))
    # a row per pair of blocks is placed by its list and its second block, so no task meets a whole long list
    blocks = F.sequence(F.col("block"), F.col("blocks") - 1)
    x, y = packed.select("key", F.col("rows").alias("xs"), F.explode(blocks).alias("y")), packed.select("key", F.col("block").alias("y"), F.col("rows").alias("ys"))

    def columns(rows: pa.ListScalar) -> list[np.ndarray]:
        v = rows.values
        hist = np.frombuffer(b"".join(v.field("hist").to_pylist()), np.uint8).reshape(len(v), BINS)
        return [*[v.field(c).to_numpy() for c in ("set", "n", "comp")], hist.astype(np.int16)]

    def met_before(xs: pa.ListScalar, ys: pa.ListScalar, key: int) -> np.ndarray:
        """Which pairs of two blocks share a list that comes before ``key``."""
        sides = []
        for rows in (xs, ys):
            keys = rows.values.field("keys")
            flat, row = keys.flatten().to_numpy(), np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
            sides.append((flat[flat < key], row[flat < key], len(keys)))
        common = np.intersect1d(sides[0][0], sides[1][0])
        if not len(common):
            return np.zeros((sides[0][2], sides[1][2]), bool)
        hit = []
        for flat, row, m in sides:
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            inside = common[at] == flat
            table = np.zeros((m, len(common)), np.float32)
            table[row[inside], at[inside]] = 1
            hit.append(table)
        return hit[0] @ hit[1].T > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((2, 0), np.int64)]
            for i in range(batch.num_rows):
                a_set, a_n, a_comp, a_hist = columns(batch.column("xs")[i])
                b_set, b_n, b_comp, b_hist = columns(batch.column("ys")[i])
                small, large = np.minimum(a_n[:, None], b_n), np.maximum(a_n[:, None], b_n)
                fits = (a_comp[:, None] != b_comp) & (small * den >= large.astype(np.int64) * num)
                p, q = np.nonzero(fits & ~met_before(batch.column("xs")[i], batch.column("ys")[i], batch.column("key")[i].as_py()))
                for lo in range(0, len(p), 20_000):
                    u, v = p[lo : lo + 20_000], q[lo : lo + 20_000]
                    apart, total = np.abs(a_hist[u] - b_hist[v]).sum(axis=1), a_n[u].astype(np.int64) + b_n[v]
                    good = den * (total - apart) >= num * (total + apart)
                    pair = np.stack([a_set[u[good]], b_set[v[good]]])
                    out.append(np.sort(pair, axis=0))
            both = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return x.join(y, ["key", "y"]).select("key", "xs", "ys").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df`` (doc_id, text)."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col("doc_id").cast("long"), "text")
    slots = power_of_two(df.count(), MIN_SLOTS, MAX_SLOTS)
    summary = saved(docs.mapInArrow(lambda it: summaries(it, n, slots), "doc_id long, n long, set long, hist binary, piece int, counts binary"), "summary")
    levels = frequency_levels(summary, slots)
    rows = summary.where(F.col("piece").isNull()).select("doc_id", F.col("n").alias("n_shingles"), "set", "hist")
    reps = rows.where(F.col("set").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("hist").alias("hist"))
    reps = saved(reps, "reps")
    # sizes above 400 are heavy under any boundary
    sizes = {r.n: r["count"] for r in reps.where("n <= 400").groupBy("n").count().collect()}
    shared = spark.sparkContext.broadcast(levels)

    def fresh_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """The sets of each chunk of texts that this task has not met before."""
        seen: set[int] = set()
        for batch in tv.chunks(batches):
            new = []
            for s in shingle_sets(batch.column("text"), n):
                name = set_id(s) if len(s) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    new.append((name, s))
            if new:
                yield new

    def first_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in fresh_sets(batches):
            out = [in_order(s, shared.value, None)[: len(s) - needed(len(s), num, den) + 1] for _, s in new]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["rep"])

    texts = docs.where(F.col("doc_id").isNotNull())
    counted = texts.mapInArrow(first_shingles, "rep long").groupBy("rep").count()
    long = spark.sparkContext.broadcast(bit_filter(counted, slots, LONG_LIST))
    boundary = light_boundary(sizes, 1 + long.value.mean_list, num, den)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in fresh_sets(batches):
            keys = [postings_of(in_order(s, shared.value, long.value), boundary, num, den) for _, s in new]
            per = [len(k) for k in keys]
            cols = (np.concatenate(keys).view(np.int64), np.repeat([name for name, _ in new], per), np.repeat([len(s) for _, s in new], per).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "set", "n"])

    listed = saved(texts.mapInArrow(post, "key long, set long, n int"), "postings")
    shared_keys = listed.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("key")
    every = saved(listed.join(shared_keys, "key").select("key", "set", "n").distinct(), "lists")
    # near-copies share most of their lists: of lists with the same members one is enough
    same = every.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("name"))
    lists = saved(every.join(same.groupBy("name", "members").agg(F.min("key").alias("key")).select("key", "members"), "key"), "lists")
    discard(listed, every)
    fits = lambda x, y: (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)
    open_lists, links, comp = lists.withColumn("comp", F.col("set")), None, None
    for turn in range(HUB_ROUNDS):
        hub = F.struct(F.xxhash64(F.lit(turn), "set").alias("h"), F.col("set").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp"))
        hubs = open_lists.groupBy("key").agg(F.min(hub).alias("least"), F.first("members").alias("list_members")).select("key", "least.*", "list_members")
        star = with_list(open_lists, hubs).where((F.col("comp") != F.col("hub_comp")) & fits("n", "hub_n"))
        star = star.groupBy("set", "hub").agg(F.count("*").alias("lists")).groupBy("set").agg(F.max(F.struct("lists", "hub"))["hub"].alias("hub"))
        star = saved(star.select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct(), "star")
        found = verified(star, docs, reps, n, num, den)
        every_link = found if links is None else saved(links.unionByName(found), "links")
        if links is not None:
            discard(links, found, comp, open_lists)
        links = every_link
        comp = saved(components(links), "components")
        # what is left: sets of one list that are in different components
        labelled = lists.join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set")).select("key", "members", "set", "n", "comp")
        mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("members").alias("list_members")).where("lo <> hi").select("key", "list_members")
        open_lists = saved(with_list(labelled, mixed), "open")
        per = open_lists.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("inside"))
        pairs = per.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        discard(star)
        if pairs[0] <= FEW_PAIRS * pairs[1]:
            break
    rest = saved(list_pairs(open_lists, reps, num, den), "rest")
    more = verified(rest, docs, reps, n, num, den, filtered=True)
    last = saved(components(links.unionByName(more)), "components")
    discard(lists, open_lists, rest, links, more, comp)
    # a component's id is its smallest document id
    named = reps.drop("hist").join(last, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    groups = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = named.select("set", "comp").join(groups, "comp").select("set", "component_id")
    out = rows.drop("hist").join(labels, "set", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = saved(out.select("doc_id", "n_shingles", own.cast("long").alias("component_id")), "groups")
    discard(summary, reps, last)
    return out
