"""Language-model scoring with a hashed maximum-entropy model (operator 6).

The model factors a token's probability twice:

    P(class | history) P(part | class, history) P(token | class, part).

The most frequent tokens and the end of a text are classes of their own; other
words fall into classes by their last two bytes, and each class into PARTS parts
by a hash.  The first two factors are softmaxes over hashed features: the
previous word, the previous two as a pair, and a skip feature of the word before
the previous one - for the second each together with the class.  The last is
estimated from the training counts of the part's tokens, with half a count added
to each known token and to one unknown.

Training is distributed: in each of ROUNDS rounds every task takes the current
weights through the training texts of its partitions with Adagrad mini-batches
(rounds use disjoint parts of the texts), and the tasks' weights are averaged by
their tokens in a tree of sums.  A task has TASK_TOKENS tokens or more where
there are as many, so what the weights add to the shuffle stays in proportion.
The weight tables have a fixed size, as every task sends them; the token counts
and what follows from them grow with the corpus and cover all training tokens.
Scoring runs in batches: gathers of weight rows and softmaxes per chunk.

The counts of the most frequent training tokens, up to ``broadcast_tokens`` of
them, are broadcast as two sorted arrays.  Rarer tokens of a text are joined with
theirs; no such token is frequent, so no key of that join is.

Defined cases: a null text is empty and has the end token alone; A-Z are
lower-cased; a null id counts as the empty string and is in training or not
like any other; repeated rows are scored alike and count repeatedly; an empty
table gives an empty result; without training tokens every base probability is
that of an unknown; other columns are ignored.  Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import discard, saved, small_batches

#: Frequent tokens with a class of their own; classes by ending; the class of the end; parts of a class.
OWN, ENDINGS, PARTS = 24, 23, 32
END_CLASS, CLASSES = OWN + ENDINGS, OWN + ENDINGS + 1
#: Rows of either weight table: for the previous word, the pair, the skipped word.  All fit 16 bits, which sort fast.
WORD_ROWS, PAIR_ROWS, SKIP_ROWS = 1 << 14, 1 << 15, 1 << 14
ROWS = WORD_ROWS + PAIR_ROWS + SKIP_ROWS
ROUNDS, STEP, RATE, FAN_IN, PIECES, TASK_TOKENS = 2, 8192, 0.25, 16, 8, 1_500_000
END, START = np.uint64(0x454E44), np.uint64(0x535441)
MODEL_CHUNK = 1_000_000
LIMIT = np.float32(80.0)
#: Counts up to this are told apart when the frequent tokens are chosen.
FINE_COUNTS = 1024


@dataclass
class Tokens:
    """Tokens of a chunk of texts: hash, ending class, and bounds by text."""

    hash: np.ndarray
    ending: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words = tv.split_words(texts, lower=True)
    n, docs = len(words.start), len(words.counts)
    first = words.first + np.arange(docs + 1)
    h, ending = np.full(n + docs, END), np.full(n + docs, END_CLASS, dtype=np.int64)
    at = np.arange(n) + words.doc
    h[at] = tv.hash_words(words)
    last = words.data[words.end - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64) if n else last
    ending[at] = OWN + (last * 31 + before * 7) % ENDINGS
    return Tokens(h, ending, first)


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids.to_pylist()], dtype=bool)


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, ending, n) summed over each Arrow batch."""
    for batch in batches:
        parts = [tokens(part.column("text")) for part in tv.chunks(iter([batch]))]
        if not parts:
            continue
        h, at, n = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate([p.ending for p in parts])[at]), pa.array(n.astype(np.int64))], ["token", "ending", "n"])


def hashed_rows(prev: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """(tokens, 3) rows of a weight table, by feature in columns that lie together."""
    rows = np.empty((3, len(prev)), np.uint16)
    rows[0] = prev % np.uint64(WORD_ROWS)
    rows[1] = np.uint64(WORD_ROWS) + tv.mix(prev * tv.GOLD + skip) % np.uint64(PAIR_ROWS)
    rows[2] = np.uint64(WORD_ROWS + PAIR_ROWS) + tv.mix(skip + np.uint64(5)) % np.uint64(SKIP_ROWS)
    return rows.T


def history(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The previous word of each token and the one before that."""
    prev = np.concatenate([[START], t.hash[:-1]])
    skip = np.concatenate([[START, START], t.hash[:-2]]) if len(t.hash) > 1 else np.full(len(t.hash), START)
    starts = t.first[:-1]
    prev[starts], skip[starts] = START, START
    second = starts[np.diff(t.first) > 1] + 1
    skip[second] = START
    return prev, skip


def classes(t: Tokens, own: np.ndarray) -> np.ndarray:
    """Classes of the tokens; ``own`` is sorted."""
    if not len(own):
        return t.ending
    at = np.minimum(np.searchsorted(own, t.hash), len(own) - 1)
    return np.where(own[at] == t.hash, at, t.ending)


def single(cls: np.ndarray) -> np.ndarray:
    """Classes that hold one token."""
    return (cls < OWN) | (cls == END_CLASS)


def part_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(PARTS)).astype(np.int64)


@dataclass
class Examples:
    """Rows of both tables and the outcomes of a chunk's tokens; the second
    table's are those of the tokens ``at``."""

    rows: np.ndarray
    cls: np.ndarray
    at: np.ndarray
    part_rows: np.ndarray
    part: np.ndarray


def examples(t: Tokens, own: np.ndarray) -> Examples:
    prev, skip = history(t)
    cls = classes(t, own)
    at = np.flatnonzero(~single(cls))
    of = tv.mix(cls[at].astype(np.uint64) + np.uint64(11))
    return Examples(hashed_rows(prev, skip), cls, at, hashed_rows(tv.mix(prev[at] ^ of), tv.mix(skip[at] ^ of)), part_of(t.hash[at]))


def scores(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Unnormalised scores; the limit keeps exp finite in single precision."""
    z = weights.take(rows[:, 0], axis=0)
    z += weights.take(rows[:, 1], axis=0)
    z += weights.take(rows[:, 2], axis=0)
    z += bias
    return np.minimum(z, LIMIT, out=z)


def log_softmax_at(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The log-probability of each row's outcome."""
    z = scores(rows, weights, bias)
    at = z[np.arange(len(z)), cls]
    np.exp(z, out=z)
    return at - np.log(z @ np.ones(z.shape[1], z.dtype))


def descend(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: np.ndarray, cls: np.ndarray) -> None:
    """One Adagrad step of the summed gradient per weight row."""
    grad = scores(rows, weights, bias)
    np.exp(grad, out=grad)
    grad /= (grad @ np.ones(grad.shape[1], grad.dtype))[:, None]
    grad[np.arange(len(cls)), cls] -= 1
    for k in range(3):
        order = np.argsort(rows[:, k], kind="stable")
        row = rows[order, k]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        g, at = np.add.reduceat(grad.take(order, axis=0), head, axis=0), row[head]
        s = squares.take(at, axis=0)
        s += g * g
        squares[at] = s
        np.sqrt(s, out=s)
        g /= s
        g *= RATE
        weights[at] -= g


@dataclass
class Model:
    own: np.ndarray
    bias: np.ndarray
    #: (ROWS, CLASSES) and (ROWS, PARTS)
    weights: np.ndarray
    part_weights: np.ndarray


ZERO = np.zeros(PARTS, np.float32)
SENT = "piece int, n double, weights binary"


def trained_part(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """This task's weights and its number of tokens, in pieces."""
    tables = [model.weights.copy(), model.part_weights.copy()]
    squares = [np.full_like(w, 1.0) for w in tables]
    n = 0
    for batch in tv.chunks(batches, MODEL_CHUNK):
        x = examples(tokens(batch.column("text")), model.own)
        for at in range(0, len(x.cls), STEP):
            descend(tables[0], squares[0], model.bias, x.rows[at : at + STEP], x.cls[at : at + STEP])
        for at in range(0, len(x.at), STEP):
            descend(tables[1], squares[1], ZERO, x.part_rows[at : at + STEP], x.part[at : at + STEP])
        n += len(x.cls)
    del squares
    if n:
        both = np.concatenate(tables, axis=1)
        size = ROWS // PIECES
        for p in range(PIECES):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([float(n)]), pa.array([both[p * size : (p + 1) * size].astype(np.float16).tobytes()], pa.binary())], ["piece", "n", "weights"])
    tv.release()


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted means of the pieces in this task; one model's memory."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    for batch in batches:
        for p, n, raw in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist(), batch.column("weights"), strict=True):
            part = np.frombuffer(raw.as_buffer(), np.float16).astype(np.float64) * n
            total[p] = total[p] + part if p in total else part
            weight[p] = weight.get(p, 0.0) + n
    for p, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([weight[p]]), pa.array([(part / weight[p]).astype(np.float16).tobytes()], pa.binary())], ["piece", "n", "weights"])
    tv.release()


def train(texts: DataFrame, own: np.ndarray, bias: np.ndarray, n_tokens: int) -> Model:
    """``texts`` has the training texts and a column ``turn`` from 0 to ROUNDS - 1."""
    context = texts.sparkSession.sparkContext
    model = Model(own, bias, np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, PARTS), np.float32))
    for turn in range(ROUNDS):
        shared = context.broadcast(model)
        part = texts.where(F.col("turn") == turn).select("text")
        tasks = min(part.rdd.getNumPartitions(), max(context.defaultParallelism, math.ceil(n_tokens / ROUNDS / TASK_TOKENS)))
        parts = part.coalesce(max(tasks, 1)).mapInArrow(lambda it, shared=shared: trained_part(it, shared.value), SENT)
        while tasks > 1:
            tasks = -(-tasks // FAN_IN)
            parts = parts.repartition(tasks * PIECES, "piece", F.crc32("weights") % tasks).mapInArrow(averaged, SENT)
        found = parts.collect()  # one model, of one size whatever the input
        width = CLASSES + PARTS
        sums, n = np.zeros((PIECES, ROWS // PIECES, width)), np.zeros(PIECES)
        for r in found:
            sums[r.piece] += (np.frombuffer(r.weights, np.float16).astype(np.float64) * r.n).reshape(-1, width)
            n[r.piece] += r.n
        if n.all():
            both = (sums / n[:, None, None]).reshape(ROWS, width).astype(np.float32)
            model = Model(own, bias, np.ascontiguousarray(both[:, :CLASSES]), np.ascontiguousarray(both[:, CLASSES:]))
        shared.destroy()
    return model


@dataclass
class Lexicon:
    """Counts of the frequent training tokens by sorted token hash."""

    token: np.ndarray
    count: np.ndarray

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each token or 0, whether it is here)."""
        if not len(self.token):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        here = self.token[at] == tokens
        return np.where(here, self.count[at], 0).astype(np.int64), here


@dataclass
class Statistics:
    """Training tokens and distinct ones, in all and by class and part."""

    n: int
    distinct: int
    part_n: np.ndarray
    part_distinct: np.ndarray


def history_score(x: Examples, model: Model) -> np.ndarray:
    """log10 P(class | history) P(part | class, history) of each token."""
    out = np.zeros(len(x.cls))
    for at in range(0, len(x.cls), STEP):
        out[at : at + STEP] = log_softmax_at(x.rows[at : at + STEP], model.weights, model.bias, x.cls[at : at + STEP])
    for at in range(0, len(x.at), STEP):
        out[x.at[at : at + STEP]] += log_softmax_at(x.part_rows[at : at + STEP], model.part_weights, ZERO, x.part[at : at + STEP])
    return out / np.log(10)


def frequent_from(counts: DataFrame, distinct: int, most: int) -> int | None:
    """The least count that at most ``most`` tokens reach; none if all tokens do."""
    if distinct <= most:
        return None
    coarse = F.lit(FINE_COUNTS) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / FINE_COUNTS)))
    level = F.when(F.col("n") <= FINE_COUNTS, F.col("n")).otherwise(coarse.cast("long"))
    reached, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # a thousand rows or so
        reached += r["count"]
        if reached > most:
            break
        least = r.level
    return least if least is not None else 2**62


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    small_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    docs = df.select(F.col("doc_id").cast("long"), "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    training = docs.where(crc % 5 != 1).withColumn("turn", F.floor(crc / 5) % ROUNDS)
    counts = training.select("text").mapInArrow(token_counts, "token long, ending long, n long").groupBy("token").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    counts = saved(counts, "counts")
    top = counts.where(F.col("ending") != END_CLASS).orderBy(F.col("n").desc(), "token").limit(OWN).collect()
    own = np.sort(np.array([r.token for r in top], dtype=np.int64).view(np.uint64))
    named = F.when(F.col("token").isin([r.token for r in top]), F.lit(-1)).otherwise(F.col("ending")) if top else F.col("ending")
    part = (F.shiftrightunsigned("token", 40) % PARTS).alias("p")
    part_n, part_distinct = np.zeros((CLASSES, PARTS)), np.zeros((CLASSES, PARTS))
    for r in counts.groupBy(named.alias("c"), part).agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():  # CLASSES x PARTS rows
        if r.c >= 0:
            part_n[r.c, r.p], part_distinct[r.c, r.p] = r.n, r.d
    class_n = part_n.sum(axis=1)
    for r in top:
        class_n[np.searchsorted(own, np.int64(r.token).view(np.uint64))] = r.n
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    stats = Statistics(int(total), int(distinct), part_n, part_distinct)
    bias = np.log((class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)).astype(np.float32)
    model = context.broadcast(train(training, own, bias, stats.n))
    least = frequent_from(counts, stats.distinct, broadcast_tokens)
    rows = (counts if least is None else counts.where(F.col("n") >= least)).select("token", "n").toArrow()
    order = np.argsort(rows["token"].to_numpy().view(np.uint64))
    lexicon = context.broadcast(Lexicon(rows["token"].to_numpy().view(np.uint64)[order], rows["n"].to_numpy()[order].astype(np.uint32 if total < 2**32 else np.int64)))
    del rows, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the result, of tokens that are not broadcast as if they were unknown;
        these tokens beside them, unless there are none."""
        known, m = lexicon.value, model.value
        context = TaskContext.get()
        row = context.partitionId() << 40 if context else 0
        for batch in tv.chunks(batches):
            t = tokens(batch.column("text"))
            x = examples(t, m.own)
            different, where = np.unique(t.hash, return_inverse=True)
            count, here = (v[where] for v in known.of(different))
            inside = np.zeros(len(count))
            many = np.zeros(len(count))
            many[x.at] = stats.part_n[x.cls[x.at], x.part] + 0.5 * (stats.part_distinct[x.cls[x.at], x.part] + 1)
            inside[x.at] = np.log10((count[x.at] + 0.5) / many[x.at])
            base = np.log10((count + 0.5) / (stats.n + 0.5 * (stats.distinct + 1)))
            sums = [np.add.reduceat(v, t.first[:-1]) for v in ((count > 0).astype(np.int64), base, inside + history_score(x, m))]
            n = batch.num_rows
            cols = [batch.column("doc_id"), pa.array(held_out(batch.column("doc_id"))), pa.array(np.diff(t.first)), pa.array(sums[0]), pa.array(np.full(n, stats.n)), pa.array(sums[1]), pa.array(sums[2])]
            if least is None:
                yield pa.RecordBatch.from_arrays(cols, RESULT)
                continue
            rare = np.flatnonzero(~here)
            of, h = np.searchsorted(t.first, rare, "right") - 1, t.hash[rare]
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))[: len(h)]
            times, off = np.diff(np.concatenate([head, [len(h)]])), np.searchsorted(of[head], np.arange(n + 1)).astype(np.int32)
            # a class of one token says all about it
            scored = np.where(single(x.cls[rare][order][head]), 0, times)
            pairs = pa.StructArray.from_arrays([pa.array(h[head].view(np.int64)), pa.array(times.astype(np.int64)), pa.array(scored.astype(np.int64))], ["token", "times", "scored"])
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), *cols, pa.ListArray.from_arrays(pa.array(off), pairs)], ["row", *RESULT, "rare"])
            row += n

    if least is None:
        discard(counts)
        return docs.mapInArrow(run, SCHEMA)
    scored = saved(docs.mapInArrow(run, f"row long, {SCHEMA}, rare array<struct<token:long,times:long,scored:long>>"), "scored")
    each = scored.select("row", F.inline("rare")).join(counts.where(F.col("n") < least).select("token", "n"), "token")
    gain = F.log10(F.col("n") * 2 + 1)  # of n + 0.5 over the 0.5 of an unknown
    more = each.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * gain).alias("more_base"), F.sum(F.col("scored") * gain).alias("more_score"))
    out = scored.join(more, "row", "left")
    sums = {"n_known": "more_known", "base_score": "more_base", "score": "more_score"}
    return out.withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in sums.items()}).select(*RESULT)
