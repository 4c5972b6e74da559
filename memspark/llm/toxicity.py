"""Toxicity by a classifier chain (operator 2).

Linear (logistic) models predict the categories one after another; each gets,
besides the features of the text, the log-odds of all earlier categories.  In
training these are out-of-fold predictions: of a model that has not seen the
row, so the later model learns how far to trust them on new texts.

Features of a text: the presence of words that are associated with a category
in the training rows (all of them, however many), whatever their case and the
signs around them, and a few shares of the whole text (signs, upper case,
digits, repeats).  Training rows are the ``train_rows`` labelled rows with the
smallest hash - a bounded sample; the models are trained on the driver from
hashed features, never from texts, until the loss no longer falls.  Scoring
reads every text whole.

Defined cases: a null text is an empty one; a text without a word has the shares
of the training rows as its probabilities; rows whose label of a category is null do not train that
category; a document that is labelled more than once has the greatest of its
labels (bad if any says so), and where several rows share an id the one whose
text has the smallest hash is trained on, once; a category with one class among its training rows
has a constant probability; one without training rows has a null probability, is
no evidence for later ones and makes nothing toxic; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import small_batches
from memspark.llm.quality import SYMBOLS, per_doc

#: Bytes that are not part of a word here become spaces; A-Z become a-z.
PLAIN = tv.LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
FOLDS, MIN_ROWS, MIN_CHI = 4, 4, 15
#: Training ends when a step lowers the mean loss by less than this; it warns where MAX_STEPS end it.
ENOUGH, MEMORY, MAX_STEPS = 1e-8, 10, 2000
N_SHARES = 6


def text_features(texts: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray]:
    """(words, hash of each word, shares per text)."""
    data, off = tv.text_buffers(texts)
    n = np.diff(off)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(PLAIN[data])))
    words = tv.split_words(plain)
    h = tv.hash_words(words)
    size = np.maximum(n, 1)
    upper, digit = (data >= 0x41) & (data < 0x5B), (data >= 0x30) & (data < 0x3A)
    counts = words.counts
    same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    shares = np.stack([np.ones(len(n)), np.log1p(counts) / 10, per_doc(SYMBOLS[data], off) / size, per_doc(upper, off) / size, per_doc(digit, off) / size, per_doc(same, words.first) / np.maximum(counts, 1)], axis=1)
    return words, h, shares


def sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word hashes and the shares of each row, with its labels."""
    for batch in tv.chunks(batches):
        words, h, shares = text_features(batch.column("text"))
        sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(words.first, words.first[1:], strict=False)]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(sets, pa.list_(pa.int64())), pa.array(list(shares), pa.list_(pa.float64()))], names=[*rest, "words", "shares"])


@dataclass
class Matrix:
    """Rows with word features (CSR without values) and dense columns."""

    first: np.ndarray
    index: np.ndarray
    dense: np.ndarray

    def rows(self, keep: np.ndarray) -> Matrix:
        n = np.diff(self.first)
        inside = np.repeat(keep, n)
        return Matrix(np.concatenate([[0], np.cumsum(n[keep])]), self.index[inside], self.dense[keep])

    def dot(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.dense)), np.diff(self.first))
        return np.bincount(row, weights=w[self.index], minlength=len(self.dense)) + self.dense @ d


def fit_logistic(x: Matrix, y: np.ndarray, width: int, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Word and dense weights by L-BFGS, run until the loss no longer falls."""
    w, d = np.zeros(width), np.zeros(x.dense.shape[1])
    if y.min(initial=1) == y.max(initial=0):
        p = (y.sum() + 0.5) / (len(y) + 1)
        d[0] = np.log(p / (1 - p))
        return w, d
    p = y.mean()
    d[0] = np.log(p / (1 - p))
    row = np.repeat(np.arange(len(y)), np.diff(x.first))

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(theta[:width], theta[width:])
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.concatenate([np.bincount(x.index, weights=err[row], minlength=width), x.dense.T @ err])
        grad[:width] += l2 * theta[:width] / len(y)
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (theta[:width] @ theta[:width]) / len(y)), grad

    theta = np.concatenate([w, d])
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(MAX_STEPS + 1):
        if step == MAX_STEPS:
            warnings.warn(f"a model's loss still falls after {MAX_STEPS} steps", stacklevel=2)
            break
        # two-loop recursion: the gradient times an estimate of the inverse Hessian
        way, used = grad.copy(), []
        for s, g in reversed(steps):
            a = (s @ way) / (s @ g)
            used.append(a)
            way -= a * g
        if steps:
            s, g = steps[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(used), strict=True):
            way += (a - (g @ way) / (s @ g)) * s
        slope, size = float(grad @ way), 1.0 if steps else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        while True:
            after, new = loss(theta - size * way)
            if after <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        fallen, s, g = value - after, -size * way, new - grad
        if fallen <= 0:
            break
        theta, value, grad = theta + s, after, new
        if fallen < ENOUGH:
            break
        if s @ g > 1e-16:
            steps = [*steps[1 - MEMORY :], (s, g)]
    return theta[:width], theta[width:]


def associated(first: np.ndarray, hashes: np.ndarray, labels: dict[str, np.ndarray]) -> np.ndarray:
    """Sorted hashes of the words associated with a category (chi-squared over MIN_CHI),
    among those in at least MIN_ROWS rows."""
    vocab, index = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    best = np.zeros(len(vocab))
    for y in labels.values():
        known = ~np.isnan(y)
        inside = known[row]
        n, pos = known.sum(), np.nansum(y)
        a = np.bincount(index[inside], weights=y[row[inside]], minlength=len(vocab))
        df = np.bincount(index[inside], minlength=len(vocab))
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = n * (a * n - df * pos) ** 2 / (df * (n - df) * pos * (n - pos))
        best = np.maximum(best, np.where((df >= MIN_ROWS) & np.isfinite(chi), chi, 0))
    return vocab[best > MIN_CHI]


@dataclass
class Chain:
    categories: list[str]
    vocab: np.ndarray
    #: Word and dense weights by category; none for one without training rows.
    models: list[tuple[np.ndarray, np.ndarray] | None] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)

    def matrix(self, first: np.ndarray, hashes: np.ndarray, shares: np.ndarray) -> Matrix:
        """Presence of the vocabulary's words, once per row."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if not len(self.vocab):
            return Matrix(np.zeros(len(first), np.int64), np.zeros(0, np.int64), shares)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        hit = self.vocab[at] == hashes
        key = np.unique(row[hit] * len(self.vocab) + at[hit])
        row, at = key // len(self.vocab), key % len(self.vocab)
        return Matrix(np.searchsorted(row, np.arange(len(first))), at, shares)

    def predict(self, x: Matrix) -> np.ndarray:
        """(rows, categories) probabilities, each fed with the log-odds of those before."""
        odds: list[np.ndarray] = []
        for model in self.models:
            dense = np.column_stack([x.dense, *odds])
            odds.append(np.zeros(len(x.dense)) if model is None else np.clip(Matrix(x.first, x.index, dense).dot(*model), -30, 30) / 10)
        p = 1 / (1 + np.exp(-10 * np.stack(odds, axis=1)))
        p[:, [m is None for m in self.models]] = np.nan
        return p


def train(rows: pa.Table, categories: list[str]) -> Chain:
    rows = rows.combine_chunks()
    words = rows["words"].combine_chunks()
    hashes = words.flatten().to_numpy().view(np.uint64)
    first = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]) if len(words) else np.zeros(1, np.int64)
    shares = rows["shares"].combine_chunks().flatten().to_numpy().reshape(-1, N_SHARES)
    labels = {c: rows[c].to_numpy().astype(np.float64) for c in categories}
    chain = Chain(categories, associated(first, hashes, labels))
    x = chain.matrix(first, hashes, shares)
    fold = (np.arange(len(shares)) * 2654435761 >> 7) % FOLDS
    odds: list[np.ndarray] = []
    for c in categories:
        y, known = labels[c], ~np.isnan(labels[c])
        chain.shares.append(float(y[known].mean()) if known.any() else np.nan)
        if not known.any():
            chain.models.append(None)
            odds.append(np.zeros(len(shares)))
            continue
        fed = Matrix(x.first, x.index, np.column_stack([x.dense, *odds]))
        chain.models.append(fit_logistic(fed.rows(known), y[known], len(chain.vocab)))
        if c == categories[-1]:
            break
        out = np.zeros(len(shares))
        for k in range(FOLDS):
            w, d = fit_logistic(fed.rows(known & (fold != k)), y[known & (fold != k)], len(chain.vocab))
            part = fold == k
            out[part] = fed.rows(part).dot(w, d)
        odds.append(np.clip(out, -30, 30) / 10)
    return chain


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str], train_rows: int = 20_000, threshold: float = 0.4) -> DataFrame:
    """(doc_id, p_<category>..., toxic) of all docs (doc_id, text).

    ``categories`` maps the chain's categories, in its order, to SQL conditions on
    ``labels`` (1, 0 or null); ``toxic`` is the verdict on the last.
    """
    small_batches(docs.sparkSession)
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long"), *[F.expr(e).cast("double").alias(n) for n, e in categories.items()])
    marked = marked.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    # one text per id, however many rows have it: train_rows rows at most reach the driver
    chosen = texts.select("doc_id", "text_hash").join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    picked = texts.join(F.broadcast(sample.join(chosen, "doc_id")), ["doc_id", "text_hash"]).drop("text_hash")
    rows = picked.mapInArrow(sparse_rows, ", ".join(["doc_id long", *[f"{n} double" for n in names], "words array<long>", "shares array<double>"])).dropDuplicates(["doc_id"])
    chain = train(rows.orderBy("doc_id").toArrow(), names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            words, h, shares = text_features(batch.column("text"))
            x = shared.value.matrix(words.first, h, shares)
            p = shared.value.predict(x)
            p[words.counts == 0] = shared.value.shares
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, from_pandas=True) for c in p.T], pa.array(p[:, -1] >= threshold)], ["doc_id", *[f"p_{n}" for n in names], "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(["doc_id long", *[f"p_{n} double" for n in names], "toxic boolean"]))
