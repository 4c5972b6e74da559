"""Quality rules as a short-circuit cascade (operator 10).

Every rule is a test on counts of one text.  The first rules (BASE) are on counts
that are wanted for all rows; a row that they reject is decided.  The planner
draws a sample of about ``sample_rows`` rows, computes all features of it, and
so knows which rows each further rule rejects and how much work its features
are - the bytes, words and lines that they go through, weighted by a fixed cost
per pass, so that reruns plan alike.  It orders the rules greedily by (rows
still alive that the rule rejects) / (cost of the features it adds).  The
cascade computes a feature only for rows that no earlier rule has rejected.  A
row is kept if no rule rejects it, so the order changes the cost and never the
verdict.

Defined cases: a null or blank text has no words and fails ``min_words``; whole
texts are read; repeated rows are judged each for itself; an empty table gives
an empty result; columns of the input with the names of verdicts are replaced,
others are kept by ``cascade`` and ignored by ``measure``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from memspark.llm import textvec as tv
from memspark.llm.common import small_batches

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
BULLETS = ("-", "*", "\u2022")
WINDOW = 5


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Counts:
    """Features of a chunk of texts; each is an array over its rows and computed when asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = tv.split_words(texts)
        self._lines: tuple[np.ndarray, ...] | None = None

    def full_lines(self) -> tuple[np.ndarray, ...]:
        """(text, start, end, trimmed start, trimmed end) of the lines with a word."""
        if self._lines is None:
            doc, start, end, lo, hi = tv.lines(self.words)
            full = hi > lo
            self._lines = doc[full], start[full], end[full], lo[full], hi[full]
        return self._lines

    def per_text(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=len(self.words.counts)).astype(np.int64)

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @property
    def word_chars(self) -> np.ndarray:
        data = self.words.data
        return per_doc(~tv.SPACE[data] & ((data & 0xC0) != 0x80), self.words.offsets)

    @property
    def n_symbols(self) -> np.ndarray:
        return per_doc(SYMBOLS[self.words.data], self.words.offsets)

    @property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        doc, start, end, _, _ = self.full_lines()
        h = tv.hash_spans(self.words.data, start, end)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        return self.per_text(doc[1:][again])

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside five-word windows that occur at least twice in the text."""
        w = self.words
        spans, off = tv.windows(tv.hash_words(w), w.first, WINDOW)
        out = np.zeros(len(w.counts), dtype=np.int64)
        for i in np.flatnonzero(np.diff(off) > 1).tolist():
            h = spans[off[i] : off[i + 1]]
            ordered = np.sort(h)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if not len(twice):
                continue
            twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
            found = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
            edge = np.zeros(len(h) + WINDOW, dtype=np.int64)
            edge[: len(h)] += found
            edge[WINDOW:] -= found
            out[i] = np.count_nonzero(np.cumsum(edge))
        return out

    @property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return self.per_text(self.full_lines()[0])

    @property
    def n_bullet_lines(self) -> np.ndarray:
        """Lines whose first word starts with a bullet."""
        doc, _, _, lo, _ = self.full_lines()
        return self.per_text(doc[self.starts(lo, BULLETS)])

    @property
    def n_open_lines(self) -> np.ndarray:
        """Lines that end in three periods or an ellipsis."""
        doc, _, _, lo, hi = self.full_lines()
        at = np.maximum(hi - 3, lo)
        return self.per_text(doc[(hi - lo >= 3) & self.starts(at, ("...", "\u2026"))])

    @property
    def n_letter_words(self) -> np.ndarray:
        """Words with a letter; every character beyond ASCII counts as one."""
        w = self.words
        letters = np.concatenate([[0], np.cumsum(LETTERS[w.data])])
        return per_doc(letters[w.end] > letters[w.start], w.first)

    @property
    def top_word(self) -> np.ndarray:
        """How often the most frequent word comes, upper and lower case apart."""
        w = self.words
        out = np.zeros(len(w.counts), dtype=np.int64)
        h, doc = tv.hash_words(w), w.doc
        if len(h):
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
            np.maximum.at(out, doc[head], np.diff(np.concatenate([head, [len(h)]])))
        return out

    def starts(self, at: np.ndarray, prefixes: tuple[str, ...]) -> np.ndarray:
        """Whether one of the prefixes stands at each place of the bytes."""
        data = np.concatenate([self.words.data, np.zeros(4, np.uint8)])
        hit = np.zeros(len(at), dtype=bool)
        for p in prefixes:
            raw = np.frombuffer(p.encode(), np.uint8)
            hit |= np.all([data[at + k] == b for k, b in enumerate(raw.tolist())], axis=0)
        return hit


#: Features that are reported for every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_lines", "n_bullet_lines", "n_open_lines", "n_letter_words", "top_word")


@dataclass(frozen=True)
class Work:
    """What a feature goes through: nanoseconds per byte, word and line, roughly as measured once."""

    byte: float = 0.0
    word: float = 0.0
    line: float = 0.0


COST = {
    "n_words": Work(byte=12), "word_chars": Work(byte=6), "n_symbols": Work(byte=4), "n_dup_lines": Work(byte=4, line=400), "n_repeat_words": Work(word=180),
    "n_lines": Work(byte=4, line=150), "n_bullet_lines": Work(byte=4, line=250), "n_open_lines": Work(byte=4, line=250), "n_letter_words": Work(byte=4, word=10), "top_word": Work(word=250),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the arrays of ``features`` and returns which rows fail."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: Rules of the base verdict.
BASE = (
    Rule("min_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("duplicate_lines", ("n_words", "n_dup_lines"), lambda n, d: 10 * d > n),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), lambda n, b: 10 * b > 9 * n),
    Rule("open_lines", ("n_lines", "n_open_lines"), lambda n, o: 10 * o > 3 * n),
    Rule("letter_words", ("n_words", "n_letter_words"), lambda n, a: 10 * a < 6 * n),
    Rule("top_word", ("n_words", "top_word"), lambda n, t: 10 * t > 4 * n),
)


def plan_order(sample: list[pa.RecordBatch], rules: tuple[Rule, ...] = RULES, have: tuple[str, ...] = ()) -> list[str]:
    """Rule names in order of rejections per cost among the sample's rows; the
    features ``have`` are there already and cost nothing."""
    batches = [b for b in sample if b.num_rows]
    if not batches:
        return [r.name for r in rules]
    wanted = sorted({f for r in rules for f in r.features})
    values: dict[str, list[np.ndarray]] = {f: [] for f in wanted}
    size = np.zeros(3)
    for batch in batches:
        counts = Counts(batch.column("text"))
        for f in wanted:
            values[f].append(getattr(counts, f))
        size += [len(counts.words.data), len(counts.words.start), len(counts.full_lines()[0])]
    column = {f: np.concatenate(v) for f, v in values.items()}
    cost = {f: float(size @ [COST[f].byte, COST[f].word, COST[f].line]) for f in wanted}
    rows = len(column[wanted[0]])
    alive, known = np.ones(rows, dtype=bool), set(have)
    left, order = list(rules), []
    while left:
        # half a row more than was seen: a rule that the sample knows no case of is not for nothing
        score = lambda r: (np.count_nonzero(r.rejects(*[column[f] for f in r.features]) & alive) + 0.5) / (sum(cost[f] for f in r.features if f not in known) + rows)
        best = max(left, key=score)
        alive &= ~best.rejects(*[column[f] for f in best.features])
        known |= set(best.features)
        left.remove(best)
        order.append(best.name)
    return order


def verdicts(texts: pa.Array, order: list[str], rules: tuple[Rule, ...] = RULES, have: dict[str, np.ndarray] | None = None, alive: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, int]]:
    """(index in ``order`` of the rule that rejects each text or -1, rows each feature
    was computed for).  ``have`` holds features of all texts; texts that are not
    ``alive`` are decided and stay at -1."""
    by = {r.name: r for r in rules}
    failed, computed = np.full(len(texts), -1), {}
    rows = np.arange(len(texts)) if alive is None else np.flatnonzero(alive)
    known = {f: v[rows] for f, v in (have or {}).items()}
    counts, of = None, -1
    for at, name in enumerate(order):
        if not len(rows):
            break
        rule = by[name]
        for f in rule.features:
            if f not in known:
                if of != len(rows):
                    # rows only ever leave: the same number is the same rows
                    counts, of = Counts(texts if len(rows) == len(texts) else texts.take(pa.array(rows))), len(rows)
                known[f] = getattr(counts, f)
                computed[f] = len(rows)
        bad = rule.rejects(*[known[f] for f in rule.features])
        if bad.any():
            failed[rows[bad]] = at
            rows = rows[~bad]
            known = {f: v[~bad] for f, v in known.items()}
    return failed, computed


def sample_batches(df: DataFrame, rows: int = 2000) -> list[pa.RecordBatch]:
    """About ``rows`` texts from all over the table; used for costs and rejection rates only."""
    small_batches(df.sparkSession)
    total = df.count()
    part = df.select("text").sample(fraction=min(1.0, rows / max(total, 1)), seed=7)
    return list(tv.chunks(iter(part.toArrow().to_batches())))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``df`` with ``kept`` and ``rejected_by``; features of rejected rows are not computed further."""
    order = plan_order(sample_batches(df, sample_rows), rules)
    keep = [c for c in df.columns if c not in ("kept", "rejected_by")]
    source = df.select(*keep)
    schema = StructType([*source.schema.fields, StructField("kept", BooleanType()), StructField("rejected_by", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            failed, _ = verdicts(batch.column("text"), order, rules)
            names = pa.array([order[i] if i >= 0 else None for i in failed.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed < 0), names], names=[*keep, "kept", "rejected_by"])

    return source.mapInArrow(run, schema)


def measure(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, the reported counts, base_failed, kept, rejected_by) of every row.

    The reported counts are computed for all rows.  Rows that the base rules reject
    are decided; the others go through the cascade of the further rules, which
    computes further features for those still alive only.
    """
    base = {r.name for r in BASE}
    later = tuple(r for r in rules if r.name not in base)
    order = plan_order(sample_batches(df, sample_rows), later, REPORTED)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    names = ["doc_id", *REPORTED, "base_failed", "kept", "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            texts = batch.column("text")
            counts = Counts(texts)
            have = {f: getattr(counts, f) for f in REPORTED}
            failed = [r.rejects(*[have[f] for f in r.features]) for r in BASE]
            bad = np.any(failed, axis=0)
            later_failed, _ = verdicts(texts, order, later, have, ~bad)
            by = [next(r.name for r, f in zip(BASE, failed, strict=True) if f[i]) if b else order[k] if k >= 0 else None for i, (b, k) in enumerate(zip(bad.tolist(), later_failed.tolist(), strict=True))]
            cols = [pa.array(have[f].astype(np.int64)) for f in REPORTED]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(bad), pa.array(~bad & (later_failed < 0)), pa.array(by, pa.string())], names=names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
