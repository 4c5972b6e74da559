"""Language identification by Bayesian evidence fusion (operator 9).

Four sources of evidence are added as log-probabilities per language:

* the text: a multinomial model of hashed byte trigrams of the lower-cased
  words, learnt from all rows with a declared language (counts by task, summed;
  a text of more than LONG trigrams counts as the root of its length beyond, so
  that no long text with a wrong declaration makes a language's model);
  every declared language has one, and tasks go through them in pieces;
  its log-likelihood is tempered to ``text_power`` of its length, as trigrams
  are far from independent, and counts fully for short texts only;
* the declared markup language (``declared``): how often a declaration is right,
  measured against the text model's own verdicts, per declared value;
* the address suffix (``suffix``): likewise, when a column gives one;
* the host prior, smoothed level by level: the language shares of the host are
  shrunk towards those of its domain (the host without its first label), these
  towards the shares of all rows, by ``host_weight`` pseudo-documents each.  A
  host of one or two labels has no domain above it and is shrunk towards all
  rows at once.  Counts per level come by grouped aggregation.

Row verdicts: ``lang_id`` (the most probable language, ties to the first in
code-point order), ``confidence`` (its posterior), and ``accepted``: there is a
letter in the text, and the posterior is at least ``min_confidence``.

Defined cases: a null or letterless text gives no text evidence and is not
accepted; null declarations, suffixes and hosts give no evidence of their kind
(a null host has the global prior; a host seen nowhere else has its domain's); with no declared language at all every row
has a null ``lang_id`` and is not accepted; an empty table gives an empty
result; input columns with the names of the three results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from memspark.llm import textvec as tv
from memspark.llm.common import saved, small_batches

#: Hashed trigram classes; languages per piece of the text model, of which a task holds one at a time.
CLASSES, PIECE, LONG = 1 << 15, 64, 256
#: (language, class) counts that a task gathers before it passes them on; values and (value, language) pairs broadcast at most.
GATHERED, FEW_VALUES, FEW_PAIRS = 1 << 21, 200_000, 1_000_000
KINDS = ("declared", "suffix", "domain", "host")
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0xC3:] = True


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each trigram, its text's index, letters per text); trigrams that
    hold a byte other than letters, UTF-8 continuations and spaces are left out."""
    data, off = tv.text_buffers(texts)
    data = tv.LOWER[data]
    n = np.diff(off)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    per = letters[off[1:]] - letters[off[:-1]]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), per
    plain = np.where(tv.SPACE[data], np.uint8(0x20), data)
    good = LETTER[plain] | (plain == 0x20) | (plain >= 0x80)
    ok = good[:-2] & good[1:-1] & good[2:] & ~((plain[:-2] == 0x20) & (plain[1:-1] == 0x20))
    doc = np.repeat(np.arange(len(n)), n)
    ok &= doc[:-2] == doc[2:]
    at = np.flatnonzero(ok)
    code = plain[at].astype(np.uint32) | plain[at + 1].astype(np.uint32) << 8 | plain[at + 2].astype(np.uint32) << 16
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), doc[at], per


def trigram_counts(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    names = pa.array(langs, pa.string())
    keys, sums = np.zeros(0, np.int64), np.zeros(0)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys // CLASSES).astype(np.int32)), pa.array((keys % CLASSES).astype(np.int32)), pa.array(sums)], ["lang", "class", "n"])

    for batch in tv.chunks(batches):
        lang = pc.index_in(batch.column("declared").cast(pa.string()), names).fill_null(-1).to_numpy().astype(np.int64)
        cls, doc, _ = trigrams(batch.column("text"))
        of = lang[doc]
        weight = np.minimum(1.0, np.sqrt(LONG / np.maximum(np.bincount(doc, minlength=batch.num_rows), 1)))
        merged, at = np.unique(np.concatenate([keys, (of * CLASSES + cls)[of >= 0]]), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([sums, weight[doc[of >= 0]]]), minlength=len(merged))
        keys = merged
        if len(keys) >= GATHERED:
            yield out()
            keys, sums = keys[:0], sums[:0]
    yield out()


class TextModel:
    """Trigram counts of all languages, a broadcast per PIECE of them."""

    def __init__(self, rows: DataFrame, langs: list[str]) -> None:
        sc = rows.sparkSession.sparkContext
        self.size, self.piece, self.held = len(langs), PIECE, None
        names = sc.broadcast(langs)
        counts = rows.where(F.col("declared").isNotNull()).select("declared", "text").mapInArrow(lambda it: trigram_counts(it, names.value), "lang int, class int, n double")
        counts = counts.groupBy("lang", "class").agg(F.sum("n").alias("n"))
        if self.size > self.piece:
            counts = saved(counts, "trigrams")
        self.parts = []
        for a in range(0, self.size, self.piece):
            found = counts.where((F.col("lang") >= a) & (F.col("lang") < a + self.piece)).toArrow()
            self.parts.append(sc.broadcast((found["lang"].to_numpy() - a, found["class"].to_numpy(), found["n"].to_numpy())))

    def table(self, i: int) -> np.ndarray:
        """(languages of piece i, CLASSES) log-probabilities."""
        part = self.parts[i]
        lang, cls, n = part.value
        table = np.full((min(self.piece, self.size - i * self.piece), CLASSES), 0.5)
        table[lang, cls] += n
        if len(self.parts) > 1:
            vars(part).pop("_value", None)  # the file of the broadcast stays
        return np.log(table / table.sum(axis=1, keepdims=True))

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first language, table) of each piece; a single one is kept."""
        if len(self.parts) > 1:
            yield from ((i * self.piece, self.table(i)) for i in range(len(self.parts)))
            return
        if self.held is None:
            self.held = self.table(0)
        yield 0, self.held


def text_scores(texts: pa.Array, model: TextModel, text_power: float) -> tuple[Iterator[tuple[int, np.ndarray]], np.ndarray]:
    """(first language, (rows, languages) tempered log-likelihoods) by piece, and letters per row."""
    cls, doc, letters = trigrams(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    scale = (np.maximum(n, 1.0) ** (text_power - 1.0))[:, None]

    def scores() -> Iterator[tuple[int, np.ndarray]]:
        for a, table in model.pieces():
            yield a, np.stack([np.bincount(doc, weights=row[cls], minlength=len(texts)) for row in table], axis=1) * scale

    return scores(), letters


def best_of(pieces: Iterator[tuple[int, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(best language, its posterior) per row over all pieces; ties to the first."""
    best, top, mass = np.zeros(rows, np.int64), np.full(rows, -np.inf), np.zeros(rows)
    for a, score in pieces:
        high = score.max(axis=1)
        best = np.where(high > top, a + score.argmax(axis=1), best)
        both = np.maximum(top, high)
        mass = mass * np.exp(top - both) + np.exp(score - both[:, None]).sum(axis=1)
        top = both
    return best, 1.0 / mass


def confusion(batches: Iterator[pa.RecordBatch], model: TextModel, text_power: float) -> Iterator[pa.RecordBatch]:
    """Counts of (kind, value, best language by text) of each of KINDS."""
    for batch in tv.chunks(batches):
        pieces, letters = text_scores(batch.column("text"), model, text_power)
        best = pa.array(best_of(pieces, batch.num_rows)[0].astype(np.int32), mask=letters == 0)
        for kind in KINDS:
            rows = pa.table({"value": batch.column(kind), "lang": best, "n": pa.array(np.ones(batch.num_rows, np.int64))}).drop_null()
            part = rows.group_by(["value", "lang"]).aggregate([("n", "sum")])
            yield from part.select(["value", "lang", "n_sum"]).rename_columns(["value", "lang", "n"]).add_column(0, "kind", pa.array([kind] * part.num_rows, pa.string())).combine_chunks().to_batches()


def joined_counts(seen: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the counts by language of their value of a kind: arrays
    {kind}__langs and {kind}__counts, null for a value that was not seen."""
    key = f"{kind}__evidence"
    pairs = F.collect_list(F.struct("lang", "n")).alias("pairs")
    values = seen.where(F.col("kind") == kind).groupBy(F.col("value").alias(key)).agg(pairs)
    size = values.agg(F.count("*").alias("values"), F.coalesce(F.sum(F.size("pairs")), F.lit(0)).alias("pairs")).first()
    few = size["values"] <= FEW_VALUES and size["pairs"] <= FEW_PAIRS
    values = values.select(key, F.col("pairs.lang").alias(f"{kind}__langs"), F.col("pairs.n").alias(f"{kind}__counts"))
    return rows.join(F.broadcast(values) if few else values, key, "left")


class Counts:
    """The joined counts of a batch, spread over the languages of one piece at a time."""

    def __init__(self, batch: pa.RecordBatch, kind: str) -> None:
        lists = batch.column(f"{kind}__langs")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        self.known = lists.is_valid().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(batch.num_rows), size)
        self.lang = lists.flatten().to_numpy()
        self.n = batch.column(f"{kind}__counts").flatten().to_numpy()
        self.all = np.bincount(self.row, weights=self.n, minlength=batch.num_rows)

    def dense(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((len(self.known), b - a))
        here = (self.lang >= a) & (self.lang < b)
        out[self.row[here], self.lang[here] - a] = self.n[here]
        return out


def domain_of(host: Column) -> Column:
    """A host of three or more labels without its first; null for others."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", ""))


def identify(df: DataFrame, declared: Column, host: Column, suffix: Column | None = None, text_power: float = 0.5, host_weight: float = 20.0, min_confidence: float = 0.5) -> DataFrame:
    """``df`` (with a column ``text``) with lang_id, confidence and accepted."""
    spark = df.sparkSession
    small_batches(spark)
    results = [StructField("lang_id", StringType()), StructField("confidence", DoubleType()), StructField("accepted", BooleanType())]
    keep = [c for c in df.columns if c not in {f.name for f in results}]
    given = {"declared": declared, "suffix": F.lit(None) if suffix is None else suffix, "domain": domain_of(host.cast("string")), "host": host}
    clash = {f"{k}__evidence": given[k] for k in KINDS}
    rows = df.select(*keep, *[v.cast("string").alias(k) for k, v in clash.items()])
    view = rows.select("text", *[F.col(f"{k}__evidence").alias(k) for k in KINDS])
    langs = sorted(r.declared for r in view.where(F.col("declared").isNotNull()).select("declared").distinct().collect())
    if not langs:
        return df.select(*keep, F.lit(None).cast("string").alias("lang_id"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    model = TextModel(view, langs)
    seen = saved(view.mapInArrow(lambda it: confusion(it, model, text_power), "kind string, value string, lang int, n long").groupBy("kind", "value", "lang").agg(F.sum("n").alias("n")), "evidence")
    overall = np.ones(len(langs))
    for r in seen.where("kind = 'declared'").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        overall[r.lang] += r.n
    evidence = spark.sparkContext.broadcast((langs, overall))
    kinds = ["host", "domain", "declared", *([] if suffix is None else ["suffix"])]
    joined = rows
    for kind in kinds:
        joined = joined_counts(seen, joined, kind)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, overall = evidence.value
        prior = overall / overall.sum()
        for batch in tv.chunks(batches):
            counts = {kind: Counts(batch, kind) for kind in kinds}
            pieces, letters = text_scores(batch.column("text"), model, text_power)

            def fused() -> Iterator[tuple[int, np.ndarray]]:
                for a, score in pieces:
                    b = a + score.shape[1]
                    # shares of each level shrunk towards the level above; log P(value | language) of the other kinds
                    share = prior[a:b]
                    for level in ("domain", "host"):
                        at = counts[level]
                        share = np.where(at.known[:, None], (at.dense(a, b) + host_weight * share) / (at.all + host_weight)[:, None], share)
                    score += np.log(share)
                    for kind in kinds[2:]:
                        given = counts[kind]
                        score += np.where(given.known[:, None], np.log((given.dense(a, b) + 0.5) / overall[a:b]), 0.0)
                    yield a, score

            best, posterior = best_of(fused(), batch.num_rows)
            ok = (letters > 0) & (posterior >= min_confidence)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(posterior), pa.array(ok)], names=[*keep, "lang_id", "confidence", "accepted"])

    schema = StructType([*df.select(*keep).schema.fields, *results])
    return joined.select(*keep, *[f"{kind}__{x}" for kind in kinds for x in ("langs", "counts")]).mapInArrow(fuse, schema)
