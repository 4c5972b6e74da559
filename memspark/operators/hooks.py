"""Places for a user's own code: encoders of texts, answering models, judges, timers.

A hook gets a factory, not an object: each Python worker makes one object per
(name, device) and keeps it, so a model is loaded once per worker and not per
batch; what loading takes is not part of any measured cost.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from memspark.functions import text as T

# The prefix that one family of encoders wants on queries, and the prompts.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
ANSWER_PROMPT = (
    "Here are excerpts from earlier conversations with the user, most relevant first.\n\n{context}\n\nToday's date is {date}.\n\n"
    "Using only the excerpts above, answer the user's question. If the excerpts do not contain the answer, say you don't know.\n\n"
    "Question: {question}\nAnswer concisely."
)
CLOSED_BOOK_PROMPT = "Today's date is {date}.\n\nAnswer the user's question. If you do not know the answer, say you don't know.\n\nQuestion: {question}\nAnswer concisely."
# End of fixed values.
#: Texts that an encoder gets at once; tokens that a verdict may take.
ENCODE_BATCH, VERDICT_TOKENS = 128, 8
KEPT: dict[tuple[str, str], object] = {}


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Backend(Protocol):
    def generate(self, prompt: str, max_new_tokens: int) -> tuple[str, int | None, int | None]:
        """(text, prompt tokens, completion tokens); tokens are null if the client does not tell."""
        ...


def kept(name: str, device: str, make: Callable[[], object]) -> object:
    """This worker's object of a name and device."""
    if (name, device) not in KEPT:
        KEPT[name, device] = make()
    return KEPT[name, device]


class HashingEncoder:
    """Counts of a text's tokens in ``dims`` buckets by md5: needs no model, the same in every engine."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9']+", t.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % self.dims] += 1
        return out


def prefix_of(name: str, query: bool) -> str:
    """What a model wants before a text."""
    return QUERY_PREFIX if query and "bge" in name.lower() else ""


def encoded(df: DataFrame, text_col: str, name: str, make: Callable[[], Encoder] = HashingEncoder, device: str = "cpu", query: bool = False, seconds: bool = False) -> DataFrame:
    """``df`` with ``vec``: the text's unit vector (all zeros for one without tokens), and with
    ``seconds`` its share of the time that the encoder took.  Null texts are empty."""
    made = ["vec", "seconds"] if seconds else ["vec"]
    keep = [c for c in df.columns if c not in made]
    schema = StructType([*df.select(*keep).schema.fields, *[StructField(c, t) for c, t in zip(made, (ArrayType(DoubleType()), DoubleType()), strict=False)]])
    prefix = prefix_of(name, query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(name, device, make)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_BATCH):
                part = batch.slice(at, ENCODE_BATCH)
                began = time.perf_counter()
                x = np.asarray(encoder.encode([prefix + (t or "") for t in part.column(text_col).to_pylist()]), dtype=np.float64)
                took = (time.perf_counter() - began) / part.num_rows
                size = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                out = [pa.array(list(x), pa.list_(pa.float64())), pa.array([took] * part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, *out[: len(made)]], names=[*keep, *made])

    return df.select(*keep).mapInArrow(run, schema)


def content_key(name: str, cache_key: Column, texts: Column) -> Column:
    """The key of a group of texts in the vector cache: model, group, number and the texts
    themselves, each ended by a NUL so that no two lists of texts run together."""
    content = F.concat(F.array_join(texts, "\0"), F.when(F.size(texts) > 0, F.lit("\0")).otherwise(""))
    digest = F.left(F.sha1(content.cast("binary")), F.lit(16))
    return F.left(F.sha1(F.concat_ws("|", F.lit(name), cache_key, F.size(texts), digest).cast("binary")), F.lit(20))


def cache_get(groups: DataFrame, cache: DataFrame, name: str) -> DataFrame:
    """groups(cache_key, texts) with key, vectors, cost and ``hit``.  An entry with another
    number of vectors than texts is a miss; the cost of a hit is the one it was made at."""
    rows = groups.withColumn("key", content_key(name, F.col("cache_key"), F.col("texts"))).join(cache.dropDuplicates(["key"]), "key", "left")
    hit = F.coalesce(F.size("vectors") == F.size("texts"), F.lit(False))
    return rows.withColumn("hit", hit).withColumns({c: F.when(F.col("hit"), F.col(c)) for c in ("vectors", "cost")})


def cache_put(found: DataFrame, path: str) -> None:
    """Append new entries (key, vectors, cost) to the cache at ``path``."""
    found.select("key", "vectors", "cost").write.mode("append").parquet(path)


def cache_stats(found: DataFrame) -> DataFrame:
    """One row: hits, misses, and whether any cost was replayed instead of measured."""
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("used_replayed_timings"))


def prompts(questions: DataFrame, contexts: DataFrame, closed_book: bool = False) -> DataFrame:
    """questions(question_id, question, question_date) with ``prompt``; contexts(query_id, context).
    A question without context is asked with no context, or by the closed-book prompt."""
    rows = questions.join(contexts.select(F.col("query_id").alias("question_id"), "context"), "question_id", "left")
    filled = lambda template: F.replace(F.replace(F.replace(F.lit(template), F.lit("{date}"), F.coalesce("question_date", F.lit("None"))), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("question"))
    empty = F.coalesce("context", F.lit("")) == ""
    return rows.withColumn("prompt", F.when(empty & F.lit(closed_book), filled(CLOSED_BOOK_PROMPT)).otherwise(filled(ANSWER_PROMPT))).drop("context")


def predictions(rows: DataFrame, name: str, make: Callable[[], Backend], max_new_tokens: int = 64) -> DataFrame:
    """``rows`` (with ``prompt``) with pred, prompt_tokens, completion_tokens and ``estimated``:
    tokens that the client does not tell are estimated from the characters."""
    keep = [c for c in rows.columns if c not in ("pred", "prompt_tokens", "completion_tokens", "estimated")]
    reply = [StructField("pred", StringType()), StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType())]
    schema = StructType([*rows.select(*keep).schema.fields, *reply])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = kept(name, "", make)
        for batch in batches:
            out = [backend.generate(p or "", max_new_tokens) for p in batch.column("prompt").to_pylist()]
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*keep, "pred", "prompt_tokens", "completion_tokens"])

    told = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    estimate = lambda c, of: F.coalesce(c, T.estimate_tokens(F.col(of)).cast("long")).alias(c)
    out = rows.select(*keep).mapInArrow(run, schema)
    return out.select(*keep, "pred", estimate("prompt_tokens", "prompt"), estimate("completion_tokens", "pred"), (~told).alias("estimated"))


def judge_prompt(template: str, abstain_template: str) -> Column:
    """What a judge is asked: a template of {question}, {gold} and {pred}, another one for abstentions."""
    filled = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{question}"), F.col("question")), F.lit("{gold}"), F.col("gold")), F.lit("{pred}"), F.col("pred"))
    return F.when(F.col("is_abstention"), filled(abstain_template)).otherwise(filled(template))


def judged(answers: DataFrame, name: str, make: Callable[[], Backend], template: str, abstain_template: str) -> DataFrame:
    """``answers`` (question, gold, pred, is_abstention) with raw_verdict and verdict by a judge."""
    asked = answers.withColumns({"answer": F.col("pred"), "prompt": judge_prompt(template, abstain_template)})
    replies = predictions(asked, name, make, max_new_tokens=VERDICT_TOKENS)
    return replies.select(*[F.col("answer").alias("pred") if c == "pred" else F.col(c) for c in answers.columns], F.col("pred").alias("raw_verdict"), T.parse_verdict(F.col("pred")).alias("verdict"))


class ContainmentJudge:
    """Says correct where the text behind the first MARK holds the text before it: needs no model."""

    MARK = "\n<answer>\n"
    SMALL = str.maketrans(*T.SMALL)

    def generate(self, prompt: str, max_new_tokens: int) -> tuple[str, int | None, int | None]:
        gold, _, pred = (part.translate(self.SMALL).lower() for part in prompt.partition(self.MARK))
        return ("correct" if gold in pred else "incorrect"), None, None


class Timer:
    """Wall-clock seconds per phase, of the actions run inside ``phase``."""

    def __init__(self) -> None:
        self.seconds = {"write": 0.0, "read": 0.0}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        if name not in self.seconds:
            raise ValueError(f"unknown phase {name!r}: one of {tuple(self.seconds)}")
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began
