"""Costs of writing and reading: metered calls, prices, the write-cost model, break-even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

BATCHES = ("per_turn", "per_pair", "per_session", "per_conversation")


# Inputs of the published write-cost model and list prices per million tokens.
@dataclass(frozen=True)
class WriteModel:
    system_tokens: int = 7671
    template_tokens: int = 200
    memories: int = 10
    memory_tokens: int = 30
    completion_tokens: int = 300
    look_back: int = 10
    price_in: float = 0.25
    price_cached: float = 0.025
    price_out: float = 2.0
    read_tokens: int = 2109
    read_tokens_other: int = 1764


PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.0)}
# End of fixed values.


def batch_starts(turns: DataFrame) -> DataFrame:
    """``turns`` with a flag per batching: whether the turn is the first of its batch.
    Pairs never straddle sessions; turns of a reused session id are one session."""
    nth = F.row_number().over(Window.partitionBy("question_id", "session_id").orderBy("turn_index")) - 1
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("turn_index")) == 1
    return turns.withColumn("nth", nth).withColumns({"per_turn": F.lit(True), "per_pair": F.col("nth") % 2 == 0, "per_session": F.col("nth") == 0, "per_conversation": first}).drop("nth")


def write_calls(turns: DataFrame, model: WriteModel = WriteModel()) -> DataFrame:
    """(question_id, batching, n_calls, resent, content): each call carries its new turns
    and sends again the ``look_back`` turns before its first, over the whole conversation."""
    before = Window.partitionBy("question_id").orderBy("turn_index").rowsBetween(-model.look_back, -1)
    rows = batch_starts(turns).withColumn("tokens", T.count_tokens(F.concat("role", F.lit(": "), "content")).cast("long"))
    rows = rows.withColumn("back", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    per = rows.groupBy("question_id").agg(F.sum("tokens").alias("content"), *[F.struct(F.count_if(b).alias("n_calls"), F.coalesce(F.sum(F.when(F.col(b), F.col("back"))), F.lit(0)).alias("resent")).alias(b) for b in BATCHES])
    one = lambda b: F.struct(F.lit(b).alias("batching"), F.col(f"{b}.n_calls").alias("n_calls"), F.col(f"{b}.resent").alias("resent"))
    return per.select("question_id", "content", F.inline(F.array(*[one(b) for b in BATCHES])))


def write_cost(turns: DataFrame, model: WriteModel = WriteModel()) -> DataFrame:
    """Means per batching: calls, tokens, dollars with and without a cached system prompt,
    shares of the tokens, and the queries after which the write has paid off."""
    m = write_calls(turns, model).groupBy("batching").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("n_calls", "resent", "content")])
    system, completion = F.col("n_calls") * model.system_tokens, F.col("n_calls") * model.completion_tokens
    prompt = F.col("n_calls") * (model.system_tokens + model.template_tokens + model.memories * model.memory_tokens) + F.col("resent") + F.col("content")
    cached = F.greatest(F.lit(0.0), F.col("n_calls") - 1) * model.system_tokens
    total = prompt + completion
    dollars = lambda full, cheap: (full * model.price_in + cheap * model.price_cached + completion * model.price_out) / 1e6
    out = {
        "n_calls": F.col("n_calls"), "prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": total, "usd_uncached": dollars(prompt, F.lit(0.0)), "usd_cached": dollars(prompt - cached, cached),
        "share_system": system / total, "share_resent": F.col("resent") / total, "share_content": F.col("content") / total, "break_even": total / (model.read_tokens - model.read_tokens_other),
    }
    return m.select("batching", "n", *[F.round(c, 6).alias(n) for n, c in out.items()])


def sensitivity(turns: DataFrame) -> DataFrame:
    """(label, total_tokens) of session batches with low, middle and high guesses of what cannot be measured."""
    out = None
    for label, memory, completion in (("low", 15, 100), ("mid", 30, 300), ("high", 60, 800)):
        part = write_cost(turns, WriteModel(memory_tokens=memory, completion_tokens=completion)).where("batching = 'per_session'").select(F.lit(label).alias("label"), "total_tokens")
        out = part if out is None else out.unionByName(part)
    return out


def meter(events: DataFrame, *group: str) -> DataFrame:
    """Sums of metered events(kind, phase, n_items, prompt_tokens or null, estimate,
    completion_tokens): a model call counts once, an embedding once per item; a call
    without reported usage is billed by its estimate and marks the sum as estimated."""
    llm = F.col("kind") == "llm"
    billed = F.coalesce("prompt_tokens", "estimate")
    return events.groupBy(*group, "phase").agg(
        F.count_if(llm).alias("llm_calls"), F.coalesce(F.sum(F.when(llm, billed)), F.lit(0)).alias("llm_prompt_tokens"), F.coalesce(F.sum(F.when(llm, F.col("completion_tokens"))), F.lit(0)).alias("llm_completion_tokens"),
        F.coalesce(F.sum(F.when(~llm, F.col("n_items"))), F.lit(0)).alias("embed_calls"), F.coalesce(F.sum(F.when(~llm, billed)), F.lit(0)).alias("embed_tokens"),
        F.bool_or(F.when(llm, F.col("prompt_tokens").isNull()).otherwise(False)).alias("estimated"),
    )


#: What a phase of a record holds.
LEDGER = ("llm_calls", "llm_prompt_tokens", "llm_completion_tokens", "embed_calls", "embed_tokens")


def records(metered: DataFrame, *group: str) -> DataFrame:
    """(group, cost): sums of ``meter`` as one record with the phases write and read, each a
    struct of LEDGER; a phase without calls has zeros."""
    of = lambda phase: F.struct(*[F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col(c))), F.lit(0)).cast("long").alias(c) for c in LEDGER])
    return metered.groupBy(*group).agg(F.struct(of("write").alias("write"), of("read").alias("read")).alias("cost"))


def dollars(model: Column, prompt: Column, completion: Column, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """Dollars of tokens at list prices; an unknown model costs nothing."""
    cost = F.lit(0.0)
    for name, (price_in, price_out) in prices.items():
        cost = F.when(model == name, (prompt * price_in + completion * price_out) / 1e6).otherwise(cost)
    return cost


#: Memories that an external store returns at most.
TOP_K = 50_000


def extracted_store(memories: DataFrame, most: int = TOP_K) -> DataFrame:
    """units(question_id, unit_id, text, session_date, provenance) of memory versions
    (question_id, memory_id, batch, text, session_date, turn_index array): the last batch that
    touches a memory gives its text and date, its provenance is every turn of every batch;
    blank memories are dropped; ids are given in memory order.  A question with ``most``
    memories or more has met the limit of the store it came from: that is an error."""
    per = memories.groupBy("question_id", "memory_id").agg(F.max_by(F.struct("text", "session_date"), "batch").alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("turns")))).alias("provenance"))
    per = per.where(F.trim(F.coalesce("last.text", F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("memory_id"))
    full = F.raise_error(F.concat(F.lit("a store has met its limit: "), F.col("question_id")))
    unit = F.when(nth >= most, full.cast("int")).otherwise((nth - 1).cast("int"))
    return per.select("question_id", unit.alias("unit_id"), F.col("last.text").alias("text"), F.col("last.session_date").alias("session_date"), "provenance")
