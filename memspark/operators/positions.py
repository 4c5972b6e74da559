"""Where the tokens of units stand, and which answers are found there.

``tokens`` has a row per token of a unit with its place in the whole store, so a
phrase is looked for by its rarest token, and the others are tested at the places
that this one leaves: a phrase never meets a unit that lacks that token, and no
row holds more than one token, however many units a store has.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.sources.stage import discard, saved

#: Unit numbers whose places are summed together before they are summed over the store.
BIN = 1024


class Answers(NamedTuple):
    """Of answers known by (question_id, nth): their phrases, the items of their enumerations
    (n of them, in order if ``ordered``), and their distinct tokens."""

    phrases: DataFrame  # question_id, nth, span
    items: DataFrame  # question_id, nth, item, span, n, ordered
    tokens: DataFrame  # question_id, nth, token


def answers_of(golds: DataFrame) -> Answers:
    """golds(question_id, question, nth, answer); spans are texts of normal tokens, empty ones are left out."""
    g = golds.select("question_id", "nth", T.answer_key(F.col("answer"), F.col("question")).alias("key"), F.array_distinct(T.normal_tokens(F.col("answer"))).alias("tokens"))
    phrases = g.select("question_id", "nth", F.explode("key.any").alias("span")).withColumn("span", F.trim("span")).where("span <> ''").distinct()
    items = g.select("question_id", "nth", F.posexplode("key.all").alias("item", "span"), F.size("key.all").alias("n"), F.col("key.ordered").alias("ordered"))
    return Answers(phrases, items.withColumn("span", F.trim("span")).where("span <> ''"), g.select("question_id", "nth", F.explode("tokens").alias("token")))


def store_tokens(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_id, token, at): at counts through the units of a store in their order."""
    rows = units.select(*keys, "unit_id", T.normal_tokens(F.col("text")).alias("tokens")).withColumn("bin", F.floor(F.col("unit_id") / BIN))
    bins = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*keys, "bin").agg(F.sum(F.size("tokens")).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(bins), F.lit(0))).drop("n")
    inner = Window.partitionBy(*keys, "bin").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(F.size("tokens")).over(inner), F.lit(0))).join(start, [*keys, "bin"])
    each = placed.select(*keys, "unit_id", (F.col("start") + F.col("before")).alias("first"), F.posexplode("tokens").alias("pos", "token"))
    return each.select(*keys, "unit_id", "token", (F.col("first") + F.col("pos")).cast("long").alias("at"))


def occurrences(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, span, at, one_unit, unit_id) of spans(question_id, span): each place at which a span's tokens stand one after the other."""
    each = spans.select("question_id", "span", F.posexplode(F.split("span", " ")).alias("j", "token"), F.size(F.split("span", " ")).alias("k"))
    counts = tokens.groupBy(*keys, "token").agg(F.count("*").alias("c"))
    rare = each.join(counts, ["question_id", "token"]).groupBy(*keys, "span", "k").agg(F.count("*").alias("have"), F.min_by(F.struct("j", "token"), F.struct("c", "j")).alias("rare")).where("have = k")
    starts = rare.select(*keys, "span", "k", F.col("rare.j").alias("j"), F.col("rare.token").alias("token")).join(tokens.drop("unit_id"), [*keys, "token"])
    starts = starts.select(*keys, "span", "k", (F.col("at") - F.col("j")).alias("start"))
    wanted = starts.join(each.select("question_id", "span", "j", "token"), ["question_id", "span"]).withColumn("at", F.col("start") + F.col("j"))
    found = wanted.join(tokens, [*keys, "token", "at"]).groupBy(*keys, "span", "k", "start").agg(F.count("*").alias("have"), F.min("unit_id").alias("unit_id"), F.max("unit_id").alias("last")).where("have = k")
    return found.select(*keys, "span", F.col("start").alias("at"), (F.col("unit_id") == F.col("last")).alias("one_unit"), "unit_id")


def covered(tokens: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth) of the answers all of whose tokens(question_id, nth, token) stand in one unit."""
    inside = tokens.select(*keys, "unit_id", "token").distinct()
    need = wanted.withColumn("k", F.count("*").over(Window.partitionBy("question_id", "nth")))
    counts = inside.groupBy(*keys, "token").agg(F.count("*").alias("c"))
    rare = need.join(counts, ["question_id", "token"]).groupBy(*keys, "nth", "k").agg(F.count("*").alias("have"), F.min_by("token", F.struct("c", "token")).alias("token")).where("have = k")
    units = rare.drop("have").join(inside, [*keys, "token"]).drop("token")
    met = units.join(wanted, ["question_id", "nth"]).join(inside, [*keys, "unit_id", "token"])
    return met.groupBy(*keys, "nth", "unit_id", "k").count().where("count = k").select(*keys, "nth").distinct()


def in_order(seen: DataFrame, by: list[str], longest: int) -> DataFrame:
    """``by`` of the enumerations whose items can each start after the one before: the first
    place of the first item, then the first place of the second after it, and so on."""
    at = seen.where("item = 0").groupBy(*by, "n").agg(F.min("at").alias("from"))
    done = at.where("n = 1").select(*by)
    for i in range(1, longest):
        later = seen.where(F.col("item") == i).select(*by, "at")
        at = at.where(F.col("n") > i).join(later, by).where("at > from").groupBy(*by, "n").agg(F.min("at").alias("from"))
        done = done.unionByName(at.where(F.col("n") == i + 1).select(*by))
    return done


def found(units: DataFrame, golds: DataFrame, *group: str) -> DataFrame:
    """(group, question_id, nth, record, soft, union_hit) of the golds that are found at all in
    the units of their question, as a saved table: in one unit, by their tokens in one unit, anywhere."""
    keys = [*group, "question_id"]
    a = answers_of(golds)
    spans = a.phrases.select("question_id", "span").unionByName(a.items.select("question_id", "span")).distinct()
    every = spans.select("question_id", F.explode(F.split("span", " ")).alias("token")).unionByName(a.tokens.select("question_id", "token")).distinct()
    tokens = saved(store_tokens(units, keys).join(every, ["question_id", "token"], "left_semi"), "tokens")
    places = saved(occurrences(tokens, spans, keys), "places")
    no, yes = F.lit(False), F.lit(True)
    flag = lambda rows, record, soft, union: rows.select(*keys, "nth", record.alias("record"), soft.alias("soft"), union.alias("union_hit"))
    parts = [flag(a.phrases.join(places, ["question_id", "span"]), F.col("one_unit"), no, yes), flag(covered(tokens, a.tokens, keys), no, yes, no)]
    seen = a.items.join(places, ["question_id", "span"])
    free = seen.where("NOT ordered")
    whole = lambda rows, by: rows.groupBy(*by, "n").agg(F.count_distinct("item").alias("have")).where("have = n").select(*by)
    parts.append(flag(whole(free, [*keys, "nth"]), no, no, yes))
    parts.append(flag(whole(free.where("one_unit"), [*keys, "nth", "unit_id"]), yes, no, yes))
    longest = a.items.where("ordered").agg(F.max("n")).first()[0]
    if longest:
        strict = seen.where("ordered")
        parts.append(flag(in_order(strict, [*keys, "nth"], longest), no, no, yes))
        parts.append(flag(in_order(strict.where("one_unit"), [*keys, "nth", "unit_id"], longest), yes, no, yes))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = saved(out.groupBy(*keys, "nth").agg(*[F.bool_or(c).alias(c) for c in ("record", "soft", "union_hit")]), "found")
    discard(tokens, places)
    return out
