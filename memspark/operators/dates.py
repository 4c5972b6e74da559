"""Audit of question dates against session dates, at day and at minute resolution.

Dates are text; one that does not name a real day is null.  A question counts as
usable if its own date has a day and a minute and all its sessions have a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

STAMP = r"\d{4}/\d{2}/\d{2}\D*(\d{2}):(\d{2})"
HALF_LIFE_DAYS, FAR_DAYS = 30.0, 100_000


def day_ordinal(text: Column) -> Column:
    """Days since 0001-01-01, that day being 1; null for no or an impossible date."""
    return F.datediff(F.try_to_date(T.parse_date(text), "yyyy/MM/dd"), F.lit("0001-01-01").cast("date")) + 1


def minute_stamp(text: Column) -> Column:
    """Minutes of the first date that a time of day follows; null without one."""
    found = F.regexp_extract(text, STAMP, 0)
    part = lambda i: F.when(found != "", F.regexp_extract(text, STAMP, i)).cast("int")
    return day_ordinal(found) * 1440 + part(1) * 60 + part(2)


def dated(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (question_id, session_date, ...) with s_day, s_min and their question's q_day, q_min."""
    q = asked.select("question_id", day_ordinal(F.col("question_date")).alias("q_day"), minute_stamp(F.col("question_date")).alias("q_min"))
    return rows.join(q, "question_id").withColumns({"s_day": day_ordinal(F.col("session_date")), "s_min": minute_stamp(F.col("session_date"))})


def usable(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, q_day, q_min, last_day, last_min, ok): last_min is null if any session lacks a minute."""
    per = dated(sessions, asked).groupBy("question_id").agg(
        F.first("q_day").alias("q_day"), F.first("q_min").alias("q_min"), F.max("s_day").alias("last_day"),
        F.when(F.count("s_min") == F.count("*"), F.max("s_min")).alias("last_min"), (F.count("s_day") == F.count("*")).alias("dated"),
    )
    return per.withColumn("ok", F.col("dated") & F.col("q_day").isNotNull() & F.col("q_min").isNotNull()).drop("dated")


def positions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(resolution, position, n): where a question's latest session lies to the question."""
    place = lambda last, q: F.when(F.col(last) < F.col(q), "before").when(F.col(last) == F.col(q), "same").when(F.col(last) > F.col(q), "after")
    rows = F.when(~F.col("ok"), F.array(F.struct(F.lit("any").alias("resolution"), F.lit("unparsable").alias("position")))).otherwise(
        F.array(F.struct(F.lit("day").alias("resolution"), place("last_day", "q_day").alias("position")), F.struct(F.lit("minute").alias("resolution"), place("last_min", "q_min").alias("position")))
    )
    return usable(sessions, asked).select(F.inline(rows)).where("position IS NOT NULL").groupBy("resolution", "position").agg(F.count("*").alias("n"))


def gaps(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(n, min_gap, median_gap, max_gap) in days from a question's latest session to the question."""
    gap = F.col("q_day") - F.col("last_day")
    return usable(sessions, asked).where("ok").agg(F.count("*").alias("n"), F.min(gap).alias("min_gap"), F.median(gap).alias("median_gap"), F.max(gap).alias("max_gap"))


def ordering(units: DataFrame, sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(resolution, agree, differ): questions in which newest-first order is also the
    order by nearness to the question; equal keys go to the later session, then by unit."""
    rows = dated(units, asked).join(usable(sessions, asked).where("ok").select("question_id"), "question_id", "left_semi")
    by = Window.partitionBy("question_id")

    def same(s: str, q: str) -> Column:
        key = F.coalesce(s, F.lit(0))
        newest = F.row_number().over(by.orderBy(key.desc(), F.col("session_index").desc(), "unit_id"))
        nearest = F.row_number().over(by.orderBy(F.abs(F.col(q) - key), F.col("session_index").desc(), "unit_id"))
        return newest == nearest

    ranked = rows.withColumns({"day": same("s_day", "q_day"), "minute": same("s_min", "q_min")})
    per = ranked.groupBy("question_id").agg(F.bool_and("day").alias("day"), F.bool_and("minute").alias("minute"))
    long = per.select(F.inline(F.array(*[F.struct(F.lit(r).alias("resolution"), F.col(r).alias("same")) for r in ("day", "minute")])))
    return long.groupBy("resolution").agg(F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("differ"))


def leaks(units: DataFrame, sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, n_post, n_post_evidence, n_evidence, overshoot): usable questions with
    units dated after the question's minute."""
    rows = dated(units, asked).join(usable(sessions, asked).where("ok").select("question_id"), "question_id", "left_semi")
    over = F.coalesce("s_min", F.lit(0)) - F.col("q_min")
    post = over > 0
    out = rows.groupBy("question_id").agg(
        F.count_if(post).alias("n_post"), F.count_if(post & F.col("is_evidence")).alias("n_post_evidence"), F.count_if("is_evidence").alias("n_evidence"), F.max(over).alias("overshoot"),
    )
    return out.where("n_post > 0")


def origin_deviation(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(n_pairs, worst): over pairs of a question's session days, how far the ratio of two
    exponential weights depends on the day they are counted from; pairs within a question."""
    days = dated(sessions, asked).join(usable(sessions, asked).where("ok").select("question_id"), "question_id", "left_semi").select("question_id", "q_day", "s_day").distinct()
    pairs = days.join(days.select("question_id", F.col("s_day").alias("t_day")), "question_id").where("s_day < t_day")
    rate = F.log(F.lit(2.0)) / HALF_LIFE_DAYS
    ratio = lambda q: -rate * (q - F.col("s_day")) + rate * (q - F.col("t_day"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.coalesce(F.max(F.abs(F.exp(ratio(F.col("q_day")) - ratio(F.col("q_day") + FAR_DAYS)) - 1)), F.lit(0.0)), 6).alias("worst"))
