"""Whether gold answers survive in a store, against a floor of matched placebos, and
where they stand in a haystack.

questions(question_id, question_type, gold, is_abstention); units(question_id, unit_id,
text).  All comparisons are within a question; an empty gold is found nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import metrics, positions
from memspark.sources.stage import discard, saved

# Question types whose answers are spans of text.
SPAN_TYPES = ("single-session-user", "single-session-assistant", "knowledge-update")
# End of fixed values.
#: Placebos per question.
PLACEBOS = 10


def routed(questions: DataFrame) -> DataFrame:
    """``questions`` with extractive, primary, numeral, gold_abstains, scored and eligible flags."""
    g = T.normal_tokens(F.col("gold"))
    out = questions.withColumns({"extractive": T.is_extractive(g), "primary": F.size(g) >= T.PRIMARY_TOKENS, "numeral": T.is_numeral(F.col("gold")), "gold_abstains": T.gold_abstains(F.col("gold")), "bucket": T.length_bucket(g)})
    scored = ~F.col("is_abstention") & F.col("extractive") & ~F.col("gold_abstains")
    return out.withColumns({"scored": scored, "eligible": scored & F.col("question_type").isin(*SPAN_TYPES)})


def joined(texts: Column, order: str) -> Column:
    """The texts of a group in order, one per line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), texts.alias("t")))), lambda x: x["t"]), "\n")


def locations(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Per scored question: gold in one evidence turn, in all of them together, in any turn, only outside the evidence."""
    q = routed(questions).where("scored").select("question_id", "question_type", "question", "gold", "bucket", "numeral")
    keys = q.withColumn("key", T.answer_key(F.col("gold"), F.col("question"))).select("question_id", "key")
    hit = T.has_answer(T.normal_tokens(F.col("content")), F.col("key"))
    per = turns.join(q.join(keys, "question_id"), "question_id").withColumn("hit", hit).groupBy("question_id", "question_type", "question", "gold", "bucket", "numeral").agg(
        F.coalesce(F.bool_or(F.when(F.col("has_answer"), F.col("hit"))), F.lit(False)).alias("in_evidence"), F.bool_or("hit").alias("in_haystack"),
        joined(F.when(F.col("has_answer"), F.col("content")), "turn_index").alias("text"),
    )
    union = T.contains_answer(F.col("text"), F.col("gold"), F.col("question")).alias("in_union")
    return per.select("question_id", "question_type", "bucket", "numeral", "in_evidence", union, "in_haystack", (F.col("in_haystack") & ~F.col("in_evidence")).alias("outside_only"))


def rate(c: str) -> Column:
    return F.round(F.avg(F.col(c).cast("int")), 6)


def location_rates(rows: DataFrame) -> DataFrame:
    """Rates of the locations for all, by type, by length bucket and by both."""
    cube = rows.cube("question_type", "bucket").agg(F.count("*").alias("n"), *[rate(c).alias(c) for c in ("in_evidence", "in_union", "in_haystack", "outside_only", "numeral")])
    return cube.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("question_type", "bucket")})


def fates(rows: DataFrame) -> DataFrame:
    """Golds of two or more tokens, by type: in labelled evidence, elsewhere word for word, nowhere."""
    return rows.where("bucket <> '1'").groupBy("question_type").agg(
        F.count("*").alias("n"), rate("in_evidence").alias("in_labelled_evidence"), rate("outside_only").alias("unlabelled"), F.round(F.avg((~F.col("in_haystack")).cast("int")), 6).alias("nowhere"),
    )


def exclusions(questions: DataFrame) -> DataFrame:
    """One row: questions, abstentions, those left out as too long or because the gold abstains, scored ones."""
    asked = ~F.col("is_abstention")
    return routed(questions).agg(
        F.count("*").alias("n"), F.count_if("is_abstention").alias("n_abstention"), F.count_if(asked & ~F.col("extractive")).alias("n_not_extractive"),
        F.count_if(asked & F.col("extractive") & F.col("gold_abstains")).alias("n_gold_abstains"), F.count_if("scored").alias("n_scored"), F.count_if("eligible").alias("n_eligible"),
    )


def placebos(questions: DataFrame, m: int = PLACEBOS) -> DataFrame:
    """(question_id, nth, placebo): up to m golds of other questions of the same type and
    length bucket - of the same type if there are none - that differ from the question's own.

    A group's golds stand in hash order, each as often as it is given, so that a frequent
    one weighs as often as it comes.  A question starts at its own hash after its gold's
    place and takes evenly spaced ones: neighbours draw different ones, and only distinct
    golds are put in order.
    """
    q = questions.withColumn("bucket", T.length_bucket(T.normal_tokens(F.col("gold"))))

    def drawn(*group: str) -> DataFrame:
        of = Window.partitionBy(*group)
        before = F.coalesce(F.sum("freq").over(of.orderBy(F.md5(F.col("gold").cast("binary")), "gold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        golds = q.groupBy(*group, "gold").agg(F.count("*").alias("freq")).withColumns({"first": before, "size": F.sum("freq").over(of)})
        places = golds.select(*group, F.col("gold").alias("placebo"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("freq") - 1)).alias("at"))
        others = F.col("size") - F.col("freq")
        start = F.conv(F.substring(F.md5(F.col("question_id").cast("binary")), 1, 8), 16, 10).cast("long")
        own = q.join(golds, [*group, "gold"]).withColumns({"others": others, "start": start}).where("others > 0")
        own = own.withColumn("nth", F.explode(F.sequence(F.lit(0), (F.least(F.lit(m), F.col("others")) - 1).cast("int"))))
        at = F.expr(f"(first + freq + (start + nth * (others div least({m}, others))) % others) % size")
        return own.withColumn("at", at).join(places, [*group, "at"]).select("question_id", "nth", "placebo")

    tight = drawn("question_type", "bucket")
    return tight.unionByName(drawn("question_type").join(tight.select("question_id").distinct(), "question_id", "left_anti"))


def score(units: DataFrame, questions: DataFrame, m: int = PLACEBOS, *group: str) -> DataFrame:
    """One row per question with units, and per value of the further columns ``group`` of the
    units (several stores at once): record (the answer in one unit), soft (its tokens in
    one unit), union_hit (the answer in all units together), the same of m placebos as floors
    (0 if there are none), sizes.  Answers are looked for in a positional index of the tokens."""
    q = questions.select("question_id", "question_type", "question", "gold")
    golds = q.select("question_id", "question", F.lit(-1).alias("nth"), F.col("gold").alias("answer"))
    if m:
        golds = golds.unionByName(placebos(questions, m).join(q, "question_id").select("question_id", "question", "nth", F.col("placebo").alias("answer")))
    golds = saved(golds, "golds")
    keys = [*group, "question_id"]
    hits = positions.found(units.join(q.select("question_id"), "question_id", "left_semi"), golds, *group)
    own = hits.where("nth < 0").drop("nth")
    other = hits.where("nth >= 0").groupBy(*keys).agg(*[F.count_if(c).alias(f"n_{c}") for c in ("record", "soft", "union_hit")])
    drawn = golds.where("nth >= 0").groupBy("question_id").agg(F.count("*").alias("m"))
    sizes = units.groupBy(*keys).agg(F.count("*").alias("n_records"), F.sum(T.count_tokens(F.col("text")).cast("long")).alias("store_tokens"))
    rows = sizes.join(q, "question_id").join(own, keys, "left").join(other, keys, "left").join(drawn, "question_id", "left").withColumn("g", T.normal_tokens(F.col("gold")))
    floor = lambda c: F.when(F.col("m") > 0, F.coalesce(F.col(f"n_{c}"), F.lit(0)) / F.col("m")).otherwise(0.0)
    hit = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = rows.select(
        *keys, "question_type", T.length_bucket(F.col("g")).alias("bucket"), (F.size("g") >= T.PRIMARY_TOKENS).alias("in_primary"), hit("record"), hit("soft"), hit("union_hit"),
        "n_records", "store_tokens", floor("record").alias("null_record"), floor("soft").alias("null_soft"), floor("union_hit").alias("null_union"),
    )
    out = saved(out, "outcomes")
    discard(golds, hits)
    return out


def groups(rows: DataFrame) -> DataFrame:
    """Survival and its floor for all, by bucket and by type of the primary questions, with store sizes."""
    part = lambda df, group, key: df.groupBy(key).agg(
        F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("record", "soft", "union_hit", "null_record", "null_soft", "null_union", "n_records", "store_tokens")],
        F.round(metrics.chance_corrected(F.avg(F.col("record").cast("double")), F.avg("null_record")), 6).alias("corrected"),
    ).withColumn("by", F.lit(group))
    primary = rows.where("in_primary")
    out = part(rows, "all", F.lit("all").alias("value")).unionByName(part(primary, "primary", F.lit("all").alias("value")))
    return out.unionByName(part(rows, "bucket", F.col("bucket").alias("value"))).unionByName(part(primary, "type", F.col("question_type").alias("value")))


def summary(rows: DataFrame, *group: str) -> DataFrame:
    """Survival with its Wilson interval, the measured floor and the corrected value, by group."""
    per = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("record").alias("record"), F.avg("null_record").alias("floor"))
    lo, hi = metrics.wilson(F.col("record"), F.col("n"))
    corrected = metrics.chance_corrected(F.col("record") / F.col("n"), F.col("floor"))
    return per.select(*group, "n", "record", *[F.round(c, 6).alias(a) for c, a in ((lo, "lo"), (hi, "hi"), (F.col("floor"), "floor"), (corrected, "corrected"))])


def store_table(scored: DataFrame) -> DataFrame:
    """Stores by their mean tokens, the largest first: scored(store, ...) holds the rows of ``score`` of several stores."""
    primary = F.col("in_primary")
    mean = lambda c, of=F.lit(True): F.avg(F.when(of, F.col(c).cast("double")))
    rows = scored.groupBy("store").agg(
        mean("store_tokens").alias("tokens"), mean("n_records").alias("records"), F.count_if(primary).alias("n"), mean("record", primary).alias("survival"), mean("null_record", primary).alias("floor"),
    )
    place = F.row_number().over(Window.orderBy(F.col("tokens").desc(), "store"))
    return rows.select(place.alias("place"), "store", "n", *[F.round(c, 6).alias(c) for c in ("tokens", "records", "survival", "floor")], F.round(metrics.chance_corrected(F.col("survival"), F.col("floor")), 6).alias("corrected"))
