"""Audits: constructed grader cases with known verdicts, clamped arms, verdict changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators.hooks import Backend
from memspark.operators.replies import ReplyStore


# Spellings and replies that the constructed cases use.
SPELLED = {
    "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten",
    "11": "eleven", "12": "twelve", "15": "fifteen", "20": "twenty", "30": "thirty", "40": "forty", "50": "fifty", "100": "hundred",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNITS = {"$": "dollars", "%": "percent"}
REFUSALS = (
    "I don't know -- that wasn't mentioned in the conversation.",
    "I cannot find that information in the excerpts provided.",
    "The conversation does not contain any mention of that.",
    "I don't have enough information to determine that.",
    "I'm sorry, but the excerpts provided do not contain information about that.",
)
# End of fixed values.
FIRST_NUMBER = r"(?s)^([^0-9]*)([0-9]+)(.*)$"
TRIES = 6
#: Cases that a judge is asked; false-accept rate from which a grader is too lenient.
JUDGED, LENIENT = 400, 0.05


def pluralised(gold: Column) -> Column:
    """The gold with its last word in the plural, or null if that word is no count noun."""
    words = T.words(F.regexp_replace(gold, r"[.!? ]+\z", ""))
    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    noun = last.rlike(r"^[A-Za-z]{4,}\z") & ~F.lower(last).endswith("s") & ~F.lower(last).isin(*SPELLED.values()) & ((F.lower(last) == last) | F.lower(last).isin(*WEEKDAYS))
    ending = F.when(F.lower(last).rlike("(x|z|ch|sh)$"), "es").otherwise("s")
    return F.when(noun, F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.concat(last, ending))), " "))


def rotated(items: Column) -> Column:
    """An enumeration with its first item last, as prose; null for fewer than three."""
    n = F.size(items)
    middle = F.when(n >= 3, F.array_join(F.slice(items, F.lit(2), F.greatest(n - 2, F.lit(0))), ", "))
    return F.concat(middle, F.lit(", "), F.try_element_at(items, F.lit(-1)), F.lit(", and "), F.try_element_at(items, F.lit(1)))


def cases(questions: DataFrame, abstentions: DataFrame, pool: int = 360) -> DataFrame:
    """(question_id, kind, question, gold, pred, expected): answers whose verdict is known by construction.

    questions(question_id, question_type, question, gold) and abstentions of the same
    columns; the first ``pool`` gradable questions by id are used.  A wrong answer made
    from another gold or another number counts only if the grader, which is not told the
    question for this, does not accept it.
    """
    g = T.normal_tokens(F.col("gold"))
    answerable = questions.where(T.is_extractive(g) & ~T.gold_abstains(F.col("gold")))
    q = answerable.orderBy("question_id").limit(pool)
    gold, ordered = F.col("gold"), F.coalesce(F.col("question").rlike(T.exact(T.ORDER_QUESTION)), F.lit(False))
    number = F.regexp_extract("gold", FIRST_NUMBER, 2)
    put = lambda x: F.when((number != "") & (F.length(number) <= 9), F.concat(F.regexp_extract("gold", FIRST_NUMBER, 1), x, F.regexp_extract("gold", FIRST_NUMBER, 3)))
    value = F.when((number != "") & (F.length(number) <= 9), number).cast("long")
    spelled = F.try_element_at(F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv]), number)
    month = F.coalesce(*[F.when(F.contains(T.small_letters(gold), F.lit(m.lower())), F.regexp_replace(gold, f"(?i){m}", m[:3])) for m in MONTHS])
    unit = F.coalesce(*[F.when(F.contains(gold, F.lit(c)), F.concat(T.trimmed(F.replace(gold, F.lit(c), F.lit(""))), F.lit(f" {word}"))) for c, word in UNITS.items()])
    swap = rotated(T.set_items(gold))
    pick = F.element_at(F.array(*[F.lit(r) for r in REFUSALS]), (F.conv(F.substring(F.md5(F.col("question_id").cast("binary")), 1, 4), 16, 10).cast("int") % len(REFUSALS) + 1))
    near = Window.partitionBy("question_type").orderBy(F.md5(F.col("question_id").cast("binary")))
    wrong = lambda pred: ~F.coalesce(T.grade(pred, F.col("gold"), F.lit(False)), F.lit(False))
    one = lambda kind, pred, expected: F.struct(F.lit(kind).alias("kind"), pred.alias("pred"), F.lit(expected).alias("expected"))
    made = [
        one("identity", gold, True), one("padded", F.concat(F.lit("I believe the answer is "), gold, F.lit(", based on our chat.")), True), one("sentence", F.concat(F.lit("The answer is "), gold, F.lit(".")), True),
        one("hard_number_word", put(spelled), True), one("hard_month_abbrev", month, True), one("hard_unit_expanded", unit, True), one("hard_case_punct", F.concat(T.capitals(gold), F.lit("!!")), True),
        one("hard_plural", pluralised(gold), True), one("hard_list_reorder", F.when(~ordered, swap), True), one("reordered_ordered_list", F.when(ordered, swap), False),
        one("perturbed_number", put((value + F.when(F.length(number) <= 3, 7).otherwise(111)).cast("string")), False), one("refusal_to_answerable", pick, False), one("empty", F.lit(""), False),
    ]
    out = q.select("question_id", "question", "gold", F.inline(F.array(*made))).where("pred IS NOT NULL").where((F.col("kind") != "perturbed_number") | wrong(F.col("pred")))
    # of the next golds of the type, the first that is another answer and not accepted either
    ahead = q.withColumn("ahead", F.array(*[F.lead("gold", i).over(near) for i in range(1, TRIES + 1)]))
    tried = ahead.select("question_id", "question", "gold", F.posexplode("ahead").alias("at", "pred")).where("pred IS NOT NULL")
    differs = T.normal_tokens(F.col("pred")) != T.normal_tokens(F.col("gold"))
    swapped = tried.where(differs & wrong(F.col("pred"))).groupBy("question_id", "question", "gold").agg(F.min_by("pred", "at").alias("pred"))
    refused = abstentions.select("question_id", "question", "gold", F.explode(F.array(*[F.lit(r) for r in REFUSALS])).alias("pred"))
    confident = answerable.agg(F.min_by("gold", F.md5(F.col("question_id").cast("binary"))).alias("pred")).where("pred IS NOT NULL")
    named = lambda df, kind, expected: df.select("question_id", F.lit(kind).alias("kind"), "question", "gold", "pred", F.lit(expected).alias("expected"))
    parts = [named(swapped, "swapped_gold", False), named(refused, "correct_abstention", True), named(abstentions.crossJoin(F.broadcast(confident)), "hallucinated_on_abstention", False)]
    out = out.select("question_id", "kind", "question", "gold", "pred", "expected")
    for p in parts:
        out = out.unionByName(p)
    return out


def report(audit_cases: DataFrame) -> DataFrame:
    """Counts per kind of graded cases: right, wrongly accepted, wrongly rejected."""
    verdict = T.grade(F.col("pred"), F.col("gold"), F.col("kind").endswith("abstention"), F.col("question"))
    rows = audit_cases.withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
    v, e = F.col("verdict"), F.col("expected")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(v == e).alias("right"), F.count_if(v & ~e).alias("false_accepts"), F.count_if(~v & e).alias("false_rejects"))


def rates(audit_cases: DataFrame, verdict: Column | None = None) -> DataFrame:
    """One row: cases, graded ones, accuracy, false-accept and false-reject rates, the latter
    also of the rewrites (``hard_`` kinds) alone; a rate without cases is null.  The verdict is
    the grader's, or the one given."""
    told = T.grade(F.col("pred"), F.col("gold"), F.col("kind").endswith("abstention"), F.col("question")) if verdict is None else verdict
    rows = audit_cases.withColumn("v", told)
    v, e, hard = F.col("v"), F.col("expected"), F.col("kind").startswith("hard_")
    share = lambda hit, of: F.round(F.avg(F.when(v.isNotNull() & of, hit.cast("int"))), 6)
    return rows.agg(
        F.count("*").alias("n_cases"), F.count("v").alias("n_graded"), share(v == e, F.lit(True)).alias("accuracy"), share(v, ~e).alias("false_accept_rate"),
        share(~v, e).alias("false_reject_rate"), share(~v, e & hard).alias("false_reject_rate_hard"),
    )


def judged_rates(audit_cases: DataFrame, store: ReplyStore, name: str, make: Callable[[], Backend], template: str, abstain_template: str, limit: int = JUDGED) -> DataFrame:
    """``rates`` of the grader over all cases, and of a judge over the first ``limit`` by question,
    kind and answer, by ``grader``; ``too_lenient`` warns of a grader that accepts too many wrong answers."""
    first = audit_cases.orderBy("question_id", "kind", "pred").limit(limit).withColumn("is_abstention", F.col("kind").endswith("abstention"))
    verdicts = store.judged(first, name, make, template, abstain_template)
    both = rates(audit_cases).withColumn("grader", F.lit("deterministic")).unionByName(rates(verdicts, F.col("verdict")).withColumn("grader", F.lit(f"judge:{name}")))
    return both.withColumn("too_lenient", F.coalesce((F.col("grader") == "deterministic") & (F.col("false_accept_rate") > LENIENT), F.lit(False)))


def clamped_arms(predictions: DataFrame) -> DataFrame:
    """Arms whose prompts all have one non-zero length over more than five records."""
    per = predictions.groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct("prompt_tokens").alias("lengths"), F.max("prompt_tokens").alias("length"))
    return per.where("n > 5 AND lengths = 1 AND length <> 0").select("arm", "n", "length")


def changed_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two gradings whose verdicts differ, a null differing from either value."""
    pairs = before.select("question_id", F.col("correct").alias("before")).join(after.select("question_id", F.col("correct").alias("after")), "question_id")
    return pairs.where(~F.col("before").eqNullSafe(F.col("after")))


def truncated_prompts(predictions: DataFrame, num_ctx: int, max_new: int) -> DataFrame:
    """Prompts per arm that do not fit, or of which the model has seen less than nine tenths."""
    cut = (F.col("sent") > num_ctx - max_new) | (F.col("prompt_tokens") < 0.9 * F.col("sent"))
    return predictions.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(cut).alias("n_truncated"), F.max("sent").alias("longest"))
