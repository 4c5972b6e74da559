"""Write policies: stores under a token budget, built per question."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators.units import renumber

SPEC = re.compile(r"(verbatim)_(turn|user_turn|session)|(truncated_recency|leadk|tailk|lexrank)_(\d+)|(truncated_random)_(\d+)(?:_s(\d+))?")
#: Fixed values of the centrality ranking.
DAMPING, MAX_STEPS, TOLERANCE = 0.85, 40, 1e-8
#: Weights are rounded before they rank.
WEIGHT_DIGITS = 10


@dataclass(frozen=True)
class Policy:
    kind: str
    percent: int = 100
    seed: int = 0
    granularity: str = "turn"

    @property
    def fraction(self) -> float:
        return self.percent / 100

    @property
    def name(self) -> str:
        """The name that results carry: kind, percentage, and the seed of a random one."""
        parts = {"verbatim": [self.granularity], "truncated_random": [f"{self.percent}pct", f"s{self.seed}"]}
        return "_".join([self.kind, *parts.get(self.kind, [f"{self.percent}pct"])])

    def config(self) -> dict[str, object]:
        """What a result must tell of its policy."""
        if self.kind == "verbatim":
            return {"policy": "verbatim", "granularity": self.granularity}
        rule = {"rule": self.kind.removeprefix("truncated_"), "seed": self.seed} if self.kind.startswith("truncated") else {}
        return {"policy": "truncated_verbatim" if rule else self.kind, "fraction": self.fraction, "granularity": self.granularity} | rule


def parse(spec: str) -> Policy:
    m = SPEC.fullmatch(spec)
    if not m:
        raise ValueError(f"not a policy: {spec!r}")
    if m[1]:
        return Policy("verbatim", granularity=m[2])
    percent = int(m[4] or m[6])
    if not 0 < percent <= 100:
        raise ValueError(f"{spec!r}: the percentage must be from 1 to 100")
    return Policy(m[3] or m[5], percent, int(m[7] or 0))


def fill(rows: DataFrame, fraction: float, *order: Column | str) -> DataFrame:
    """Rows (question_id, item, tokens) taken greedily in order while they fit; one that
    does not fit is passed over and the scan goes on.  The budget is ``fraction`` of
    ``total``, the question's tokens.  All items before the first that does not fit are
    taken by their running sum; only those after it that fit what is left are folded."""
    by = Window.partitionBy("question_id").orderBy(*order)
    upto = F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumns({"ord": F.row_number().over(by), "upto": upto, "budget": F.col("total") * F.lit(float(fraction))})
    sure = F.col("upto") <= F.col("budget")
    packed = ranked.groupBy("question_id").agg(
        F.first("budget").alias("limit"), F.coalesce(F.max(F.when(sure, F.col("upto"))), F.lit(0)).cast("long").alias("used"),
        F.array_sort(F.collect_list(F.when(~sure & (F.col("tokens") <= F.col("budget")), F.struct("ord", "tokens")))).alias("items"),
    )
    left = F.filter("items", lambda x: F.col("used") + x["tokens"] <= F.col("limit"))
    start = F.struct(F.col("used").alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda acc, x: acc["used"] + x["tokens"] <= F.col("limit")
    step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x["ord"])).alias("kept"))).otherwise(acc)
    more = packed.select("question_id", F.aggregate(left, start, step)["kept"].alias("more"))
    return ranked.join(more, "question_id").where(sure | F.array_contains("more", F.col("ord"))).drop("ord", "upto", "budget", "more")


def costed(units: DataFrame) -> DataFrame:
    rows = units.withColumn("tokens", T.count_tokens(F.col("text")).cast("long"))
    return rows.withColumn("total", F.sum("tokens").over(Window.partitionBy("question_id")))


def truncated(units: DataFrame, fraction: float, rule: str = "recency", seed: int = 0) -> DataFrame:
    """Whole units, newest first or in a seeded order; kept ones are renumbered in unit order."""
    if rule == "recency":
        order = [T.parse_date(F.col("session_date")).desc_nulls_last(), F.col("session_index").desc(), F.col("unit_id").desc()]
    elif rule == "random":
        order = [F.md5(F.concat_ws("|", F.lit(seed), "question_id", "unit_id").cast("binary"))]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return renumber(fill(costed(units), fraction, *order), "unit_id").drop("total", "tokens")


def sentence_rows(units: DataFrame) -> DataFrame:
    """(question_id, unit_id, pos, n, sentence, tokens, total): one row per sentence."""
    cut = costed(units).select("question_id", "unit_id", "total", T.sentences(F.col("text")).alias("sentences"))
    rows = cut.select("question_id", "unit_id", "total", F.size("sentences").cast("long").alias("n"), F.posexplode("sentences").alias("pos", "sentence"))
    return rows.withColumn("tokens", T.count_tokens(F.col("sentence")).cast("long"))


def by_sentences(units: DataFrame, kept: DataFrame) -> DataFrame:
    """Units of the kept sentences in their order; units that lost all are gone."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    parts = kept.groupBy("question_id", "unit_id").agg(text.alias("text"))
    out = units.drop("text", "is_evidence").join(parts, ["question_id", "unit_id"]).withColumn("is_evidence", F.lit(False))
    return renumber(out.withColumn("provenance", F.array("unit_id")), "unit_id")


def lead_k(units: DataFrame, fraction: float) -> DataFrame:
    """First sentences of all units, then second ones, and so on."""
    return by_sentences(units, fill(sentence_rows(units), fraction, "pos", "unit_id"))


def tail_k(units: DataFrame, fraction: float) -> DataFrame:
    """Last sentences of all units first."""
    return by_sentences(units, fill(sentence_rows(units), fraction, F.col("n") - F.col("pos"), "unit_id"))


def sentence_idf(units: DataFrame) -> DataFrame:
    """(question_id, term, df, idf) with idf = ln(n / (1 + df)) + 1 over a question's sentences."""
    rows = sentence_rows(units).select("question_id", "unit_id", "pos", F.array_distinct(T.bm25_tokens(F.col("sentence"))).alias("terms"))
    n = rows.groupBy("question_id").agg(F.count("*").alias("n"))
    df = rows.select("question_id", F.explode("terms").alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("df"))
    return df.join(n, "question_id").select("question_id", "term", "df", F.round(F.log(F.col("n") / (1 + F.col("df"))) + 1, 9).alias("idf"))


def sentence_terms(units: DataFrame) -> DataFrame:
    """(question_id, unit_id, pos, term, w, norm): tf-idf weights of a sentence's terms, and its length.

    Sentences, and later the weights, are dealt by unit, so that counts, lengths and cosines
    find theirs in the same task."""
    dealt = sentence_rows(units).select("question_id", "unit_id", "pos", "sentence").repartition("question_id", "unit_id")
    terms = dealt.select("question_id", "unit_id", "pos", F.explode(T.bm25_tokens(F.col("sentence"))).alias("term"))
    w = terms.groupBy("question_id", "unit_id", "pos", "term").agg(F.count("*").alias("tf")).join(sentence_idf(units), ["question_id", "term"])
    w = w.select("question_id", "unit_id", "pos", "term", (F.col("tf") * F.col("idf")).alias("w")).repartition("question_id", "unit_id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("question_id", "unit_id", "pos")))
    return w.select("question_id", "unit_id", "pos", "term", "w", norm.alias("norm"))


def cosines(terms: DataFrame) -> DataFrame:
    """(question_id, unit_id, i, j, cosine) of the sentences i < j of a unit that share a
    term: paired by term within the unit, never all pairs."""
    own = F.array_sort(F.collect_list(F.struct("pos", "w", "norm")))
    by_term = terms.where("norm > 0").groupBy("question_id", "unit_id", "term").agg(own.alias("own")).where("size(own) > 1")  # a unit's own
    first = by_term.select("question_id", "unit_id", "own", F.posexplode("own").alias("at", "a"))
    pairs = first.select("question_id", "unit_id", "a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    part = F.col("a.w") * F.col("b.w") / (F.col("a.norm") * F.col("b.norm"))
    each = pairs.select("question_id", "unit_id", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), part.alias("part"))
    return each.groupBy("question_id", "unit_id", "i", "j").agg(F.round(F.sum("part"), 6).alias("cosine"))


def sentence_cosines(units: DataFrame) -> DataFrame:
    return cosines(sentence_terms(units))


def centrality(nodes: DataFrame, cosines: DataFrame) -> DataFrame:
    """nodes(question_id, unit_id, pos, n) with p, their stationary weights on the graph of a
    unit's cosines, by damped power iteration.

    The graph is its edges alone, dealt by unit and read in unit order: a task holds the
    edges of one unit at a time.  A unit is done when a step changes its weights by less
    than TOLERANCE in all, or after MAX_STEPS; without an edge all weigh alike.  A sentence
    without an edge gives its weight to all sentences of its unit."""
    unit = ["question_id", "unit_id"]
    some = cosines.where("cosine > 0")
    both = some.select(*unit, "cosine", F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    edges = both.join(nodes.select(*unit, "n").distinct(), unit)
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in (*unit, "pos"))
    weights = edges.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(weigh, f"{kinds}, p double")
    return nodes.join(weights, [*unit, "pos"], "left").withColumn("p", F.coalesce("p", 1.0 / F.col("n")))


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(question_id, unit_id, pos, p) of the units whose edges (i, j, cosine) come one unit after the other."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        p = power(t["i"].to_numpy(), t["j"].to_numpy(), t["cosine"].to_numpy(), t["n"][0].as_py())
        cols = [pa.array([t[c][0].as_py()] * len(p), t.schema.field(c).type) for c in ("question_id", "unit_id")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(p)), t.schema.field("i").type), pa.array(p)], ["question_id", "unit_id", "pos", "p"])

    for batch in batches:
        units = list(zip(batch.column("question_id").to_pylist(), batch.column("unit_id").to_pylist(), strict=True))
        cuts = [0, *(k for k in range(1, len(units)) if units[k] != units[k - 1]), len(units)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if held and (held[0].column("question_id")[0].as_py(), held[0].column("unit_id")[0].as_py()) != units[a]:
                    yield done()
                    held.clear()
                held.append(batch.slice(a, b - a))
    if held:
        yield done()


def power(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
    """Stationary weights on a sparse graph of n nodes, edges in both directions."""
    mass = np.bincount(i, cosine, n)
    share, lone = cosine / mass[i], mass == 0
    p = np.full(n, 1.0 / n)
    for _ in range(MAX_STEPS):
        q = (1 - DAMPING) / n + DAMPING * (np.bincount(j, p[i] * share, n) + p[lone].sum() / n)
        apart = np.abs(q - p).sum()
        p = q
        if apart < TOLERANCE:
            break
    return p


def lexrank(units: DataFrame, fraction: float) -> DataFrame:
    """Most central sentence of every unit, then the second ones; ties in sentence order."""
    rows = sentence_rows(units)
    nodes = rows.select("question_id", "unit_id", "pos", "n")
    weights = centrality(nodes, cosines(sentence_terms(units)))
    place = F.row_number().over(Window.partitionBy("question_id", "unit_id").orderBy(F.round("p", WEIGHT_DIGITS).desc(), "pos"))
    depth = weights.select("question_id", "unit_id", "pos", place.alias("depth"))
    return by_sentences(units, fill(rows.join(depth, ["question_id", "unit_id", "pos"]), fraction, "depth", "unit_id").drop("depth"))


def build(units: DataFrame, spec: str) -> DataFrame:
    """The store of a policy; ``units`` are those of its granularity."""
    policy = parse(spec)
    if policy.kind == "verbatim":
        return units
    if policy.kind.startswith("truncated"):
        return truncated(units, policy.fraction, policy.kind.removeprefix("truncated_"), policy.seed)
    return {"leadk": lead_k, "tailk": tail_k, "lexrank": lexrank}[policy.kind](units, policy.fraction)
