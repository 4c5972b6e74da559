"""Retrieval metrics, resampling-free statistics, paired arms, costs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that a bootstrap sends to every task.
BROADCAST_ROWS = 1_000_000
KS = (1, 3, 5, 10, 20)
# The constants of md5 (RFC 1321).
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURNED = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_WORD = (lambda i: i, lambda i: 5 * i + 1, lambda i: 3 * i + 5, lambda i: 7 * i)
# End of fixed values.
#: Draws that are hashed together: few enough for a core's cache; their numbers as this worker has written them.
DRAWN_AT_ONCE = 65_536
numbers_of: dict[tuple[int, int], list[tuple[int, int, list[tuple[int, np.ndarray]]]]] = {}


def per_query(hits: DataFrame, evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_evidence, ranks): evidence(query_id, unit_id) found, by rank."""
    found = hits.join(evidence, ["query_id", "unit_id"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    wanted = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    return queries.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks")
    )


def aggregate(results: DataFrame, *group: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Macro averages over queries with evidence; queries without are counted apart."""
    scorable = F.col("n_evidence") > 0
    inside = lambda k: F.size(F.filter("ranks", lambda r: r < k))
    mean = lambda c: F.round(F.avg(F.when(scorable, c)), 6)
    rr = F.when(F.size("ranks") > 0, 1.0 / (F.get("ranks", F.lit(0)) + 1)).otherwise(0.0)
    return results.groupBy(*group).agg(
        F.count("*").alias("n_total"), F.count_if(scorable).alias("n_scorable"), F.count_if(~scorable).alias("n_zero_evidence"), mean(rr).alias("mrr"),
        *[mean(inside(k) / F.when(scorable, F.col("n_evidence"))).alias(f"recall_{k}") for k in ks],
        *[mean((inside(k) > 0).cast("double")).alias(f"any_hit_{k}") for k in ks],
    )


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, (0, 0) for n = 0."""
    p, nn = successes / F.when(n > 0, n), F.when(n > 0, n).cast("double")
    mid, spread = (p + z * z / (2 * nn)) / (1 + z * z / nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)) / (1 + z * z / nn)
    bound = lambda c: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)
    return bound(mid - spread), bound(mid + spread)


def chance_corrected(score: Column, null: Column) -> Column:
    return F.when(null < 1, (score - null) / F.when(null < 1, 1 - null))


def contingency(pairs: DataFrame, *group: str) -> DataFrame:
    """Counts of pairs(system boolean, control boolean), as n, both, system_only, control_only, neither."""
    s, c = F.col("system"), F.col("control")
    return pairs.where(s.isNotNull() & c.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(s & c).alias("both"), F.count_if(s & ~c).alias("system_only"), F.count_if(~s & c).alias("control_only"), F.count_if(~s & ~c).alias("neither")
    )


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of b against c discordant pairs, summed in log space."""
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    # log C(n, i) grows by log((n - i + 1) / i) from term to term
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1) / i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1) / i))).alias("sum"))
    total = F.aggregate(F.when(low > 0, F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def kappa(pairs: DataFrame) -> DataFrame:
    """Agreement, Cohen's kappa and false-accept rate of pairs(human boolean, judge boolean)."""
    h, j = F.col("human").cast("int"), F.col("judge").cast("int")
    rows = pairs.where(h.isNotNull() & j.isNotNull()).agg(
        F.count("*").alias("n"), F.avg((h == j).cast("double")).alias("agreement"), F.avg(h).alias("ph"), F.avg(j).alias("pj"),
        F.avg(F.when(h == 0, j)).alias("false_accept"),
    )
    expected = F.col("ph") * F.col("pj") + (1 - F.col("ph")) * (1 - F.col("pj"))
    value = F.when(expected >= 1, 1.0).otherwise((F.col("agreement") - expected) / (1 - F.when(expected < 1, expected)))
    return rows.select("n", F.round("agreement", 6).alias("agreement"), F.round(value, 6).alias("kappa"), F.round("false_accept", 6).alias("false_accept"))


def portable_index(key: Column, n: Column) -> Column:
    """An index below n from a text key: the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def positions(df: DataFrame, *keys: str, bins: int = 1024) -> DataFrame:
    """``df`` with ``pos`` from 0: rows in an order by a hash of the keys; only counts per
    bin of the hash are summed in one place."""
    h = F.md5(F.concat_ws("|", *keys).cast("binary"))
    rows = df.withColumns({"h": h, "bin": F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % bins})
    sizes = rows.groupBy("bin").agg(F.count("*").alias("size"))
    starts = sizes.select("bin", (F.sum("size").over(Window.orderBy("bin")) - F.col("size")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bin").orderBy("h", *keys)) - 1
    return rows.join(F.broadcast(starts), "bin").withColumn("pos", (F.col("start") + inside).cast("long")).drop("h", "bin", "start")


def resampled(rows: DataFrame, replicates: int, seed: int, values: list[str]) -> DataFrame:
    """Means of the values in each replicate b: n draws by hash from rows(pos from 0, values).

    While the rows number at most BROADCAST_ROWS, all their values are one array that
    goes to every task and the replicates are made where they are summed: nothing but
    the means is shuffled.  Beyond that, how often each distinct value comes in a
    replicate is one multinomial draw, whose generator the replicate's number seeds; values
    are counted first, so neither draws nor rows move.  Only where the distinct values
    are too many as well, draws and rows are joined.
    """
    spark = rows.sparkSession
    n = rows.count()
    tasks = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    if not n:
        return rows.select(F.lit(0).alias("b"), *values).where(F.lit(False))
    starts = spark.range(0, replicates, 1, tasks).select(F.col("id").cast("int").alias("b"))
    if n > BROADCAST_ROWS and (counts := rows.groupBy(*values).agg(F.count("*").alias("times")).orderBy(*values).limit(BROADCAST_ROWS + 1).toArrow()).num_rows <= BROADCAST_ROWS:
        columns = [counts[v].to_numpy().astype(np.float64) for v in values]
        sent = spark.sparkContext.broadcast((columns, counts["times"].to_numpy()))
        return starts.mapInArrow(lambda it: drawn_counts(it, *sent.value, seed, values), ", ".join(["b int", *[f"{v} double" for v in values]]))
    if n > BROADCAST_ROWS:
        places = starts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("at"))
        draws = places.select("b", portable_index(F.concat_ws("|", F.lit(seed), "b", "at"), F.lit(n)).alias("pos"))
        return draws.join(rows, "pos").groupBy("b").agg(*[F.avg(v).alias(v) for v in values])
    found = rows.orderBy("pos").select(*[F.col(v).cast("double") for v in values]).toArrow()  # at most BROADCAST_ROWS numbers a column
    shared = spark.sparkContext.broadcast([found[v].to_numpy() for v in values])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = shared.value
        for batch in batches:
            sums = []
            for b in batch.column("b").to_pylist():
                at = drawn_places(f"{seed}|{b}|", n)
                sums.append([float(np.mean(c[at])) for c in columns])
            cols = [pa.array(c, pa.float64(), from_pandas=True) for c in (zip(*sums, strict=True) if sums else [[] for _ in columns])]
            yield pa.RecordBatch.from_arrays([batch.column("b"), *cols], names=["b", *values])

    return starts.mapInArrow(means, ", ".join(["b int", *[f"{v} double" for v in values]]))


def numbered(lead: int, first: int, last: int) -> list[tuple[int, np.ndarray]]:
    """The little-endian words of a message, by their places, that hold the digits of first..last (of
    equal length), written after ``lead`` bytes."""
    i, digits = np.arange(first, last, dtype=np.int64), len(str(first))
    raw = np.zeros((-(-(lead + digits) // 4) - lead // 4, len(i)), np.uint32)
    for k in range(digits):
        at = lead + k
        raw[at // 4 - lead // 4] |= (i // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
    return [(lead // 4 + k, w) for k, w in enumerate(raw)]


def md5_heads(prefix: bytes, first: int, last: int, words: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The first 32 bits of the md5 of prefix + i for i in first..last, whose ``numbered`` words are
    given; all i together, as a call of hashlib for each takes several times as long."""
    lead, digits = len(prefix), len(str(first))
    block = bytearray(prefix + bytes(56 - lead) + (8 * (lead + digits)).to_bytes(8, "little"))
    block[lead + digits] = 0x80
    fixed, moving = np.frombuffer(bytes(block), "<u4"), dict(words)
    a, b, c, d = (np.full(last - first, x, np.uint32) for x in MD5_START)
    f, t = np.empty_like(a), np.empty_like(a)
    for step in range(64):
        turn, k = step // 16, MD5_WORD[step // 16](step % 16) % 16
        if turn < 2:  # a choice by bits: of c and d by b, of b and c by d
            by, yes, no = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(yes, no, out=f)
            np.bitwise_and(f, by, out=f)
            np.bitwise_xor(f, no, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32((MD5_ADDED[step] + int(fixed[k])) & 0xFFFFFFFF), out=f)
        if k in moving:
            np.add(f, moving[k], out=f)
        left = MD5_TURNED[turn][step % 4]
        np.left_shift(f, np.uint32(left), out=t)
        np.right_shift(f, np.uint32(32 - left), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(MD5_START[0])).byteswap()


def drawn_places(prefix: str, n: int) -> np.ndarray:
    """``portable_index`` of prefix + i below n, for i from 0 to n - 1."""
    lead, out = prefix.encode(), np.empty(n, np.int64)
    key = (len(lead), n)
    if key not in numbers_of:  # a task has replicates of one or two lengths
        ends = sorted({0, n, *(10**k for k in range(1, 19) if 10**k < n), *range(0, n, DRAWN_AT_ONCE)})
        numbers_of.clear()
        numbers_of[key] = [(x, y, numbered(len(lead), x, y)) for x, y in zip(ends, ends[1:], strict=False)]
    for x, y, words in numbers_of[key]:
        out[x:y] = md5_heads(lead, x, y, words)
    return out % n


def drawn_counts(batches: Iterator[pa.RecordBatch], columns: list[np.ndarray], times: np.ndarray, seed: int, values: list[str]) -> Iterator[pa.RecordBatch]:
    """Means of replicates, by counts of the distinct values."""
    n = int(times.sum())
    for batch in batches:
        out = []
        for b in batch.column("b").to_pylist():
            drawn = np.random.default_rng([seed, b]).multinomial(n, times / n)
            out.append([float(drawn @ c) / n for c in columns])
        cols = [pa.array(c, pa.float64()) for c in (zip(*out, strict=True) if out else [[] for _ in columns])]
        yield pa.RecordBatch.from_arrays([batch.column("b"), *cols], names=["b", *values])


def interval(stats: DataFrame, alpha: float, interpolate: bool = False) -> DataFrame:
    """(lo, hi) of stats(b, m): order statistics of the m that are not null, or interpolated quantiles."""
    if interpolate:
        return stats.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    known = stats.where("m IS NOT NULL")
    ranked = known.withColumns({"r": F.row_number().over(Window.orderBy("m", "b")) - 1, "k": F.count("*").over(Window.partitionBy())})
    at = lambda i: F.max(F.when(F.col("r") == i, F.col("m")))
    lo, hi = F.floor(F.lit(alpha / 2) * F.col("k")), F.least(F.col("k") - 1, F.floor(F.lit(1 - alpha / 2) * F.col("k")))
    return ranked.agg(at(lo).alias("lo"), at(hi).alias("hi"))


def bootstrap_mean(diffs: DataFrame, replicates: int = 10_000, alpha: float = 0.05, seed: int = 0, interpolate: bool = False) -> DataFrame:
    """(n, point, lo, hi) of the mean of diffs(pos from 0, value): bounds from the
    means of ``replicates`` resamples; draws are hashes, so the same in every engine."""
    n = diffs.agg(F.count("*").alias("n"), F.avg("value").alias("point"))
    means = resampled(diffs, replicates, seed, ["value"]).withColumnRenamed("value", "m")
    return n.crossJoin(interval(means, alpha, interpolate)).select("n", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


def bootstrap_corrected(outcomes: DataFrame, replicates: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(n, point, lo, hi) of the chance-corrected mean of outcomes(pos, score, floor): the
    floor is resampled with the scores; replicates without a corrected value are dropped."""
    n = outcomes.agg(F.count("*").alias("n"), chance_corrected(F.avg("score"), F.avg("floor")).alias("point"))
    stats = resampled(outcomes, replicates, seed, ["score", "floor"]).select("b", chance_corrected(F.col("score"), F.col("floor")).alias("m"))
    return n.crossJoin(interval(stats, alpha)).select("n", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")])


def order_statistics(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Count, mean, upper median, upper 90th percentile (index floor(0.9 n)) and maximum.

    Only the histogram of the values is sorted: a row per distinct value and group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    upto = counts.withColumns({"upto": F.sum("c").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "of": F.sum("c").over(by)})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("of")), F.col(value)))
    mean = F.sum(F.col(value) * F.col("c")) / F.sum("c")
    return upto.groupBy(*group).agg(F.sum("c").alias("n"), F.round(mean, 6).alias("mean"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max(value).alias("max"))
