"""Cases of the third round's findings."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.llm import phrases
from memspark.operators import audit, bm25_index, hooks, metrics, policies, replies, retrieve
from memspark.plans.oracle import SQL
from memspark.plans.report_sql import REPORT_SQL
from memspark.plans.reports import QUERIES
from memspark.sources import stage

QUESTION = "question_id string, question_type string, question string, gold string, is_abstention boolean"


def sharp(spark):
    return spark.createDataFrame([("a", "t", "wo", "Beß teßsch", False), ("b", "t", "what", "blue bicycle", False)], QUESTION)


def test_capitals_go_letter_by_letter(spark):
    words = ["teßsch", "ﬁne ŉ", "ᾳ ǰ", "éà ö", "", "𐐨x"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    got = [r.u for r in df.orderBy("i").select(T.capitals(F.col("t")).alias("u")).collect()]
    assert got == ["TEẞSCH", "ﬁNE ŉ", "ᾼ ǰ", "ÉÀ Ö", "", "𐐀X"]
    cases = {r.question_id: r.pred for r in audit.cases(sharp(spark), sharp(spark).limit(0)).where("kind = 'hard_case_punct'").collect()}
    assert cases == {"a": "BEẞ TEẞSCH!!", "b": "BLUE BICYCLE!!"}


def test_a_sharp_s_in_capitals_is_accepted(spark):
    row = audit.report(audit.cases(sharp(spark), sharp(spark).limit(0))).where("kind = 'hard_case_punct'").first()
    assert (row.n, row.right, row.false_rejects) == (2, 2, 0)


def test_rates_of_grader_and_judge_with_a_sharp_s(spark, tmp_path):
    cases = audit.cases(sharp(spark), sharp(spark).limit(0)).where("kind LIKE 'hard_case%'")
    store, mark = replies.ReplyStore(spark, f"file://{tmp_path}/replies"), hooks.ContainmentJudge.MARK
    rows = {r.grader: r for r in audit.judged_rates(cases, store, "c", hooks.ContainmentJudge, "{gold}" + mark + "{pred}", mark + "{pred}").collect()}
    assert rows["deterministic"].false_reject_rate_hard == 0 and rows["deterministic"].n_cases == 2


#: Words four to six of a turn are the gold: sigmas at the end of a word, a dotted I, bounds and white space that engines take differently.
ODD = [
    "Wo the blue sea beς wood oak", "Ba the red le\u03c3 wood sea oak", "İn the old TİNY wood oak sea", "Ora éorder ba oak, elm, ash", "Ina wo ba oak, elm, éorder", "Un\u000ba ba wo ba\u000bbo green oak",
    "Ba bo bi oak, andó, elm", "Ba bo bi \u00a0oak, elm\u2003, ash", "Ba bo bi ñdo not\u000bknow", "Ba bo bi dr.st. elm 7th", "Ba bo bi éno such oaké", "Ba bo bi ñco. elm ash",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    ks = [k for k in range(40) if k % 10 != 9 and k % 4 != 1][: 2 * len(ODD)] + [9]
    rows = [(10 * k, 0, "user", ODD[i % len(ODD)] + " and more words that make the turn long enough to be evidence") for i, k in enumerate(ks)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows, strict=True)), strict=True))), d / "conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["audit_cases", "grader_audit", "judge_audit"])
def test_audits_of_odd_texts_equal_their_sql(spark, odd, name):
    df = QUERIES[name](spark, odd)
    cols = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{odd}/conversations.parquet'")
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({(SQL | REPORT_SQL)[name]}) x").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_shards_of_phrases_scan_coded_texts(spark, monkeypatch):
    """However many shards: the texts are listed and coded once, and each phrase is counted in one shard."""
    rng = random.Random(3)
    words = ["oak", "elm", "ash", "fir.", "yew", "ivy"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60))), rng.choice(["en", "de", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    calls = {"listing": 0, "coded": 0}
    shards = []

    def counting(name):
        f = getattr(phrases, name)

        def g(*a):
            calls[name] += 1
            return f(*a)

        return g

    for name in calls:
        monkeypatch.setattr(phrases, name, counting(name))
    scanned = phrases.scanned
    monkeypatch.setattr(phrases, "scanned", lambda *a: shards.append(a[2]) or scanned(*a))
    whole = sorted(map(tuple, phrases.mine(df, min_count=3, shard_size=10**6).collect()))
    assert len(shards) == 1 and len(whole) > 50
    shards.clear()
    assert sorted(map(tuple, phrases.mine(df, min_count=3, shard_size=20).collect())) == whole
    assert len(shards) > 5 and all(a[1] < b[0] for a, b in zip(shards, shards[1:], strict=False)) and calls == {"listing": 2, "coded": 2}


def test_bm25_cuts_rows_before_the_shuffle(spark):
    """Tasks send their best k; what negative weights would bring back is still ranked right."""
    found = spark.createDataFrame([("q", i, float(i)) for i in range(9)], "query_id string, unit_id long, score double")
    plan = retrieve.top(found, 3, F.col("score").desc(), "unit_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    queries, units = spark.createDataFrame([("q",), ("r",)], "query_id string"), spark.range(9).withColumnRenamed("id", "unit_id")
    low = found.withColumn("score", -F.col("score") - 1)
    ranks = lambda f, least: sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in retrieve.filled(f, queries, units, 2, least).collect())
    assert ranks(found, 0.5) == [("q", 0, 8, 8.0), ("q", 1, 7, 7.0), ("r", 0, 0, 0.0), ("r", 1, 1, 0.0)]
    assert ranks(low, -1.0)[:2] == [("q", 0, 0, -1.0), ("q", 1, 1, -2.0)]


def test_postings_of_repeated_ids_and_terms_without_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Oak oak elm"), (2, None), (1, "oak"), (3, "?!")], "unit_id long, text string")
    assert sorted((r.unit_id, r.term, r.tf) for r in retrieve.postings(docs).collect()) == [(1, "elm", 1), (1, "oak", 3), (2, "<empty>", 1), (3, "<empty>", 1)]
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    table = spark.read.parquet(path)
    terms = {r.term: r.df for r in bm25_index.term_table(table, table).collect()}
    assert terms == {"oak": 1, "elm": 1, "<empty>": 2} and not stage.exists(spark, f"{stage.shared_dir(spark)}/bm25-{stage.content_of(table)}")
    bm25_index.stored(table, table)
    assert {r.term: r.df for r in bm25_index.term_table(table, table).collect()} == terms


def test_draws_are_hashed_together():
    """draws of a replicate equal the md5 of each place, at every length of a number and over the bounds of what is hashed together."""
    for prefix, n in (("0|0|", 1), ("0|7|", 9), ("0|42|", 10), ("0|123|", 11), ("12|9999|", 1001), ("0|1234|", metrics.DRAWN_AT_ONCE + 3)):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert metrics.drawn_places(prefix, n).tolist() == want


def test_sentences_are_dealt_by_unit(spark):
    """from a unit's terms to its cosines no row moves, and no sentence moves for being counted."""
    units = spark.createDataFrame([("q", 0, "Blue bikes ran. A bike ran blue blue. None here."), ("q", 1, "Blue bikes ran. Red bikes ran far. Blue."), ("r", 0, "Alone.")], "question_id string, unit_id long, text string")
    terms = policies.sentence_terms(units)
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    found = policies.cosines(terms)
    assert moved(found) == moved(terms)
    w = {}
    for r in terms.collect():
        w.setdefault((r.question_id, r.unit_id, r.pos), {})[r.term] = r.w / r.norm
    want = {}
    for (q, u, i), a in w.items():
        for (q2, u2, j), b in w.items():
            if (q, u) == (q2, u2) and i < j and a.keys() & b.keys():
                want[q, u, i, j] = sum(a[t] * b[t] for t in a.keys() & b.keys())
    got = {(r.question_id, r.unit_id, r.i, r.j): r.cosine for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert sorted((r.unit_id, r.pos, r.n) for r in policies.sentence_rows(units).where("question_id = 'q'").collect()) == [(u, p, 3) for u in (0, 1) for p in range(3)]
