"""DuckDB SQL that defines the results of the queries in ``reports``."""

from __future__ import annotations

from memspark.plans.oracle import ANSWER, AUDIT, CLOSED_BOOK, GOLD_ABSTAINS, METRIC_COLS, NEWEST, PRED, QBM25, QDENSE, QUESTIONS, SENTENCES, TURNS, UNITS, answers, by_sentence, count, fused, graded, normal, quoted, ranked, tokens
from memspark.sources.fixtures import ASKED_SQL

BASE = f"{UNITS}, {QUESTIONS}"
RR = "CASE WHEN len(ranks) > 0 THEN 1.0::DOUBLE / (ranks[1] + 1) ELSE 0 END"
COUNTS = "count(*) AS n_total, count(*) FILTER (WHERE n_evidence > 0) AS n_scorable, count(*) FILTER (WHERE n_evidence = 0) AS n_zero_evidence"
MRR = f"round(avg({RR}) FILTER (WHERE n_evidence > 0), 6) AS mrr"
NUMBER = "regexp_replace(query_id, '[a-z_]', '', 'g')::BIGINT"
NEAR = ranked(f"{NEWEST}, unit_id", "-rank::DOUBLE", 100)


def results(parts: dict[str, str], arms: list[str]) -> str:
    hits = " UNION ALL ".join(f"SELECT '{arm}' AS arm, query_id, unit_id, rank FROM ({sql}) h_{arm}" for arm, sql in parts.items())
    names = ", ".join(f"('{a}')" for a in arms)
    return f"""hits AS ({hits}), ev AS (SELECT question_id AS query_id, unit_id FROM units WHERE is_evidence),
        res AS (SELECT arm, q.question_id AS query_id, question_type, coalesce(n, 0) AS n_evidence, coalesce(ranks, []) AS ranks FROM questions q CROSS JOIN (VALUES {names}) a(arm)
                LEFT JOIN (SELECT query_id AS eq, count(*) AS n FROM ev GROUP BY 1) e ON eq = q.question_id
                LEFT JOIN (SELECT arm AS fa, query_id AS fq, list(rank ORDER BY rank) AS ranks FROM hits SEMI JOIN ev USING (query_id, unit_id) GROUP BY 1, 2) f ON fa = arm AND fq = q.question_id)"""


ARMS = results(
    {
        "bm25": "SELECT * FROM qhits WHERE rank < 20", "oracle": ranked("is_evidence DESC, unit_id", "0", 20),
        "random": ranked("md5('0|' || question_id || '|' || unit_id)", "0", 20), "recency": ranked(f"{NEWEST}, unit_id DESC", "0", 20),
    },
    ["bm25", "none", "oracle", "random", "recency"],
)
ASKING = f"SELECT x.* FROM ({NEAR}) x SEMI JOIN questions ON questions.question_id = x.query_id"
WEIGHTS = {"w0": 0.0, "w025": 0.25, "w05": 0.5, "w1": 1.0}
SWEEP = results({n: fused([("SELECT * FROM qhits", 1.0), ("SELECT * FROM dhits", 1.0)] + ([(ASKING, w)] if w else [])) for n, w in WEIGHTS.items()}, list(WEIGHTS))


def units_of(granularity: str) -> str:
    """units(question_id, unit_id, session_date, session_index, is_evidence) of a granularity, from turns."""
    cols = "session_date, session_index, has_answer AS is_evidence"
    if granularity == "turn":
        return f"SELECT question_id, turn_index AS unit_id, {cols} FROM turns"
    if granularity == "user_turn":
        return f"SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY turn_index) - 1 AS unit_id, {cols} FROM turns WHERE role = 'user'"
    return """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first) - 1 AS unit_id, session_date, session_index, is_evidence FROM
        (SELECT question_id, session_id, min(turn_index) AS first, arg_min(session_date, turn_index) AS session_date, arg_min(session_index, turn_index) AS session_index, bool_or(has_answer) AS is_evidence FROM turns GROUP BY ALL) s"""


def day(c: str) -> str:
    return f"date_diff('day', DATE '0001-01-01', try_strptime(regexp_extract({c}, '\\d{{4}}/\\d{{2}}/\\d{{2}}'), '%Y/%m/%d')::DATE) + 1"


def minute(c: str) -> str:
    stamp = r"\d{4}/\d{2}/\d{2}\D*(\d{2}):(\d{2})"
    part = lambda i: f"try_cast(nullif(regexp_extract({c}, '{stamp}', {i}), '') AS INT)"
    return f"({day(f'regexp_extract({c}, {quoted(stamp)})')}) * 1440 + {part(1)} * 60 + {part(2)}"


ASKED = f"{TURNS}, asked AS ({ASKED_SQL}), when_asked AS (SELECT question_id, {day('question_date')} AS q_day, {minute('question_date')} AS q_min FROM asked)"


def dated(name: str, granularity: str) -> str:
    return f"{name} AS (SELECT u.*, q_day, q_min, {day('session_date')} AS s_day, {minute('session_date')} AS s_min FROM ({units_of(granularity)}) u JOIN when_asked w ON w.question_id = u.question_id)"


USABLE = f"""{ASKED}, {dated('sess', 'session')}, usable AS (SELECT question_id, any_value(q_day) AS q_day, any_value(q_min) AS q_min, max(s_day) AS last_day,
    CASE WHEN count(s_min) = count(*) THEN max(s_min) END AS last_min, count(s_day) = count(*) AND any_value(q_day) IS NOT NULL AND any_value(q_min) IS NOT NULL AS ok FROM sess GROUP BY question_id)"""


def place(last: str, q: str) -> str:
    return f"CASE WHEN {last} < {q} THEN 'before' WHEN {last} = {q} THEN 'same' WHEN {last} > {q} THEN 'after' END"


def same_order(granularity: str) -> str:
    def same(s: str, q: str) -> str:
        return f"""row_number() OVER (PARTITION BY question_id ORDER BY coalesce({s}, 0) DESC, session_index DESC, unit_id)
            = row_number() OVER (PARTITION BY question_id ORDER BY abs({q} - coalesce({s}, 0)), session_index DESC, unit_id)"""

    return f"""SELECT '{granularity}' AS granularity, resolution, count(*) FILTER (WHERE same) AS agree, count(*) FILTER (WHERE NOT same) AS differ FROM (
        SELECT question_id, unnest(['day', 'minute']) AS resolution, unnest([bool_and(d), bool_and(m)]) AS same FROM (
            SELECT question_id, {same('s_day', 'q_day')} AS d, {same('s_min', 'q_min')} AS m FROM d_{granularity} SEMI JOIN (SELECT * FROM usable WHERE ok) o USING (question_id)) r GROUP BY question_id) l GROUP BY resolution"""


LEAKS = f"""{USABLE}, {dated('dt', 'turn')}, leaks AS (SELECT question_id, count(*) FILTER (WHERE coalesce(s_min, 0) > q_min) AS n_post, count(*) FILTER (WHERE coalesce(s_min, 0) > q_min AND is_evidence) AS n_post_evidence,
    count(*) FILTER (WHERE is_evidence) AS n_evidence, max(coalesce(s_min, 0) - q_min) AS overshoot FROM dt SEMI JOIN (SELECT * FROM usable WHERE ok) o USING (question_id) GROUP BY question_id)"""

CALLS = f"""{TURNS}, b AS (SELECT question_id, turn_index, session_id, {count("role || ': ' || content")} AS tokens, row_number() OVER (PARTITION BY question_id, session_id ORDER BY turn_index) - 1 AS nth,
        row_number() OVER (PARTITION BY question_id ORDER BY turn_index) = 1 AS first FROM turns),
    k AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY question_id ORDER BY turn_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS back FROM b),
    calls AS ({" UNION ALL ".join(f"SELECT question_id, sum(tokens)::BIGINT AS content, '{name}' AS batching, count(*) FILTER (WHERE {cond}) AS n_calls, coalesce(sum(back) FILTER (WHERE {cond}), 0)::BIGINT AS resent FROM k GROUP BY question_id" for name, cond in (("per_turn", "true"), ("per_pair", "nth % 2 = 0"), ("per_session", "nth = 0"), ("per_conversation", "first")))})"""


def cost(memory: int = 30, completion: int = 300) -> str:
    return f"""SELECT batching, n, round(n_calls, 6) AS n_calls, round(p, 6) AS prompt_tokens, round(c, 6) AS completion_tokens, round(p + c, 6) AS total_tokens,
        round((p * 0.25::DOUBLE + c * 2) / 1000000::DOUBLE, 6) AS usd_uncached, round(((p - h) * 0.25::DOUBLE + h * 0.025::DOUBLE + c * 2) / 1000000::DOUBLE, 6) AS usd_cached,
        round(n_calls * 7671 / (p + c), 6) AS share_system, round(resent / (p + c), 6) AS share_resent, round(content / (p + c), 6) AS share_content, round((p + c) / 345, 6) AS break_even
        FROM (SELECT *, n_calls * {7671 + 200 + 10 * memory} + resent + content AS p, n_calls * {completion} AS c, greatest(0, n_calls - 1) * 7671 AS h
              FROM (SELECT batching, count(*) AS n, avg(n_calls) AS n_calls, avg(resent) AS resent, avg(content) AS content FROM calls GROUP BY batching) m) t"""


METER = """calls AS (SELECT user_id, event_id, event_type <> 'click' AS llm, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS phase, event_id % 3 + 1 AS n_items,
        CASE WHEN event_id % 5 <> 0 THEN length(coalesce(props, '')) END AS reported, coalesce(reported, length(coalesce(props, '')) // 4) AS billed, event_id % 7 AS completion FROM events),
    meter AS (SELECT user_id, phase, count(*) FILTER (WHERE llm) AS llm_calls, coalesce(sum(billed) FILTER (WHERE llm), 0)::BIGINT AS llm_prompt_tokens, coalesce(sum(completion) FILTER (WHERE llm), 0)::BIGINT AS llm_completion_tokens,
        coalesce(sum(n_items) FILTER (WHERE NOT llm), 0)::BIGINT AS embed_calls, coalesce(sum(billed) FILTER (WHERE NOT llm), 0)::BIGINT AS embed_tokens, bool_or(llm AND reported IS NULL) AS estimated FROM calls GROUP BY ALL)"""

LEDGER = ("llm_calls", "llm_prompt_tokens", "llm_completion_tokens", "embed_calls", "embed_tokens")
BUCKET = "CASE WHEN len(g) <= 1 THEN '1' WHEN len(g) <= 3 THEN '2-3' ELSE '4+' END"
ROUTED = f"""{BASE}, q0 AS (SELECT question_id, question_type, question, gold, {normal('gold')} AS g FROM questions),
    routed AS (SELECT question_id, question_type, question, gold, false AS is_abstention, len(g) <= 12 AS extractive, len(g) >= 2 AS "primary", regexp_matches(trim(gold), '^[0-9]*\\.?[0-9]*$') AND regexp_matches(gold, '[0-9]') AS numeral,
        regexp_matches(gold, {quoted(GOLD_ABSTAINS)}) AS gold_abstains, {BUCKET} AS bucket FROM q0),
    flagged AS (SELECT *, extractive AND NOT gold_abstains AS scored, extractive AND NOT gold_abstains AND question_type IN ('single-session-user', 'single-session-assistant', 'knowledge-update') AS eligible FROM routed)"""


PLACES = f"""{ROUTED}, seen AS (SELECT f.question_id, question_type, bucket, question, gold, numeral, has_answer, content, turn_index, {answers(normal('content'))} AS hit FROM turns t JOIN flagged f ON f.question_id = t.question_id WHERE scored),
    per AS (SELECT question_id, question_type, bucket, question, gold, numeral, coalesce(bool_or(hit) FILTER (WHERE has_answer), false) AS in_evidence, bool_or(hit) AS in_haystack,
        coalesce(string_agg(content, chr(10) ORDER BY turn_index) FILTER (WHERE has_answer), '') AS text FROM seen GROUP BY ALL),
    places AS (SELECT *, {answers(normal('text'))} AS in_union, in_haystack AND NOT in_evidence AS outside_only FROM per)"""


def ring(name: str, group: str, m: int) -> str:
    """Drawn golds of other questions of a group: m evenly spaced ones of those that differ from the own, from a hashed start."""
    return f"""{name}_g AS (SELECT {group}, gold, count(*) AS freq, coalesce(sum(count(*)) OVER (PARTITION BY {group} ORDER BY md5(gold), gold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, sum(count(*)) OVER (PARTITION BY {group})::BIGINT AS size FROM q1 GROUP BY {group}, gold),
    {name}_r AS (SELECT {group}, gold AS placebo, unnest(range(first, first + freq)) AS place FROM {name}_g),
    {name}_d AS (SELECT question_id, {group}, i AS nth, (first + freq + (('0x' || substr(md5(question_id), 1, 8))::BIGINT + i * (c // least({m}, c))) % c) % size AS place
        FROM (SELECT *, size - freq AS c FROM q1 JOIN {name}_g USING ({group}, gold)) x, range({m}) t(i) WHERE c > 0 AND i < least({m}, c)),
    {name} AS (SELECT question_id, nth::INT AS nth, placebo FROM {name}_d JOIN {name}_r USING ({group}, place))"""


PLACEBOS = f"""{ROUTED}, q1 AS (SELECT question_id, question_type, question, gold, {normal('gold')} AS g, bucket FROM flagged WHERE eligible), {ring('tight', 'question_type, bucket', 10)}, {ring('wide', 'question_type', 10)},
    placebos AS (SELECT * FROM tight UNION ALL SELECT * FROM wide WHERE question_id NOT IN (SELECT question_id FROM tight))"""
HELD = "len(list_filter({g}, lambda x: NOT list_contains(t, x))) = 0 AND len({g}) > 0"
SCORED = f"""{PLACEBOS}, store AS (SELECT question_id, unit_id, {normal('text')} AS t, {count('text')} AS tokens FROM units),
    own AS (SELECT s.question_id, question_type, bucket, any_value(len(g)) >= 2 AS in_primary, bool_or({answers('t')}) AS record, bool_or({HELD.format(g='g')}) AS soft,
        {answers('flatten(list(t ORDER BY unit_id))', 'any_value(gold)', 'any_value(question)')} AS union_hit, count(*) AS n_records, sum(tokens)::BIGINT AS store_tokens FROM store s JOIN q1 ON q1.question_id = s.question_id GROUP BY ALL),
    pl AS (SELECT question_id, nth, placebo, question, {normal('placebo')} AS p FROM placebos JOIN q1 USING (question_id)),
    hit AS (SELECT s.question_id, nth, bool_or({answers('t', 'placebo')}) AS record, bool_or({HELD.format(g='p')}) AS soft, {answers('flatten(list(t ORDER BY unit_id))', 'any_value(placebo)', 'any_value(question)')} AS whole FROM store s JOIN pl ON pl.question_id = s.question_id GROUP BY ALL),
    floor_of AS (SELECT question_id AS fq, avg(record::INT) AS null_record, avg(soft::INT) AS null_soft, avg(whole::INT) AS null_union FROM hit GROUP BY question_id),
    rows_of AS (SELECT own.*, coalesce(null_record, 0) AS null_record, coalesce(null_soft, 0) AS null_soft, coalesce(null_union, 0) AS null_union FROM own LEFT JOIN floor_of ON fq = own.question_id)"""
SURVIVAL = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {c}" for c in ("record", "soft", "union_hit", "null_record", "null_soft", "null_union", "n_records", "store_tokens"))
CORRECTED = "round(CASE WHEN avg(null_record) < 1 THEN (avg(record::DOUBLE) - avg(null_record)) / (1 - avg(null_record)) END, 6) AS corrected"


def positions(source: str, key: str, bins: int = 1024) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5({key}), 1, 8))::BIGINT % {bins}, md5({key}), {key}) - 1 AS pos FROM {source})"


def resampled(values: str) -> str:
    return f"""n AS (SELECT count(*) AS n FROM v), dr AS (SELECT b, ('0x' || substr(md5('0|' || b || '|' || pos), 1, 8))::BIGINT % n AS pos FROM range(10000) r(b), v, n),
        reps AS (SELECT b, {values} FROM dr JOIN v ON v.pos = dr.pos GROUP BY b)"""


def selector(order: str) -> str:
    """One row per question: does the gold survive in the sentences kept by an order."""
    return f"""SELECT s.question_id, bool_or({answers(normal('s.text'), 'q.gold', 'q.question')}) AS record, count(*) AS n_records, sum({count('s.text')})::BIGINT AS tokens
        FROM ({by_sentence(order)}) s JOIN q1 q ON q.question_id = s.question_id GROUP BY s.question_id"""


JUDGED = """judged AS (SELECT l.doc_id, CASE WHEN l.doc_id % 7 = 0 THEN NULL ELSE coalesce(quality = 1, false) END AS judge, n_chars > 1000 AS deterministic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
PROMPTS = f"{TURNS}, prompts AS (SELECT role AS arm, {count('content')} AS sent, CASE WHEN role = 'system' THEN 16 ELSE least({count('content')}, 40) END AS prompt_tokens FROM turns)"
LABEL = "regexp_replace(name, '^[^:]*:', '')"
SIZE = r"([0-9]+(?:\.[0-9]+)?)\s*([bm])\b"


HALF = "substr(md5(question_id), 1, 1) < '8'"


def stored(name: str, granularity: str, which: str, order: str) -> str:
    return f"""SELECT '{name}' AS name, '{granularity}' AS granularity, count(*) AS n, round(avg(CASE WHEN rank < 10 THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END), 6) AS mrr FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}) - 1 AS rank FROM ({units_of(granularity)}) u) r
        SEMI JOIN questions USING (question_id) WHERE is_evidence AND {which}"""


STORED = "stored AS (" + " UNION ALL ".join(stored(name, g, which, o) for name, o in (("oracle", "is_evidence DESC, unit_id"), ("recency", f"{NEWEST}, unit_id DESC")) for g, which in (("turn", "true"), ("turn", HALF), ("session", HALF))) + ")"
LABELLED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, q.label AS label, c.vec_id AS unit_id, q.label = c.label AS same, round(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b), 6) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) - 1 AS rank FROM s),
        p AS (SELECT query_id, any_value(label) AS label, count(*) FILTER (WHERE same) AS n_evidence, coalesce(list(rank ORDER BY rank) FILTER (WHERE same AND rank < 20), []) AS ranks FROM r GROUP BY query_id)"""
PAIRED = """j AS (SELECT l.*, n_chars, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
        s AS (SELECT 'quality' AS system_arm, doc_id, lang, quality = 1 AS s FROM j UNION ALL SELECT 'clean', doc_id, lang, toxic = 0 FROM j),
        c AS (SELECT 'long' AS control_arm, doc_id, n_chars > 1000 AS c FROM j UNION ALL SELECT 'short', doc_id, n_chars <= 200 FROM j UNION ALL SELECT 'even', doc_id, doc_id % 2 = 0 FROM j),
        pairs AS (SELECT system_arm, control_arm, s.doc_id, lang, s, c FROM s JOIN c ON s.doc_id = c.doc_id WHERE s IS NOT NULL AND c IS NOT NULL),
        t AS (SELECT system_arm, control_arm, avg(s::INT) - avg(c::INT) AS lift, count(*) FILTER (WHERE s AND NOT c) AS b, count(*) FILTER (WHERE c AND NOT s) AS k FROM pairs GROUP BY system_arm, control_arm
              QUALIFY row_number() OVER (PARTITION BY system_arm ORDER BY avg(c::INT) DESC, control_arm) = 1),
        chosen AS (SELECT pairs.* FROM pairs JOIN t USING (system_arm, control_arm))"""
MCNEMAR = "CASE WHEN b + k = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, k) + 1), lambda i: exp(lgamma(b + k + 1) - lgamma(i + 1) - lgamma(b + k - i + 1) - (b + k) * ln(2))))) END"


def store_rows(name: str, units: str) -> str:
    """The rows of ``score`` for a store given as units."""
    return f"""SELECT '{name}' AS store, in_primary, record, null_record, n_records, store_tokens FROM (WITH units_ AS ({units}), {SCORED.removeprefix(BASE + ', ').replace('FROM units)', 'FROM units_)')} SELECT * FROM rows_of) z_{name}"""


REPORT_SQL: dict[str, str] = {
    "metrics_by_type": f"WITH {BASE}, {QBM25}, {ARMS} SELECT arm, question_type, {COUNTS}, {MRR}, {METRIC_COLS} FROM res GROUP BY arm, question_type",
    "recency_sweep": f"WITH {BASE}, {QBM25}, {QDENSE}, {SWEEP} SELECT question_type, " + ", ".join(f"round(avg({RR}) FILTER (WHERE arm = '{a}'), 6) AS {a}" for a in WEIGHTS) + " FROM res WHERE n_evidence > 0 GROUP BY question_type",
    "paired_dmrr": f"""WITH {BASE}, {QBM25}, {QDENSE}, {SWEEP}, rr AS (SELECT arm, query_id, {RR} AS rr FROM res WHERE n_evidence > 0),
        diffs AS (SELECT a.query_id, a.rr - b.rr AS value FROM rr a JOIN rr b ON a.query_id = b.query_id WHERE a.arm = 'w1' AND b.arm = 'w0'),
        v AS (SELECT * FROM {positions('diffs', 'query_id')} p), {resampled('avg(value) AS m')}
        SELECT n, round((SELECT avg(value) FROM v), 6) AS point, round((SELECT quantile_cont(m, 0.025) FROM reps), 6) AS lo, round((SELECT quantile_cont(m, 0.975) FROM reps), 6) AS hi FROM n""",
    "hit_recall_gap": f"""WITH {LABELLED}, m AS (SELECT label, {METRIC_COLS} FROM p GROUP BY label)
        SELECT label, any_hit_10, recall_10, round(any_hit_10 - recall_10, 6) AS gap FROM m WHERE any_hit_10 - recall_10 >= 0.1::DOUBLE""",
    "dense_metrics": f"WITH {LABELLED} SELECT {COUNTS}, {MRR}, {METRIC_COLS} FROM p",
    "placebo_survival": f"""WITH {SCORED} SELECT question_id, count(placebo) AS n_placebos, round(any_value(null_record), 6) AS null_record FROM rows_of LEFT JOIN placebos USING (question_id) GROUP BY question_id""",
    "survival_outcomes": f"WITH {SCORED} SELECT question_id, question_type, bucket AS gold_len_bucket, record, soft, union_hit, n_records FROM rows_of",
    "survival_summary": f"""WITH {SCORED}, s AS (SELECT question_type, count(*) AS n, count(*) FILTER (WHERE record) AS record, avg(null_record) AS floor FROM rows_of GROUP BY question_type),
        w AS (SELECT *, record / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM s),
        b AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM w)
        SELECT question_type, n, record, round(greatest(0, least(1, mid - h)), 6) AS lo, round(greatest(0, least(1, mid + h)), 6) AS hi, round(floor, 6) AS floor, round(CASE WHEN floor < 1 THEN (p - floor) / (1 - floor) END, 6) AS corrected FROM b""",
    "survival_stores": f"""WITH {BASE}, every AS ({" UNION ALL ".join(store_rows(n, u) for n, u in (("verbatim_turn", "SELECT * FROM units"), ("leadk_25pct", by_sentence("pos, unit_id")), ("tailk_25pct", by_sentence("n - pos, unit_id"))))}),
        g AS (SELECT store, avg(store_tokens) AS tokens, avg(n_records) AS records, count(*) FILTER (WHERE in_primary) AS n, avg(record::INT) FILTER (WHERE in_primary) AS survival, avg(null_record) FILTER (WHERE in_primary) AS floor FROM every GROUP BY store)
        SELECT row_number() OVER (ORDER BY tokens DESC, store)::INT AS place, store, n, round(tokens, 6) AS tokens, round(records, 6) AS records, round(survival, 6) AS survival, round(floor, 6) AS floor, round(CASE WHEN floor < 1 THEN (survival - floor) / (1 - floor) END, 6) AS corrected FROM g""",
    "exclusion_counts": f"""WITH {ROUTED} SELECT count(*) AS n, 0::BIGINT AS n_abstention, count(*) FILTER (WHERE NOT extractive) AS n_not_extractive, count(*) FILTER (WHERE extractive AND gold_abstains) AS n_gold_abstains,
        count(*) FILTER (WHERE scored) AS n_scored, count(*) FILTER (WHERE eligible) AS n_eligible FROM flagged""",
    "cost_curves": f"""WITH {UNITS}, m AS (SELECT avg({count('text')}) AS unit, sum({count('text')}) / count(DISTINCT question_id)::DOUBLE AS whole FROM units),
        c AS (SELECT 'full' AS series, 0.0::DOUBLE AS w, whole AS r FROM m UNION ALL SELECT 'retrieved', 0, 10 * unit FROM m UNION ALL SELECT 'extracting', 1233500, 1764)
        SELECT series, n_queries, round((w + n_queries * r) * 0.15::DOUBLE / 1000000::DOUBLE, 9) AS dollars FROM c, range(1, 201) x(n_queries)""",
    "lift_by_type": f"""WITH {PAIRED} SELECT system_arm, coalesce(lang, '?') AS question_type, count(*) AS n, round(avg(s::INT), 6) AS system_accuracy, round(avg(c::INT), 6) AS control_accuracy, round(avg(s::INT) - avg(c::INT), 6) AS lift FROM chosen GROUP BY ALL""",
    "lift_intervals": f"""WITH {PAIRED}, ranked AS (SELECT system_arm, s::INT - c::INT AS value, row_number() OVER (PARTITION BY system_arm ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1024, md5(doc_id::VARCHAR)) - 1 AS pos, count(*) OVER (PARTITION BY system_arm) AS n FROM chosen),
        sizes AS (SELECT system_arm, max(n) AS n FROM ranked GROUP BY system_arm), places AS (SELECT system_arm, b, n, unnest(range(n)) AS i FROM sizes, range(10000) r(b)),
        means AS (SELECT p.system_arm, b, avg(value) AS m FROM places p JOIN ranked v ON v.system_arm = p.system_arm AND v.pos = ('0x' || substr(md5('0|' || b || '|' || i), 1, 8))::BIGINT % p.n GROUP BY p.system_arm, b),
        o AS (SELECT system_arm, m, row_number() OVER (PARTITION BY system_arm ORDER BY m, b) - 1 AS r FROM means),
        e AS (SELECT system_arm, round(max(m) FILTER (WHERE r = 250), 6) AS ci_lo, round(max(m) FILTER (WHERE r = 9750), 6) AS ci_hi FROM o GROUP BY system_arm)
        SELECT t.system_arm, control_arm, round(lift, 6) AS lift, ci_lo, ci_hi, round({MCNEMAR}, 9) < 0.05 AND ci_lo > 0 AS significant FROM t JOIN e ON e.system_arm = t.system_arm""",
    "answer_prompts": f"""WITH {UNITS}, {QUESTIONS}, asked AS ({ASKED_SQL}), h AS ({ranked(f"{NEWEST}, unit_id DESC", "0", 3)}),
        c AS (SELECT query_id, string_agg('[' || session_date || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h JOIN units u ON u.question_id = h.query_id AND u.unit_id = h.unit_id WHERE regexp_extract(query_id, '\\d+')::INT % 3 <> 0 GROUP BY query_id)
        SELECT q.question_id, replace(replace(replace(CASE WHEN coalesce(context, '') = '' THEN {quoted(CLOSED_BOOK)} ELSE {quoted(ANSWER)} END, '{{date}}', question_date), '{{context}}', coalesce(context, '')), '{{question}}', question) AS prompt
        FROM questions q JOIN asked USING (question_id) LEFT JOIN c ON c.query_id = q.question_id""",
    "best_runs": f"WITH {BASE}, {STORED} SELECT * FROM stored WHERE mrr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, granularity ORDER BY n DESC) = 1",
    "matched_runs": f"""WITH {BASE}, {STORED}, c AS (SELECT max(n) AS n FROM (SELECT n FROM stored WHERE mrr IS NOT NULL GROUP BY n HAVING count(DISTINCT granularity) = 2) x)
        SELECT stored.* FROM stored JOIN c ON c.n = stored.n WHERE mrr IS NOT NULL""",
    "strongest_control": """WITH j AS (SELECT l.*, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
        s AS (SELECT 'quality' AS system_arm, doc_id, quality = 1 AS s FROM j UNION ALL SELECT 'clean', doc_id, toxic = 0 FROM j),
        c AS (SELECT 'long' AS control_arm, doc_id, n_chars > 1000 AS c FROM j UNION ALL SELECT 'short', doc_id, n_chars <= 200 FROM j UNION ALL SELECT 'even', doc_id, doc_id % 2 = 0 FROM j),
        p AS (SELECT system_arm, control_arm, count(*) AS n, avg(s::INT) AS sa, avg(c::INT) AS ca, count(*) FILTER (WHERE s AND NOT c) AS b, count(*) FILTER (WHERE c AND NOT s) AS k FROM s JOIN c ON s.doc_id = c.doc_id WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
        t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY system_arm ORDER BY ca DESC, control_arm) = 1)
        SELECT system_arm, control_arm, n, round(sa, 6) AS system_accuracy, round(ca, 6) AS control_accuracy, round(sa - ca, 6) AS lift, round(CASE WHEN sa > 0 THEN (sa - ca) / sa ELSE 0 END, 6) AS attributable,
            round(CASE WHEN b + k = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, k) + 1), lambda i: exp(lgamma(b + k + 1) - lgamma(i + 1) - lgamma(b + k - i + 1) - (b + k) * ln(2))))) END, 9) AS p FROM t""",
    "date_positions": f"""WITH {USABLE}, l AS (SELECT 'any' AS resolution, 'unparsable' AS position FROM usable WHERE NOT ok UNION ALL SELECT 'day', {place('last_day', 'q_day')} FROM usable WHERE ok
        UNION ALL SELECT 'minute', {place('last_min', 'q_min')} FROM usable WHERE ok) SELECT resolution, position, count(*) AS n FROM l WHERE position IS NOT NULL GROUP BY ALL""",
    "date_gaps": f"WITH {USABLE} SELECT count(*) AS n, min(q_day - last_day) AS min_gap, median(q_day - last_day) AS median_gap, max(q_day - last_day) AS max_gap FROM usable WHERE ok",
    "date_ordering": f"WITH {USABLE}, " + ", ".join(dated(f"d_{g}", g) for g in ("session", "user_turn", "turn")) + " " + " UNION ALL ".join(same_order(g) for g in ("session", "user_turn", "turn")),
    "date_leaks": f"WITH {LEAKS} SELECT * FROM leaks WHERE n_post > 0",
    "date_leak_types": f"""WITH {LEAKS}, {QUESTIONS} SELECT coalesce(question_type, '?') AS question_type, count(*) AS n_sessions, count(*) FILTER (WHERE n_post_evidence > 0) AS n_evidence,
        count(*) FILTER (WHERE n_post_evidence > 0 AND n_post_evidence = leaks.n_evidence) AS n_all_evidence, max(overshoot) AS overshoot FROM leaks LEFT JOIN questions q ON q.question_id = leaks.question_id WHERE n_post > 0 GROUP BY 1""",
    "date_origin": f"""WITH {USABLE}, d AS (SELECT DISTINCT question_id, s_day FROM sess SEMI JOIN (SELECT * FROM usable WHERE ok) o USING (question_id))
        SELECT count(*) AS n_pairs, 0.0::DOUBLE AS worst FROM d a JOIN d b ON a.question_id = b.question_id AND a.s_day < b.s_day""",
    "write_calls": f"WITH {CALLS} SELECT * FROM calls",
    "write_cost_model": f"WITH {CALLS} {cost()}",
    "write_cost_sensitivity": f"WITH {CALLS} " + " UNION ALL ".join(f"SELECT '{n}' AS label, total_tokens FROM ({cost(m, c)}) c_{n} WHERE batching = 'per_session'" for n, m, c in (("low", 15, 100), ("mid", 30, 300), ("high", 60, 800))),
    "meter_events": f"WITH {METER} SELECT * FROM meter",
    "ledger_dollars": f"""WITH {METER}, w AS (SELECT user_id, {", ".join(f"coalesce(sum(llm_{c}_tokens) FILTER (WHERE phase = '{p}'), 0)::BIGINT AS {p}_{c}" for p in ("write", "read") for c in ("prompt", "completion"))} FROM meter GROUP BY user_id),
        p AS (SELECT *, [0.15::DOUBLE, 2.5, 0][user_id % 3 + 1] AS i, [0.6::DOUBLE, 10, 0][user_id % 3 + 1] AS o FROM w)
        SELECT user_id, write_prompt, write_completion, read_prompt, read_completion, round((write_prompt * i + write_completion * o) / 1000000::DOUBLE + 100 * (read_prompt * i + read_completion * o) / 1000000::DOUBLE, 9) AS dollars_100_queries FROM p""",
    "extracted_store": f"""WITH {TURNS}, m AS (SELECT question_id, session_id || '/' || (turn_index % 2) AS memory_id, arg_max(content, turn_index) AS text, arg_max(session_date, turn_index) AS session_date, string_agg(turn_index::VARCHAR, ',' ORDER BY turn_index) AS provenance FROM turns GROUP BY ALL)
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY memory_id) - 1)::INT AS unit_id, text, session_date, provenance FROM m WHERE trim(text) <> ''""",
    "stored_memories": f"""WITH {TURNS}, m AS (SELECT question_id, session_id || '/' || (turn_index % 2) AS memory_id, arg_max(content, turn_index) AS text, arg_max(session_date, turn_index) AS session_date, string_agg(turn_index::VARCHAR, ',' ORDER BY turn_index) AS provenance FROM turns GROUP BY ALL)
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY memory_id) - 1)::INT AS unit_id, text, session_date, provenance FROM m WHERE trim(text) <> ''""",
    "ledger_records": f"""WITH {METER}, w AS (SELECT user_id, {", ".join(f"coalesce(sum({c}) FILTER (WHERE phase = '{p}'), 0)::BIGINT AS {p}_{c}" for p in ("write", "read") for c in LEDGER)} FROM meter GROUP BY user_id)
        SELECT user_id, '{{' || {" || ',' || ".join(f"""'"{p}":{{' || """ + " || ',' || ".join(f"""'"{c}":' || {p}_{c}""" for c in LEDGER) + " || '}'" for p in ("write", "read"))} || '}}' AS cost FROM w""",
    "eligible_questions": f"WITH {ROUTED} SELECT * EXCLUDE (question) FROM flagged",
    "benchmark_audit": f"""WITH {PLACES} SELECT coalesce(question_type, 'all') AS question_type, coalesce(bucket, 'all') AS bucket, count(*) AS n, {", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in ("in_evidence", "in_union", "in_haystack", "outside_only", "numeral"))}
        FROM places GROUP BY CUBE (question_type, bucket)""",
    "answer_location": f"""WITH {PLACES} SELECT question_type, count(*) AS n, round(avg(in_evidence::INT), 6) AS in_labelled_evidence, round(avg(outside_only::INT), 6) AS unlabelled, round(avg((NOT in_haystack)::INT), 6) AS nowhere
        FROM places WHERE bucket <> '1' GROUP BY question_type""",
    "placebo_pool": f"WITH {PLACEBOS} SELECT * FROM placebos",
    "survival_groups": f"""WITH {SCORED}, every AS (SELECT 'all' AS "by", 'all' AS value, * FROM rows_of UNION ALL SELECT 'primary', 'all', * FROM rows_of WHERE in_primary UNION ALL SELECT 'bucket', bucket, * FROM rows_of UNION ALL SELECT 'type', question_type, * FROM rows_of WHERE in_primary)
        SELECT "by", value, count(*) AS n, {SURVIVAL}, {CORRECTED} FROM every GROUP BY "by", value""",
    "bootstrap_corrected": f"""WITH {SCORED}, v AS (SELECT pos, soft::INT::DOUBLE AS score, null_soft AS floor FROM {positions('rows_of', 'question_id')} p), {resampled('avg(score) AS s, avg(floor) AS z')},
        o AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS r, count(*) OVER () AS k FROM (SELECT b, CASE WHEN z < 1 THEN (s - z) / (1 - z) END AS m FROM reps) c WHERE m IS NOT NULL)
        SELECT n, round((SELECT CASE WHEN avg(floor) < 1 THEN (avg(score) - avg(floor)) / (1 - avg(floor)) END FROM v), 6) AS point, round((SELECT max(m) FROM o WHERE r = floor(0.025::DOUBLE * k)), 6) AS lo,
            round((SELECT max(m) FROM o WHERE r = least(k - 1, floor(0.975::DOUBLE * k))), 6) AS hi FROM n""",
    "matched_budget_selectors": f"""WITH {ROUTED}, q1 AS (SELECT question_id, question, gold FROM flagged WHERE eligible), a AS ({selector('pos, unit_id')}), z AS ({selector('n - pos, unit_id')}),
        p AS (SELECT coalesce(z.record, false) AS s, coalesce(a.record, false) AS c, a.n_records AS ar, a.tokens AS atk, z.n_records AS zr, z.tokens AS zt FROM q1 q LEFT JOIN a ON a.question_id = q.question_id LEFT JOIN z ON z.question_id = q.question_id),
        t AS (SELECT coalesce(sum(ar), 0)::BIGINT AS lead_records, coalesce(sum(atk), 0)::BIGINT AS lead_tokens, coalesce(sum(zr), 0)::BIGINT AS tail_records, coalesce(sum(zt), 0)::BIGINT AS tail_tokens, count(*) AS n, count(*) FILTER (WHERE s AND c) AS "both",
            count(*) FILTER (WHERE s AND NOT c) AS system_only, count(*) FILTER (WHERE c AND NOT s) AS control_only, count(*) FILTER (WHERE NOT s AND NOT c) AS neither FROM p)
        SELECT *, round(CASE WHEN system_only + control_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(system_only, control_only) + 1),
            lambda i: exp(lgamma(system_only + control_only + 1) - lgamma(i + 1) - lgamma(system_only + control_only - i + 1) - (system_only + control_only) * ln(2))))) END, 9) AS p FROM t""",
    "arm_accuracy": f"""WITH {PRED}, c AS (SELECT question_type, {graded('p', 'pred')} AS correct, list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) AS common, len(p) AS np, len(g) AS ng
            FROM pred JOIN questions USING (question_id, question, gold)), f AS (SELECT *, CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 THEN 0 ELSE 2.0::DOUBLE * coalesce(common, 0) / (np + ng) END AS f1 FROM c)
        SELECT coalesce(question_type, 'all') AS question_type, count(correct) AS n_gradable, round(avg(correct::INT), 6) AS accuracy, round(avg(f1) FILTER (WHERE correct IS NOT NULL), 6) AS f1 FROM f GROUP BY ROLLUP (question_type)""",
    "regrade_diff": f"""WITH {PRED}, s AS (SELECT *, array_to_string(list_filter(string_split_regex(pred, '\\s+'), lambda w: w <> '')[1:8], ' ') AS short FROM pred),
        v AS (SELECT question_id || '/' || turn_index AS question_id, {graded('p', 'pred')} AS before, {graded(normal('short'), 'short')} AS after FROM s) SELECT * FROM v WHERE before IS DISTINCT FROM after""",
    "judge_verdicts": f"WITH {JUDGED} SELECT doc_id, judge FROM judged",
    "disagreements": f"WITH {JUDGED} SELECT * FROM judged WHERE judge <> deterministic",
    "judge_validation": f"""WITH {JUDGED}, m AS (SELECT count(*) AS n, avg((deterministic = judge)::INT) AS a, avg(deterministic::INT) AS h, avg(judge::INT) AS j, avg(CASE WHEN NOT deterministic THEN judge::INT END) AS fa FROM judged WHERE judge IS NOT NULL AND deterministic IS NOT NULL),
        e AS (SELECT *, h * j + (1 - h) * (1 - j) AS pe FROM m), k AS (SELECT n, round(a, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (a - pe) / (1 - pe) END, 6) AS kappa, round(fa, 6) AS false_accept FROM e)
        SELECT *, CASE WHEN kappa >= 0.8 THEN 'strong' WHEN kappa >= 0.6 THEN 'moderate' ELSE 'weak' END AS band FROM k""",
    "judge_audit": f"""WITH {TURNS}, {QUESTIONS}, {AUDIT}, g AS (SELECT 'deterministic' AS grader, kind, expected, {graded(normal('pred'), 'pred', abstains="ends_with(kind, 'abstention')")} AS v FROM cases
        UNION ALL SELECT 'judge:containment', kind, expected, ends_with(kind, 'abstention') OR contains(lower(pred), lower(gold)) FROM (SELECT * FROM cases ORDER BY question_id, kind, pred LIMIT 400) c),
        r AS (SELECT grader, count(*) AS n_cases, count(v) AS n_graded, round(avg((v = expected)::INT), 6) AS accuracy, round(avg(v::INT) FILTER (WHERE NOT expected), 6) AS false_accept_rate,
            round(avg((NOT v)::INT) FILTER (WHERE expected), 6) AS false_reject_rate, round(avg((NOT v)::INT) FILTER (WHERE expected AND starts_with(kind, 'hard_')), 6) AS false_reject_rate_hard FROM g GROUP BY grader)
        SELECT *, coalesce(grader = 'deterministic' AND false_accept_rate > 0.05, false) AS too_lenient FROM r""",
    "resumed_sweep": f"""WITH {BASE}, {QBM25}, {ARMS}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE {NUMBER.replace('query_id', 'question_id')} % 3 <> 0) AS rest FROM questions)
        SELECT arm, query_id AS question_id, round({RR}, 6) AS rr, CASE arm WHEN 'bm25' THEN rest ELSE n END AS asked FROM res, n WHERE arm IN ('bm25', 'recency')""",
    "clamped_arms": f"WITH {PROMPTS} SELECT arm, count(*) AS n, max(prompt_tokens)::BIGINT AS length FROM prompts GROUP BY arm HAVING count(*) > 5 AND count(DISTINCT prompt_tokens) = 1 AND max(prompt_tokens) <> 0",
    "truncated_prompts": f"WITH {PROMPTS} SELECT arm, count(*) AS n, count(*) FILTER (WHERE sent > 56 OR prompt_tokens < 0.9::DOUBLE * sent) AS n_truncated, max(sent) AS longest FROM prompts GROUP BY arm",
    "model_labels": f"""WITH m AS (SELECT DISTINCT coalesce(lang, 'x') || CASE WHEN doc_id % 3 = 0 THEN '-' ELSE ':' END || 'net-' || ['1.5b', '14b', '350m', 'instruct'][doc_id % 4 + 1] AS name FROM documents), l AS (SELECT name, {LABEL} AS label FROM m)
        SELECT name, label, CASE WHEN regexp_extract(lower(label), '{SIZE}', 1) = '' THEN 'inf'::DOUBLE ELSE regexp_extract(lower(label), '{SIZE}', 1)::DOUBLE * CASE WHEN regexp_extract(lower(label), '{SIZE}', 2) = 'b' THEN 1e9 ELSE 1e6 END END AS parameters FROM l""",
    "sentence_cosine": f"""WITH {UNITS}, {SENTENCES}, nn AS (SELECT question_id, count(*) AS n FROM sent GROUP BY question_id), tk AS (SELECT question_id, unit_id, pos, unnest({tokens('sentence')}) AS term FROM sent),
        d AS (SELECT question_id, term, count(DISTINCT (unit_id, pos)) AS df FROM tk GROUP BY ALL), idf AS (SELECT d.question_id, term, round(ln(n / (1 + df)::DOUBLE) + 1, 9) AS idf FROM d JOIN nn ON nn.question_id = d.question_id),
        w AS (SELECT question_id, unit_id, pos, term, count(*) * any_value(idf) AS w FROM tk JOIN idf USING (question_id, term) GROUP BY ALL), v AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY question_id, unit_id, pos)) AS z FROM w)
        SELECT a.question_id, a.unit_id, a.pos AS i, b.pos AS j, round(sum(a.w * b.w / (a.z * b.z)), 6) AS cosine FROM v a JOIN v b ON a.question_id = b.question_id AND a.unit_id = b.unit_id AND a.term = b.term AND a.pos < b.pos AND a.z > 0 AND b.z > 0 GROUP BY ALL""",
    "temporal_misses": f"""WITH {PLACES}, m AS (SELECT question_id, bucket FROM places WHERE question_type = 'temporal-reasoning' AND NOT in_evidence AND bucket <> '1' ORDER BY md5('0|' || question_id) LIMIT 20)
        SELECT question_id, bucket, quality AS label FROM m LEFT JOIN labels ON doc_id = {NUMBER.replace('query_id', 'question_id')}""",
}
