"""DuckDB SQL that defines the result of each registered query independently."""

from __future__ import annotations

from memspark.sources.fixtures import TURNS_SQL


# Fixed values, spelt out here apart from the code that they check.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NUMBERS = (
    "MAP {'zero': '0', 'one': '1', 'two': '2', 'three': '3', 'four': '4', 'five': '5', 'six': '6', 'seven': '7', 'eight': '8', 'nine': '9', 'ten': '10', "
    "'eleven': '11', 'twelve': '12', 'thirteen': '13', 'fourteen': '14', 'fifteen': '15', 'sixteen': '16', 'seventeen': '17', 'eighteen': '18', 'nineteen': '19', "
    "'twenty': '20', 'thirty': '30', 'forty': '40', 'fifty': '50', 'sixty': '60', 'seventy': '70', 'eighty': '80', 'ninety': '90', 'hundred': '100', 'thousand': '1000'}"
)
IN_MONTHS = "('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december', 'sept')"
IN_ARTICLES = "('', 'a', 'an', 'the')"
REFUSAL = (
    r"(?i)\bdo(n't| not)\s+know\b|\b(can't|cannot|unable to)\s+(find|determine|tell|answer|recall)\b|\bno\s+(information|mention|record|reference|details?)\b"
    r"|\bnot\s+(mentioned|specified|provided|discussed|stated|available|included)\b|\bis(n't| not)\s+(mentioned|specified|provided|discussed|stated)\b"
    r"|\bdo(es)?(n't| not)\s+(contain|mention|specify|say|include)\b|\bwas(n't| not)\s+(mentioned|discussed|specified)\b|\bnever\s+(mentioned|discussed|stated)\b"
    r"|\bno\s+such\s+\w+\b|\binsufficient\s+(information|context|detail)\b|\bdo(n't| not)\s+have\s+(enough|sufficient|any|access)\b"
    r"|\b(not|isn't|is not)\s+enough\s+(information|context|detail)\b|\bno\s+way\s+to\s+(know|tell|determine)\b"
)
GOLD_ABSTAINS = r"(?i)\b(information provided is not enough|not enough information|did(n't| not) mention|was not mentioned|cannot be answered|no information (about|on|regarding))\b"
ALSO_ACCEPTABLE = r"(?i)\s*(is|are|would be)?\s*(also\s+)?acceptable(\s+too)?\s*\.?"
#: RE2 takes only ASCII letters for word characters; this bound takes all.
ABBREVIATION = r"(?i)(^|[^\pL\pN_])(dr|mr|mrs|ms|messrs|prof|rev|hon|sgt|capt|lt|col|gen|st|jr|sr|mt|no|vs|approx|etc|inc|ltd|co|corp|dept|est|avg|fig|vol|pp)\."
ORDER_QUESTION = r"(?i)\b(order|sequence|chronological|earliest|latest)\b"
SPELLED = {
    "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten",
    "11": "eleven", "12": "twelve", "15": "fifteen", "20": "twenty", "30": "thirty", "40": "forty", "50": "fifty", "100": "hundred",
}
AUDIT_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNIT_WORDS = {"$": "dollars", "%": "percent"}
AUDIT_REFUSALS = (
    "I don't know -- that wasn't mentioned in the conversation.", "I cannot find that information in the excerpts provided.", "The conversation does not contain any mention of that.",
    "I don't have enough information to determine that.", "I'm sorry, but the excerpts provided do not contain information about that.",
)
ANSWER = (
    "Here are excerpts from earlier conversations with the user, most relevant first.\n\n{context}\n\nToday's date is {date}.\n\n"
    "Using only the excerpts above, answer the user's question. If the excerpts do not contain the answer, say you don't know.\n\nQuestion: {question}\nAnswer concisely."
)
CLOSED_BOOK = "Today's date is {date}.\n\nAnswer the user's question. If you do not know the answer, say you don't know.\n\nQuestion: {question}\nAnswer concisely."
# End of fixed values.


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9'']+')"


def count(c: str) -> str:
    return f"greatest(1, length({c}) // 4)"


DATE = r"nullif(regexp_extract(session_date, '\d{4}/\d{2}/\d{2}'), '')"

def normal(c: str) -> str:
    parts = f"string_split_regex(translate(lower({c}), {quoted(PUNCTUATION)}, '{' ' * len(PUNCTUATION)}'), '\\s+')"
    digits = f"list_transform({parts}, lambda t: regexp_replace(t, '^([0-9]+)(st|nd|rd|th)$', '\\1'))"
    one = (
        f"CASE WHEN {NUMBERS}[t] IS NOT NULL THEN {NUMBERS}[t] WHEN t IN {IN_MONTHS} THEN left(t, 3) "
        "WHEN length(t) <= 3 OR NOT ends_with(t, 's') OR ends_with(t, 'ss') OR ends_with(t, 'us') OR ends_with(t, 'is') THEN t "
        "WHEN regexp_matches(t, '(ss|x|z|ch|sh)es$') THEN left(t, length(t) - 2) ELSE left(t, length(t) - 1) END"
    )
    return f"list_filter(list_transform({digits}, lambda t: {one}), lambda t: t NOT IN {IN_ARTICLES})"


def contains(t: str, g: str) -> str:
    return f"(len({g}) > 0 AND contains(' ' || array_to_string({t}, ' ') || ' ', ' ' || array_to_string({g}, ' ') || ' '))"


TURNS = f"turns AS ({TURNS_SQL})"
UNITS = f"{TURNS}, units AS (SELECT question_id, turn_index AS unit_id, role || ': ' || content AS text, session_id, session_date, session_index, has_answer AS is_evidence FROM turns)"
WORDS = r"list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')"
PLAIN = f"list_transform({WORDS}, lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))[4:6]"
K = "regexp_extract(question_id, '\\d+')::INT"
ASKS_ORDER = f"({K} % 10 IN (0, 3, 6) AND len({PLAIN}) = 3)"
QUESTIONS = f"""questions AS (SELECT question_id, CASE WHEN {ASKS_ORDER} THEN 'In what order: ' ELSE '' END || array_to_string({WORDS}[1:8], ' ') AS question,
    CASE WHEN {ASKS_ORDER} AND {K} % 10 = 3 THEN {PLAIN}[3] || ', ' || {PLAIN}[2] || ', and ' || {PLAIN}[1] WHEN {ASKS_ORDER} THEN {PLAIN}[1] || ', ' || {PLAIN}[2] || ', and ' || {PLAIN}[3] WHEN regexp_extract(question_id, '\\d+')::INT % 4 = 1 THEN 'exactly ' || regexp_extract(question_id, '\\d+')::INT || ' days later' ELSE array_to_string({WORDS}[4:6], ' ') END AS gold,
    ['knowledge-update', 'single-session-assistant', 'temporal-reasoning'][regexp_extract(question_id, '\\d+')::INT % 3 + 1] AS question_type FROM turns WHERE has_answer)"""
UNIT_COLS = "question_id, unit_id, text, session_id, session_date, session_index, is_evidence"


def ranked(order: str, score: str, k: int) -> str:
    return f"""SELECT question_id AS query_id, unit_id, rank, {score} AS score FROM
        (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY {order}) - 1)::INT AS rank FROM units) r WHERE rank < {k}"""


NEWEST = f"{DATE} DESC NULLS LAST, session_index DESC"
ORACLE_ALL, RECENT_ALL = ranked("is_evidence DESC, unit_id", "is_evidence::INT::DOUBLE", 100), ranked(f"{NEWEST}, unit_id", "-rank::DOUBLE", 100)


def fused(parts: list[tuple[str, float]], k: int = 10) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, unit_id, {i} AS i, rank, {w}::DOUBLE / (61 + rank) AS part FROM ({sql}) f{i}" for i, (sql, w) in enumerate(parts))
    return f"""SELECT query_id, unit_id, rank, score FROM (
        SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1)::INT AS rank FROM (
            SELECT query_id, unit_id, round(sum(part), 9) AS score, min([i, rank]) AS seen FROM ({union}) u GROUP BY ALL) s) t WHERE rank < {k}"""


BM25 = f"""
    docs AS (SELECT doc_id AS unit_id, coalesce(text, '') AS text FROM documents),
    tok AS (SELECT unit_id, CASE WHEN len({tokens('text')}) > 0 THEN {tokens('text')} ELSE ['<empty>'] END AS t FROM docs),
    post AS (SELECT unit_id, term, count(*) AS tf, any_value(dl)::INT AS dl FROM (SELECT unit_id, len(t) AS dl, unnest(t) AS term FROM tok) x GROUP BY unit_id, term),
    size AS (SELECT count(*) AS n, avg(len(t)) AS mean_dl FROM tok),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, size GROUP BY term),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens("coalesce(text, '')")}) AS term FROM benchmark) b GROUP BY item_id, term),
    found AS (SELECT query_id, unit_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))) AS score
              FROM q JOIN idf USING (term) JOIN post USING (term), size GROUP BY query_id, unit_id),
    every AS (SELECT item_id AS query_id, docs.unit_id, round(coalesce(score, 0), 6) AS score FROM benchmark CROSS JOIN docs LEFT JOIN found ON found.query_id = item_id AND found.unit_id = docs.unit_id),
    hits AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) - 1)::INT AS rank FROM every) r WHERE rank < 20)"""

QBM25 = f"""
    tok AS (SELECT question_id, unit_id, CASE WHEN len({tokens('text')}) > 0 THEN {tokens('text')} ELSE ['<empty>'] END AS t FROM units),
    post AS (SELECT question_id, unit_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT question_id, unit_id, len(t) AS dl, unnest(t) AS term FROM tok) x GROUP BY ALL),
    size AS (SELECT question_id, count(*) AS n, avg(len(t)) AS mean_dl FROM tok GROUP BY question_id),
    raw AS (SELECT question_id, term, any_value(mean_dl) AS mean_dl, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post JOIN size USING (question_id) GROUP BY ALL),
    idf AS (SELECT *, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY question_id) ELSE raw END AS idf FROM raw),
    qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({tokens('question')}) AS term FROM questions) b GROUP BY ALL),
    found AS (SELECT question_id, unit_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))) AS score
              FROM qt JOIN idf USING (question_id, term) JOIN post USING (question_id, term) GROUP BY ALL),
    every AS (SELECT u.question_id AS query_id, u.unit_id, round(coalesce(f.score, 0), 6) AS score FROM units u SEMI JOIN questions USING (question_id)
              LEFT JOIN found f ON f.question_id = u.question_id AND f.unit_id = u.unit_id),
    qhits AS (SELECT query_id, unit_id, rank, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) - 1)::INT AS rank FROM every) r WHERE rank < 100)"""

#: Cosines of token counts in 64 md5 buckets, within each question.
QDENSE = f"""
    bucket AS (SELECT question_id, unit_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM (SELECT question_id, unit_id, unnest({tokens('text')}) AS term FROM units) x GROUP BY ALL),
    asked_b AS (SELECT question_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM (SELECT question_id, unnest({tokens('question')}) AS term FROM questions) x GROUP BY ALL),
    cosine AS (SELECT u.question_id, u.unit_id, sum(u.c * a.c) / (any_value(un.z) * any_value(an.z)) AS score FROM bucket u JOIN asked_b a ON a.question_id = u.question_id AND a.b = u.b
               JOIN (SELECT question_id, unit_id, sqrt(sum(c * c)) AS z FROM bucket GROUP BY ALL) un ON un.question_id = u.question_id AND un.unit_id = u.unit_id
               JOIN (SELECT question_id, sqrt(sum(c * c)) AS z FROM asked_b GROUP BY ALL) an ON an.question_id = u.question_id GROUP BY ALL),
    dhits AS (SELECT query_id, unit_id, rank, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) - 1)::INT AS rank FROM (
              SELECT u.question_id AS query_id, u.unit_id, round(coalesce(c.score, 0), 6) AS score FROM units u SEMI JOIN questions USING (question_id) LEFT JOIN cosine c ON c.question_id = u.question_id AND c.unit_id = u.unit_id) e) r WHERE rank < 100)"""

PRED = f"{TURNS}, {QUESTIONS}, pred AS (SELECT t.question_id, turn_index, content AS pred, question, gold, {normal('content')} AS p, {normal('gold')} AS g FROM turns t JOIN questions q ON t.question_id = q.question_id)"


def alternatives(c: str) -> str:
    text = f"regexp_replace(regexp_replace({c}, {quoted(ALSO_ACCEPTABLE)}, '', 'g'), {quoted(ABBREVIATION)}, '\\1\\2' || chr(57344), 'g')"
    parts = f"flatten(list_transform(string_split_regex({text}, '[.;]\\s+'), lambda s: string_split_regex(replace(s, chr(57344), '.'), '\\s+\\bor\\b\\s+')))"
    clean = f"list_filter(list_transform({parts}, lambda s: regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^[.;,]+|[.;,]+$', '', 'g')), lambda s: s <> '')"
    bare = "trim(regexp_replace(s, '\\([^)]*\\)', ' ', 'g'))"
    every = f"flatten(list_transform({clean}, lambda s: CASE WHEN {bare} <> '' AND {bare} <> s THEN [s, {bare}] ELSE [s] END))"
    return f"CASE WHEN len({every}) > 0 THEN {every} ELSE [{c}] END"


def enumerated(c: str) -> str:
    body = f"regexp_replace(regexp_replace(trim({c}), '\\.+$', ''), '\\s*\\band\\b\\s*', ', ', 'g')"
    items = f"list_filter(list_transform(string_split({body}, ','), lambda s: trim(s)), lambda s: s <> '')"
    return f"CASE WHEN len({items}) >= 3 AND len(list_filter({items}, lambda s: len(string_split_regex(s, '\\s+')) > 4)) = 0 THEN {items} ELSE [] END"


def answers(p: str, gold: str = "gold", question: str | None = "question") -> str:
    """Whether tokens p hold an answer; a question that asks for an order wants each item to start after the one before."""
    some = f"len(list_filter({alternatives(gold)}, lambda a: {contains(p, normal('a'))})) > 0"
    items = enumerated(gold)
    every = f"len(list_filter({items}, lambda i: NOT {contains(p, normal('i'))})) = 0"
    hay = f"(' ' || array_to_string({p}, ' ') || ' ')"
    steps = f"list_prepend({{'at': 0::BIGINT, 's': ''}}, list_transform({items}, lambda i: {{'at': 0::BIGINT, 's': ' ' || array_to_string({normal('i')}, ' ') || ' '}}))"
    found = f"instr(substr({hay}, a.at + 1), x.s)"
    in_order = f"list_reduce({steps}, lambda a, x: CASE WHEN a.at < 0 OR trim(x.s) = '' OR {found} = 0 THEN {{'at': -1::BIGINT, 's': ''}} ELSE {{'at': a.at + {found}, 's': ''}} END).at >= 0"
    asked = "false" if question is None else f"regexp_matches({question}, {quoted(ORDER_QUESTION)})"
    return f"({some} OR (len({items}) > 0 AND CASE WHEN {asked} THEN {in_order} ELSE {every} END))"


def graded(p: str, raw: str, gold: str = "gold", abstains: str = "false", question: str | None = "question") -> str:
    refuses = f"regexp_matches({raw}, {quoted(REFUSAL)})"
    return f"CASE WHEN {abstains} OR regexp_matches({gold}, {quoted(GOLD_ABSTAINS)}) THEN {refuses} WHEN len({normal(gold)}) > 12 THEN NULL WHEN {refuses} THEN false ELSE {answers(p, gold, question)} END"


SPELLED_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SPELLED.items()) + "}"
NUMBER_AT = "'^([^0-9]*)([0-9]+)(.*)$', {}, 's'"
HEAD, FIGURE, REST = (f"regexp_extract(gold, {NUMBER_AT.format(i)})" for i in (1, 2, 3))
MONTH_CUT = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(gold), '{m.lower()}') THEN regexp_replace(gold, '(?i){m}', '{m[:3]}', 'g') END" for m in AUDIT_MONTHS) + ")"
UNIT_OUT = "coalesce(" + ", ".join(f"CASE WHEN contains(gold, '{c}') THEN trim(replace(gold, '{c}', '')) || ' {w}' END" for c, w in UNIT_WORDS.items()) + ")"
LAST_WORDS = "list_filter(string_split_regex(regexp_replace(gold, '[.!? ]+$', ''), '\\s+'), lambda w: w <> '')"
LAST = f"coalesce({LAST_WORDS}[-1], '')"
PLURAL = f"""CASE WHEN regexp_matches({LAST}, '^[A-Za-z]{{4,}}$') AND NOT ends_with(lower({LAST}), 's') AND lower({LAST}) NOT IN ({", ".join(quoted(w) for w in SPELLED.values())})
    AND (lower({LAST}) = {LAST} OR lower({LAST}) IN ({", ".join(quoted(w) for w in WEEKDAYS)})) THEN array_to_string(list_append({LAST_WORDS}[1:-2], {LAST} || CASE WHEN regexp_matches(lower({LAST}), '(x|z|ch|sh)$') THEN 'es' ELSE 's' END), ' ') END"""
ITEMS = enumerated("gold")
ROTATED = f"CASE WHEN len({ITEMS}) >= 3 THEN array_to_string(list_append({ITEMS}[2:], 'and ' || {ITEMS}[1]), ', ') END"
ORDERED = f"regexp_matches(question, {quoted(ORDER_QUESTION)})"
ACCEPTED = f"coalesce({graded(normal('pred'), 'pred', question=None)}, false)"
AUDIT = f"""abst AS (SELECT question_id, array_to_string({WORDS}[1:8], ' ') AS question, 'The information provided is not enough.' AS gold FROM turns WHERE question_id LIKE '%\\_abs' ESCAPE '\\' AND turn_index = 0),
    able AS (SELECT * FROM questions WHERE len({normal('gold')}) <= 12 AND NOT regexp_matches(gold, {quoted(GOLD_ABSTAINS)})), aq AS (SELECT * FROM able ORDER BY question_id LIMIT 360),
    made AS (SELECT question_id, 'identity' AS kind, question, gold, gold AS pred, true AS expected FROM aq
    UNION ALL SELECT question_id, 'padded', question, gold, 'I believe the answer is ' || gold || ', based on our chat.', true FROM aq
    UNION ALL SELECT question_id, 'sentence', question, gold, 'The answer is ' || gold || '.', true FROM aq
    UNION ALL SELECT question_id, 'hard_number_word', question, gold, {HEAD} || {SPELLED_SQL}[{FIGURE}] || {REST}, true FROM aq
    UNION ALL SELECT question_id, 'hard_month_abbrev', question, gold, {MONTH_CUT}, true FROM aq
    UNION ALL SELECT question_id, 'hard_unit_expanded', question, gold, {UNIT_OUT}, true FROM aq
    UNION ALL SELECT question_id, 'hard_case_punct', question, gold, upper(gold) || '!!', true FROM aq
    UNION ALL SELECT question_id, 'hard_plural', question, gold, {PLURAL}, true FROM aq
    UNION ALL SELECT question_id, CASE WHEN {ORDERED} THEN 'reordered_ordered_list' ELSE 'hard_list_reorder' END, question, gold, {ROTATED}, NOT {ORDERED} FROM aq
    UNION ALL SELECT question_id, 'perturbed_number', question, gold, {HEAD} || (try_cast({FIGURE} AS BIGINT) + CASE WHEN length({FIGURE}) <= 3 THEN 7 ELSE 111 END) || {REST}, false FROM aq WHERE length({FIGURE}) <= 9
    UNION ALL SELECT question_id, 'refusal_to_answerable', question, gold, [{", ".join(quoted(r) for r in AUDIT_REFUSALS)}][('0x' || substr(md5(question_id), 1, 4))::INT % 5 + 1], false FROM aq
    UNION ALL SELECT question_id, 'empty', question, gold, '', false FROM aq),
    ring AS (SELECT question_type AS rt, gold AS pred, row_number() OVER (PARTITION BY question_type ORDER BY md5(question_id)) AS rr FROM aq),
    tried AS (SELECT question_id, question, gold, i, pred FROM (SELECT question_id, question_type, question, gold, row_number() OVER (PARTITION BY question_type ORDER BY md5(question_id)) AS r FROM aq) a, range(1, 7) t(i), ring WHERE rt = question_type AND rr = r + i),
    swaps AS (SELECT question_id, question, gold, arg_min(pred, i) AS pred FROM tried WHERE {normal('pred')} <> {normal('gold')} AND NOT {ACCEPTED} GROUP BY question_id, question, gold),
    cases AS (SELECT * FROM made WHERE pred IS NOT NULL AND (kind <> 'perturbed_number' OR NOT {ACCEPTED})
    UNION ALL SELECT question_id, 'swapped_gold', question, gold, pred, false FROM swaps
    UNION ALL SELECT question_id, 'correct_abstention', question, gold, unnest([{", ".join(quoted(r) for r in AUDIT_REFUSALS)}]), true FROM abst
    UNION ALL SELECT question_id, 'hallucinated_on_abstention', question, gold, pred, false FROM abst, (SELECT arg_min(gold, md5(question_id)) AS pred FROM able) c WHERE pred IS NOT NULL)"""
COSTED = f"costed AS (SELECT *, {count('text')} AS tokens, sum({count('text')}) OVER (PARTITION BY question_id) AS total FROM units)"


def greedy(source: str, order: str, fraction: float) -> str:
    """kept(question_id, ord) of a greedy fill, and ranked rows ``r`` with ord."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}) AS ord FROM {source}),
    f AS (SELECT question_id, list_reduce(list_prepend({{'u': 0::BIGINT, 't': 0::BIGINT, 'k': []::BIGINT[]}}, list({{'u': 0::BIGINT, 't': tokens::BIGINT, 'k': [ord]::BIGINT[]}} ORDER BY ord)),
            lambda a, x: CASE WHEN a.u + x.t <= b THEN {{'u': a.u + x.t, 't': 0::BIGINT, 'k': list_concat(a.k, x.k)}} ELSE a END).k AS k
          FROM (SELECT *, total * {fraction}::DOUBLE AS b FROM r) rb GROUP BY question_id, b),
    kept AS (SELECT r.* FROM r JOIN (SELECT question_id, unnest(k) AS ord FROM f) x ON x.question_id = r.question_id AND x.ord = r.ord)"""


SENTENCES = f"""{COSTED},
    cut AS (SELECT question_id, unit_id, total, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM costed),
    sent AS (SELECT question_id, unit_id, total, n, pos::INT AS pos, s AS sentence, {count('s')} AS tokens FROM (
        SELECT question_id, unit_id, total, len(p) AS n, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT *, CASE WHEN len(parts) > 0 THEN parts ELSE [text] END AS p FROM cut) c) s)"""


def by_sentence(order: str) -> str:
    return f"""WITH {UNITS}, {SENTENCES}, {greedy('sent', order, 0.25)},
        joined AS (SELECT question_id, unit_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM kept GROUP BY ALL)
        SELECT u.question_id, (row_number() OVER (PARTITION BY u.question_id ORDER BY u.unit_id) - 1)::INT AS unit_id, j.text, session_id, session_date, session_index, false AS is_evidence
        FROM units u JOIN joined j ON j.question_id = u.question_id AND j.unit_id = u.unit_id"""


def centrality() -> str:
    """depths(question_id, unit_id, pos, depth): sentences by damped power iteration over the cosines of a unit's sentences."""
    return f"""nn AS (SELECT question_id, count(*) AS n FROM sent GROUP BY question_id), tk AS (SELECT question_id, unit_id, pos, unnest({tokens('sentence')}) AS term FROM sent),
        df AS (SELECT question_id, term, count(DISTINCT (unit_id, pos)) AS df FROM tk GROUP BY ALL), idf AS (SELECT df.question_id, term, round(ln(n / (1 + df)::DOUBLE) + 1, 9) AS idf FROM df JOIN nn ON nn.question_id = df.question_id),
        w AS (SELECT question_id, unit_id, pos, term, count(*) * any_value(idf) AS w FROM tk JOIN idf USING (question_id, term) GROUP BY ALL), v AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY question_id, unit_id, pos)) AS z FROM w),
        cosine AS (SELECT a.question_id, a.unit_id, a.pos AS i, b.pos AS j, round(sum(a.w * b.w / (a.z * b.z)), 6) AS c FROM v a JOIN v b ON a.question_id = b.question_id AND a.unit_id = b.unit_id AND a.term = b.term AND a.pos <> b.pos GROUP BY ALL),
        edge AS (SELECT question_id AS eq, unit_id AS eu, i, j, c / sum(c) OVER (PARTITION BY question_id, unit_id, i) AS share FROM cosine WHERE c > 0),
        power(step, question_id, unit_id, pos, n, p, apart) AS (SELECT 0, question_id, unit_id, pos, n, 1.0::DOUBLE / n, 1.0::DOUBLE FROM sent SEMI JOIN edge ON eq = question_id AND eu = unit_id
            UNION ALL SELECT step + 1, question_id, unit_id, pos, n, q, sum(abs(q - p)) OVER (PARTITION BY question_id, unit_id) FROM (
                SELECT x.*, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(flow, 0) + sum(CASE WHEN lone THEN p ELSE 0 END) OVER (PARTITION BY question_id, unit_id) / n) AS q
                FROM (SELECT power.*, NOT EXISTS (SELECT 1 FROM edge WHERE eq = question_id AND eu = unit_id AND i = pos) AS lone FROM power WHERE step < 40 AND apart >= 1e-8) x
                LEFT JOIN (SELECT eq, eu, j, sum(p * share) AS flow FROM edge JOIN power ON eq = question_id AND eu = unit_id AND i = pos GROUP BY ALL) f ON eq = question_id AND eu = unit_id AND j = pos) y),
        last AS (SELECT question_id, unit_id, pos, arg_max(p, step) AS p FROM power GROUP BY ALL),
        depths AS (SELECT sent.*, row_number() OVER (PARTITION BY sent.question_id, sent.unit_id ORDER BY coalesce(round(p, 10), 0) DESC, sent.pos) - 1 AS depth FROM sent
            LEFT JOIN last ON last.question_id = sent.question_id AND last.unit_id = sent.unit_id AND last.pos = sent.pos)"""


def by_centrality(fraction: float = 0.25) -> str:
    return f"""WITH RECURSIVE {UNITS}, {SENTENCES}, {centrality()}, {greedy('depths', 'depth, unit_id', fraction)},
        joined AS (SELECT question_id, unit_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM kept GROUP BY ALL)
        SELECT u.question_id, (row_number() OVER (PARTITION BY u.question_id ORDER BY u.unit_id) - 1)::INT AS unit_id, j.text, session_id, session_date, session_index, false AS is_evidence
        FROM units u JOIN joined j ON j.question_id = u.question_id AND j.unit_id = u.unit_id"""


def truncated(order: str) -> str:
    return f"""WITH {UNITS}, {COSTED}, {greedy('costed', order, 0.25)}
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY unit_id) - 1)::INT AS unit_id, text, session_id, session_date, session_index, is_evidence FROM kept"""


ARMS = "arms AS (SELECT l.doc_id, lang, quality = 1 AS system, n_chars > 1000 AS control FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
CONT = f"""{ARMS}, cont AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE system AND control) AS "both", count(*) FILTER (WHERE system AND NOT control) AS system_only,
    count(*) FILTER (WHERE NOT system AND control) AS control_only, count(*) FILTER (WHERE NOT system AND NOT control) AS neither FROM arms WHERE system IS NOT NULL AND control IS NOT NULL GROUP BY lang)"""
LEDGER = """ledger AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS phase, count(*) AS calls, sum(length(coalesce(props, '')))::BIGINT AS tokens FROM events GROUP BY ALL)"""
METRIC_COLS = ", ".join(
    [f"round(avg(len(list_filter(ranks, lambda r: r < {k})) / n_evidence) FILTER (WHERE n_evidence > 0), 6) AS recall_{k}" for k in (1, 3, 5, 10, 20)]
    + [f"round(avg((len(list_filter(ranks, lambda r: r < {k})) > 0)::INT::DOUBLE) FILTER (WHERE n_evidence > 0), 6) AS any_hit_{k}" for k in (1, 3, 5, 10, 20)]
)

SQL: dict[str, str] = {
    "bm25_topk": f"WITH {BM25} SELECT query_id, unit_id, rank, score FROM hits WHERE rank < 10",
    "bm25_index_topk": f"WITH {BM25} SELECT query_id, unit_id, rank, score FROM hits WHERE rank < 10",
    "bm25_index_again": f"WITH benchmark AS (SELECT item_id, substr(text, length(text) // 2 + 1) AS text FROM main.benchmark), {BM25} SELECT query_id, unit_id, rank, score FROM hits WHERE rank < 10",
    "bm25_metrics": f"""WITH {BM25}, ev AS (SELECT item_id AS query_id, doc_id AS unit_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        f AS (SELECT query_id, list(rank ORDER BY rank) AS ranks FROM hits SEMI JOIN ev USING (query_id, unit_id) GROUP BY query_id),
        w AS (SELECT query_id, count(*) AS n_evidence FROM ev GROUP BY query_id),
        p AS (SELECT item_id, coalesce(n_evidence, 0) AS n_evidence, coalesce(ranks, []) AS ranks FROM benchmark LEFT JOIN w ON w.query_id = item_id LEFT JOIN f ON f.query_id = item_id)
        SELECT count(*) AS n_total, count(*) FILTER (WHERE n_evidence > 0) AS n_scorable, count(*) FILTER (WHERE n_evidence = 0) AS n_zero_evidence,
               round(avg(CASE WHEN len(ranks) > 0 THEN 1.0::DOUBLE / (ranks[1] + 1) ELSE 0 END) FILTER (WHERE n_evidence > 0), 6) AS mrr, {METRIC_COLS} FROM p""",
    "bm25_idf": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_postings": f"WITH {BM25} SELECT unit_id, term, tf, dl FROM post",
    "dense_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS unit_id, round(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b), 6) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)
        SELECT query_id, unit_id, rank, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) - 1)::INT AS rank FROM s) r WHERE rank < 10""",
    "units_turn": f"WITH {UNITS} SELECT {UNIT_COLS} FROM units",
    "units_user_turn": f"""WITH {TURNS} SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY turn_index) - 1)::INT AS unit_id, content AS text,
        session_id, session_date, session_index, has_answer AS is_evidence FROM turns WHERE role = 'user'""",
    "units_session": f"""WITH {TURNS}, s AS (SELECT question_id, session_id, min(turn_index) AS first, string_agg(role || ': ' || content, chr(10) ORDER BY turn_index) AS text,
        arg_min(session_date, turn_index) AS session_date, arg_min(session_index, turn_index) AS session_index, bool_or(has_answer) AS is_evidence FROM turns GROUP BY ALL)
        SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY first) - 1)::INT AS unit_id, text, session_id, session_date, session_index, is_evidence FROM s""",
    "store_check": f"""WITH {UNITS} SELECT question_id, count(*) AS n_units, min(unit_id) = 0 AND max(unit_id) = count(*) - 1 AND count(DISTINCT unit_id) = count(*) AS contiguous,
        count(*) FILTER (WHERE {DATE} IS NULL) AS bad_dates FROM units GROUP BY question_id""",
    "stratified_subset": """WITH s AS (SELECT doc_id, lang, md5('0|' || doc_id) AS draw, greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 50.0::DOUBLE / count(*) OVER (), 0)) AS quota FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw) AS nth FROM s) SELECT doc_id, lang FROM n WHERE nth <= quota ORDER BY draw LIMIT 50""",
    "question_bm25_topk": f"WITH {UNITS}, {QUESTIONS}, {QBM25} SELECT * FROM qhits WHERE rank < 10",
    "recency_topk": f"WITH {UNITS} " + ranked(f"{NEWEST}, unit_id DESC", "-rank::DOUBLE", 10),
    "recency_ranking_hybrid": f"WITH {UNITS} " + ranked(f"{NEWEST}, unit_id", "-rank::DOUBLE", 10),
    "oracle_topk": f"WITH {UNITS} " + ranked("is_evidence DESC, unit_id", "is_evidence::INT::DOUBLE", 10),
    "random_topk": f"WITH {UNITS} " + ranked("md5('0|' || question_id || '|' || unit_id)", "0.0::DOUBLE", 10),
    "none_topk": f"WITH {UNITS} SELECT question_id AS query_id, unit_id, 0::INT AS rank, 0.0::DOUBLE AS score FROM units WHERE false",
    "rrf_fuse": f"WITH {UNITS} " + fused([(ORACLE_ALL, 1.0), (RECENT_ALL, 1.0)]),
    "rrf_weighted": f"WITH {UNITS} " + fused([(ORACLE_ALL, 1.0), (RECENT_ALL, 0.25)]),
    "rrf_zero_weight": f"WITH {UNITS} " + fused([(ORACLE_ALL, 1.0)]),
    "question_dense_topk": f"WITH {UNITS}, {QUESTIONS}, {QDENSE} SELECT * FROM dhits WHERE rank < 10",
    "hybrid_topk": f"WITH {UNITS}, {QUESTIONS}, {QBM25}, {QDENSE} " + fused([("SELECT * FROM qhits", 1.0), ("SELECT * FROM dhits", 1.0), (f"SELECT x.* FROM ({RECENT_ALL}) x SEMI JOIN questions ON questions.question_id = x.query_id", 0.5)]),
    "cached_hybrid_topk": f"WITH {UNITS}, {QUESTIONS}, {QBM25}, {QDENSE} " + fused([("SELECT * FROM qhits", 1.0), ("SELECT * FROM dhits", 1.0), (f"SELECT x.* FROM ({RECENT_ALL}) x SEMI JOIN questions ON questions.question_id = x.query_id", 0.5)]),
    "cache_replay": f"""WITH {UNITS}, {QUESTIONS}, u AS (SELECT DISTINCT text FROM units), q AS (SELECT DISTINCT question AS text FROM questions), wanted AS (SELECT text FROM u UNION ALL SELECT text FROM q),
        fresh AS (SELECT DISTINCT text FROM wanted), c AS (SELECT (SELECT count(*) FROM wanted) AS asked, (SELECT sum({count('text')}) FROM wanted)::BIGINT AS tokens, (SELECT count(*) FROM fresh) AS made, (SELECT sum({count('text')}) FROM fresh)::BIGINT AS made_tokens)
        SELECT 0 AS run, asked - made AS hits, made AS misses, tokens - made_tokens AS replayed_tokens, made_tokens AS measured_tokens, asked > made AS used_replayed_timings FROM c
        UNION ALL SELECT 1, asked, 0, tokens, 0, asked > 0 FROM c""",
    "normalize_tokens": f"""SELECT conv_id, turn, array_to_string({normal("coalesce(text, '')")}, ' ') AS tokens FROM conversations""",
    "is_refusal": f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), {quoted(REFUSAL)}) AS refusal FROM conversations",
    "grade": f"WITH {PRED} SELECT question_id, turn_index, {graded('p', 'pred')} AS correct FROM pred",
    "token_f1": f"""WITH {PRED}, c AS (SELECT *, list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) AS common FROM pred)
        SELECT question_id, turn_index, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2.0::DOUBLE * coalesce(common, 0) / (len(p) + len(g)) END, 6) AS f1 FROM c""",
    "length_decay": f"""WITH {PRED}, capped AS (SELECT role AS arm, cap, question, gold, CASE WHEN cap = 0 THEN pred ELSE array_to_string(list_filter(string_split_regex(pred, '\\s+'), lambda w: w <> '')[1:cap], ' ') END AS short
            FROM pred JOIN turns USING (question_id, turn_index), (VALUES (0), (8), (15), (25), (40)) v(cap))
        SELECT arm, cap, count(*) AS n, count(*) FILTER (WHERE {graded(normal('short'), 'short')}) AS correct FROM capped GROUP BY arm, cap""",
    "gold_alternatives": f"""SELECT conv_id, turn, array_to_string({alternatives("coalesce(text, '')")}, '|') AS alternatives, array_to_string({enumerated("coalesce(text, '')")}, '|') AS items FROM conversations""",
    "audit_cases": f"WITH {TURNS}, {QUESTIONS}, {AUDIT} SELECT * FROM cases",
    "grader_audit": f"""WITH {TURNS}, {QUESTIONS}, {AUDIT}, v AS (SELECT *, {graded(normal('pred'), 'pred', abstains="ends_with(kind, 'abstention')")} AS verdict FROM cases)
        SELECT kind, count(*) AS n, count(*) FILTER (WHERE verdict = expected) AS right, count(*) FILTER (WHERE verdict AND NOT expected) AS false_accepts,
               count(*) FILTER (WHERE NOT verdict AND expected) AS false_rejects FROM v WHERE verdict IS NOT NULL GROUP BY kind""",
    "truncated_recency": truncated(f"{NEWEST}, unit_id DESC"),
    "truncated_random": truncated("md5('1|' || question_id || '|' || unit_id)"),
    "token_budget": f"WITH {UNITS}, {COSTED} SELECT question_id, max(total)::BIGINT AS total, max(total) * 0.25::DOUBLE AS budget FROM costed GROUP BY question_id",
    "sentence_split": f"WITH {UNITS}, {SENTENCES} SELECT question_id, unit_id, pos, sentence FROM sent",
    "leadk": by_sentence("pos, unit_id"),
    "tailk": by_sentence("n - pos, unit_id"),
    "lexrank": by_centrality(),
    "sentence_idf": f"""WITH {UNITS}, {SENTENCES}, n AS (SELECT question_id, count(*) AS n FROM sent GROUP BY question_id),
        d AS (SELECT question_id, term, count(*) AS df FROM (SELECT question_id, unnest(list_distinct({tokens('sentence')})) AS term FROM sent) x GROUP BY ALL)
        SELECT d.question_id, term, df, round(ln(n / (1 + df)::DOUBLE) + 1, 6) AS idf FROM d JOIN n ON n.question_id = d.question_id""",
    "contingency": f"WITH {CONT} SELECT * FROM cont",
    "mcnemar": f"""WITH {CONT} SELECT lang, round(CASE WHEN system_only + control_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(system_only, control_only) + 1),
        lambda i: exp(lgamma(system_only + control_only + 1) - lgamma(i + 1) - lgamma(system_only + control_only - i + 1) - (system_only + control_only) * ln(2))))) END, 9) AS p FROM cont""",
    "lift_report": f"""WITH {CONT}, a AS (SELECT lang, n, ("both" + system_only) / n::DOUBLE AS s, ("both" + control_only) / n::DOUBLE AS c FROM cont)
        SELECT lang, n, round(s, 6) AS system_accuracy, round(c, 6) AS control_accuracy, round(s - c, 6) AS lift, round(CASE WHEN s > 0 THEN (s - c) / s END, 6) AS attributable FROM a""",
    "cohens_kappa": f"""WITH {ARMS}, m AS (SELECT count(*) AS n, avg((system = control)::INT) AS a, avg(system::INT) AS h, avg(control::INT) AS j, avg(CASE WHEN NOT system THEN control::INT END) AS fa
        FROM arms WHERE system IS NOT NULL AND control IS NOT NULL), e AS (SELECT *, h * j + (1 - h) * (1 - j) AS pe FROM m)
        SELECT n, round(a, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (a - pe) / (1 - pe) END, 6) AS kappa, round(fa, 6) AS false_accept FROM e""",
    "bootstrap_ci": f"""WITH {ARMS}, v AS (SELECT row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1024, md5(doc_id::VARCHAR)) - 1 AS pos, system::INT - control::INT AS value FROM arms WHERE system IS NOT NULL AND control IS NOT NULL),
        n AS (SELECT count(*) AS n, avg(value) AS point FROM v),
        dr AS (SELECT b, ('0x' || substr(md5('0|' || b || '|' || pos), 1, 8))::BIGINT % n AS pos FROM range(10000) r(b), v, n),
        m AS (SELECT b, avg(value) AS m FROM dr JOIN v ON v.pos = dr.pos GROUP BY b), o AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS r FROM m)
        SELECT n, round(point, 6) AS point, round((SELECT m FROM o WHERE r = 250), 6) AS lo, round((SELECT m FROM o WHERE r = 9750), 6) AS hi FROM n""",
    "token_stats": f"""WITH t AS (SELECT lang, {count("coalesce(text, '')")}::BIGINT AS tokens FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM t)
        SELECT lang, count(*) AS n, round(avg(tokens), 6) AS mean, max(tokens) FILTER (WHERE r = floor(0.5::DOUBLE * n)) AS median, max(tokens) FILTER (WHERE r = floor(0.9::DOUBLE * n)) AS p90, max(tokens) AS max FROM r GROUP BY lang""",
    "ledger_rollup": f"WITH {LEDGER} SELECT user_id, phase, calls, tokens, round(tokens * 0.15::DOUBLE / 1000000::DOUBLE, 9) AS dollars FROM ledger",
    "amortisation": f"""WITH {LEDGER}, o AS (SELECT coalesce(sum(tokens) FILTER (WHERE phase = 'write'), 0) AS w, sum(tokens) FILTER (WHERE phase = 'read') / (sum(calls) FILTER (WHERE phase = 'read'))::DOUBLE AS r FROM ledger)
        SELECT n_queries, round(w + n_queries * r, 6) AS tokens FROM range(1, 101) x(n_queries), o""",
    "batches_pair": f"""WITH {TURNS}, b AS (SELECT *, ((row_number() OVER (PARTITION BY question_id, session_id ORDER BY turn_index) - 1) // 2)::INT AS batch FROM turns)
        SELECT question_id, session_id, batch, count(*) AS n_turns, min(turn_index) AS first_turn, sum({count('content')})::BIGINT AS tokens FROM b GROUP BY ALL""",
    "resent_context": f"""WITH {TURNS} SELECT question_id, turn_index, coalesce(sum({count('content')}) OVER (PARTITION BY question_id ORDER BY turn_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS resent FROM turns""",
    "grader_rates": f"""WITH {TURNS}, {QUESTIONS}, {AUDIT}, v AS (SELECT *, {graded(normal('pred'), 'pred', abstains="ends_with(kind, 'abstention')")} AS v FROM cases), g AS (SELECT *, starts_with(kind, 'hard_') AS hard FROM v)
        SELECT count(*) AS n_cases, count(v) AS n_graded, round(avg((v = expected)::INT), 6) AS accuracy, round(avg(v::INT) FILTER (WHERE NOT expected), 6) AS false_accept_rate,
            round(avg((NOT v)::INT) FILTER (WHERE expected), 6) AS false_reject_rate, round(avg((NOT v)::INT) FILTER (WHERE expected AND hard), 6) AS false_reject_rate_hard FROM g""",
    "prompt_render": f"""WITH {UNITS}, h AS ({ranked(f"{NEWEST}, unit_id DESC", "0", 3)}) SELECT query_id, string_agg('[' || session_date || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM h JOIN units u ON u.question_id = h.query_id AND u.unit_id = h.unit_id GROUP BY query_id""",
    "parse_session_date": f"WITH {TURNS} SELECT DISTINCT session_id, session_date, {DATE} AS date_key FROM turns",
    "embed_cache_hits": f"""WITH {UNITS}, mine AS (SELECT question_id, unit_id, text, 'turn' AS granularity FROM units UNION ALL
            SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY turn_index) - 1, content, 'user_turn' FROM turns WHERE role = 'user'),
        g AS (SELECT granularity, question_id, count(*) AS n, string_agg(text || chr(0), '' ORDER BY unit_id) AS body FROM mine GROUP BY ALL),
        k AS (SELECT *, left(sha1('m|' || question_id || '|' || n || '|' || left(sha1(body), 16)), 20) AS key, regexp_extract(question_id, '\\d+')::INT AS number FROM g),
        c AS (SELECT DISTINCT key, n - CASE WHEN number % 4 = 0 THEN 1 ELSE 0 END AS n_vectors, n AS cost FROM k WHERE granularity = 'turn' AND number % 2 = 0),
        h AS (SELECT granularity, coalesce(n_vectors = n, false) AS hit, c.cost FROM k LEFT JOIN c ON c.key = k.key)
        SELECT granularity, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, coalesce(sum(cost) FILTER (WHERE hit), 0)::BIGINT AS replayed_cost FROM h GROUP BY granularity""",
    "oracle_gap_pivot": f"WITH {ARMS} SELECT lang, round(avg(system::INT), 6) AS system, round(avg(control::INT), 6) AS control FROM arms GROUP BY lang",
}
