"""Queries and DuckDB SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import ann, html_text, jaccard, langid, lines, maxent, merkle, mixing, packing, phrases, quality, suffixes, toxicity
from memspark.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels tell low quality and toxicity; the chain predicts them in this order."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.score(table(spark, sf_dir, "documents"), labels, {"low_quality": "1 - quality", "toxic": "toxic"})


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=8)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), max_len=1024)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the column lang is the declaration, the source is the host."""
    out = langid.identify(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"))
    return out.select("doc_id", "lang_id", "confidence", "accepted")


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: markup language, address suffix and host all give evidence."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)
    rows = pages.withColumns({"text": body, "markup": F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1), "site": host})
    blank = lambda c: F.when(F.col(c) != "", F.lower(c))
    suffix = F.regexp_extract("site", r"\.([A-Za-z]+)$", 1)
    out = langid.identify(rows, blank("markup"), blank("site"), F.when(suffix != "", F.lower(suffix)))
    return out.select("page_id", "lang_id", "confidence", "accepted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).drop("rejected_by")


def op11_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows against their manifest; a third of the texts is tampered with."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verify(table(spark, sf_dir, "documents"), F.when(hit, small))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ann, op2_toxicity, op3_html, op4_line_dedup, op5_jaccard, op6_lm_score, op7_packing, op8_mixing, op9_language_id, langid_pages, op10_quality, op11_suffix, op12_merkle, op13_phrases)
}

CRC32 = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend((1000 + ascii(c))::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[])))),
    lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"""


def leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL: dict[str, str] = {
    "op1_ann": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        asked AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
            FROM asked q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_line_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce('s' || source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        l AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM pieces),
        b AS (SELECT line, min(doc_id) AS keeper FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8),
        m AS (SELECT l.*, b.line IS NOT NULL AND NOT (b.keeper IS NOT DISTINCT FROM l.doc_id
                     AND l.pos = min(l.pos) OVER (PARTITION BY l.doc_id, l.line)) AS gone
              FROM l LEFT JOIN b ON l.line = b.line),
        t AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
                     count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM m GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
        FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op5_jaccard": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                     ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM w),
        g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r(doc_id, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x)
        SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, c.component_id
        FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id""",
    "op10_quality": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
        g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM p),
        twice AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
        pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
        full_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS n_lines,
                              count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{2022}]')) AS n_bullet,
                              count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) AS n_open
                       FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        each AS (SELECT doc_id, unnest(words) AS word FROM w),
        top AS (SELECT doc_id, max(k) AS n FROM (SELECT doc_id, word, count(*) AS k FROM each GROUP BY doc_id, word) t GROUP BY doc_id),
        alpha AS (SELECT doc_id, count(*) AS n FROM each WHERE regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]') GROUP BY doc_id),
        c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(f.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                     coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet, 0) AS n_bullet, coalesce(n_open, 0) AS n_open, coalesce(alpha.n, 0) AS n_alpha, coalesce(top.n, 0) AS n_top
              FROM w LEFT JOIN covered r ON w.doc_id = r.doc_id LEFT JOIN full_lines f ON w.doc_id = f.doc_id
              LEFT JOIN alpha ON w.doc_id = alpha.doc_id LEFT JOIN top ON w.doc_id = top.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > n_words
                    OR 10 * n_bullet > 9 * n_lines OR 10 * n_open > 3 * n_lines
                    OR 10 * n_alpha < 6 * n_words OR 10 * n_top > 4 * n_words) AS kept FROM b""",
    "op12_merkle": f"""
        WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf_sql('text')} AS leaf, CASE WHEN xor({CRC32}, 4294967295) % 3 = 0 THEN {leaf_sql(LOWER)} ELSE leaf END AS seen FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id FROM d),
        t(tree, g, level, w, idx, digest) AS (SELECT 0, g, 0, n, idx, leaf FROM r
            UNION ALL SELECT tree, g, level + 1, (w + 7) // 8, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE w > 1 GROUP BY tree, g, level, w, idx // 8),
        top0 AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS w FROM t WHERE w = 1),
        u(g, level, w, idx, digest) AS (SELECT '', 0, w, idx, digest FROM top0
            UNION ALL SELECT g, level + 1, (w + 7) // 8, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE w > 1 GROUP BY g, level, w, idx // 8),
        runs AS (SELECT g, level, idx // 8 AS parent, list(digest ORDER BY idx) AS kids FROM (SELECT g, level, w, idx, digest FROM t) x WHERE w > 1 GROUP BY ALL),
        above AS (SELECT level, idx // 8 AS parent, list(digest ORDER BY idx) AS kids FROM u WHERE w > 1 GROUP BY ALL),
        f(id, g, level, idx, h, proof) AS (SELECT id, g, 0, idx, seen, '' FROM r
            UNION ALL SELECT id, f.g, f.level + 1, idx // 8, sha256(array_to_string(kids[:idx % 8] || [h] || kids[idx % 8 + 2:], '')), proof || array_to_string(kids[:idx % 8] || kids[idx % 8 + 2:], '')
            FROM f JOIN runs ON runs.g = f.g AND runs.level = f.level AND runs.parent = idx // 8),
        sub AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof, any_value(g) AS g FROM f GROUP BY id),
        e(id, level, idx, h, proof) AS (SELECT id, 0, top0.idx, h, proof FROM sub JOIN top0 ON top0.g = sub.g
            UNION ALL SELECT id, e.level + 1, idx // 8, sha256(array_to_string(kids[:idx % 8] || [h] || kids[idx % 8 + 2:], '')), proof || array_to_string(kids[:idx % 8] || kids[idx % 8 + 2:], '')
            FROM e JOIN above ON above.level = e.level AND above.parent = idx // 8),
        z AS (SELECT id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM e GROUP BY id)
        SELECT doc_id, leaf, top0.digest AS subroot, whole.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = whole.digest AS verified
        FROM r JOIN z ON z.id = r.id JOIN top0 ON top0.g = r.g, (SELECT digest FROM u WHERE w = 1) whole""",
    "op13_phrases": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        f AS (SELECT lang, g, k, count(*) AS a FROM (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, range(1, 5) r(k) WHERE len(w) >= k) x GROUP BY ALL),
        c AS (SELECT lang, g AS phrase, string_split(g, ' ') AS w, k AS size, a FROM f WHERE k > 1 AND a >= 30),
        cut AS (SELECT c.*, i, array_to_string(w[:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM c, range(1, 4) r(i) WHERE i < size),
        s AS (SELECT cut.lang, phrase, cut.a, i, x.a AS l, y.a AS r, cut.a::HUGEINT * 2000000 // (x.a + y.a) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.g = head AND x.k = i JOIN f y ON y.lang = cut.lang AND y.g = tail AND y.k = size - i),
        low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        longer AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS within FROM c, range(2, 4) r(k), range(1, 4) q(i) WHERE k < size AND i + k - 1 <= size GROUP BY 1, 2),
        kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase WHERE within IS NULL OR 100::HUGEINT * within < 80::HUGEINT * a)
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000""",
}
