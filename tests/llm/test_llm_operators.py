"""Training-data operators on small tables with nulls, ties, repeats, empty tables
and clashing columns, against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import ann, html_text, jaccard, langid, lines, maxent, mixing, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(t or "")


def odd_texts():
    rng = random.Random(3)
    vocab = ["the", "of", "Größe", "été", "x", "Word", "a#b", "日本", "run", "far", "idle", "blue"]
    base = [" ".join(rng.choices(vocab, k=n)) for n in (60, 45, 200, 12, 4, 3)]
    near = base[0].split()
    near[3] = "changed"
    out = [*base, " ".join(near), base[0], base[0].upper(), None, "", " \n\t ", "one", "one two", "x\n\nx\nlong line here\nlong line here\n", " nbsp wide", "y" * 5000, " ".join(rng.choices(vocab, k=30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, ["en", "de", None][i % 3], [f"s{i % 9}", None][i % 7 == 0], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id text here with words", "en", "s1", 0)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ann_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 8)).astype(np.float32)
    base[20:60] = base[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None] * 4, 0), (904, [float("inf")] * 8, 0), (None, base[0].tolist(), 0), (0, base[0].tolist(), 0), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=20, block_rows=16, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = base.astype(np.float64)
    for q in range(0, 150, 20):
        s = np.zeros(150)
        for d in range(8):
            s += x[q, d] * x[:, d]
        # the row of id 0 stands twice in the table and is a candidate each time
        want = sorted((-s[i], i) for i in [0, *range(150)] if i != q)[:20]
        assert got[q] == [(i, -v) for v, i in want]
    few = spark.createDataFrame(rows[:3], df.schema)
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), *[(20, [2.0, 0.0])] * 45, (21, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])], "vec_id long, embedding array<float>")
    # rows that share an id, and repeats: the query 20 has the vectors (1, 0) and (2, 0)
    found = ann.nearest(twice, F.col("id") == 20, k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 10.0), (2, 6.0), (2, 6.0), (1, 5.0), (21, 4.0), (2, 3.0), (2, 3.0), (1, 2.0), (21, 2.0), (1, 1.0)]
    assert ann.nearest(few, F.col("id") % 20 == 0).count() == 2
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site name of the newspaper</h1></header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>A &amp; B</h1></header><p>First   paragraph of<br>text&nbsp;here.</p><p>En.</p><div class="ad">Buy</div><form>Email <input></form><ul><li>one</li><li>two</ul>
    <p><b>Unclosed<p>Last</p></article><aside>More</aside><section class="comments"><p>I think that this is a very long comment.</p></section><footer>&copy; 2024</footer>"""
    assert html_text.main_text(page) == "A & B\nFirst paragraph of text here.\nEn.\none\ntwo\nUnclosed\nLast"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain", "<p>cut <b")] == ["", "", "", "plain", "cut"]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>"), (2, None, None), (1, "u", "<p>a b</p>")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_lines", [1000, 1, 0])
def test_lines_match_brute_force(spark, empty, broadcast_lines):
    rows = [(i, f"own {i}\n  shared line \nend {i}\n\nshared line", "en", [f"s{i % 6}", None][i == 4], 0) for i in range(9)]
    rows += [(20, "rare\nrare", "en", "s0", 0), (21, None, "en", "s1", 0), (22, "", "en", "s2", 0), rows[2]]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_removed", F.lit("clash"))
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_boilerplate(df, min_sites=5, broadcast_lines=broadcast_lines).collect() if r.text is not None)
    want = [(0, "own 0\n  shared line \nend 0\n", 4, 1), *[(i, f"own {i}\nend {i}\n", 4, 2) for i in range(1, 9)], (2, "own 2\nend 2\n", 4, 2), (20, "rare\nrare", 2, 0), (22, "", 0, 0)]
    assert got == sorted(want)
    assert lines.remove_boilerplate(empty, broadcast_lines=broadcast_lines).count() == 0


def test_line_removal_does_not_depend_on_what_is_broadcast(spark):
    rng = random.Random(11)
    shared = [f"shared line {i}" for i in range(30)]
    # line i is on about 40 / (i + 1) documents: some are frequent, some just over the threshold
    rows = []
    for d in range(60):
        parts = [f"own {d} {k}" for k in range(3)] + [t for i, t in enumerate(shared) if rng.random() < 1.5 / (1 + i / 3)] * rng.choice([1, 2])
        rng.shuffle(parts)
        rows.append((d, "\n".join(parts), "en", f"s{d % 12}", 0))
    df = spark.createDataFrame(rows, DOCS)
    by = lambda n: sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_boilerplate(df, min_sites=6, broadcast_lines=n).collect())
    whole = by(1000)
    assert whole == by(0) == by(7) and sum(r[3] for r in whole) > 100


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard_matches_brute_force(spark, docs, empty, n, num):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    extra = []
    for i in range(60):
        t = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            t[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        extra.append((100 + i, " ".join(t), "en", "s", 0))
    df = docs.unionByName(spark.createDataFrame(extra, DOCS)).withColumn("component_id", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, n, num, 100).collect()), key=str)
    assert got == want
    assert jaccard.near_duplicates(empty, n, num, 100).count() == 0


@pytest.mark.parametrize("limit", [1000, 0])
def test_lm_base_matches_brute_force(docs, empty, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toks = [[*words(lower(t or "")), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    count: dict = {}
    for t, h in zip(toks, held, strict=True):
        for w in t if not h else ():
            count[w] = count.get(w, 0) + 1
    total, v = sum(count.values()), len(count)
    base = [float(sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in t)) for t in toks]
    want = sorted(((d, h, len(t), sum(w in count for w in t), total, round(b, 4)) for (d, _), h, t, b in zip(rows, held, toks, base, strict=True)), key=str)
    scored = maxent.score(docs.withColumn("score", F.lit("clash")), broadcast_tokens=limit).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored), key=str) == want
    assert all(r.score < 0 for r in scored)
    assert maxent.score(empty, broadcast_tokens=limit).count() == 0


def test_lm_scores_do_not_depend_on_what_is_broadcast(docs):
    by = lambda limit: sorted(((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in maxent.score(docs, broadcast_tokens=limit).collect()), key=str)
    assert by(1000) == by(0) == by(8)


def test_lm_learns_from_history(spark):
    rng = random.Random(2)
    follows = {f"v{i}": [f"v{(7 * i + k) % 60}" for k in range(3)] for i in range(60)}

    def text(n):
        out = [f"v{rng.randrange(60)}"]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    rows = [(i, text(80)) for i in range(600)]
    got = maxent.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    held = [r for r in got if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    # a token is one of three after its predecessor, one of sixty without it
    assert per_token("base_score") < -1.7 and per_token("score") > per_token("base_score") + 0.6


def test_lm_probabilities_sum_to_one(spark):
    """Over all known tokens, the end and an unknown token in every part, after one history."""
    words_ = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(200)]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words_, k=30))) for i in range(300)]
    probe = [(10_000 + 5 * i, w) for i, w in enumerate(words_)]
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    held = [d for d in range(20_000, 60_000) if zlib.crc32(str(d).encode()) % 5 == 1]
    df = spark.createDataFrame([*train, *zip(held, ["", *[w for _, w in probe]], strict=False)], "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score(df).collect()}
    # a one-word text's probability is that of the word after the start and of the end after it: under one in sum
    total = sum(10 ** got[d].score for d, _ in zip(held, range(len(words_) + 1), strict=False))
    assert 0 < total <= 1.0 + 1e-6


def test_packing_ids_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "<|endoftext| >", "a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000, "x \u3000" * 50_000, "\u3000" * packing.LONG_SPACE]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got: dict[int, list[int]] = {}
    for r in packing.pack(rows, path, 1 << 16, with_ids=True).orderBy("doc_id", "start").toLocalIterator():
        got.setdefault(r.doc_id, []).extend(r.ids)
    slow = Tokenizer.from_file(path)
    assert slow.encode(texts[0], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    for i, text in enumerate(texts):
        assert got[i] == [*slow.encode(text, add_special_tokens=False).ids, 0]


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    # null ids, repeated rows and clashing columns: every row is packed for itself
    every = packing.pack(docs.withColumn("length", F.lit("clash")).withColumn("start", F.lit(9)), path, 256, with_ids=True).collect()
    flat = lambda rows: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    singly = [r for part in docs.collect() for r in packing.pack(spark.createDataFrame([part], DOCS), path, 256).collect()] if docs.count() < 40 else []
    assert flat(every) == flat(singly) and len({r.sequence_id for r in every}) == len(every)
    got = packing.pack(one, path, 256, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 256 for r in got)
    for row in one.collect():
        pieces = sorted((r for r in got if r.doc_id == row.doc_id), key=lambda r: r.start)
        ids = [i for p in pieces for i in p.ids]
        assert ids == [*slow.encode(row.text or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces[:-1]]]))
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.doc_tokens == len(ids) for p in pieces)
    assert packing.pack(empty, path).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(empty, path, 1000)


def waterfill(sizes, weights, cap):
    """Targets by resharing the excess round after round."""
    total, target, fixed = sum(sizes), [0.0] * len(sizes), [s == 0 for s in sizes]
    while True:
        left = total - sum(cap * s for s, f in zip(sizes, fixed, strict=True) if f)
        w = sum(x for x, f in zip(weights, fixed, strict=True) if not f)
        target = [cap * s if f else left * x / w for s, x, f in zip(sizes, weights, fixed, strict=True)]
        over = [i for i, f in enumerate(fixed) if not f and target[i] > cap * sizes[i] + 1e-9]
        if not over:
            return target
        for i in over:
            fixed[i] = True


def test_mixing(spark, docs, empty):
    df = docs.withColumn("taken", F.lit("clash"))
    rows = mixing.mix(df, block_docs=2).collect()
    again = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(df, block_docs=2).collect()), key=str)
    assert again == sorted(((r.doc_id, r.size, r.taken) for r in rows), key=str)
    per: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and sum(d.words for d in r.draws) == r.taken
        per.setdefault(r.source, []).append(r)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in per[s]) for s in names]
    want = waterfill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, w in zip(names, want, strict=True):
        assert per[s][0].target == pytest.approx(w) and sum(r.taken for r in per[s]) == round(w)
    mixed = mixing.mixed_rows(docs, block_docs=2)
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_shards_are_disjoint_draws_with_exact_quotas(spark, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 5), f"s{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(df, shards=5, block_docs=8).select("doc_id", "source", F.explode("draws").alias("d")).select("doc_id", "source", "d.*").collect()
    # each draw of a document (its pass) stands in one shard only, and every shard has part of every source's blocks
    assert len({(r.doc_id, r["pass"]) for r in drawn}) == len(drawn) and {r.shard for r in drawn} == set(range(5))
    per = {k: sum(r.shard == k for r in drawn) for k in range(5)}
    assert max(per.values()) < 2 * min(per.values())
    mixing.write_shards(mixing.mixed_rows(df, shards=5, block_docs=8), str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == len(drawn) and sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in drawn)


def test_splitting_tree_is_exact():
    draws = np.array([1000, 0, 7, 313])
    quota = mixing.split_tree(draws, 12, np.random.default_rng(0))
    assert (quota.sum(axis=0) == draws).all() and quota.min() >= 0 and np.ptp(quota.sum(axis=1)) <= 4


def test_language_id(spark, empty):
    rng = random.Random(5)
    vocab = {"en": ["the", "and", "this", "with", "from", "thing"], "de": ["der", "und", "nicht", "schön", "über", "zeit"]}
    rows = [(i, " ".join(rng.choices(vocab[l], k=20)), l, f"h{i % 4}", 0) for i in range(80) for l in (["en", "de"][i % 2],)]
    rows += [(100, "der und nicht schön über zeit der und nicht", "en", "h0", 0), (101, None, "en", None, 0), (102, "123 456", "de", "h1", 0), (103, "the and this", None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("confidence", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, F.col("lang"), F.col("source")).collect()}
    assert all(got[r[0]].lang_id == r[2] and got[r[0]].accepted for r in rows[:80])
    assert got[100].lang_id == "de" and got[103].lang_id == "en" and not got[101].accepted and not got[102].accepted
    assert langid.identify(empty, F.col("lang"), F.col("source")).count() == 0
    assert langid.identify(df, F.lit(None), F.col("source")).where("accepted").count() == 0


def test_langid_models_every_declared_language(spark):
    rng = random.Random(5)
    # 150 languages of own letters each; the last ones are the rarest
    names = [f"l{i:03d}" for i in range(150)]
    vocab = [["".join(chr(0x4E00 + 40 * i + rng.randrange(40)) for _ in range(3)) for _ in range(12)] for i in range(150)]
    rows = [(100 * i + k, " ".join(rng.choices(vocab[i], k=40)), names[i], f"h{k}", 0) for i in range(150) for k in range(12 if i < 80 else 8)]
    rows += [(100_000 + i, " ".join(rng.choices(vocab[i], k=40)), None, None, 0) for i in range(150)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in langid.identify(df, F.col("lang"), F.col("source")).collect()}
    assert all(got[r[0]].lang_id == r[2] and got[r[0]].accepted for r in rows if r[2])
    assert all(got[100_000 + i].lang_id == names[i] for i in range(150))


def test_langid_pieces_do_not_change_the_posterior(spark, monkeypatch):
    rng = random.Random(6)
    vocab = {f"l{i}": ["".join(rng.choices("abcdefgh", k=4)) for _ in range(6)] for i in range(7)}
    rows = [(i, " ".join(rng.choices(vocab[f"l{i % 7}"], k=5)), f"l{i % 7}" if i % 5 else None, f"h{i % 3}" if i % 4 else None, 0) for i in range(140)]
    df = spark.createDataFrame(rows, DOCS)
    found = lambda: {r.doc_id: r for r in langid.identify(df, F.col("lang"), F.col("source")).collect()}
    whole = found()
    score = {k: (r.lang_id, r.accepted) for k, r in whole.items()}
    monkeypatch.setattr(langid, "PIECE", 2)
    monkeypatch.setattr(langid, "FEW_VALUES", 0)
    parts = found()
    assert {k: (r.lang_id, r.accepted) for k, r in parts.items()} == score
    assert all(abs(parts[k].confidence - whole[k].confidence) < 1e-9 for k in whole)


def test_langid_rare_values_are_evidence(spark):
    many = [(i, "the and this that", "en", None, f"s{i // 2}") for i in range(2 * 4200)]
    rows = [*many, (9000, "der und nicht schön", "de", None, "rare"), (9001, None, None, None, "rare"), (9002, None, None, None, "never")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, suffix string")
    got = {r.doc_id: r.lang_id for r in langid.identify(df, F.col("lang"), F.col("source"), F.col("suffix")).where("doc_id >= 9000").collect()}
    assert got == {9000: "de", 9001: "de", 9002: "en"}


def test_langid_host_prior_is_shrunk_level_by_level(spark):
    """The prior of hosts against the formula, on rows whose texts and declarations say nothing apart."""
    rows = [(i, "the and this that", "en", "www.a.example") for i in range(40)] + [(100 + i, "der und nicht das", "de", "www.b.example") for i in range(40)]
    rows += [(200 + i, "der und nicht das", "de", f"h{i}.c.example") for i in range(30)]
    probe = [(900, None, None, "new.c.example"), (901, None, None, "www.a.example"), (902, None, None, "h0.c.example"), (903, None, None, "solo"), (904, None, None, None)]
    df = spark.createDataFrame([*rows, *probe], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang_id, r.confidence) for r in langid.identify(df, F.col("lang"), F.col("source")).where("doc_id >= 900").collect()}
    de = 71 / 112  # shares of all rows, one more row a language
    shrunk = lambda n, of, above: (n + 20 * above) / (of + 20)
    domain = shrunk(30, 30, de)
    want = {900: domain, 901: 1 - shrunk(0, 40, shrunk(0, 40, de)), 902: shrunk(1, 1, domain), 903: de, 904: de}
    for k, p in want.items():
        assert got[k] == ("en" if k == 901 else "de", pytest.approx(p)), k


def test_langid_text_overrules_wrong_declarations(spark):
    """One declaration in five is another language's; repeated rows and very long texts among them."""
    rng = random.Random(8)
    vocab = {"en": ["the", "and", "this", "with", "from", "thing"], "de": ["der", "und", "nicht", "schön", "über", "zeit"], "fr": ["le", "et", "avec", "été", "nous", "chose"]}
    rows = []
    for i in range(300):
        true = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choices(vocab[true], k=30 if i % 50 else 20_000)), rng.choice(["en", "de", "fr"]) if i % 5 == 0 else true, f"h{i % 7}", 0))
    df = spark.createDataFrame([*rows, *rows[:3]], DOCS).repartition(3)
    got = [(r.doc_id, r.lang_id) for r in langid.identify(df, F.col("lang"), F.col("source")).collect()]
    assert len(got) == 303 and all(lang == ["en", "de", "fr"][d % 3] for d, lang in got)


def test_langid_pages(spark, tmp_path):
    from memspark.llm import queries

    page = lambda i, lang, text: (i, f"https://www.s{i % 3}.example.{'de' if lang == 'de' else 'com'}/p", f"<html lang='{lang}'><script>var the = 'and the this';</script><p>{text}</p></html>")
    rows = [page(i, *(("en", "the and this with from") if i % 2 else ("de", "der und nicht schön über"))) for i in range(40)]
    rows += [(100, "https://www.s0.example.de/x", "<html><p>der und nicht</p></html>"), (101, None, None), (102, "no address", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.langid_pages(spark, str(tmp_path)).collect()}
    assert len(got) == 43 and all(got[i].lang_id == ("en" if i % 2 else "de") and got[i].accepted for i in range(40))
    assert got[100].lang_id == "de" and not got[101].accepted and not got[102].accepted


def test_toxicity_finds_held_out_rows(spark, empty):
    rng = random.Random(9)
    plain, bad = [f"w{i}" for i in range(40)], ["scum", "idiot", "loser"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = rng.choices(plain, k=25) + ([rng.choice(bad).upper() + "!!"] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 0))
        if i < 300:
            marks.append((i, 1 if i % 7 else 0, int(toxic)))
    labels = spark.createDataFrame([*marks, (0, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    chain = {"low_quality": "1 - quality", "toxic": "toxic"}
    df = spark.createDataFrame([*rows, (500, None, "en", "s", 0)], DOCS).withColumn("toxic", F.lit("clash"))
    got = {r.doc_id: r.toxic for r in toxicity.score(df, labels, chain).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(300, 400)) and got[500] is False
    assert toxicity.score(empty, labels.limit(0), chain).count() == 0
    none = toxicity.score(df, labels.limit(0), chain).collect()
    assert len(none) == len(rows) + 1 and all(r.p_toxic is None and r.p_low_quality is None and r.toxic is False for r in none)
    # a verdict is the chain's own, and labels that contradict one another count as the greatest
    every = toxicity.score(df, labels.unionByName(spark.createDataFrame([(1, 1, 1)], labels.schema)), chain).collect()
    assert all(r.toxic == (r.p_toxic >= 0.4) for r in every)


def test_toxicity_without_labels_of_a_category(spark):
    df = spark.createDataFrame([(i, ["fine words here", "vile words here"][i % 2]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, labels, {"low_quality": "1 - quality", "toxic": "toxic"}).collect()
    assert all(r.p_low_quality is None and r.toxic == (r.doc_id % 2 == 1) for r in got)


def test_logistic_training_reaches_the_optimum():
    rng = np.random.default_rng(4)
    dense = np.column_stack([np.ones(300), rng.normal(size=(300, 2))])
    y = (rng.random(300) < 1 / (1 + np.exp(-(dense @ [0.2, 1.5, -2.0])))).astype(float)
    x = toxicity.Matrix(np.zeros(301, np.int64), np.zeros(0, np.int64), dense)
    _, d = toxicity.fit_logistic(x, y, 0)
    theta = np.zeros(3)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-dense @ theta))
        theta -= np.linalg.solve((dense * (p * (1 - p))[:, None]).T @ dense, dense.T @ (p - y))
    assert np.allclose(d, theta, atol=1e-2)


def test_quality_matches_brute_force(spark, docs, empty):
    def brute(t):
        t = t or ""
        w, full = words(t), [x for x in t.split("\n") if words(x)]
        seen: dict = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
        n, chars, symbols, again, repeats = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered)
        trimmed = [WORD.search(x).group() + " " + WORD.findall(x)[-1] for x in full]
        bullets, cut = sum(x[0] in "-*\u2022" for x in trimmed), sum(x.endswith(("...", "\u2026")) for x in trimmed)
        letters, top = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w), max([w.count(x) for x in set(w)], default=0)
        base = n < 10 or 100 * repeats > 20 * n
        rest = chars < 2 * n or chars > 15 * n or 10 * symbols > 3 * n or 10 * again > n or 10 * bullets > 9 * len(full) or 10 * cut > 3 * len(full) or 10 * letters < 6 * n or 10 * top > 4 * n
        return n, chars, symbols, again, repeats, base, not base and not rest

    odd = [
        [f"- point{i} of{i} list{i} words{i}" for i in range(4)], [f"this{i} line{i} is{i} cut..." for i in range(6)],
        [f"{i} {i * 7} {i * 13} {i * 31} one" for i in range(9)], [f"so {i}a so {i}b so {i}c" for i in range(9)],
    ]
    more = [(700 + i, "\n".join(x), "en", "s", 0) for i, x in enumerate([*odd, ["\u2022 tail \u2026"] * 2, ["fine words stand here", "and go on in another way until twelve"]])]
    df = docs.unionByName(spark.createDataFrame(more, DOCS))
    rows = quality.measure(df.withColumn("kept", F.lit("clash"))).collect()
    want = sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows), key=str) == want
    kept = sorted(((r.doc_id, r.kept) for r in rows), key=str)
    assert sorted(((r.doc_id, r.kept) for r in quality.cascade(df).collect()), key=str) == kept
    assert {"bullet_lines", "open_lines", "letter_words", "top_word"} <= {r.rejected_by for r in rows}
    assert all(r.kept == (r.rejected_by is None) for r in rows)
    assert quality.measure(empty).count() == 0 and quality.cascade(empty).count() == 0


def test_cascade_orders_rules_and_saves_work():
    import pyarrow as pa

    texts = pa.array(["short text"] * 90 + ["plain words without any end that go on and on, so that it has twelve"] * 10)
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    order = quality.plan_order([batch])
    assert order == quality.plan_order([batch]) and sorted(order) == sorted(r.name for r in quality.RULES)
    assert order[0] == "min_words"  # rejects nine in ten for the price of counting words
    failed, computed = quality.verdicts(texts, order)
    assert (failed[:90] == 0).all() and (failed[90:] == -1).all()
    assert computed["n_words"] == 100 and all(n == 10 for f, n in computed.items() if f != "n_words")
    # with the base counts at hand the rules on them come first
    later = tuple(r for r in quality.RULES if r not in quality.BASE)
    assert set(quality.plan_order([batch], later, quality.REPORTED)[:3]) == {"word_length", "symbols", "duplicate_lines"}


def test_toxicity_trains_on_each_id_once(spark):
    rng = random.Random(6)
    base = [(i, " ".join(rng.choices(["calm", "river", "stone", "path", "light"], k=30)) + (" vile scum" if i % 4 == 0 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    # 400 copies of one row, and other texts under ids that are there
    more = [base[0]] * 400 + [(1, " ".join(reversed(base[1][1].split())))] * 3 + [(None, "no id"), (3, None)]
    score = lambda rows: toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels, {"toxic": "toxic"}, train_rows=60)
    seen = []
    plain = toxicity.train

    def counted(rows, categories):
        seen.append(rows.num_rows)
        return plain(rows, categories)

    toxicity.train = counted
    try:
        alone = {r.doc_id: r.toxic for r in score(base).collect()}
        many = score(base + more).collect()
    finally:
        toxicity.train = plain
    assert seen == [60, 60] and len(many) == len(base) + len(more)
    assert {r.doc_id for r in many if r.toxic} == {i for i, t in alone.items() if t} == {i for i, _ in base if i % 4 == 0}
