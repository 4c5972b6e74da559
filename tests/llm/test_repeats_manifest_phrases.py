"""Suffix index, Merkle manifest and phrases against brute force, with nulls, repeats,
very long texts, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.llm import merkle, phrases, queries, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_spans(texts, length):
    """Removed spans of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans: list[list[int]] = []
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out.append(spans)
    return out


def repeat_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, shared, edge = text(300), text(60), text(400)
    out = [base, base[:700] + "X" + base[701:], base[1:], text(200) + shared + text(150), shared + text(90), text(90) + shared, text(300)]
    out += [f"{text(5)} {shared[k : k + 170]} {text(30)}" for k in range(0, 90, 13)]
    out += ["y" * 1000, "z" * 180 + "y" * 150, "ab" * 600, "b" + "ab" * 90, None, "", "short", "q" * 149, edge + edge, edge[-160:] + text(3), text(40) + edge[20:175]]
    for i in range(25):
        t = list(base)
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = rng.choice("QRS")
        out.append("".join(t))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_match_brute_force(spark, batches):
    texts = repeat_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[3]), (None, "n" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "text_hash": F.lit(7)}).repartition(3)
    got = suffixes.remove_repeats(df, min_bytes=150, batches=batches)
    assert got.columns == ["doc_id", "text", "text_hash", "n_bytes", "spans", "kept"]
    found = sorted(((r.doc_id, r.text, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()), key=str)
    want = []
    for (i, t), spans in zip(rows, brute_spans([t for _, t in rows], 150), strict=True):
        b = (t or "").encode()
        gone = {p for a, e in spans for p in range(a, e)}
        want.append((i, t, len(b), [tuple(s) for s in spans], bytes(c for p, c in enumerate(b) if p not in gone)))
    assert found == sorted(want, key=str)
    assert sum(len(x[3]) for x in found) > 30


def test_repeats_of_long_texts_and_of_nothing(spark, empty, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 2000)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, long), (2, long[2500:6400] + "!" + long[100:900]), (3, long[8999:] + "x" * 300)]
    spans = brute_spans([t for _, t in rows], 200)
    texts = pa.array([t for _, t in rows])
    ids = pa.array([1, 2, 3])
    # segments of 2000 windows, in this process
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "text_hash", "text"])
    made = [b for b in suffixes.entries(iter([batch]), 200)]
    owned = sorted((r["doc_id"], p) for b in made for r in b.to_pylist() for p in range(r["q"] - r["first"], r["q"] - r["last"] + r["run"] + 1))
    # each window has one owner
    assert owned == sorted((i, p) for i, t in rows for p in range(len(t) - 200 + 1))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=200, batches=2)
    assert sorted((r.doc_id, [[s.start, s.end] for s in r.spans]) for r in got.collect()) == [(i, s) for (i, _), s in zip(rows, spans, strict=True)]
    assert suffixes.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        suffixes.SuffixIndex(spark, 100)


def test_levels_grow_geometrically(spark):
    index = suffixes.SuffixIndex(spark, 150)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(600))
    sizes = []
    for i in range(5):
        index.add(spark.createDataFrame([(i, text if i in (0, 4) else f"{i}" * 10)], "doc_id long, text string"))
        sizes.append([x.batches for x in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    docs = spark.createDataFrame([(0, text), (4, text)], "doc_id long, text string")
    # the copy came four batches later
    assert sorted((r.doc_id, r.spans[0].start, r.spans[0].end) for r in index.spans(docs).collect()) == [(0, 0, 600), (4, 0, 600)]
    index.drop()


def test_fingerprints_tell_spans_apart():
    data = np.frombuffer(b"abcabcabdabc" * 50, np.uint8)
    prints = suffixes.Prints(data)
    start = np.arange(len(data) - 40)
    by = {}
    for s, f in zip(start.tolist(), prints.of(start, start + 40).tolist(), strict=True):
        by.setdefault(f, set()).add(data[s : s + 40].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({data[s : s + 40].tobytes() for s in start.tolist()})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows(doc_id, text, lang, source, n_chars)."""

    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, i, h):
        proof = ""
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            proof += "".join(run[: i % 8] + run[i % 8 + 1 :])
            h = sha("".join([*run[: i % 8], h, *run[i % 8 + 1 :]]))
            i //= 8
        return proof, h

    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, own = {}, {}
    for lang in langs:
        leaves = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), i) for i, r in enumerate(rows) if r[2] == lang))
        trees[lang] = tree([x[2] for x in leaves])
        own |= {x[3]: at for at, x in enumerate(leaves)}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for i, r in enumerate(rows):
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        a, h = climb(trees[r[2]], own[i], leaf(r, lower(r[1]) if tampered else r[1]))
        b, h = climb(top, langs.index(r[2]), h)
        out.append((r[0], leaf(r, r[1]), trees[r[2]][-1][0], top[-1][0], sha(a + b), h, h == top[-1][0]))
    return out


def manifest_query(df):
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verify(df, F.when(hit, small))


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_manifest_matches_brute_force(spark, n):
    rng = random.Random(n)
    langs = [None, "en", "de", "ß", "日本", ""] if n < 100 else [None, *[f"l{i}" for i in range(12)], *["en"] * 20]
    rows = [(rng.randrange(3 * n) if rng.random() < 0.95 else None, rng.choice(["Some Text", "", None, "é\nÀB", "x" * 50]), rng.choice(langs), rng.choice([None, "a", "s:1"]), rng.choice([None, 0, -5, 10**12])) for _ in range(n)]
    rows += rows[: n // 10]
    df = spark.createDataFrame(rows, DOCS).withColumns({"digest": F.lit("clash"), "idx": F.lit(1)}).repartition(5)
    got = sorted((tuple(r) for r in manifest_query(df).collect()), key=str)
    want = sorted(brute_manifest(rows), key=str)
    # of rows that share all fields, places are dealt in any order
    assert [g[:4] for g in got] == [w[:4] for w in want] and Counter(got) == Counter(want)


def test_manifest_of_nothing(empty):
    assert manifest_query(empty).count() == 0


def test_untampered_rows_verify(spark):
    df = spark.createDataFrame([(i, f"Text {i}", "en", "s", i) for i in range(40)], DOCS)
    assert merkle.verify(df).where("verified").count() == 40
    assert 0 < manifest_query(df).where("NOT verified").count() < 40


def test_partial_parents_meet_in_any_deal():
    """Events of a tree in any order and any tasks give the same nodes."""
    n = 8**3 * 2 + 5
    leaves = [sha(str(i)) for i in range(n)]
    order = list(range(n))
    random.Random(3).shuffle(order)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["g", "n", "level", "idx", "digest"])

    rows = [("g", n, 0, i, leaves[i]) for i in order]
    out = [r for part in (rows[:400], rows[400:900], rows[900:]) for b in merkle.resolve(iter([batch(part)])) for r in b.to_pylist()]
    again = [(r["g"], r["n"], r["level"], r["idx"], r["digest"]) for r in out if r["kids"] is None]
    out = [r for r in out if r["kids"] is not None] + [r for b in merkle.resolve(iter([batch(again)])) for r in b.to_pylist()]
    nodes, level = {(r["level"], r["idx"]): r["digest"] for r in out if r["kids"] is not None}, leaves
    for k in range(1, 5):
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        assert [nodes[k, i] for i in range(len(level))] == level
    assert len(level) == 1 and not [r for r in out if r["kids"] is None]


def brute_phrases(rows, least, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items())
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, r, total[lang], -s) for i, (s, a, p, x, r) in enumerate(sorted(best)[:top])]
    return out


def phrase_rows():
    rng = random.Random(4)
    vocab = ["the", "The", "of", "Größe", "été", "日本", "x", "a#b", "run", "far"]
    rows = [(" ".join(rng.choices(vocab, k=rng.randrange(0, 60))) + rng.choice([".", ",\n", " ", "; "]) + " ".join(rng.choices(vocab[:4], k=20)), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(120)]
    rows += [("fixed set of words here again", "en")] * 12 + [("echo echo echo echo\techo  echo", "fr")] * 9 + [(None, "en"), ("", None), (" . \n", "xx"), ("one", "yy"), (" ".join(rng.choices(vocab, k=20_000)), "en")]
    return rows


@pytest.mark.parametrize(("least", "shard"), [(8, 10**6), (3, 50), (30, 10**6)])
def test_phrases_match_brute_force(spark, least, shard):
    rows = phrase_rows()
    df = spark.createDataFrame([(i if i % 50 else None, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").withColumns({"phrase": F.lit("clash"), "row": F.lit(1)}).repartition(4)
    got = sorted(tuple(r) for r in phrases.mine(df, min_count=least, shard_size=shard).collect())
    want = sorted(brute_phrases(rows, least))
    assert got == want and len(got) > (20 if least < 30 else 3)


def test_phrases_of_nothing(spark, empty):
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, "en"), (2, "a b c", None)], "doc_id long, text string, lang string")).count() == 0


def test_sketches_are_upper_bounds():
    """Cells of a crowded sketch pass whatever reaches the count, and more."""
    texts = pa.array(["a b c d e f " * 40, "g h i j " * 10])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en", "en"])], ["text", "lang"])
    c = phrases.read(batch)
    count = Counter(h for _, _, hs in phrases.phrase_hashes(c, 2) for h in hs.tolist())
    cells = np.zeros((2, 1 << 3), np.int64)
    for h, n in count.items():
        for row in range(2):
            cells[row, phrases.cell(np.array([h], np.uint64), row, 3)[0]] += n
    sketch = phrases.Sketch(3, [np.packbits(x >= 30) for x in cells])
    often = np.array([h for h, n in count.items() if n >= 30], np.uint64)
    assert len(often) and sketch.passes(often).all()


def test_new_queries_are_registered():
    assert {"op11_suffix", "op12_merkle", "op13_phrases"} <= set(queries.QUERIES) and {"op12_merkle", "op13_phrases"} <= set(queries.SQL)
