"""Cross-site boilerplate lines by distinct-site spread (operator 4).

A line is a trimmed, non-blank ``\\n``-piece of a text, known by a 64-bit hash.
Occurrences are summed per (line, site) inside each task before they move.
Lines with fewer than ``min_sites`` occurrences cannot be on so many sites and
leave first.  For the others a HyperLogLog sketch of the sites is kept per line
hash; sketches merge in the aggregation, so one small sketch per line and task
moves, however often the line occurs.  A line whose estimate is clear of
``min_sites`` is decided by it; within the sketch's error of the threshold the
sites are counted exactly.  A boilerplate line stays in the document with the
smallest id that carries it, at its first place there, and goes everywhere
else: no line leaves the corpus altogether.

The ``broadcast_lines`` most frequent boilerplate lines are broadcast and cut in
one pass.  Where there are more, the lines of the documents are joined with the
rest; a line that is on very many documents is not among these, so no key of
that join is hot.

Defined cases: a null text stays null; a null site is a site of its own; a null
id keeps no first occurrence unless no other document has the line; repeated
rows of one document lose and keep the same lines; blank lines are never
boilerplate; an empty table gives an empty result; other columns are kept
unchanged, but for those named n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from memspark.llm import textvec as tv
from memspark.llm.common import discard, saved, small_batches

#: lg2 of the registers of a sketch; the error allowed for its estimate (4 standard errors).
LG_K, ERROR = 12, 4 * 1.04 / 64
NO_ID = np.iinfo(np.int64).max


def hashed_lines(texts: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text index, start, end, hash, not blank) of the lines of a chunk."""
    words = tv.split_words(texts)
    doc, start, end, lo, hi = tv.lines(words)
    return words, doc, start, end, tv.hash_spans(words.data, lo, hi).view(np.int64), hi > lo


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.chunks(batches):
        _, doc, _, _, h, full = hashed_lines(batch.column("text"))
        site = batch.column("site").to_numpy()[doc[full]]
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()[doc[full]]
        h = h[full]
        if not len(h):
            continue
        order = np.lexsort((ids, site, h))
        h, site, ids = h[order], site[order], ids[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (site[1:] != site[:-1])]))
        n = np.diff(np.concatenate([head, [len(h)]]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[head], site[head], n.astype(np.int64), ids[head])], ["line", "site", "n", "keeper"])


def boilerplate(df: DataFrame, min_sites: int = 8, site_col: str = "source") -> DataFrame:
    """(line, keeper, n) of the lines on at least ``min_sites`` sites, as a saved table."""
    site = F.when(F.col(site_col).isNull(), F.lit(0)).otherwise(F.xxhash64(site_col)).alias("site")
    source = df.select(F.col("doc_id").cast("long"), site, "text").where(F.col("text").isNotNull())
    found = saved(source.mapInArrow(occurrences, "line long, site long, n long, keeper long"), "lines")
    often = found.groupBy("line").agg(F.sum("n").alias("n"), F.min("keeper").alias("keeper")).where(F.col("n") >= min_sites)
    often = saved(often, "often")
    seen = found.join(often.select("line"), "line", "left_semi").select("line", "site")
    spread = seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = saved(spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + ERROR)).select("line")
    near = spread.where(F.col("sites").between(int(min_sites * (1 - ERROR)), min_sites * (1 + ERROR))).select("line")
    exact = seen.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites).select("line")
    out = saved(sure.unionByName(exact).join(often, "line"), "boilerplate")
    discard(found, often, spread)
    return out


def strip_lines(batch: pa.RecordBatch, lines: np.ndarray, keepers: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(text, n_lines, n_removed) of a batch; ``lines`` is sorted."""
    words, doc, start, end, h, full = hashed_lines(batch.column("text"))
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
    at = np.minimum(np.searchsorted(lines, h), max(len(lines) - 1, 0))
    hit = full & (lines[at] == h) if len(lines) else np.zeros(len(h), bool)
    where = np.flatnonzero(hit)
    mine = keepers[at[where]] == ids[doc[where]]
    first = np.zeros(len(where), bool)
    order = np.lexsort((where, h[where], doc[where]))
    d, g = doc[where][order], h[where][order]
    first[order] = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])[: len(order)]
    gone = np.zeros(len(h), bool)
    gone[where[~(mine & first)]] = True
    n = len(ids)
    removed = np.bincount(doc[gone], minlength=n)
    texts = batch.column("text").to_pylist()
    raw = words.data.tobytes() if gone.any() else b""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for i in np.flatnonzero(removed).tolist():
        span = range(bounds[i], bounds[i + 1])
        texts[i] = b"\n".join(raw[start[j] : end[j]] for j in span if not gone[j]).decode()
    return pa.array(texts, pa.string()), pa.array(np.bincount(doc[full], minlength=n).astype(np.int64)), pa.array(removed.astype(np.int64))


def remove_boilerplate(df: DataFrame, min_sites: int = 8, site_col: str = "source", broadcast_lines: int = 1_000_000) -> DataFrame:
    """``df`` with boilerplate lines cut from ``text``, and n_lines (not blank) and n_removed."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    df = df.select(*keep)
    lines = boilerplate(df, min_sites, site_col)
    least = least_count(lines, broadcast_lines)
    rows = lines.where(F.col("n") >= least).select("line", "keeper").toArrow().sort_by("line")
    known = df.sparkSession.sparkContext.broadcast((rows["line"].to_numpy(), rows["keeper"].to_numpy()))
    schema = StructType([*df.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches):
            text, total, removed = strip_lines(batch, *known.value)
            cols = [text if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, total, removed], names=[*keep, "n_lines", "n_removed"])

    cut = df.mapInArrow(run, schema)
    if not least:
        discard(lines)
        return cut

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, pos, line, first, id) of the lines, one row each."""
        for batch in tv.chunks(batches):
            _, doc, _, _, h, full = hashed_lines(batch.column("text"))
            # the lines of the broadcast part are gone but for the one that stays
            lines_cut = known.value[0]
            if len(lines_cut):
                full &= lines_cut[np.minimum(np.searchsorted(lines_cut, h), len(lines_cut) - 1)] != h
            order = np.lexsort((np.arange(len(h)), h, doc))
            d, g = doc[order], h[order]
            first = np.zeros(len(h), bool)
            first[order] = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])])[: len(order)]
            pos = np.arange(len(h)) - np.searchsorted(doc, doc)
            row, ids = batch.column("row").to_numpy(), batch.column("doc_id").fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (row[doc], pos, h, first, ids[doc])], ["row", "pos", "line", "first", "id"])

    marked = saved(cut.withColumn("row", F.monotonically_increasing_id()), "marked")
    each = marked.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(listed, "row long, pos long, line long, first boolean, id long")
    rest = lines.where(F.col("n") < least).select("line", "keeper")
    gone = each.join(rest, "line").where(~(F.col("first") & (F.col("keeper") == F.col("id"))))
    hits = gone.groupBy("row").agg(F.collect_list(F.col("pos").cast("int")).alias("gone"))
    out = marked.join(hits, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else c for c in keep], "n_lines", (F.col("n_removed") + F.size("gone")).cast("long").alias("n_removed"))


def least_count(lines: DataFrame, most: int) -> int:
    """0 if there are at most ``most`` lines, else the least count that at most ``most`` of them reach."""
    if lines.count() <= most:
        return 0
    # by powers of two, so that a few dozen rows tell it
    levels = lines.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.col("level").desc()).collect()
    reached, least = 0, 2**62
    for r in levels:
        reached += r["count"]
        if reached > most:
            break
        least = 2**r.level
    return least
