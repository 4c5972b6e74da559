"""Merkle manifest of a table, with a proof for every row (operator 12).

A row's leaf is the SHA-256 of its fields, each as ``-`` (null) or byte length,
``:`` and value.  Leaves are numbered within their group by the key; every
ARITY consecutive nodes have one parent, the digest of their hex digests, until
one node is left, the group's subroot.  Subroots, in the order of their groups,
are the leaves of a last tree, whose top is the root.

Leaves are numbered by a range partitioning: rows are counted per partition and
a prefix sum of these counts gives each partition its first number, so a group
is never gathered in one task.  Then nodes are events: a task keeps partial
parents, keyed by (group, level, number), which collect the indexed digests of
their children; the size of the group tells how many each must have.  A parent
that has them all is emitted and is itself an event for its own parent.  What a
task can't complete is its frontier: these few events are dealt out anew by
ever larger blocks of leaves until none are left.  Each emitted parent keeps its
children, so the links can be followed back from the root: top down, each level
hands its path to the level below, and a leaf's proof is read off the path.

Defined cases: a null in any field is ``-``; a null group is a group of its own
and the first; a null key is the smallest; rows that share a key are ordered by
their leaves, repeated rows are leaves each; a single leaf is its group's
subroot, a single subroot the root; an empty table gives an empty result.
Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import discard, saved, small_batches

ARITY = 8
HEX = 64
#: Levels by which the blocks grow from one round over the frontier to the next.
ROUND_LEVELS = 4
#: Partial parents that a task keeps before it passes them on as frontier.
MAX_PARTIAL = 100_000
EVENT = "g string, n long, level int, idx long, digest string, kids string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def group_key(c: Column) -> Column:
    """A text that orders as the group does, a null first."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx, their number within ``g`` by ``order``, and n, the size of their group; as a saved table."""
    sort = ["g", *order]
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = []
            for g in batch.column("g").to_pylist():
                group, at = g, (at + 1 if g == group else 0)
                nth.append(at)
            if nth:
                cols = [*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "part", "nth"])

    first = saved(placed.mapInArrow(count, f"{schema},part int,nth long"), "numbered")
    of = Window.partitionBy("g")
    per = first.groupBy("part", "g").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("part", "g", before.alias("first"), F.sum("rows").over(of).alias("n"))
    out = saved(first.join(starts, ["part", "g"]).withColumn("idx", F.col("first") + F.col("nth")).drop("part", "nth", "first"), "leaves")
    discard(first)
    return out


def width(n: int, level: int) -> int:
    """Nodes at a level over n leaves."""
    return -(-n // ARITY**level)


def digest_of(kids: str) -> str:
    return hashlib.sha256(kids.encode()).hexdigest()


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents that events complete, and those events back whose parents stay partial (kids is null)."""
    partial: dict[tuple[str, int, int], dict[int, str]] = {}
    sizes: dict[str, int] = {}
    out: list[tuple] = []

    def flush() -> None:
        for (g, level, i), kids in partial.items():
            out.extend((g, sizes[g], level - 1, i * ARITY + k, d, None) for k, d in kids.items())
        partial.clear()

    def packed() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "n", "level", "idx", "digest", "kids"])
        out.clear()
        return batch

    for batch in batches:
        for g, n, level, i, digest in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "level", "idx", "digest")), strict=True):
            sizes[g] = n
            while width(n, level) > 1:
                parent = (g, level + 1, i // ARITY)
                kids = partial.setdefault(parent, {})
                kids[i % ARITY] = digest
                if len(kids) < min(ARITY, width(n, level) - ARITY * parent[2]):
                    break
                del partial[parent]
                joined = "".join(kids[k] for k in range(len(kids)))
                level, i, digest = level + 1, parent[2], digest_of(joined)
                out.append((g, n, level, i, digest, joined))
        if len(partial) > MAX_PARTIAL:
            flush()
        if out:
            yield packed()
    flush()
    if out:
        yield packed()


def combine(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes, tables to discard): the parents (g, n, level, idx, digest, kids) over leaves(g, n, idx, digest)."""
    events = leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest").where("n > 1")
    made, nodes, rounds = [], None, 0
    while True:
        done = saved(events.mapInArrow(resolve, EVENT), "nodes")
        made.append(done)
        full = done.where("kids IS NOT NULL")
        nodes = full if nodes is None else nodes.unionByName(full)
        frontier = done.where("kids IS NULL").drop("kids")
        if frontier.isEmpty():
            return nodes, made
        rounds += 1
        # the leaf at which a node starts, by blocks of 8^4, 8^8 ... leaves
        block = F.floor(F.col("idx") * F.pow(F.lit(float(ARITY)), F.col("level") - ROUND_LEVELS * rounds))
        events = frontier.repartition("g", block)


def paths(nodes: DataFrame) -> DataFrame | None:
    """(g, idx, runs) of the parents of leaves: the children of each node on the way up, the own first."""
    top = nodes.agg(F.max("level")).first()[0]
    out = None
    for level in range(top or 0, 0, -1):
        here = nodes.where(F.col("level") == level).select("g", "idx", "kids")
        if out is None:
            out = here.select("g", "idx", F.array("kids").alias("runs"))
        else:
            up = out.select(F.col("g").alias("ug"), F.col("idx").alias("ui"), F.col("runs").alias("up"))
            joined = here.join(up, (F.col("g") == F.col("ug")) & (F.expr(f"idx div {ARITY}") == F.col("ui")), "left")
            out = joined.select("g", "idx", F.concat(F.array("kids"), F.coalesce("up", F.array().cast("array<string>"))).alias("runs"))
    return out


def tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, digest) of the last node of each group."""
    last = nodes.where(F.expr(f"n <= power({ARITY}, level)"))
    return last.select("g", "digest").unionByName(leaves.where("n = 1").select("g", "digest"))


def siblings(runs: list[str], idx: int) -> str:
    """The digests beside a node and beside its ancestors, level by level, left to right."""
    out = []
    for run in runs:
        at = idx % ARITY * HEX
        out.append(run[:at] + run[at + HEX :])
        idx //= ARITY
    return "".join(out)


def fold(digest: str, runs: list[str], idx: int) -> str:
    """The digest at the top if ``digest`` stands at ``idx`` among its siblings."""
    for run in runs:
        at = idx % ARITY * HEX
        digest = digest_of(run[:at] + digest + run[at + HEX :])
        idx //= ARITY
    return digest


@dataclass
class Manifest:
    """leaves(g, n, idx, digest, ...), their parents, and per group its subroot's place in the last tree."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame  # (g, top_idx, subroot, top_runs, root)

    def families(self, *columns: str) -> DataFrame:
        """Leaves by parent, with the runs up to the subroot and from there to the root."""
        kin = F.struct("idx", "digest", *columns)
        per = self.leaves.groupBy("g", F.expr(f"idx div {ARITY}").alias("parent")).agg(F.array_sort(F.collect_list(kin)).alias("kin"))  # eight at most
        runs = paths(self.nodes)
        if runs is None:
            per = per.withColumn("runs", F.array().cast("array<string>"))
        else:
            per = per.join(runs.select("g", F.col("idx").alias("parent"), "runs"), ["g", "parent"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<string>")))
        return per.join(self.groups, "g")


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows(g, key, digest, ...), leaves ordered by key and digest within ``g``."""
    small_batches(rows.sparkSession)
    leaves = numbered(rows, "key", "digest")
    nodes, _ = combine(leaves)
    subroots = tops(leaves, nodes).select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
    heads = numbered(subroots, "key")
    above, _ = combine(heads)
    root = tops(heads, above).select(F.col("digest").alias("root"))
    runs = paths(above)
    own = heads.select(F.col("key").alias("g"), F.col("idx").alias("top_idx"), F.col("digest").alias("subroot"))
    if runs is None:
        groups = own.withColumn("top_runs", F.array().cast("array<string>"))
    else:
        up = runs.select(F.col("idx").alias("at"), F.col("runs").alias("top_runs"))
        groups = own.join(up, F.expr(f"top_idx div {ARITY}") == F.col("at")).drop("at")
    # one row, the root
    return Manifest(leaves, nodes, saved(groups.crossJoin(F.broadcast(root)), "groups"))


VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf: its proof, and the root that it folds to from what is found (``seen``) in its place."""
    for batch in batches:
        rows = []
        for kin, runs, top_idx, top_runs, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("kin", "runs", "top_idx", "top_runs", "subroot", "root")), strict=True):
            upper = siblings(runs[1:], kin[0]["idx"] // ARITY) + siblings(top_runs, top_idx)
            for leaf in kin:
                proof = siblings(runs[:1], leaf["idx"]) + upper
                folded = fold(fold(leaf["seen"], runs, leaf["idx"]), top_runs, top_idx)
                rows.append((leaf["key"], leaf["digest"], subroot, root, digest_of(proof), folded, folded == root))
        if rows:
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(docs: DataFrame, seen_text: Column | None = None, fields: Sequence[str] = FIELDS, group: str = "lang") -> DataFrame:
    """Build the manifest of ``docs`` and check against it what a reader sees: the same
    rows, with ``seen_text`` in place of the text where that is given and not null."""
    columns = [F.col(c) for c in fields]
    digest = row_digest(columns)
    seen = digest
    if seen_text is not None:
        other = row_digest([seen_text if c == "text" else F.col(c) for c in fields])
        seen = F.when(seen_text.isNotNull(), other).otherwise(digest)
    rows = docs.select(group_key(F.col(group)).alias("g"), F.col("doc_id").cast("long").alias("key"), digest.alias("digest"), seen.alias("seen"))
    return build(rows).families("key", "seen").mapInArrow(check, VERIFIED)
