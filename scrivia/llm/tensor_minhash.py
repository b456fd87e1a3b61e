"""Near-duplicate classes by MinHash with tensored banding.

A text is its set of word shingles; texts with equal sets are one node. Two small collections of half keys are computed for each node, `collections` on
either side and `width` MinHash values in each half key; a table key is a pair of one left and one right half. So 2 * 25 half keys (200
MinHash values) stand for 625 tables of eight values, which would need 5,000 values if each table had its own. A pair meets in a table as
soon as one left half and one right half agree: with the defaults a pair at the threshold 0.8 misses all tables with a chance of 4 in a million.
Half keys that no other node has are left out before pairs of them are formed; such a pair can't be shared.

Candidates are verified on the full sets in two steps, and links are never written out as all pairs of a group:

1. every member of a table's bucket is compared with the bucket's least node (its leader), in tasks of one leader and at most `star_nodes` members;
2. buckets whose other members then still lie in different components are gathered into groups, cut into blocks of about `group_nodes`; a task holds
   two blocks, and compares those pairs that share a table and lie in different components.

Every pair that shares a table is thus compared or already connected, and a task's memory does not grow with a bucket. The second step's work
grows with the square of a group's nodes; nodes that step 1 has connected with all that they meet do not enter it.

Defined results: a text without words, or null, has an empty set, is linked with nothing and is its own component; with fewer words than a shingle the whole
sequence is one; repeated rows are copies; a component's id is the least of its ids that are not null, and null where it has none. A pair exactly at the threshold is a link.
An empty table gives no rows; other columns, whatever their names, are ignored; a very long text is held whole by the task that reads it.
Shingles and nodes are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivia.llm.common import cut, mix64, slices, texts
from scrivia.llm.components import settled_components
from scrivia.llm.ngram_join import node_of, shingles, verified


class Halves:
    """The half keys of a set of shingles: `collections` left ones, then as many right ones."""

    def __init__(self, collections: int, width: int):
        draw = np.random.default_rng(20260311)
        self.collections, self.width, n = collections, width, 2 * collections * width
        self.times, self.plus = draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, dtype=np.uint32)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        low = (own >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(low), 4096):
            np.minimum(least, (low[k : k + 4096, None] * self.times + self.plus).min(0), out=least)
        keys = np.arange(2 * self.collections, dtype=np.uint64)
        for values in least.astype(np.uint64).reshape(-1, self.width).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values)
        return keys.view(np.int64)


def _with_leader(threshold: float, size: int):
    """Links (a, b) of a leader with members; the leader's row is the one whose node is the leader."""

    def run(part: pa.Table) -> pa.Table:
        leader = part.column("leader")[0].as_py()
        sets = {node: shingles(text, size) for node, text in zip(part.column("node").to_pylist(), texts(part.column("text").combine_chunks()))}
        own, found = sets.pop(leader), []
        for node, other in sets.items():
            if min(len(own), len(other)) >= threshold * max(len(own), len(other)) - 1e-9:
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common >= threshold * (len(own) + len(other) - common) - 1e-9:
                    found.append(node)
        return pa.table([pa.array([leader] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return run


def _meeting(left: np.ndarray, right: np.ndarray, collections: int) -> np.ndarray:
    """Which pairs of nodes share a table: one left half and one right half."""
    meet = np.ones((len(left), len(right)), bool)
    for side in (slice(0, collections), slice(collections, None)):
        any_half = np.zeros_like(meet)
        for a, b in zip(left[:, side].T, right[:, side].T):
            any_half |= a[:, None] == b[None, :]
        meet &= any_half
    return meet


def _across(threshold: float, size: int, halves: Halves):
    """Links between nodes of different components in two blocks (or one), as pairs (a, b) of the components."""

    def run(part: pa.Table) -> pa.Table:
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        rows = sorted(zip(part.column("block").to_pylist(), part.column("node").to_pylist(), part.column("comp").to_pylist(), texts(part.column("text").combine_chunks())), key=lambda r: r[:2])
        comp = np.array([r[2] for r in rows], np.int64)
        sets = [shingles(r[3], size) for r in rows]
        sizes = np.array([len(s) for s in sets])
        kind, code = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(code, np.cumsum(sizes)[:-1])
        keys = np.stack([halves(s) for s in sets])
        first_right = sum(r[0] == low for r in rows) if low != high else 0
        last_left = first_right or len(rows)
        found: set[tuple[int, int]] = set()
        for k in range(0, last_left, 256):
            at = slice(k, min(k + 256, last_left))
            meet = _meeting(keys[at], keys[first_right:], halves.collections) & (comp[at, None] != comp[None, first_right:])
            meet &= np.minimum(sizes[at, None], sizes[None, first_right:]) >= threshold * np.maximum(sizes[at, None], sizes[None, first_right:]) - 1e-9
            i, j = np.nonzero(meet)
            i, j = i + k, j + first_right
            if low == high:
                i, j = i[i < j], j[i < j]
            ok = verified(i, j, codes, len(kind), threshold)
            found.update(zip(np.minimum(comp[i[ok]], comp[j[ok]]).tolist(), np.maximum(comp[i[ok]], comp[j[ok]]).tolist()))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: float = 0.8, collections: int = 25, width: int = 4, star_nodes: int = 512, group_nodes: int = 1024
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row."""
    halves = Halves(collections, width)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingles(t, shingle) for t in texts(batch.column(1))]
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([halves(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["id", "mark", "node", "size", "halves"])

    described = cut(rows.mapInArrow(describe, f"id {id_type}, mark long, node long, size long, halves array<long>"))
    # the row that shows a node is found by text and id, since ids may be null or stand on many texts
    nodes = described.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.min(F.struct("mark", "id", "halves")).alias("shown"))

    each = nodes.select("node", F.posexplode("shown.halves").alias("pos", "half"))
    shared = each.groupBy("half").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select(F.col("half").alias("_half"))
    side = lambda of_side: F.collect_list(F.when(of_side, F.col("half")))
    met = each.join(shared, F.col("half") == F.col("_half")).groupBy("node").agg(side(F.col("pos") < collections).alias("lefts"), side(F.col("pos") >= collections).alias("rights"))
    tensored = met.select("node", F.explode("lefts").alias("left"), "rights").select("node", "left", F.explode("rights").alias("right")).select("node", F.xxhash64("left", "right").alias("key"))
    # tables whose buckets hold the same nodes are one: nodes are few in comparison with the tables that they share
    buckets = tensored.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("nodes"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("nodes > 1")
    buckets = buckets.groupBy("leader", "nodes", "mark").agg(F.min("key").alias("_key"))
    hits = cut(tensored.join(buckets, F.col("key") == F.col("_key")).filter("node != leader").select(F.when(F.col("nodes") > 2, F.col("key")).alias("key"), "leader", "node"))

    stars = cut(hits.select("leader", "node").distinct())
    parts = stars.groupBy(F.col("leader").alias("_leader")).agg(F.ceil(F.count("*") / star_nodes).alias("parts"))
    stars = cut(stars.join(parts, F.col("leader") == F.col("_leader")).select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node"))
    wanted = stars.select(F.explode(F.array("leader", "node")).alias("_node")).distinct()
    shown = nodes.join(wanted, F.col("node") == F.col("_node")).select("node", F.col("shown.mark").alias("_mark"), F.col("shown.id").alias("_id"))
    # repeated rows show their node more than once: one of them is kept, since equal marks are equal texts
    text = cut(rows.join(shown, (F.col("mark") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["node"]).select(F.col("node").alias("_node"), "text"))
    with_text = lambda df: df.join(text, F.col("node") == F.col("_node")).drop("_node")
    every = stars.union(stars.select("leader", "part", F.col("leader").alias("node")).distinct())
    links = cut(with_text(every).groupBy("leader", "part").applyInArrow(_with_leader(threshold, shingle), "a long, b long"))

    # of a member's leaders the least stays its neighbour, and the others become neighbours of that one: as connected, with fewer links
    least = links.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    links = least.select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    roots = cut(settled_components(links.withColumnRenamed("m", "a")).select(F.col("node").alias("_rnode"), F.col("root").alias("comp")))

    in_comp = hits.filter("key is not null").join(roots, F.col("node") == F.col("_rnode"), "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    kinds = cut(in_comp.groupBy("key", "comp").agg(F.count("*").alias("nodes")))
    open_keys = kinds.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("a"), F.max("comp").alias("z")).filter("a != z").select("_key", "a")
    meet = cut(kinds.join(open_keys, F.col("key") == F.col("_key")).filter("a != comp").select("a", F.col("comp").alias("b")).distinct())
    joined = None
    if not meet.isEmpty():
        # components that meet in a bucket are one group, with those of their nodes that are in buckets of more than two
        groups = cut(settled_components(meet).select(F.col("node").alias("_comp"), F.col("root").alias("group")))
        member = cut(in_comp.select("node", "comp").distinct().join(groups, F.col("comp") == F.col("_comp")).drop("_comp"))
        blocks = member.groupBy(F.col("group").alias("_group")).agg(F.ceil(F.count("*") / group_nodes).cast("int").alias("blocks"))
        member = member.join(blocks, F.col("group") == F.col("_group")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        task = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
        dealt = with_text(member.select("group", "node", "comp", "block", F.explode(task).alias("task")).select("group", "task.low", "task.high", "node", "comp", "block"))
        late = cut(dealt.groupBy("group", "low", "high").applyInArrow(_across(threshold, shingle, halves), "a long, b long").distinct())
        if not late.isEmpty():
            joined = settled_components(late).select(F.col("node").alias("_joined"), F.col("root").alias("late"))

    rooted = nodes.select("node", "rep").join(roots, F.col("node") == F.col("_rnode"), "left").select("node", "rep", F.coalesce("comp", "node").alias("root"))
    if joined is not None:
        rooted = rooted.join(joined, F.col("root") == F.col("_joined"), "left").select("node", "rep", F.coalesce("late", "root").alias("root"))
    classes = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component_id"))
    about = rooted.join(classes, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "component_id")
    out = described.select("id", "node", "size").join(about, F.col("node") == F.col("_node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
