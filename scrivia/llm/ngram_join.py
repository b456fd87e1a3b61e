"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Texts with equal sets are one node. MinHash bands propose which nodes may be
alike; nodes joined by bands form candidate groups. Inside a group, MinHash values of a pair are compared a few at a time, and the
pair is dropped as soon as the posterior probability that its similarity reaches the threshold, given the
agreements so far and a uniform prior, falls below the tolerance. Survivors are verified exactly on their sets.

Links are counted where they are found and never written out as pairs: each task returns one row per node, with
its number of links and its root among the verified links. Groups beyond group_nodes are cut into blocks, and each pair of blocks
is a task of its own, so no task holds more than two blocks.

Defined results: null and empty texts have no shingles, hence no links, and are classes of their own; fewer words than a shingle are
one shingle; repeated rows are copies; a null id is a copy like others, and class ids are the least ids that are not null. A pair exactly at the threshold is a link.
An empty table gives no rows; other columns, whatever their names, are ignored; a very long text is held whole by the task that reads it, with its words and 8 bytes for each shingle.
With the defaults a pair at the threshold escapes the bands with a chance of 5 in a million. Nodes are named by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import LOWER, cut, mix64, slices, texts
from scrivia.llm.components import components

HASHES, ROWS = 240, 6
_draw = np.random.default_rng(20260103)
_A = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_names: dict[bytes, int] = {}


def shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_names) > 400_000:
        _names.clear()
    names = np.fromiter((_names[w] if w in _names else _names.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15)) ^ names[k : k + n]
    return np.unique(mix64(h))


def node_of(own: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None


def min_hash(own: np.ndarray) -> np.ndarray:
    low = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        np.minimum(out, (low[k : k + 4096, None] * _A + _B).min(0), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def least_agreements(threshold: float, tolerance: float) -> np.ndarray:
    """For n compared values, how many must agree so that P(similarity >= threshold | agreements) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = np.zeros(HASHES + 1, int)
    for n in range(1, HASHES + 1):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def survivors(left: np.ndarray, right: np.ndarray, need: np.ndarray, within: bool, step: int = 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of signatures that no comparison has dropped, a band of rows of `left` at a time; within: i < j only."""
    for a in range(0, len(left), 256):
        agree = np.zeros((min(256, len(left) - a), len(right)), np.uint8)
        for k in range(step):
            agree += left[a : a + 256, k, None] == right[None, :, k]
        i, j = np.nonzero(agree >= need[step])
        m = agree[i, j].astype(int)
        i = i + a
        if within:
            i, j, m = (x[i < j] for x in (i, j, m))
        for n in range(step, HASHES, step):
            if not len(i):
                break
            part = slice(n, n + step)
            for b in range(0, len(i), 1 << 16):
                at = slice(b, b + (1 << 16))
                m[at] += (left[i[at], part] == right[j[at], part]).sum(1)
            keep = m >= need[min(n + step, HASHES)]
            i, j, m = i[keep], j[keep], m[keep]
        yield i, j


def verified(i: np.ndarray, j: np.ndarray, codes: list[np.ndarray], kinds: int, threshold: float) -> np.ndarray:
    """Which of the pairs really reach the threshold; codes: each node's shingles as small numbers."""
    ok = np.zeros(len(i), bool)
    mark = np.zeros(kinds, bool)
    order = np.argsort(i, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], i[order][1:] != i[order][:-1]))) if len(i) else []
    for a, b in zip(first, np.append(first[1:], len(i))):
        own = codes[i[order[a]]]
        mark[own] = True
        for c in range(a, b, 4096):
            at = order[c : min(b, c + 4096)]
            others = [codes[x] for x in j[at]]
            size = np.array([len(x) for x in others])
            common = np.add.reduceat(mark[np.concatenate(others)].astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))
            ok[at] = common >= threshold * (len(own) + size - common) - 1e-9
        mark[own] = False
    return ok


def _compare(threshold: float, tolerance: float, size: int):
    need = least_agreements(threshold, tolerance)

    def run(part: pa.Table) -> pa.Table:
        got: dict[int, tuple[np.ndarray, int, int]] = {}
        rows = zip(part.column("node").to_pylist(), texts(part.column("text").combine_chunks()), part.column("copies").to_pylist(), part.column("block").to_pylist())
        for node, text, copies, block in rows:
            if node not in got and node_of(own := shingles(text, size)) == node:
                got[node] = (own, copies, block)
        order = sorted(got, key=lambda x: (got[x][2], x))
        sets, copies = [got[x][0] for x in order], np.array([got[x][1] for x in order], np.int64)
        block = np.array([got[x][2] for x in order])
        signature = np.stack([min_hash(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
        kind, code = np.unique(np.concatenate(sets), return_inverse=True) if sets else ([], np.zeros(0, int))
        codes = np.split(code, np.cumsum([len(s) for s in sets])[:-1]) if sets else []
        links, root = np.zeros(len(order), np.int64), list(range(len(order)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        cut_at = int(np.searchsorted(block, low, side="right")) if low != high else 0
        left, right = (signature, signature) if low == high else (signature[:cut_at], signature[cut_at:])
        for i, j in survivors(left, right, need, low == high):
            j = j + cut_at
            ok = verified(i, j, codes, len(kind), threshold)
            i, j = i[ok], j[ok]
            links += np.bincount(i, weights=copies[j], minlength=len(order)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(order)).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        return pa.table([pa.array(order, pa.int64()), pa.array(links), pa.array([order[find(x)] for x in range(len(order))], pa.int64())], names=["node", "links", "root"])

    return run


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, group_nodes: int = 1024) -> DataFrame:
    """(id_col, class_id, n_links) of every row: its class and how many other rows are at least as similar as the threshold."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingles(t, shingle) for t in texts(batch.column(1))]
            band = [bands(min_hash(s)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["id", "mark", "node", "bands"])

    described = cut(rows.mapInArrow(describe, f"id {id_type}, mark long, node long, bands array<long>"))
    named = described.select("id", "node")
    # class ids are the least ids; the row that shows a node is found by text and id, since ids may be null or stand on many texts
    nodes = described.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.min(F.struct("mark", "id")).alias("shown"))

    proposed = described.select("node", F.explode("bands").alias("band"))
    meeting = proposed.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select(F.col("band").alias("_band"), "a")
    edges = proposed.join(meeting, F.col("band") == F.col("_band")).filter("node != a").select("a", F.col("node").alias("b")).distinct()
    groups = cut(components(edges).withColumnRenamed("root", "group"))

    sizes = groups.groupBy(F.col("group").alias("_group")).agg(F.ceil(F.count("*") / group_nodes).cast("int").alias("blocks"))
    member = groups.join(sizes, F.col("group") == F.col("_group")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = member.join(nodes.select(F.col("node").alias("_node"), "copies", "shown"), F.col("node") == F.col("_node"))
    task = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    of = member.select("group", "node", "copies", F.col("shown.mark").alias("_mark"), F.col("shown.id").alias("_id"), "block", "blocks")
    dealt = rows.join(of, (F.col("mark") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["node"])  # a row repeated whole shows its node once
    dealt = dealt.select("group", "node", "copies", "block", "text", F.explode(task).alias("task")).select("group", F.col("task.low").alias("low"), F.col("task.high").alias("high"), "node", "copies", "block", "text")
    found = cut(dealt.groupBy("group", "low", "high").applyInArrow(_compare(threshold, tolerance, shingle), "node long, links long, root long"))

    links = found.groupBy(F.col("node").alias("_lnode")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("root != node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = cut(nodes.join(roots.withColumnRenamed("node", "_rnode"), F.col("node") == F.col("_rnode"), "left").select("node", "copies", "rep", F.coalesce("root", "node").alias("root")))
    classes = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("class_id"))
    about = rooted.join(classes, F.col("root") == F.col("_root")).join(links, F.col("node") == F.col("_lnode"), "left")
    about = about.select(F.col("node").alias("_node"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.join(about, F.col("node") == F.col("_node"), "left")
    alone = F.col("node").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
