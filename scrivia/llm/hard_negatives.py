"""Hard negatives by product quantisation with rigorous bounds.

Vectors are whole numbers, floor(scale * x). A codebook for every `sub_dims` components is fitted on at most `sample_rows` rows; every row keeps its codes and the norm of what the codes
leave over. For an anchor a, sums over its lookup tables give s, its product with a row's coded part; the true score lies within |a| times the stored norm of s. Rows whose whole interval
lies below the k-th best lower bound so far, or outside the window asked for, are out for certain; the others are scored exactly in whole numbers. The sample shapes only how many rows are left to score, never a result.

Anchors are asked against all rows in blocks: rows and anchors are packed into blocks of stated sizes, and a task holds one block of either. It returns the best few of its block for each anchor, and
a ranking over the blocks' answers follows. Two passes: positives first, then the windows that their scores define.

Defined results: rows without an id, label or vector, or with a component that is null or not finite take no part; rows repeated whole count once; an anchor's own id is never its
positive; vectors of different lengths are filled up with zeros; ids on several different vectors are anchors each for itself; of equal scores the smaller id comes first, then the smaller
label. Scores beyond a long are cut to its ends. An empty table gives no rows; other columns are ignored. A positive whose score is not above zero has no window, but for zero itself: scores of zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivia.llm.common import cut

_LONG = np.iinfo(np.int64)
#: float32 sums are off by less than this share of the sum of their terms' sizes.
_ROUNDING = 1e-5


class Codebooks:
    """256 centres or fewer for every sub_dims components."""

    def __init__(self, sample: np.ndarray, dims: int, sub_dims: int, rounds: int = 8):
        self.dims, self.sub_dims = dims, sub_dims
        self.parts = max(1, -(-dims // sub_dims))
        draw = np.random.default_rng(20260511)
        own = self._split(sample)
        self.centres = np.zeros((self.parts, 256, sub_dims))
        for part, points in enumerate(own):
            kinds = np.unique(points, axis=0)
            centres = kinds if len(kinds) <= 256 else kinds[np.sort(draw.choice(len(kinds), 256, replace=False))].copy()
            for _ in range(rounds if len(kinds) > 256 else 0):
                near = self._nearest(points, centres)
                count = np.bincount(near, minlength=len(centres))
                for d in range(sub_dims):
                    centres[:, d] = np.where(count > 0, np.bincount(near, points[:, d], len(centres)) / np.maximum(count, 1), centres[:, d])
            if len(centres):
                self.centres[part] = centres[np.arange(256) % len(centres)]

    def _split(self, rows: np.ndarray) -> np.ndarray:
        filled = np.zeros((len(rows), self.parts * self.sub_dims))
        filled[:, : rows.shape[1]] = rows
        return filled.reshape(len(rows), self.parts, self.sub_dims).transpose(1, 0, 2)

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = (centres**2).sum(1) / 2
        return np.concatenate([np.argmin(half - points[k : k + 4096] @ centres.T, axis=1) for k in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, one row of bytes for each part; norms of what is left)."""
        own, codes, left = self._split(rows), [], np.zeros(len(rows))
        for points, centres in zip(own, self.centres):
            near = self._nearest(points, centres)
            codes.append(near.astype(np.uint8))
            left += ((points - centres[near]) ** 2).sum(1)
        return np.array(codes), np.sqrt(left) * (1 + 1e-9)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(part, anchor, code): each anchor's product with each centre."""
        return np.einsum("pad,pcd->pac", self._split(anchors), self.centres)


def bounds(tables: np.ndarray, norms: np.ndarray, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values the score of each (anchor, row) must lie."""
    score = np.zeros((tables.shape[1], codes.shape[1]), np.float32)
    for table, code in zip(tables.astype(np.float32), codes):
        score += table[:, code]
    slack = (norms[:, None] * left[None, :] + _ROUNDING * np.abs(tables).max(2).sum(0)[:, None] + 1).astype(np.float32)
    return score - slack, score + slack


def exact(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number scores of anchors[i] with rows[i]."""
    if not len(anchors):
        return np.zeros(0, np.int64)
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", anchors, rows).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(anchors, rows)]
    return np.array([min(max(x, _LONG.min), _LONG.max) for x in whole], np.int64)


def _kth(values: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """For every row the k-th largest of its valid values; -inf where there are fewer."""
    held = np.where(valid, values, -np.inf)
    return np.partition(held, -k, axis=1)[:, -k] if held.shape[1] >= k else np.full(len(held), -np.inf)


def _best(i: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each i, by score downwards, then id and label."""
    order = np.lexsort((labels, ids, -score.astype(object) if len(score) and score.min() == _LONG.min else -score, i))
    i = i[order]
    begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    return order[rank < k]


def _unpacked(row: dict) -> dict[str, np.ndarray]:
    kinds = {"ids": np.int64, "labels": np.int64, "left": np.float64, "codes": np.uint8, "keys": np.int64, "scores": np.int64, "vectors": np.float64}
    out = {name: np.frombuffer(row[name], kind) for name, kind in kinds.items() if row.get(name) is not None}
    n = len(out["ids"])
    for name in ("codes", "scores", "vectors"):
        if name in out:
            out[name] = out[name].reshape(-1, n) if name == "codes" else out[name].reshape(n, -1)
    return out


def _blocks(books: Codebooks | None, dims: int):
    """One row that packs a block's rows: (block, ids, labels, keys, vectors, and with codebooks codes and left)."""

    def run(part: pa.Table) -> pa.Table:
        ids, labels = (part.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        vectors = np.zeros((len(ids), dims))
        for k, v in enumerate(part.column("vector").to_pylist()):
            vectors[k, : len(v)] = v
        order = np.lexsort((ids, labels))
        ids, labels, vectors, keys = ids[order], labels[order], vectors[order], part.column("key").to_numpy()[order]
        codes, left = books.encode(vectors) if books else (np.zeros((0, 0), np.uint8), np.zeros(0))
        blob = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table([part.column("block").slice(0, 1), *map(blob, (ids, labels, keys, vectors, codes, left))], names=["block", "ids", "labels", "keys", "vectors", "codes", "left"])

    return run


_PACKED = "block int, ids binary, labels binary, keys binary, vectors binary, codes binary, left binary"


def _positives(rows: dict, anchors: dict, books: Codebooks, k: int, low: np.ndarray, high: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block, each anchor's k best rows with its label: (anchor, row, score)."""
    allowed = (anchors["labels"][at, None] == rows["labels"][None, :]) & (anchors["ids"][at, None] != rows["ids"][None, :])
    i, j = np.nonzero(allowed & (high >= _kth(low, allowed, k)[:, None]))
    score = exact(anchors["vectors"][at][i], rows["vectors"][j])
    best = _best(i, score, rows["ids"][j], rows["labels"][j], k)
    return i[best], j[best], score[best]


def window(positive: int) -> tuple[int, int]:
    """Scores n with 50 * positive <= 100 * n <= 95 * positive."""
    return -(-positive // 2), 19 * positive // 20


def _negatives(rows: dict, anchors: dict, k: int, low: np.ndarray, high: np.ndarray, at: slice) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a block, the k best rows of other labels in the window of each positive: (positive's number, anchor, row, score)."""
    other = anchors["labels"][at, None] != rows["labels"][None, :]
    scores = anchors["scores"][at]
    for p in range(scores.shape[1]):
        given = scores[:, p] > _LONG.min
        least, most = (np.array(x, np.float64)[:, None] for x in zip(*(window(s) if ok else (1, 0) for s, ok in zip(scores[:, p].tolist(), given))))
        sure = other & (low >= least) & (high <= most)
        need = np.maximum(least[:, 0], _kth(low, sure, k))
        i, j = np.nonzero(other & (high >= need[:, None]) & (low <= most) & given[:, None])
        score = exact(anchors["vectors"][at][i], rows["vectors"][j])
        inside = (score >= least[i, 0]) & (score <= most[i, 0])
        i, j, score = i[inside], j[inside], score[inside]
        best = _best(i, score, rows["ids"][j], rows["labels"][j], k)
        yield p, i[best], j[best], score[best]


def _asked(books: Codebooks, k: int, negatives: bool, chunk: int = 64):
    """Rows (key, anchor_id, place, id, label, score) from every pair of a block of rows and a block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, anchors = _unpacked(row), _unpacked({n: row.get(f"a_{n}") for n in ("ids", "labels", "keys", "vectors", "scores")})
                for begin in range(0, len(anchors["ids"]), chunk):
                    at = slice(begin, begin + chunk)
                    own = anchors["vectors"][at]
                    low, high = bounds(books.tables(own), np.sqrt((own**2).sum(1)), rows["codes"], rows["left"])
                    found = _negatives(rows, anchors, k, low, high, at) if negatives else [(0, *_positives(rows, anchors, books, k, low, high, at))]
                    for place, i, j, score in found:
                        columns = [anchors["keys"][at][i], anchors["ids"][at][i], np.full(len(i), place, np.int64), rows["ids"][j], rows["labels"][j], score]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "anchor_id", "place", "id", "label", "score"])

    return run


def mine(
    vectors: DataFrame, anchor: str, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3,
    sub_dims: int = 2, sample_rows: int = 4096, row_block: int = 8192, anchor_block: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: a condition on `vec_id`, in SQL."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(F.coalesce(finite, F.lit(False)), whole).alias("vector"))
    rows = cut(rows.filter("vec_id is not null and label is not null and vector is not null").distinct())
    held, asked, dims = rows.agg(F.count("*"), F.count_if(F.expr(anchor)), F.max(F.size("vector"))).first()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return spark.createDataFrame([], names)

    # the rows of the least hashes: the same ones in every run
    mixed = F.xxhash64("vec_id", "label", "vector")
    sample = rows.withColumn("_h", mixed).orderBy("_h").limit(sample_rows).select("vector").toArrow().column(0).to_pylist()
    filled = np.zeros((len(sample), dims))
    for k, v in enumerate(sample):
        filled[k, : len(v)] = v
    books = Codebooks(filled, dims, sub_dims)

    n_rows, n_anchors = -(-held // row_block), -(-asked // anchor_block)
    keyed = rows.withColumn("key", mixed)
    packed = cut(keyed.withColumn("block", F.pmod(F.col("key"), F.lit(n_rows)).cast("int")).groupBy("block").applyInArrow(_blocks(books, dims), _PACKED))
    chosen = keyed.filter(F.expr(anchor)).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_anchors)).cast("int"))
    anchors = cut(chosen.groupBy("block").applyInArrow(_blocks(None, dims), _PACKED).select("block", "ids", "labels", "keys", "vectors"))
    parts = min(n_rows * n_anchors, 20_000)

    def against_all(of: DataFrame, k: int, late: bool) -> DataFrame:
        each_row = packed.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).repartition(parts, "block", "a_block")
        named = of.select(*(F.col(c).alias(f"a_{c}") for c in of.columns)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).withColumnRenamed("a_block", "_a_block").repartition(parts, "_block", "_a_block")
        pairs = each_row.join(named, (F.col("block") == F.col("_block")) & (F.col("a_block") == F.col("_a_block"))).drop("keys")
        found = pairs.mapInArrow(_asked(books, k, late), "key long, anchor_id long, place long, id long, label long, score long")
        first = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id", "label")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    best = cut(against_all(anchors, positives, False))
    scores = best.groupBy("key").agg(F.collect_list(F.struct("rank", "score")).alias("ranked"))

    def with_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.frombuffer(left.column("keys")[0].as_py(), np.int64)
        place = {k: n for n, k in enumerate(keys.tolist())}
        own = np.full((len(keys), positives), _LONG.min)
        for key, ranked in zip(right.column("key").to_pylist(), right.column("ranked").to_pylist()):
            for r in ranked:
                own[place[key], r["rank"] - 1] = r["score"]
        return left.append_column("scores", pa.array([own.tobytes()], pa.binary()))

    scores = scores.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_anchors)).cast("int"))
    scored = anchors.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(with_scores, "block int, ids binary, labels binary, keys binary, vectors binary, scores binary")
    mined = against_all(scored, negatives, True)
    own = best.select(F.col("key").alias("_key"), (F.col("rank") - 1).cast("long").alias("_place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(own, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
