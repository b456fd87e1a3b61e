"""Pairs of vectors of a small angle, found in cells around centres; whole cells are left out by a bound that no pair escapes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivia.functions import vectors as v
from scrivia.lineage import cut

#: Angles are computed in floating point; no bound is drawn tighter than this.
_HAIR = 1e-6


def _whole(vector: str) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Whole vectors scaled to length one; shorter ones are filled up with zeros, which changes no angle between vectors of one length."""
    out = np.zeros((len(column), dims))
    for n, row in enumerate(column.to_pylist()):
        out[n, : len(row)] = row
    out /= np.maximum(np.abs(out).max(1, initial=0.0), np.finfo(float).tiny)[:, None]
    return out / np.sqrt((out * out).sum(1))[:, None]


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


def semantic_candidates(own: DataFrame, peers: DataFrame, *, least: float, most_centres: int = 1024) -> DataFrame:
    """own (scope, own_id, own_idx, emb), peers (scope, peer_id, peer_idx, pemb) to their pairs (both with their vectors), of a scope and other ids, without any that a bound keeps below a cosine of `least`.

    Every peer lies in the cell of its nearest centre; centres are the square root of the peers in number, `most_centres` at most, taken by least hash. Angles obey the triangle
    inequality: a peer within acos(least) of a vector lies in a cell whose radius reaches that far, and its angle to the centre differs from the vector's by no more. So only such
    cells, and in them such angles, are joined. Centres shape only how many pairs are left. Null, empty, unequal, not finite and zero vectors match nothing.
    """
    spark = peers.sparkSession
    peers = cut(peers.filter(_whole("pemb")))
    n, dims = peers.agg(F.count("*"), F.max(F.size("pemb"))).first()
    mixed = F.xxhash64("pemb", "peer_id", "peer_idx")
    wanted = min(most_centres, max(1, math.isqrt(n)))
    sample = peers.select("pemb", mixed.alias("_h")).orderBy("_h").limit(wanted).select("pemb").toArrow().column(0)
    dims = dims or 1
    centres = spark.sparkContext.broadcast(_units(sample, dims) if len(sample) else np.eye(1, dims))
    reach = math.acos(max(-1.0, min(1.0, least))) + _HAIR

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(batch.num_columns - 1), dims)
            angles = _angles(units, centres.value)
            near = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])], names=[*batch.schema.names, "cell", "angle"])

    kinds = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    rows = peers.select(F.col("scope").alias("_s"), "peer_id", "peer_idx", "pemb")
    rows = cut(rows.mapInArrow(placed, f"{kinds(rows)}, cell int, angle double"))
    cells = rows.groupBy("_s", "cell").agg(F.max("angle").alias("radius"))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                angles = _angles(_units(part.column(part.num_columns - 1), dims), centres.value)
                row = np.repeat(np.arange(len(angles)), angles.shape[1])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns), pa.array(np.tile(np.arange(angles.shape[1], dtype=np.int32), len(angles))), pa.array(angles.ravel())], names=[*part.schema.names, "_cell", "_angle"])

    asked = own.filter(_whole("emb") & (F.size("emb") <= dims)).select("scope", "own_id", "own_idx", "emb")
    probes = asked.mapInArrow(probed, f"{kinds(asked)}, _cell int, _angle double")
    # a vector's probes are first held against its scope's cells, so that only those in reach meet any peers
    near = probes.join(cells, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("cell")) & (F.col("_angle") - F.col("radius") <= reach)).drop("_s", "cell", "radius")
    met = near.join(rows, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("cell")) & (F.abs(F.col("_angle") - F.col("angle")) <= reach) & (F.col("own_id") != F.col("peer_id")))
    return met.select("own_id", "own_idx", "peer_id", "peer_idx", "emb", "pemb")


def semantic_pairs(own: DataFrame, peers: DataFrame, *, least: float, most_centres: int = 1024) -> DataFrame:
    """(own_id, own_idx, peer_id, peer_idx, semantic): the candidates scored exactly, and those of a cosine of at least `least`."""
    met = semantic_candidates(own, peers, least=least, most_centres=most_centres)
    return met.select("own_id", "own_idx", "peer_id", "peer_idx", v.cosine(F.col("emb"), F.col("pemb")).alias("semantic")).filter(F.col("semantic") >= least)
