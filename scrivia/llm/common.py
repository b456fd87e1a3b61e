"""What the corpus operators share: lineage cuts, byte-level text helpers and block exchanges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivia.lineage import cut  # noqa: F401

#: ASCII white space, as in `[^\x20\x09-\x0D]+`; bytes.split() cuts at exactly these.
SPACES = b"\t\n\x0b\x0c\r "
#: Bytes 0x80-0xBF continue a code point in UTF-8.
CONTINUATION = bytes(range(0x80, 0xC0))
#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `most` bytes (one longer text stays whole)."""
    for batch in batches:
        begin = held = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def blocks_for(df: DataFrame, text_col: str, block_bytes: int) -> int:
    """How many blocks of about block_bytes the texts need; grows with the input."""
    return max(1, math.ceil(text_bytes(df, text_col) / block_bytes))


def block_of(id_col: str, text_col: str, blocks: int) -> Column:
    """Deals rows out by id and text, so neither one id nor one text's copies meet in one block."""
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reached(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets that sorted keys reach, where each begins, and the end): bucket b holds about the b-th equal share of the 64-bit range.

    Only buckets with keys are looked at, so the work follows the keys and not the number of buckets.
    """
    own = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return own[first].astype(np.int64), np.append(first, len(keys))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of equal weight, so that the shuffle's compression finds the high zeros."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def by_bucket(block: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket of the key range that sorted keys reach: what a block asks of that bucket."""
    own, edge = reached(keys, buckets)
    cuts = lambda x, form: pa.array([form(x[i:j]) for i, j in zip(edge, edge[1:])], pa.binary())
    return pa.table([pa.array([block] * len(own), pa.int32()), pa.array(own, pa.int32()), cuts(keys, packed_keys), cuts(values, bytes)], names=["_block", "bucket", "keys", "found"])


def summed(rows: pa.Table) -> pa.Table:
    """Rows of one bucket, (block, bucket, keys, counts): each block gets, in its keys' order, their counts over all blocks."""
    parts = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("found").to_pylist()])
    place = np.unique(np.concatenate(parts), return_inverse=True)[1]
    total = np.bincount(place, weights=counts).astype(np.uint64)[place]  # whole numbers below 2^53
    out, at = [], 0
    for p in parts:
        out.append(total[at : at + len(p)].tobytes())
        at += len(p)
    return pa.table([rows.column("_block"), rows.column("bucket"), pa.array(out, pa.binary())], names=["_block", "bucket", "found"])


def answered(rows: pa.Table, kind: type = np.uint64) -> np.ndarray:
    """A block's answers in the order of its sorted keys."""
    order = np.argsort(np.asarray(rows.column("bucket").to_pylist()), kind="stable")
    found = rows.column("found").to_pylist()
    return np.frombuffer(b"".join(found[i] for i in order), kind)
