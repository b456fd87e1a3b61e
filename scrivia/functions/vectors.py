"""Signatures, vectors and the strength of a match."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivia import constants as k


_SEEDED = (np.uint64(2166136261) ^ ((np.arange(k.MINHASH_SEEDS, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))).astype(np.uint32)
#: Shingles hashed at once, and by how many seeds; the factor of each, since arrays multiply faster than by a scalar.
_BLOCK, _SEEDS_AT_ONCE = 8192, 16
_FACTOR = np.full(_BLOCK, 16777619, np.uint32)


def _minima(units: np.ndarray, begin: np.ndarray, length: np.ndarray, own: np.ndarray, count: int) -> np.ndarray:
    """(seed, text): minima of the hashes of units[begin : begin + length], each shingle of the text that `own` numbers in rising order."""
    out = np.full((k.MINHASH_SEEDS, count), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(begin), _BLOCK):
        order = np.argsort(-length[a : a + _BLOCK], kind="stable")
        at, long, of = begin[a : a + _BLOCK][order], length[a : a + _BLOCK][order], own[a : a + _BLOCK]
        left = len(at) - np.searchsorted(long[::-1], np.arange(long[0]), side="right")  # shingles that still have a character here
        chars = [units[at[:n] + c] for c, n in enumerate(left)]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        texts = of[first]
        for s in range(0, k.MINHASH_SEEDS, _SEEDS_AT_ONCE):
            h = np.repeat(_SEEDED[s : s + _SEEDS_AT_ONCE, None], len(at), axis=1)
            for n, c in zip(left, chars):
                part = h[:, :n]
                np.bitwise_xor(part, c, out=part)
                np.multiply(part, _FACTOR[:n], out=part)
            h ^= h >> np.uint32(16)
            seeds = slice(s, s + _SEEDS_AT_ONCE)
            out[seeds, texts] = np.minimum(out[seeds, texts], np.minimum.reduceat(h[:, back], first, axis=1))
    return out


def signatures_of(texts: list[list[str]]) -> np.ndarray:
    """(text, seed): seeded FNV-1a minima over the distinct word shingles of each text's words, its first MOST_SHINGLES; all ones where there is none. Words hold no spaces.

    Shingles of all the texts are hashed side by side; a repeated one changes no minimum, so they are made distinct only where there may be too many.
    """
    counts = np.array([len(words) for words in texts], np.int64)
    if not counts.sum():
        return np.full((len(texts), k.MINHASH_SEEDS), 0xFFFFFFFF, np.int64)
    units = np.frombuffer(" ".join(w for words in texts for w in words).encode("utf-16-le"), np.uint16).astype(np.uint32)
    gaps = np.flatnonzero(units == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(units)]
    width = np.minimum(k.SHINGLE_WORDS, counts)
    n = np.where(counts > 0, counts - width + 1, 0)
    own = np.repeat(np.arange(len(texts)), n)
    word = np.arange(n.sum()) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)
    begin, length = starts[word], ends[word + np.repeat(width, n) - 1] - starts[word]
    for t in np.flatnonzero(n > k.MOST_SHINGLES):
        words, rows = texts[t], np.flatnonzero(own == t)
        first = {}
        for i in range(len(rows)):
            first.setdefault(" ".join(words[i : i + k.SHINGLE_WORDS]), i)
        gone = np.setdiff1d(rows, rows[list(first.values())[: k.MOST_SHINGLES]])
        own, begin, length = np.delete(own, gone), np.delete(begin, gone), np.delete(length, gone)
    return _minima(units, begin, length, own, len(texts)).T.astype(np.int64)


def signature_of(words: list[str]) -> list[int]:
    """The signature of one text's words."""
    return signatures_of([[] if words is None else list(words)])[0].tolist()


def fnv1a(text: Column, seed: Column) -> Column:
    """Seeded 32-bit FNV-1a over the characters of an ASCII text, with its halves folded."""
    whole = F.lit(0xFFFFFFFF).cast("bigint")
    start = F.lit(2166136261).cast("bigint").bitwiseXOR((seed.cast("bigint") * 2654435761).bitwiseAND(whole))
    h = F.aggregate(F.split(text, ""), start, lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(whole))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


@F.arrow_udf(T.ArrayType(T.LongType()))
def min_hash(folded: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Signatures of folded texts, over their words of two characters or more; equal texts of a batch are signed once."""
    for batch in folded:
        known = batch.dictionary_encode()
        signed, part, held = [np.zeros((0, k.MINHASH_SEEDS), np.int64)], [], 0
        for text in known.dictionary.to_pylist():
            part.append([w for w in text.split(" ") if len(w) > 1])
            held += len(part[-1])
            if held >= 50_000:
                signed.append(signatures_of(part))
                part, held = [], 0
        signed += [signatures_of(part)] if part else []
        signed.append(signatures_of([[]]))  # of null
        rows = np.concatenate(signed)[known.indices.fill_null(len(known.dictionary)).to_numpy(zero_copy_only=False)]
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k.MINHASH_SEEDS, pa.int32()), pa.array(rows.ravel()))


def minhash_similarity(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same / F.least(F.size(a), F.size(b))


def cosine(a: Column, b: Column) -> Column:
    """Null for null, empty or unequal vectors and for a zero norm."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    square = lambda v: total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm)


def hybrid(lexical: Column, semantic: Column) -> Column:
    return F.when(semantic.isNull(), lexical).otherwise(0.65 * lexical + 0.35 * F.greatest(F.lit(0.0), semantic))


def match_strength(lexical: Column, semantic: Column) -> Column:
    """struct<kind,strength>, or null below the thresholds."""
    direct = F.when(lexical >= k.DIRECT_HIGH, 1.0).when(lexical >= k.DIRECT_REVIEW, 0.6).otherwise(0.0)
    other = F.when(semantic >= k.SEMANTIC_HIGH, 1.0).when(semantic >= k.SEMANTIC_REVIEW, 0.6).otherwise(0.0)
    kind = F.when(direct >= other, "direct").otherwise("semantic")
    return F.when((direct > 0) | (other > 0), F.struct(kind.alias("kind"), F.greatest(direct, other).alias("strength")))


def similarity_level(percent: Column, escalation: Column) -> Column:
    high = (percent >= k.REPORT_HIGH_PERCENT) | (escalation >= k.DIRECT_HIGH)
    review = (percent >= k.REPORT_REVIEW_PERCENT) | (escalation >= k.DIRECT_REVIEW)
    return F.when(high, "high").when(review, "review").otherwise("normal")


def word_count_vectors(texts: list[str | None], dims: int = 16) -> tuple[int, list[list[float]]]:
    """(status, vectors) as an embedder gives them: a text's words counted by hash. Words are what spaces, tabs and line ends part."""
    out = []
    for text in texts:
        own = [0.0] * dims
        for word in re.findall(r"[^ \t\n\r]+", text or ""):
            own[int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % dims] += 1.0
        out.append(own)
    return 200, out
