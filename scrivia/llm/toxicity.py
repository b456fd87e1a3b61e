"""Toxicity: a counterfactual-regularised classifier.

A logistic model over hashed words and word beginnings. Every sentence of the sampled documents that mentions an identity term is rewritten with each
other term of its set; the loss holds the squared difference of both sentences' scores, so that naming one group rather than another moves no score
and a neutral mention carries no weight.

The fit uses a bounded sample of labelled rows (sample_per_class of either label, in order of a hash of the id) and the first most_swaps rewritten sentences of
it in that order. Features are kept by how much more often one class holds them, a measure that is the same at every sample size; the weights of the
rest are held small. Scoring reads every whole text once, in a narrow pass, with a broadcast weight vector of fixed size.

Defined results: a null or empty text scores as the intercept; labels that are null or belong to no document are not learned from; repeated labels count each; with
no labelled rows of one class the score is that of the other; a very long text counts each of its words once; ties in the sample's order go by id; repeated rows
score alike; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import LOWER, slices, texts

BITS = 20
#: Neutral identity terms by set; a term is exchanged for the others of its own set.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("immigrants", "refugees", "natives"),
)
#: Every byte that is no ASCII letter, no digit and not beyond ASCII separates words.
_NORMAL = bytes(LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 10 if b in b".!?\n" else 32 for b in range(256))
_MASK = (1 << BITS) - 1


def features(word: bytes) -> tuple[int, ...]:
    """Where a word counts: itself and, if longer, its first four, five and six bytes."""
    own = (zlib.crc32(word) & _MASK,)
    return own + tuple(zlib.crc32(b"%d:" % n + word[:n]) & _MASK for n in (4, 5, 6) if len(word) > n)


def document_features(text: bytes) -> np.ndarray:
    """Hashed features of the distinct words, with repeats where words share a beginning."""
    return np.fromiter((f for w in set(text.translate(_NORMAL).split()) for f in features(w)), np.uint32)


def partners_of(terms: tuple[tuple[str, ...], ...]) -> dict[bytes, list[bytes]]:
    return {t.encode(): [x.encode() for x in group if x != t] for group in terms for t in group}


def counterfactuals(text: bytes, partners: dict[bytes, list[bytes]]) -> list[tuple[list[bytes], list[bytes]]]:
    """(a sentence's words, the words of its rewriting) for every identity term of every sentence and each other term of its set."""
    out = []
    for sentence in text.translate(_NORMAL).split(b"\n"):
        words = sentence.split()
        for term in dict.fromkeys(w for w in words if w in partners):
            out += [(words, [other if w == term else w for w in words]) for other in partners[term]]
    return out


def word_features(words: list[bytes]) -> np.ndarray:
    return np.fromiter((f for w in set(words) for f in features(w)), np.uint32)


def sample(labels: DataFrame, *, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """At most per_class labelled ids of either class."""
    parts = [labels.filter(F.col(label_col) == y).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of feature numbers laid end to end; a feature may stand twice in a row."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=width)


def loss_and_gradient(w: np.ndarray, bias: float, x: Sparse, y: np.ndarray, said: Sparse, swapped: Sparse, swap_weight: float, l2: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Log loss, L2, and swap_weight times the mean squared change of a sentence's score under its rewriting; with gradients of weights and bias."""
    p = sigmoid(x.times(w) + bias)
    loss = -float(np.mean(np.where(y > 0, np.log(p + 1e-12), np.log(1 - p + 1e-12)))) + 0.5 * float(l2 @ (w * w))
    g, gb = x.back((p - y) / len(y), len(w)) + l2 * w, float((p - y).mean())
    if said.n:
        a, b = sigmoid(said.times(w) + bias), sigmoid(swapped.times(w) + bias)
        loss += swap_weight * float(np.mean((a - b) ** 2))
        push = 2 * swap_weight * (a - b) / said.n
        ra, rb = push * a * (1 - a), -push * b * (1 - b)
        g += said.back(ra, len(w)) + swapped.back(rb, len(w))
        gb += float((ra + rb).sum())
    return loss, g, gb


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = 2000, swap_weight: float = 4.0, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, most_swaps: int = 20_000, lift: float = 4.0, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, intercept) learned from a bounded sample of `labels`, which the caller has already restricted.

    lift: how many times more often, counts smoothed by a half, one class's documents must hold a feature than the other's for it to be learned.
    """
    counts = dict(labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect())
    weights, partners = np.zeros(1 << BITS), partners_of(terms)
    if len(counts) < 2:
        return weights, 20.0 * (2 * max(counts, default=0) - 1) if counts else -20.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda words: word_features(words).tobytes()
        for batch in slices(batches, 0):
            own = texts(batch.column(0))
            swaps = [[{"said": packed(a), "swapped": packed(b)} for a, b in counterfactuals(t, partners)] for t in own]
            pair = pa.list_(pa.struct([("said", pa.binary()), ("swapped", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([document_features(t).tobytes() for t in own], pa.binary()), pa.array(swaps, pair)], names=["y", "place", "x", "swaps"])

    chosen = F.broadcast(sample(labels, id_col=id_col, label_col=label_col, per_class=sample_per_class))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(chosen, "_id").select("t", "_y", F.xxhash64("_id", "t").alias("place"))
    table = rows.mapInArrow(run, "y int, place long, x binary, swaps array<struct<said:binary,swapped:binary>>").toArrow().sort_by("place")
    y = np.asarray(table.column("y").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return weights, 20.0 * (2 * float(y[0]) - 1) if len(y) else -20.0
    xs = [np.frombuffer(x, np.uint32) for x in table.column("x").to_pylist()]
    have = np.zeros((2, 1 << BITS))
    for x, label in zip(xs, y.astype(int)):
        have[label, np.unique(x)] += 1
    size = np.array([[np.sum(y == 0)], [np.sum(y == 1)]])
    odds = np.log((have[1] + 0.5) / (size[1] + 1)) - np.log((have[0] + 0.5) / (size[0] + 1))
    pairs = [(np.frombuffer(p["said"], np.uint32), np.frombuffer(p["swapped"], np.uint32)) for own in table.column("swaps").to_pylist() for p in own][:most_swaps]
    kept = (have.sum(0) > 1) & (np.abs(odds) >= np.log(lift))
    for term in partners:  # the terms themselves are always learned, so that the penalty can see them
        kept[list(features(term))] |= have.sum(0)[list(features(term))] > 0
    used = np.flatnonzero(kept)
    number = np.full(1 << BITS, -1)
    number[used] = np.arange(len(used))
    known = lambda x: (n := number[x])[n >= 0]
    x, said, swapped = Sparse([known(r) for r in xs]), Sparse([known(a) for a, _ in pairs]), Sparse([known(b) for _, b in pairs])
    rate = y.mean()
    w, bias = np.zeros(len(used)), float(np.log(rate / (1 - rate)))
    # a feature of few documents is held tighter: its rate is less certain
    hold = l2 * (1 + 40 / np.maximum(have.sum(0)[used], 1))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, g, gb = loss_and_gradient(w, bias, x, y, said, swapped, swap_weight, hold)
        full = np.append(g, gb)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w
    natural = counts[1] / counts[0]
    return weights, float(bias + np.log(natural) - np.log(rate / (1 - rate)))


_cache: dict[str, tuple[np.ndarray, dict[bytes, float]]] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """(id_col, score) of every document."""
    key, shared, bias = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _cache:
            _cache.clear()
            _cache[key] = (shared.value, {})
        weights, known = _cache[key]
        for batch in slices(batches, 1):
            out = []
            for text in texts(batch.column(1)):
                total = bias
                for word in set(text.translate(_NORMAL).split()):
                    if (x := known.get(word)) is None:
                        if len(known) >= remembered:
                            known.clear()
                        x = known[word] = float(sum(weights[f] for f in features(word)))
                    total += x
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
