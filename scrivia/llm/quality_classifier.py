"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words. Every passage of the whole text is encoded by what it is made of (shares of byte classes, word
lengths, repetition) and by what it says: hashed words and hashed four-byte grams carry evidence learned from the document labels, of which a
passage holds the mean and the shares of strong words. Gated attention, exp(w . (tanh(V h) * sigmoid(U h))), learned from document labels alone,
weighs the passages, and a logistic layer scores the weighted passage representation.

The fit uses a bounded sample of labelled rows (sample_per_class of either label). The evidence that a sampled document is encoded with comes from the other
half of the sample, so the layers above learn from it as they will meet it; counts are summed by Spark before they reach the driver. Scoring is one narrow pass over all rows.

Defined results: a null or empty text is one passage of zeros; unlabelled or null labels are not learned from; with no labelled rows of one class the score is that
of the other; a very long text is a long bag, held whole while it is scored; ties in the sample's order go by id; repeated rows score alike, and repeated labels count each; an
empty table gives no rows; of other columns only those in carry pass, so names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import mix64, slices, texts
from scrivia.llm.toxicity import sample

PASSAGE_WORDS = 64
#: Byte classes: lower case, upper case, digit, white space, full stop and comma, other marks of prose, `!`, symbols, beyond ASCII, controls.
_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
for _k, _own in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r", b".,", b"'\"()-:;?/", b"!", b"#*$%&|<>@^~=+_\\[]{}`", bytes(range(128, 256)))):
    _CLASS[list(_own)] = _k
_RANDOM = np.random.default_rng(20260101).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
#: Buckets of hashed words and of hashed grams.
BUCKETS = 1 << 16
WIDTH = _CLASSES + 10
_HIDDEN = 12


class Evidence:
    """For each bucket of words and of grams how much more often good documents hold it, as log odds."""

    def __init__(self, counts: np.ndarray | None = None):
        """counts: label x (words, grams) x bucket."""
        if counts is None:
            counts = np.zeros((2, 2, BUCKETS))
        share = (counts + 1.0) / (counts.sum(2, keepdims=True) + BUCKETS)
        self.words, self.grams = np.log(share[1] / share[0]).astype(np.float32)


def grams_of(raw: np.ndarray) -> np.ndarray:
    """The bucket of the four bytes from each place on; three places fewer than bytes."""
    h = np.zeros(max(0, len(raw) - 3), np.uint32)
    for k, m in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)):
        h += raw[k : k + len(h)].astype(np.uint32) * np.uint32(m)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


class Words:
    """The words of many documents laid end to end, and the passages that they make."""

    def __init__(self, batch: list[bytes]):
        self.raw = np.frombuffer(b"".join(t + b"\n" for t in batch), np.uint8)
        lengths = np.array([len(t) + 1 for t in batch], np.int64)
        self.begin_doc = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(batch) else np.zeros(0, np.int64)
        self.kind = _CLASS[self.raw]
        solid = self.kind != 3
        self.start = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
        self.stop = np.flatnonzero(solid & np.concatenate((~solid[1:], [True]))) + 1
        self.doc = np.searchsorted(self.begin_doc, self.start, side="right") - 1
        # a hash of bytes and places
        letter = _RANDOM[self.raw] * (np.arange(len(self.raw), dtype=np.uint64) + np.uint64(1))
        flat = np.concatenate(([np.uint64(0)], np.cumsum(letter, dtype=np.uint64)))
        plain = np.concatenate(([np.uint64(0)], np.cumsum(_RANDOM[self.raw], dtype=np.uint64)))
        self.name = (flat[self.stop] - flat[self.start]) - (plain[self.stop] - plain[self.start]) * self.start.astype(np.uint64)
        self.bucket = (mix64(self.name) >> np.uint64(48)).astype(np.int64)
        first_word = np.searchsorted(self.doc, np.arange(len(batch)))
        opens = (np.arange(len(self.start)) - first_word[self.doc]) % PASSAGE_WORDS == 0
        self.passage, self.heads = np.cumsum(opens) - 1, np.flatnonzero(opens)
        self.owner, self.lo = self.doc[self.heads], self.start[self.heads]
        self.hi = np.append(self.start[self.heads[1:]], len(self.raw))[: len(self.heads)]
        last = np.append(self.owner[1:] != self.owner[:-1], True)[: len(self.heads)]
        self.hi[last] = (self.begin_doc + lengths)[self.owner[last]]


def encode(batch: list[bytes], evidence: Evidence) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, index of each passage's document), for many documents at once."""
    w = Words(batch)
    n = len(w.heads)
    if not n:
        return np.zeros((len(batch), WIDTH)), np.arange(len(batch))
    words = np.diff(np.append(w.heads, len(w.start)))
    mean = lambda x: np.bincount(w.passage, weights=x, minlength=n) / words
    out = np.zeros((n, WIDTH))
    size = np.maximum(w.hi - w.lo, 1)
    for k in range(_CLASSES):
        upto = np.concatenate(([0], np.cumsum(w.kind == k, dtype=np.int64)))
        out[:, k] = (upto[w.hi] - upto[w.lo]) / size
    # how many words of a passage are new in it and in the document
    for column, group in ((_CLASSES, w.passage), (_CLASSES + 1, w.doc)):
        key = w.name ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        fresh = np.zeros(len(key), bool)
        fresh[np.unique(key, return_index=True)[1]] = True
        out[:, column] = mean(fresh)
    size_of = w.stop - w.start
    out[:, _CLASSES + 2], out[:, _CLASSES + 3] = mean(size_of) / 10, mean(size_of == 1)
    out[:, _CLASSES + 4] = mean(np.concatenate(([False], (w.name[1:] == w.name[:-1]) & (w.doc[1:] == w.doc[:-1]))))
    out[:, _CLASSES + 5] = np.log1p(words) / np.log1p(PASSAGE_WORDS)
    said = evidence.words[w.bucket]
    out[:, _CLASSES + 6], out[:, _CLASSES + 7], out[:, _CLASSES + 8] = mean(said), mean(said > 1), mean(said < -1)
    upto = np.concatenate(([0.0], np.cumsum(evidence.grams[grams_of(w.raw)], dtype=np.float64)))
    first = np.minimum(w.lo, len(upto) - 1)
    last = np.maximum(first, np.minimum(w.hi - 3, len(upto) - 1))
    out[:, _CLASSES + 9] = (upto[last] - upto[first]) / np.maximum(last - first, 1)
    empty = np.setdiff1d(np.arange(len(batch)), w.owner)
    return np.vstack((out, np.zeros((len(empty), WIDTH)))), np.concatenate((w.owner, empty))


class Model:
    """Passage layer, gated attention and logistic score, with hand-written gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {"E": d(WIDTH, _HIDDEN), "e": np.zeros(_HIDDEN), "V": d(_HIDDEN, _HIDDEN), "U": d(_HIDDEN, _HIDDEN), "w": d(_HIDDEN), "c": d(_HIDDEN), "b": np.zeros(1)}
        self.shift, self.evidence = 0.0, Evidence()

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = np.exp(np.clip((t * s) @ p["w"], -20, 20))
        total = np.bincount(doc, weights=g, minlength=n)
        a = g / total[doc]
        z = np.stack([np.bincount(doc, weights=a * h[:, k], minlength=n) for k in range(_HIDDEN)], 1)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["b"][0]}

    def scores(self, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, doc, n)["logit"] + self.shift, -30, 30)))

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log loss."""
        n, p = len(y), self.p
        f = self.forward(x, doc, n)
        r = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / n
        dz = np.outer(r, p["c"])
        da = (dz[doc] * f["h"]).sum(1)
        mean_da = np.bincount(doc, weights=f["a"] * da, minlength=n)
        dg = f["a"] * (da - mean_da[doc])
        dts = np.outer(dg, p["w"])
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[doc] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dpre, "e": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dg, "c": f["z"].T @ r, "b": np.array([r.sum()])}

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int, l2: float = 1e-4) -> None:
        p = self.p
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            for k, g in self.gradients(x, doc, y).items():
                g = g + l2 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def _counts(rows: DataFrame) -> np.ndarray:
    """half x label x (words, grams) x bucket: how often the sampled documents hold each; tables of fixed size, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in slices(batches, 0):
            for text, y, half in zip(texts(batch.column(0)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                w = Words([text])
                own = total.setdefault((half, y), np.zeros((2, BUCKETS)))
                own[0] += np.bincount(w.bucket, minlength=BUCKETS)
                own[1] += np.bincount(grams_of(w.raw), minlength=BUCKETS)
        for (half, y), own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([half], pa.int32()), pa.array([y], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["half", "y", "n"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in part.column("n").to_pylist())
        return pa.table([part.column("half")[:1], part.column("y")[:1], pa.array([total.tobytes()], pa.binary())], names=["half", "y", "n"])

    schema = "half int, y int, n binary"
    out = np.zeros((2, 2, 2, BUCKETS))
    for r in rows.mapInArrow(count, schema).groupBy("half", "y").applyInArrow(add, schema).collect():  # four rows
        out[r.half, r.y] = np.frombuffer(r.n).reshape(2, BUCKETS)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = 1500, steps: int = 250) -> Model:
    """A model learned from a bounded sample of `labels`, which the caller has already restricted."""
    model = Model()
    counts = dict(labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect())

    chosen = F.broadcast(sample(labels, id_col=id_col, label_col=label_col, per_class=sample_per_class))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t")).join(chosen, "_id").select("t", "_id", "_y", F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("_half"))
    halves = _counts(rows) if len(counts) == 2 else np.zeros((2, 2, 2, BUCKETS))
    learned = docs.sparkSession.sparkContext.broadcast([Evidence(halves[1]), Evidence(halves[0])])  # a half is encoded by what the other shows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            half, own = np.asarray(batch.column(3).to_pylist()), [b""] * batch.num_rows
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                x, doc = encode([t for t, k in zip(texts(batch.column(0)), half) if k == h], learned.value[h])
                for k, row in enumerate(at):
                    own[row] = x[doc == k].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(run, f"id {id_type}, y int, x binary").toArrow().to_pylist() if len(counts) == 2 else []
    got.sort(key=lambda r: (str(r["id"]), r["x"]))  # the same model whatever order the rows come in
    if len({r["y"] for r in got}) < 2:
        model.p = {k: np.zeros_like(q) for k, q in model.p.items()}
        model.shift = 20.0 * (2 * max(counts, default=1) - 1)
        return model
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    y = np.array([r["y"] for r in got], float)
    model.fit(np.vstack(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y, steps)
    model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.mean() / (1 - y.mean())))
    model.evidence = Evidence(halves.sum(0))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """(id_col, score_col) of every document, with the columns named in carry."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            x, doc = encode(texts(batch.column(0)), shared.value.evidence)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.scores(x, doc, batch.num_rows))], names=[*columns, score_col])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in columns)).mapInArrow(run, f"{types}, `{score_col}` double")
