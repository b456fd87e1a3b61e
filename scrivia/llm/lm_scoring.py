"""LM scoring with a weighted backoff automaton.

States are the contexts of the n-gram model: the root and one state for each word (and for the start of a text).
A seen bigram is an arc of its state; every state has a failure arc to the root, and the root has an arc for
every word. Weights are log10 of a Dirichlet-smoothed bigram, P(w|u) = (c(uw) + mu P(w)) / (c(u) + mu), whose unseen
part is the failure weight mu / (c(u) + mu) times the root's P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). One left-to-right traversal of
a text carries the state, takes the arc or fails over, and adds the weights up; it is done for a block of texts at once, with numpy.

Counts cover every training text and nothing is pruned. No task or driver holds the model: texts are dealt into
blocks; a block asks for just the n-grams that it holds, with its own counts, sorted and cut by range of a 64-bit key; ranges are summed
by Spark's shuffle and sent back, so each block builds the part of the automaton that its texts can reach. A frequent
n-gram is one key per block wherever it occurs.

The model is of order two: three words' counts would not pass through the shuffle within the disk that this operator is given.

Defined results: a null or empty text is its end token alone; null ids are training rows, not held out; repeated rows count each; with no
training texts every count is 0; an empty table gives no rows; other columns, whatever their names, are ignored; a very long text is held whole, with about 60 bytes for each
of its words. There are no ties. Keys are 64-bit hashes of words and word pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import LOWER, answered, block_of, by_bucket, mix64, slices, summed, text_bytes, texts, unpacked_keys

#: What no word can be: words hold no white space.
_END, _START = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


@dataclass
class Block:
    """The tokens of a block's texts. Token 0 is the end, token 1 the start; arrays follow the texts one after another."""

    token: np.ndarray
    before: np.ndarray
    text_of: np.ndarray
    names: np.ndarray

    @classmethod
    def of(cls, batch: list[bytes]) -> Block:
        number: dict[bytes, int] = {}
        tokens, sizes = [], []
        for text in batch:
            own = [number.setdefault(w, len(number) + 2) for w in words_of(text)]
            own.append(0)
            tokens.append(np.array(own, np.int32))
            sizes.append(len(own))
        token = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        before = np.roll(token, 1)
        before[np.cumsum([0, *sizes[:-1]])] = 1
        names = np.fromiter((_END, _START, *map(xxhash.xxh3_64_intdigest, number)), np.uint64, len(number) + 2)
        return cls(token, before, np.repeat(np.arange(len(batch)), sizes), names)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs as numbers, the pair of every position)."""
        return np.unique(self.before.astype(np.int64) * len(self.names) + self.token, return_inverse=True)

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        """Keys of the block's words, then of its pairs."""
        first, second = np.divmod(pairs, len(self.names))
        return np.concatenate((mix64(self.names), mix64(mix64(self.names[first] + np.uint64(0x9E3779B97F4A7C15)) ^ self.names[second])))


class Automaton:
    """The part of the model that a block can reach: a state for each context, and the root as the last state.

    arcs: the seen (state, token) pairs in order, each with its weight; every state's failure arc leads to the root, with a weight; the root has an arc for
    every token. Whatever arc takes a token, the next state is that token's context.
    """

    def __init__(self, block: Block, pairs: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, mu: float):
        self.tokens = len(block.names)
        self.count = counts[: self.tokens].astype(float)
        together = counts[self.tokens :].astype(float)
        context = self.count.copy()
        context[1] = self.count[0]  # every training text starts once and ends once
        root = (self.count + 0.5) / (tokens + 0.5 * (kinds + 1))
        self.root, self.fail = np.log10(root), np.log10(mu / (context + mu))
        seen = together > 0
        first, second = np.divmod(pairs[seen], self.tokens)
        self.arcs = pairs[seen]  # in order of state, then token
        self.weight = np.log10((together[seen] + mu * root[second]) / (context[first] + mu))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the states after, the weights taken) of one token each for many traversals."""
        wanted = state.astype(np.int64) * self.tokens + token
        at = np.minimum(np.searchsorted(self.arcs, wanted), max(len(self.arcs) - 1, 0))
        taken = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(wanted), bool)
        fallen = self.fail[state] + self.root[token]
        return token, np.where(taken, self.weight[at], fallen) if len(self.arcs) else fallen

    def scores(self, block: Block) -> np.ndarray:
        """Each text's traversal from the start state, left to right; the texts of a block go side by side, the longest first."""
        n = np.bincount(block.text_of) if len(block.text_of) else np.zeros(0, np.int64)
        order = np.argsort(-n, kind="stable")
        begin, left = (np.cumsum(n) - n)[order], n[order]
        state, total = np.ones(len(n), np.int64), np.zeros(len(n))
        active, turn = len(n), 0
        # the last few long texts go on alone, a stretch at a time: their states are known from the tokens before
        while active > 16:
            state[:active], weight = self.step(state[:active], block.token[begin[:active] + turn])
            total[:active] += weight
            turn += 1
            active = int(np.searchsorted(-left, -turn, side="left"))
        for k in range(active):
            for at in range(turn, left[k], 1 << 20):
                token = block.token[begin[k] + at : begin[k] + min(at + (1 << 20), left[k])]
                after, weight = self.step(np.concatenate((state[k : k + 1], token[:-1])), token)
                state[k], total[k] = after[-1], total[k] + weight.sum()
        out = np.zeros(len(n))
        out[order] = total
        return out


def _training(name: str, modulus: int, remainder: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus != remainder, F.lit(True))


def vocabulary(texts_only: DataFrame, buckets: int, most: int = 400_000) -> tuple[int, int]:
    """(N, V): all tokens and the distinct ones, ends included, of a DataFrame of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        n = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))))
            rows = by_bucket(0, keys, np.zeros(len(keys), np.uint8), buckets)
            size = rows.num_rows
            return pa.RecordBatch.from_arrays([rows.column("bucket").combine_chunks(), rows.column("keys").combine_chunks(), pa.array([n] + [0] * (size - 1) if size else [], pa.int64())], names=["bucket", "keys", "n"])

        for batch in slices(batches, 0):
            for text in texts(batch.column(0)):
                own = words_of(text)
                seen.update(own)
                seen.add(b" end")
                n += len(own) + 1
            if len(seen) > most:
                yield flush()
                seen, n = set(), 0
        if seen:
            yield flush()

    def distinct(rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpacked_keys(x) for x in rows.column("keys").to_pylist()]))
        return pa.table([pa.array([len(keys)], pa.int64()), pa.array([sum(rows.column("n").to_pylist())], pa.int64())], names=["v", "n"])

    asked = texts_only.mapInArrow(run, "bucket int, keys binary, n long")
    total = asked.groupBy("bucket").applyInArrow(distinct, "v long, n long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(total.n or 0), int(total.v or 0)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out_remainder: int = 1, mu: float = 16.0, block_bytes: int = 10 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    size = text_bytes(docs, text_col)
    blocks, buckets = -(-size // block_bytes) or 1, -(-size // bucket_bytes) or 1
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _training(id_col, modulus, held_out_remainder).alias("train"))
    tokens, kinds = vocabulary(rows.filter("train").select("text"), buckets)
    dealt = rows.select("*", block_of("id", "text", blocks).alias("_block"))

    def ask(part: pa.Table) -> pa.Table:
        block = Block.of(texts(part.column("text").combine_chunks()))
        trained = np.asarray(part.column("train").to_pylist(), bool)[block.text_of]
        pairs, place = block.pairs()
        counts = np.concatenate((np.bincount(block.token[trained], minlength=len(block.names)), np.bincount(place[trained], minlength=len(pairs)))).astype(np.uint32)
        keys = block.keys(pairs)
        order = np.argsort(keys)
        return by_bucket(part.column("_block")[0].as_py(), keys[order], counts[order], buckets)

    def score(part: pa.Table, answers: pa.Table) -> pa.Table:
        batch = texts(part.column("text").combine_chunks()) if part.num_rows else []
        block = Block.of(batch)
        pairs, place = block.pairs()
        counts = np.zeros(len(block.names) + len(pairs), np.uint64)
        counts[np.argsort(block.keys(pairs))] = answered(answers)
        machine = Automaton(block, pairs, counts, tokens, kinds, mu)
        by_text = lambda x: np.bincount(block.text_of, weights=x, minlength=len(batch))
        whole = lambda x: pa.array(by_text(x).astype(np.int64))
        held_out = pa.compute.invert(part.column("train"))
        columns = [part.column("id"), held_out, whole(np.ones(len(place))), whole(machine.count[block.token] > 0), pa.array(np.full(len(batch), tokens)), pa.array(by_text(machine.root[block.token])), pa.array(machine.scores(block))]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    asked = dealt.groupBy("_block").applyInArrow(ask, "_block int, bucket int, keys binary, found binary")
    answers = asked.groupBy("bucket").applyInArrow(summed, "_block int, bucket int, found binary")
    scored = dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
