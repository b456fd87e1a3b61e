"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids stand over each other.

A text is encoded by a byte-level BPE file (A, given a space and the text) and by a piece model (B, given the text, to which it adds the space). Both
token sequences tile the same bytes. The end offsets of the B tokens are a static interval index: two bisections for each A token find the first and the last B token
that it overlaps, and so its links; offsets where tokens of both end cut the text into groups.

Links are counted for each pair of ids over the whole corpus. A task counts the pairs of about `block_bytes` of text before anything is exchanged; the
totals of the pairs that a block holds come back to it, and its documents sum them. So what is exchanged is one row for each block and pair of ids that occurs in it, and
the documents' own pairs once, by block. No table of pairs is broadcast or collected.

Defined results: texts that are null or empty, and those whose joined A or B bytes differ from a space and the text, have no tokens: zeros and ''. Special tokens' strings
in a text are plain text. An id pair's count is at its B id's highest also where several are. Repeated rows count each for itself; null ids are carried along; an empty table gives
no rows; a very long text is encoded whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivia.llm.common import cut, slices
from scrivia.llm.packing import REMEMBERED, Encoder
from scrivia.llm.packing import _byte_of_symbol as byte_of_symbol

_SPACE = "▁"
_loaded: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece

        self.a = Encoder(bpe_path)
        self.a.special = []  # special tokens' strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        symbol = byte_of_symbol()
        with open(bpe_path, encoding="utf-8") as file:
            entries = {i: entry for entry, i in json.load(file)["model"]["vocab"].items()}
        self.a_bytes = [bytes(symbol.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        shown = [*map(str, range(len(self.a_bytes))), *map(str, range(len(self.b_bytes)))]
        self.shown = np.array([s + end for end in (",", "|", ";") for s in shown], object)
        # a piece with a space inside or behind it, but for runs of spaces, would tie words together; without such pieces words are encoded one by one
        self.apart = not any(_SPACE in p[1:] and p.strip(_SPACE) for p in pieces)
        self.known: dict[str, list[int]] = {}

    def encode_b(self, text: str) -> list[int]:
        if not self.apart or "  " in text or _SPACE in text or text[:1] == " " or text[-1:] == " ":
            return self.b.encode(text, num_threads=1)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out, known = [], self.known
        for word in text.split(" "):
            ids = known.get(word)
            if ids is None:
                ids = self.b.encode(word, num_threads=1)
                if len(word) < 64:
                    known[word] = ids
            out += ids
        return out

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B, or none where their bytes are not a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        a, b = np.frombuffer(self.a(" " + text), "<u4").astype(np.int64), np.array(self.encode_b(text), np.int64)
        whole = b" " + text.encode()
        same = b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if same else (none, none)

    def groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """The groups' ids, as in `a1,a2|b1;a3|b2,b3`."""
        place = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        part = np.concatenate((2 * group_a, 2 * group_b + 1))[place]
        ids = np.concatenate((a, b + len(self.a_bytes)))[place]
        end = np.append(part[1:] != part[:-1], True)
        return "".join(self.shown[ids + len(self.shown) // 3 * np.where(end, 1 + part % 2, 0)].tolist())[:-1]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps; ends are ascending and both tilings cover the same bytes."""
    a_begin = np.concatenate(([0], a_end[:-1]))
    return np.searchsorted(b_end, a_begin, "right"), np.searchsorted(b_end, a_end, "left")


def loaded(bpe_path: str, piece_path: str) -> Pair:
    if (bpe_path, piece_path) not in _loaded:
        _loaded[bpe_path, piece_path] = Pair(bpe_path, piece_path)
    return _loaded[bpe_path, piece_path]


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind, place = np.unique(keys, return_inverse=True)
    return kind, np.bincount(place, weights=times, minlength=len(kind)).astype(np.int64)


def _describe(bpe_path: str, piece_path: str, block_bytes: int):
    """A row for each document, with its pairs of ids and how often each is linked; and one row for each block, with the same over its documents (no id, n_a is -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, held = loaded(bpe_path, piece_path), TaskContext.get().partitionId() << 32, 0
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        width = len(pair.b_bytes)
        names = ["id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

        def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

        id_type = None
        for batch in slices(batches, 1):
            rows, id_type = [], batch.column(0).type
            for text in batch.column(1).to_pylist():
                a, b = pair.tokens(text)
                if not len(a):
                    rows.append((block, 0, 0, 0, 0, "", b"", b""))
                    continue
                a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
                first, last = overlaps(a_end, b_end)
                many = last - first + 1
                at_a = np.repeat(np.arange(len(a)), many)
                at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(many) - many, many) + first[at_a]
                cuts = a_end[b_end[last] == a_end]  # offsets at which tokens of both end
                shown = pair.groups(a, b, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end))
                kind, times = np.unique(a[at_a] * width + b[at_b], return_counts=True)
                gathered.append((kind, times))
                held += len(text)
                rows.append((block, len(a), len(b), len(cuts), len(at_a), hashlib.sha256(shown.encode()).hexdigest(), kind.astype("<u8").tobytes(), times.astype("<u4").tobytes()))
            if rows:
                yield batch_of(batch.column(0), rows)
            if len(gathered) > 256:
                gathered = [_counted(*map(np.concatenate, zip(*gathered)))]
            if held >= block_bytes:
                kind, times = _counted(*map(np.concatenate, zip(*gathered)))
                yield batch_of(pa.nulls(1, id_type), [(block, -1, 0, 0, 0, "", kind.astype("<u8").tobytes(), times.astype("<u8").tobytes())])
                gathered, held, block = [], 0, block + 1
        if gathered:
            kind, times = _counted(*map(np.concatenate, zip(*gathered)))
            yield batch_of(pa.nulls(1, id_type), [(block, -1, 0, 0, 0, "", kind.astype("<u8").tobytes(), times.astype("<u8").tobytes())])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
            kind = np.frombuffer(pairs, "<u8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), block)), pa.array(kind), pa.array(np.frombuffer(times, "<u8").astype(np.int64))], names=["block", "pair", "times"])


def _answered(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents."""
    order = np.argsort(kind := totals.column("pair").to_numpy())
    kind, count, best = kind[order], totals.column("count").to_numpy()[order], totals.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
        at, n = np.searchsorted(kind, np.frombuffer(pairs, "<u8").astype(np.int64)), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int((n * best[at]).sum()))
        count_sum.append(int((n * count[at]).sum()))
    kept = [c for c in docs.column_names if c not in ("block", "pairs", "times")]
    return pa.table([*(docs.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "n_best", "count_sum"])


def align(docs: DataFrame, bpe_path: str, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    described = cut(rows.mapInArrow(_describe(bpe_path, piece_path, block_bytes), f"id {id_type}, block long, {own}, pairs binary, times binary"))
    b_ids = loaded(bpe_path, piece_path).b.get_piece_size()

    asked = described.filter("n_a = -1").select("block", "pairs", "times").mapInArrow(_spread, "block long, pair long, times long")
    totals = asked.groupBy("pair").agg(F.sum("times").alias("count"))
    # a B id has no more rows here than A has ids
    highest = F.max("count").over(Window.partitionBy(F.col("pair") % b_ids))
    totals = totals.select(F.col("pair").alias("_pair"), "count", (F.col("count") == highest).cast("long").alias("best"))
    answers = asked.join(totals, F.col("pair") == F.col("_pair")).select("block", "pair", "count", "best")
    found = described.filter("n_a >= 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered, f"id {id_type}, {own}, n_best long, count_sum long")
    return found.withColumnRenamed("id", id_col)
