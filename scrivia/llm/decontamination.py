"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

The windows of every benchmark item become the automaton's patterns. Each document is normalised
once and read once, left to right; match ends are mapped back to words and, through the words, to
code-point offsets in the original text.

Defined results: a null or empty text has no words and no hits; a null item text has no windows;
an item without an id counts like others, all of them as one item, named null; repeated rows are judged one by one; equal windows of several items count for each item; an item
with fewer words than a window, but not none, is one window; no items: nothing is hit. The items of one window are in the order of their ids as text, null last;
a very long text is held whole, with its words; an empty table gives no rows; find_leaks ignores other columns, without_leaks passes them on, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import slices, texts

#: Word bytes: 0-9, a-z after A-Z are lowered, and everything beyond ASCII; all else separates.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HIT = "array<struct<item:string,first_word:int,last_word:int,begin:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Machine:
    """One automaton over the windows of items, whose letters are word numbers; about 300 bytes for each word of the items.

    A window's neighbouring words are neighbours in an item, so the automaton only reads those stretches of a text whose neighbours all are; what is between cannot be part of a window.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], size: int):
        self.numbers: dict[bytes, int] = {}
        self.windows: list[tuple[int, list[str | None]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        place: dict[tuple[int, ...], int] = {}
        owners: list[set[str | None]] = []
        near = [np.zeros(0, np.int64)]
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            ids = np.array(own, np.int64)
            near.append(ids[:-1] << 32 | ids[1:])
            for i in range(max(1, len(own) - size + 1) if own else 0):
                window = tuple(own[i : i + size])
                if (at := place.setdefault(window, len(owners))) == len(owners):
                    owners.append(set())
                    self.automaton.add_word(window, at)
                owners[at].add(item)
        self.windows = [(len(window), sorted(own, key=lambda i: (i is None, i or ""))) for window, own in zip(place, owners)]
        self.near = np.unique(np.concatenate(near))
        self.shortest = min((n for n, _ in self.windows), default=0)
        if owners:
            self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.windows)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where known words follow each other as they do in items, at least as many as the shortest window has."""
        both = ids[:-1] << 32 | ids[1:]
        at = np.searchsorted(self.near, both) if len(self.near) else np.zeros(len(both), np.int64)
        linked = self.near[np.minimum(at, len(self.near) - 1)] == both if len(self.near) else np.zeros(len(both), bool)
        begin = np.flatnonzero(np.concatenate(([True], ~linked)))
        end = np.append(begin[1:], len(ids))
        fit = (end - begin >= self.shortest) & (ids[begin] > 0)
        return list(zip(begin[fit].tolist(), end[fit].tolist()))

    def ends(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(number of the last word, number of the window) of every occurrence, in order."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        return [(begin + end, window) for begin, stop in self.stretches(ids) for end, window in self.automaton.iter(tuple(ids[begin:stop].tolist()))]


def matches(machine: Machine, text: bytes, words: list[bytes]) -> list[dict]:
    """Each occurrence of each item's window: word numbers and code-point offsets, ends included and excluded."""
    found = machine.ends(words) if len(machine) and words else []
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    out = []
    for last, window in found:
        count, items = machine.windows[window]
        first = last - count + 1
        for item in items:
            out.append({"item": item, "first_word": first, "last_word": last, "begin": int(points[spans[first][0]]), "end": int(points[spans[last][1]])})
    return out


_machines: dict[str, Machine] = {}


def _machine(key: str, items: Broadcast, size: int) -> Machine:
    """The worker's automaton of a block of items, built once."""
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(items.value, size)
    return _machines[key]


def _shared(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[Broadcast]:
    """The items, broadcast in blocks of about block_words words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    words = items.agg(F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_words))
    own = lambda b: items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
    return [benchmark.sparkSession.sparkContext.broadcast([(r.item, r.text.encode()) for r in own(b)]) for b in range(blocks)]


def _scan(items: Broadcast, size: int, begun: bool, ended: bool):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, items, size)
        hit = pa.list_(pa.struct([("item", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 1):
            counts, hits = [], []
            before = batch.column(3).to_pylist() if begun else [[]] * batch.num_rows
            for text, old in zip(texts(batch.column(1)), before):
                words = words_of(text)
                counts.append(len(words))
                hits.append([*old, *matches(machine, text, words)])
            kept = [batch.column(0)] + ([] if ended else [batch.column(1)])
            names = ["id"] + ([] if ended else ["text"])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(hits, hit)], names=[*names, "n_words", "hits"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1 << 19) -> DataFrame:
    """(id_col, n_words, hits) for every document; hits lists every occurrence of a benchmark window.

    The benchmark is the stated query set: it is broadcast in blocks of block_words words on average (about 200 MB for the automaton
    in a worker), and each block's automaton reads all documents in one narrow pass, without a shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _shared(benchmark, item_col, item_text_col, block_words)
    for b, shared in enumerate(blocks):
        ended = b == len(blocks) - 1
        out = out.mapInArrow(_scan(shared, window, b > 0, ended), f"id {id_type}, {'' if ended else 'text string, '}n_words long, hits {HIT}")
    return out.withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1 << 19) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark window occurs."""
    place = docs.columns.index(text_col)

    def sieve(shared: Broadcast):
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(key, shared, window)
            for batch in slices(batches, place):
                yield batch.filter(pa.array([not matches(machine, t, words_of(t)) for t in texts(batch.column(place))], pa.bool_()))

        return run

    for shared in _shared(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(sieve(shared), docs.schema)
    return docs


def covered_words(hits: str = "hits") -> F.Column:
    """How many words stand inside any hit: hits in order of first word, overlaps counted once."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["first_word"].alias("a"), h["last_word"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("upto"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(h["a"] - 1, acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], h["b"]).alias("upto"))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def items_hit(hits: str = "hits") -> F.Column:
    return F.array_distinct(F.transform(hits, lambda h: h["item"]))
