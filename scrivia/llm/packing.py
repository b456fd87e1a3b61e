"""Best-fit packing of token sequences, improved by swap-based local search.

`tokenise` turns whole texts into token ids and cuts only documents longer than a sequence; `pack` places pieces. Pieces are dealt evenly into shards of a
stated size whose number grows with the input, so no task sees more than one shard. Inside a shard pieces go into the tightest bin that fits, largest
first; then underfull bins exchange documents one for one or two for one, or move them, each time raising the sum of squared fills, until the lower
bound is reached or no bin has an exchange left. The least filled bin of every shard goes into a second round of shards, so that shards do not each keep a remainder.

Defined results: a null or empty text is the single closing id; equal rows are packed each for itself, whatever their ids; of bins or pieces of equal size any
comes first; an empty table packs into nothing; a null id is carried along; a very long text is cut into as many pieces as it needs; other columns of pieces pass, but for
sequence_id, offset and those that begin with `_shard`.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import cut, slices

#: How many distinct words a worker remembers the ids of before it starts afresh.
REMEMBERED = 400_000
_encoders: dict[str, "Encoder"] = {}


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE file, equal to `tokenizers`' own with add_special_tokens=False.

    A single space between two characters that are no white space always begins a new pre-token,
    so texts are cut there and each distinct word is encoded once. A text with other white space at a cut is
    encoded whole; one that holds a special token's string goes to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        symbol = _byte_of_symbol()
        ranks = {bytes(symbol[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.known: dict[str, bytes | None] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def _learn(self, word: str, lead: str) -> bytes | None:
        bare = word[1:] if lead else word
        ids = None if not bare or bare[0].isspace() or bare[-1].isspace() else self._ids(word)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text:
            return b""
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        out, known = [], self.known
        for i, word in enumerate(words):
            ids = known.get(word)
            if ids is None and (word in known or (ids := self._learn(word, " " if i else "")) is None):
                return self._ids(text)
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(id_col, piece, start, length, ids): every document's ids and end_id, cut into capacity where longer; the first piece takes what is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, 1):
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = encode(text or "") + end
                n = len(own) // 4
                edges = [0, *range(n - (math.ceil(n / capacity) - 1) * capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row), pieces.append(piece), starts.append(a), lengths.append(b - a), ids.append(own[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["id", "piece", "start", "length", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: largest piece first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if above := rooms >> n:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Underfull bins, indexed by what they could give: for each sum of one or two of its pieces, the bins that hold it, roomiest first.

    An exchange gives the least filled bins' pieces to a bin with room and takes less in return, so fills grow apart and low bins empty. For what a bin may give
    one look at the index finds the greatest gain over all underfull bins; no partner is left out.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.held: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.room = np.zeros(capacity + 1, np.int64)  # for each sum, the greatest room of a bin that holds it
        for b in range(len(bins)):
            self._enter(b)

    def _parts(self, b: int) -> dict[int, tuple[int, ...]]:
        """Sums of no, one or two pieces of a bin, each with an example."""
        by_size = {}
        for i in self.bins[b]:
            by_size.setdefault(self.size[i], []).append(i)
        kinds = sorted(by_size)
        parts: dict[int, tuple[int, ...]] = {0: ()}
        for x, n in enumerate(kinds):
            for m in kinds[x:]:
                if m > n or len(by_size[n]) > 1:
                    parts[n + m] = (by_size[n][0], by_size[m][1 if m == n else 0])
        parts.update((n, (by_size[n][0],)) for n in kinds)
        return parts

    def _enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.bins[b]:
            for s in self._parts(b):
                if s <= self.capacity:
                    heapq.heappush(self.held[s], (-room, b, self.version[b]))
                    self.room[s] = max(self.room[s], room)

    def _top(self, s: int, but: int) -> int | None:
        """The roomiest bin but one that holds the sum."""
        heap, aside = self.held[s], None
        while heap and (heap[0][2] != self.version[heap[0][1]] or heap[0][1] == but):
            gone = heapq.heappop(heap)
            if gone[1] == but and gone[2] == self.version[but]:
                aside = gone
        found = heap[0][1] if heap else None
        if aside:
            heapq.heappush(heap, aside)
        self.room[s] = self.capacity - self.fill[heap[0][1]] if heap else 0
        return found

    def best(self, low: int) -> tuple[int, int, tuple[int, ...], int] | None:
        """(gain, partner, what low gives, the sum it takes) of the greatest gain for the partner; not two for two."""
        chosen = None
        for given, give in self._parts(low).items():
            if not give:
                continue
            sums = np.flatnonzero(self.room[:given] >= given - np.arange(given))
            for take in sums.tolist():
                if chosen and given - take <= chosen[0]:
                    break
                partner = self._top(take, low)
                if partner is None or self.capacity - self.fill[partner] < given - take or self.fill[partner] + given - take <= self.fill[low]:
                    continue
                if len(give) == 2 and len(self._parts(partner)[take]) == 2:
                    continue
                chosen = (given - take, partner, give, take)
                break
        return chosen

    def step(self, low: int) -> int | None:
        """Makes the best exchange of a bin; the partner, or None."""
        if not (found := self.best(low)):
            return None
        gain, partner, give, take = found
        get = self._parts(partner)[take]
        self.bins[low] = [i for i in self.bins[low] if i not in give] + list(get)
        self.bins[partner] = [i for i in self.bins[partner] if i not in get] + list(give)
        self.fill[low] -= gain
        self.fill[partner] += gain
        for b in (low, partner):
            self.version[b] += 1
            self._enter(b)
        return partner


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Bins after exchanges from the least filled on, until the lower bound is reached or no underfull bin has an exchange left."""
    need, left = math.ceil(sum(size) / capacity), len(bins)
    if left <= need:
        return bins
    search = LocalSearch(bins, size, capacity)
    queue = [(fill, b) for b, fill in enumerate(search.fill) if 0 < fill < capacity]
    heapq.heapify(queue)
    stuck: set[int] = set()
    moved = False
    while left > need:
        if not queue:
            if not moved:
                break
            moved = False  # what moved may have freed bins that were stuck
            queue = [(search.fill[b], b) for b in stuck if 0 < search.fill[b] < capacity]
            heapq.heapify(queue)
            stuck = set()
            continue
        fill, low = heapq.heappop(queue)
        if fill != search.fill[low] or not search.bins[low] or low in stuck:
            continue
        partner = search.step(low)
        if partner is None:
            stuck.add(low)
            continue
        moved = True
        for b in (low, partner):
            stuck.discard(b)
            if search.bins[b] and search.fill[b] < capacity:
                heapq.heappush(queue, (search.fill[b], b))
        left -= not search.bins[low]
    return [b for b in search.bins if b]


def pack(pieces: DataFrame, *, capacity: int = 1024, length_col: str = "length", shard_pieces: int = 32_768) -> DataFrame:
    """Every row of pieces with sequence_id and offset; sequences hold at most capacity."""
    pieces = cut(pieces.drop("sequence_id", "offset", "_shard", "_shard_tail"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, _shard_tail boolean"

    def place(round_: int):
        def run(part: pa.Table) -> pa.Table:
            size = part.column(length_col).to_pylist()
            bins = local_search(best_fit(size, capacity), size, capacity)
            fills = [sum(size[i] for i in b) for b in bins]
            first = ((round_ << 30) + part.column("_shard")[0].as_py()) << 32 if size else 0
            sequence, offset, tail = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), bool)
            for number, content in enumerate(bins):
                at = 0
                for i in content:
                    sequence[i], offset[i] = first + number, at
                    at += size[i]
            if fills and min(fills) < capacity:
                tail[bins[fills.index(min(fills))]] = True
            return part.drop_columns(["_shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("_shard_tail", pa.array(tail))

        return run

    def dealt(rows: DataFrame, number: int, round_: int) -> DataFrame:
        # the place in a checkpointed table, so that equal rows are dealt out like others
        shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, math.ceil(number / shard_pieces)))).cast("int")
        return rows.withColumn("_shard", shard).groupBy("_shard").applyInArrow(place(round_), schema)

    total = pieces.count()
    packed = dealt(pieces, total, 0)
    if total <= shard_pieces:
        return packed.drop("_shard_tail")
    packed = cut(packed)
    rest = cut(packed.filter("_shard_tail").drop("sequence_id", "offset", "_shard_tail"))
    return packed.filter("not _shard_tail").unionByName(dealt(rest, rest.count(), 1)).drop("_shard_tail")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves, for pieces that still carry `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
