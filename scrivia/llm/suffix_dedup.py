"""Removal of repeated substrings by prefix-free parsing.

A rolling hash triggers phrase ends: the k-gram with the least hash among the `reach` k-grams that a window starts with. Each text is so
parsed into phrases, the same wherever the same bytes stand. A window of `length` bytes is then the end of one phrase (a suffix of a dictionary
entry), the core that every window of that trigger holds, and the start of what the parse goes on with.

Texts are dealt into blocks. First blocks exchange a hash of each trigger's core by key range and learn which cores stand elsewhere too: a
core that is alone, or always in the same surroundings, is settled there. For the rest they send the phrases themselves, each different one once.
A range task holds the dictionary of its range: phrases in the order of their suffixes, with the common lengths of neighbours, and the parse's
continuations in their order, likewise. Both orders together are the corpus order of all windows of the range: windows are equal where
both common lengths reach, which is found by bytes, not by hashes. No task holds more than one range, and copies cost one phrase for each block.

A core in more than group_phrases surroundings (a line that a third of all texts share) would be one unbounded group; its windows are
exchanged one by one under 128 bits of hashes instead, which deals them out evenly. A core always in the same surroundings is likewise
known by 128 bits of hashes; all other equality is that of bytes.

Defined results: a null text is empty; texts shorter than length lose nothing; equal rows are different texts, so both lose what they
share, whatever their ids; runs of one byte repeat within themselves and go whole from length + 1 bytes on; extra columns are ignored, whatever their names; an
empty table gives no rows; there are no ties to break. A text needs about 150 bytes of memory for each of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import answered, block_of, by_bucket, mix64, reached, text_bytes, texts, unpacked_keys

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(20260102).integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM = 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: What a block learns of a core: it is nowhere else; the same surroundings are elsewhere; other ones are; very many are.
ALONE, SAME, MIXED, HOT = 0, 1, 2, 3
#: What a block tells of a core: a hash of its surroundings, how many different ones, and whether one of them stands there twice.
TOLD = np.dtype([("around", "<u8"), ("kinds", "<u4"), ("twice", "u1")])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_M, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Parse:
    """The triggers of a few texts laid end to end, each with its windows' starts lo..hi."""

    raw: np.ndarray
    begin: np.ndarray
    upto: np.ndarray
    trigger: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    length: int
    reach: int

    @classmethod
    def of(cls, batch: list[bytes], length: int, reach: int) -> Parse:
        raw = np.frombuffer(b"".join(batch), np.uint8)
        sizes = np.array([len(t) for t in batch], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        n = len(raw)
        power, inverse = powers(n + 1)
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw] * power[:n], out=upto[1:])
        none = np.zeros(0, np.int64)
        long = np.flatnonzero(sizes >= length)
        if not len(long):
            return cls(raw, begin, upto, none, none, none, length, reach)
        least = mix64((upto[_GRAM:] - upto[:-_GRAM]) * inverse[: n + 1 - _GRAM])
        least = (least & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(least), dtype=np.uint64)  # equal hashes: the leftmost
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        starts = np.concatenate([np.arange(begin[d], begin[d + 1] - length + 1) for d in long])
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return cls(raw, begin, upto, at[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], length, reach)

    def hashed(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """A hash of the bytes a..b, wherever they stand."""
        return mix64((self.upto[b] - self.upto[a]) * powers(len(self.upto))[1][a])

    def behind(self) -> np.ndarray:
        """Keys of the parse suffixes: what every window has from its trigger on."""
        return self.hashed(self.trigger, self.trigger + (self.length - self.reach))

    def around(self) -> np.ndarray:
        """Hashes of all that a trigger's windows cover, with where they start."""
        shape = mix64((self.trigger - self.lo).astype(np.uint64) * np.uint64(1 << 20) + (self.hi - self.lo).astype(np.uint64))
        return mix64(self.hashed(self.lo, self.hi + self.length) ^ shape)

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the windows of the triggers numbered in `of`, their triggers)."""
        sizes = self.hi[of] - self.lo[of] + 1
        owner = np.repeat(of, sizes)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.lo[owner] + step, owner


def parses(batch: list[bytes], length: int, reach: int, most: int = 1 << 20) -> list[Parse]:
    """Parses of a few texts each, so that arrays stay small; a longer text stays whole."""
    out, held, size = [], [], 0
    for text in batch:
        if held and size + len(text) > most:
            out.append(Parse.of(held, length, reach))
            held, size = [], 0
        held.append(text)
        size += len(text)
    return [*out, Parse.of(held, length, reach)] if held else out


def told(behind: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a block's distinct cores in order, what it tells of each)."""
    order = np.lexsort((around, behind))
    key, context = behind[order], around[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]))) if len(key) else np.zeros(0, bool)
    out = np.zeros(len(first), TOLD)
    if len(first):
        out["around"], out["kinds"] = context[first], np.add.reduceat(fresh.astype(np.int64), first)
        out["twice"] = np.diff(np.append(first, len(key))) > out["kinds"]
    return key[first], out


def _merge_cores(group_phrases: int):
    def run(rows: pa.Table) -> pa.Table:
        """One range of cores from all blocks: a state for every core that a block has sent."""
        keys = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
        sent = np.concatenate([np.frombuffer(x, TOLD) for x in rows.column("found").to_pylist()])
        whole = np.concatenate(keys)
        order = np.lexsort((sent["around"], whole))
        key, own = whole[order], sent[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.append(first[1:], len(key)) - 1
        kinds = np.add.reduceat(own["kinds"].astype(np.int64), first)
        one = (own["around"][first] == own["around"][last]) & (np.maximum.reduceat(own["kinds"], first) == 1)
        twice = (first != last) | (np.maximum.reduceat(own["twice"], first) > 0)
        state = np.where(one, np.where(twice, SAME, ALONE), np.where(kinds > group_phrases, HOT, MIXED)).astype(np.uint8)
        return _split(rows, keys, state[np.searchsorted(key[first], whole)])

    return run


def _merge_windows(rows: pa.Table) -> pa.Table:
    """One range of windows of hot cores from all blocks: 1 where a window occurs twice or more."""
    keys = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    sent = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("found").to_pylist()])
    whole, behind, twice = np.concatenate(keys), sent & ~np.uint64(1), (sent & np.uint64(1)).astype(np.int64)
    order = np.lexsort((behind, whole))
    fresh = np.concatenate(([True], (whole[order][1:] != whole[order][:-1]) | (behind[order][1:] != behind[order][:-1])))
    name = np.cumsum(fresh) - 1
    found = np.zeros(len(whole), np.uint8)
    found[order] = np.bincount(name, weights=1 + twice[order])[name] > 1
    return _split(rows, keys, found)


def in_order(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their group, then string; how many leading bytes each shares with the row before in that order, -1 across groups)."""
    width = strings.shape[1]
    keyed = np.concatenate((group.astype(">u4").view(np.uint8).reshape(-1, 4), strings), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], common, -1)))


def repeated_windows(before: np.ndarray, has_before: np.ndarray, core: np.ndarray, after: np.ndarray, has_after: np.ndarray, twice: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(phrases x reach) marks: whether the window that begins e bytes before its trigger occurs twice or more.

    before: phrase ends read backwards from the trigger, padded, of has_before bytes; core: what all windows of a trigger hold; after: what the parse goes on
    with, padded, of has_after bytes; windows: how many windows a trigger has, the first beginning has_before bytes before it.
    """
    n, reach = len(before), before.shape[1]
    marks = np.zeros((n, reach), bool)
    by_core, shared = in_order(np.zeros(n, np.int64), core)
    group = np.zeros(n, np.int64)
    group[by_core] = np.cumsum(shared < core.shape[1]) - 1  # cores equal byte by byte
    entry, suffix = in_order(group, before)
    parse, follow = in_order(group, after)
    for e in range(reach):
        own = np.flatnonzero((has_before >= e) & (has_before - windows < e) & (has_after >= reach - e))
        if not len(own):
            continue
        in_dictionary, in_parse = np.zeros(n, np.int64), np.zeros(n, np.int64)
        in_dictionary[entry] = np.cumsum(suffix < e)
        in_parse[parse] = np.cumsum(follow < reach - e)
        name = in_dictionary[own] * (n + 1) + in_parse[own]
        _, place, count = np.unique(name, return_inverse=True, return_counts=True)
        marks[own, e] = np.bincount(place, weights=1 + twice[own])[place] > 1
    return marks


def _padded(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """size bytes of raw from begin on (or before it, read backwards) as rows of `width` bytes, zeros behind them."""
    step = np.arange(width)
    at = begin[:, None] + (-1 - step if backwards else step)
    inside = step < size[:, None]
    return np.where(inside, raw[np.where(inside, at, 0)], 0).astype(np.uint8)


def _merge_phrases(length: int, reach: int):
    def run(rows: pa.Table) -> pa.Table:
        """One range of phrases from all blocks: for each phrase a bit for every window that occurs twice or more."""
        blobs = [_unpacked_phrases(x) for x in rows.column("found").to_pylist()]
        edges = np.cumsum([0, *(len(b[0]) for b in blobs)])
        lead, size, twice = (np.concatenate([b[k] for b in blobs]) for k in (0, 1, 2))
        raw = np.concatenate([b[3] for b in blobs])
        begin = np.cumsum(size) - size
        trigger, stop = begin + lead, begin + size
        after = np.minimum(stop - trigger - (length - reach), reach)
        marks = repeated_windows(
            _padded(raw, trigger, np.minimum(lead, reach), reach, True), lead, _padded(raw, trigger, np.full(len(lead), length - reach), length - reach),
            _padded(raw, trigger + length - reach, after, reach), after, twice, size - length + 1,
        )
        bits = np.packbits(marks, axis=1)
        return pa.table([rows.column("_block"), rows.column("bucket"), pa.array([bits[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["_block", "bucket", "found"])

    return run


def _split(rows: pa.Table, keys: list[np.ndarray], found: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *map(len, keys)])
    return pa.table([rows.column("_block"), rows.column("bucket"), pa.array([found[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["_block", "bucket", "found"])


def _packed_phrases(lead: np.ndarray, size: np.ndarray, twice: np.ndarray, raw: bytes) -> bytes:
    return b"".join((np.uint32(len(lead)).tobytes(), lead.astype(np.uint16).tobytes(), size.astype(np.uint32).tobytes(), twice.astype(np.uint8).tobytes(), raw))


def _unpacked_phrases(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at = 4 + 2 * n
    return np.frombuffer(blob, np.uint16, n, 4).astype(np.int64), np.frombuffer(blob, np.uint32, n, at).astype(np.int64), np.frombuffer(blob, np.uint8, n, at + 4 * n).astype(np.int64), np.frombuffer(blob, np.uint8, -1, at + 5 * n)


@dataclass
class Phrases:
    """The different phrases of a block's mixed cores, in the order of their cores: which Parse and trigger shows each, whether it stands there twice,
    and the phrase of every mixed trigger, Parse after Parse."""

    core: np.ndarray
    parse: np.ndarray
    trigger: np.ndarray
    twice: np.ndarray
    of: list[np.ndarray]

    @classmethod
    def of_block(cls, parsed: list[Parse], states: list[np.ndarray]) -> Phrases:
        mixed = [np.flatnonzero(state == MIXED) for state in states]
        core = np.concatenate([np.zeros(0, np.uint64), *(p.behind()[m] for p, m in zip(parsed, mixed))])
        around = np.concatenate([np.zeros(0, np.uint64), *(p.around()[m] for p, m in zip(parsed, mixed))])
        parse = np.repeat(np.arange(len(parsed)), [len(m) for m in mixed])
        trigger = np.concatenate([np.zeros(0, np.int64), *mixed])
        order = np.lexsort((around, core))
        fresh = np.concatenate(([True], (core[order][1:] != core[order][:-1]) | (around[order][1:] != around[order][:-1]))) if len(core) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        place = np.zeros(len(core), np.int64)
        place[order] = np.cumsum(fresh) - 1
        twice = np.diff(np.append(first, len(core))) > 1
        return cls(core[order[first]], parse[order[first]], trigger[order[first]], twice, np.split(place, np.cumsum([len(m) for m in mixed])[:-1]) if parsed else [])

    def rows(self, parsed: list[Parse], block: int, buckets: int) -> pa.Table:
        own, edge = reached(self.core, buckets)
        lead, size = np.zeros(len(self.core), np.int64), np.zeros(len(self.core), np.int64)
        bounds = []
        for k, p in enumerate(parsed):
            at = np.flatnonzero(self.parse == k)
            t = self.trigger[at]
            lead[at], size[at] = p.trigger[t] - p.lo[t], p.hi[t] + p.length - p.lo[t]
        for k, t in zip(self.parse.tolist(), self.trigger.tolist()):
            p = parsed[k]
            bounds.append(p.raw[p.lo[t] : p.hi[t] + p.length].tobytes())
        blobs = [_packed_phrases(lead[i:j], size[i:j], self.twice[i:j], b"".join(bounds[i:j])) for i, j in zip(edge, edge[1:])]
        return pa.table([pa.array([block] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array([b""] * len(own), pa.binary()), pa.array(blobs, pa.binary())], names=["_block", "bucket", "keys", "found"])


def _window_keys(parsed: list[Parse], states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the windows of hot cores, 63 bits of their core's key), text after text."""
    keys, behind = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for parse, state in zip(parsed, states):
        start, owner = parse.windows(np.flatnonzero(state == HOT))
        keys.append(parse.hashed(start, start + parse.length))
        behind.append(parse.behind()[owner] & ~np.uint64(1))
    return np.concatenate(keys), np.concatenate(behind)


def _states(parsed: list[Parse], found: np.ndarray) -> list[np.ndarray]:
    """The state of each trigger, from those of the block's distinct cores in order."""
    behind = [p.behind() for p in parsed]
    key = np.unique(np.concatenate(behind)) if behind else np.zeros(0, np.uint64)
    return [found[np.searchsorted(key, b)] for b in behind]


def _runs(key: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new pair of key and core begins in it)."""
    order = np.lexsort((behind, key))
    fresh = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (behind[order][1:] != behind[order][:-1]))) if len(key) else np.zeros(0, bool)
    return order, fresh


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int = 200, block_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, group_phrases: int = 4096) -> DataFrame:
    """(id_col, n_bytes, spans, kept) of every row: removed byte ranges, and the bytes that are left."""
    size = text_bytes(docs, text_col)
    blocks, buckets = -(-size // block_bytes) or 1, -(-size // bucket_bytes) or 1
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.select("*", block_of("id", "text", blocks).alias("_block"))
    parsed_of = lambda part: parses(texts(part.column("text").combine_chunks()), length, reach) if part.num_rows else []
    merge_phrases = _merge_phrases(length, reach)
    step = -(-reach // 8)

    def ask(part: pa.Table) -> pa.Table:
        parsed = parsed_of(part)
        key, about = told(np.concatenate([p.behind() for p in parsed]), np.concatenate([p.around() for p in parsed]))
        return by_bucket(part.column("_block")[0].as_py(), key, about, buckets)

    def ask_phrases(part: pa.Table, answers: pa.Table) -> pa.Table:
        block = part.column("_block")[0].as_py() if part.num_rows else answers.column("_block")[0].as_py()
        found = answered(answers, np.uint8)
        parsed = parsed_of(part)
        states = _states(parsed, found)
        phrases = Phrases.of_block(parsed, states).rows(parsed, block, buckets)
        key, behind = _window_keys(parsed, states)
        order, fresh = _runs(key, behind)
        first = np.flatnonzero(fresh)
        twice = (np.diff(np.append(first, len(key))) > 1).astype(np.uint64)
        windows = by_bucket(block, key[order[first]], behind[order[first]] | twice, buckets)
        windows = windows.set_column(1, "bucket", pa.compute.add(windows.column("bucket"), pa.scalar(buckets, pa.int32())))
        own = pa.table([pa.array([block], pa.int32()), pa.array([-1 - block], pa.int32()), pa.array([b""], pa.binary()), pa.array([found.tobytes()], pa.binary())], names=windows.column_names)
        return pa.concat_tables([phrases, windows, own])

    def merge(part: pa.Table) -> pa.Table:
        """Phrases in the ranges below `buckets`, windows of hot cores in those above; a block's own states pass."""
        bucket = part.column("bucket")[0].as_py()
        return part.drop_columns(["keys"]) if bucket < 0 else merge_phrases(part) if bucket < buckets else _merge_windows(part)

    def finish(part: pa.Table, answers: pa.Table) -> pa.Table:
        parsed = parsed_of(part)
        bucket = np.asarray(answers.column("bucket").to_pylist())
        some = lambda which: answers.filter(pa.array(which))
        states = _states(parsed, answered(some(bucket < 0), np.uint8))
        bits = answered(some((bucket >= 0) & (bucket < buckets)), np.uint8).reshape(-1, step)
        phrases = Phrases.of_block(parsed, states)
        key, behind = _window_keys(parsed, states)
        order, fresh = _runs(key, behind)
        repeated = np.zeros(len(key), bool)
        repeated[order] = answered(some(bucket >= buckets), np.uint8)[np.cumsum(fresh) - 1] > 0
        sizes, spans, kept, at = [], [], [], 0
        for k, (parse, state) in enumerate(zip(parsed, states)):
            start, _ = parse.windows(np.flatnonzero(state == HOT))
            hit, at = start[repeated[at : at + len(start)]], at + len(start)
            mixed = np.flatnonzero(state == MIXED)
            row, e = np.nonzero(np.unpackbits(bits[phrases.of[k]], axis=1)[:, :reach]) if len(mixed) else (mixed, mixed)
            hit = np.concatenate((hit, parse.trigger[mixed[row]] - e))
            same = np.flatnonzero(state == SAME)
            begins = np.concatenate((hit, parse.lo[same]))
            ends = np.concatenate((hit, parse.hi[same])) + length
            edge = np.bincount(begins, minlength=len(parse.raw) + 1) - np.bincount(ends, minlength=len(parse.raw) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            for a, b in zip(parse.begin, parse.begin[1:]):
                own = gone[a:b]
                turn = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                sizes.append(b - a)
                spans.append([{"begin": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
                kept.append(parse.raw[a:b][~own].tobytes())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    sent = "_block int, bucket int, keys binary, found binary"
    back = "_block int, bucket int, found binary"
    first = dealt.groupBy("_block").applyInArrow(ask, sent).groupBy("bucket").applyInArrow(_merge_cores(group_phrases), back)
    second = dealt.groupBy("_block").cogroup(first.groupBy("_block")).applyInArrow(ask_phrases, sent).groupBy("bucket").applyInArrow(merge, back)
    done = dealt.groupBy("_block").cogroup(second.groupBy("_block")).applyInArrow(finish, f"id {id_type}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)
