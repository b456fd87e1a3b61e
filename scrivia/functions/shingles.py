"""Shingle sets inside tasks: dealt out by ranges of their hashes, brought together, and compared group by group."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Shingles that are packed at once; pairs that are counted at once; nodes from which on a group is counted in a table of its own.
AT_ONCE, PAIRS, DENSE = 1_000_000, 1_000_000, 48
_WORD = re.compile("[a-zçğıöşüâîû0-9]{3,}")
_FACTOR = np.uint64(0x9E3779B97F4A7C1B)

Batches = Iterator[pa.RecordBatch]


class _WordHashes(dict):
    """64-bit hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = own = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return own


def shingle_hashes(text: str | None, salt: int, known: _WordHashes) -> np.ndarray:
    """Of a lower-cased text and its scope's hash: the sorted 64-bit hashes of the distinct five-word shingles of precheck_shingles, each of its scope alone."""
    words = _WORD.findall(text or "")
    n = len(words) - 4
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    own = np.full(n, salt, np.int64).view(np.uint64)
    for i in range(5):
        own = own * _FACTOR + h[i : i + n]
    own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(own ^ (own >> np.uint64(29)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each begin, as many as its length."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def _begins(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _packed(ids: list, own: list[np.ndarray], bits: int, kind: pa.DataType) -> pa.RecordBatch:
    n = np.array([len(h) for h in own])
    sets = np.array([int.from_bytes(hashlib.blake2b(h, digest_size=8).digest(), "little", signed=True) for h in own])
    value, doc = np.concatenate(own), np.repeat(np.arange(len(own)), n)
    bucket = (value >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    value, doc, bucket = value[order], doc[order], bucket[order]
    first = _begins(bucket.astype(np.int64) * len(own) + doc) if len(value) else np.zeros(0, np.int64)
    long, held = np.diff(np.r_[first, len(value)]), sets[doc[first]]
    low = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :7])
    ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    runs = np.searchsorted(first, ends)
    named = [s if m else None for s, m in zip(sets.tolist(), n.tolist())]
    rows = []
    for b in range(1 << bits):
        part, step = slice(runs[b], runs[b + 1]), slice(b, None, 1 << bits)
        if ends[b] < ends[b + 1] or ids[step]:
            counts = long[part].astype(np.min_scalar_type(long[part].max(initial=0)))
            rows.append((b, low[ends[b] : ends[b + 1]].tobytes(), counts.tobytes(), held[part].tobytes(), ids[step], named[step], n[step].tolist()))
    types = {"bucket": pa.int32(), "hashes": pa.binary(), "counts": pa.binary(), "sets": pa.binary(), "ids": pa.list_(kind), "id_sets": pa.list_(pa.int64()), "ns": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))


def packed(bits: int) -> Callable[[Batches], Batches]:
    """Rows of (id, text, salt) to one row for each range of hashes: the hashes' lower 56 bits, how many each set has there, and the sets; ids with their sets and sizes are dealt out among them.

    Ranges are named by a hash's first `bits` bits, 6 to 16, so that 62 bits or more tell shingles apart. Packed, a shingle takes some 9 bytes of shuffle.
    """

    def run(batches: Batches) -> Batches:
        known, ids, own, held, kind = _WordHashes(), [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            for one, text, salt in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "salt"))):
                ids.append(one)
                own.append(shingle_hashes(text, salt, known))
                held += len(own[-1])
                if held >= AT_ONCE:
                    yield _packed(ids, own, bits, kind)
                    ids, own, held = [], [], 0
        if ids:
            yield _packed(ids, own, bits, kind)

    return run


def whole_runs(batches: Batches, key: str) -> Iterator[pa.Table]:
    """Rows that come sorted by a key, in tables that hold all rows of each of their keys."""
    rest = []
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(key).to_numpy()
            last = int(_begins(keys)[-1])
            if rest and (last or keys[0] != rest[0].column(key)[0].as_py()):
                yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks()
                rest = []
            elif last:
                yield pa.Table.from_batches([batch.slice(0, last)]).combine_chunks()
            rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _held(hashes: list[bytes], counts: list[bytes], sets: list[bytes]) -> list[np.ndarray]:
    """(set, item, df, w, lead) of a range."""
    widths = [len(c) * 8 // len(s) if s else 1 for c, s in zip(counts, sets)]
    long = np.concatenate([np.frombuffer(c, f"u{w}").astype(np.int64) for c, w in zip(counts, widths)])
    sets = np.frombuffer(b"".join(sets), np.int64)
    low = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 7)
    once = np.zeros(len(sets), bool)
    once[np.unique(sets, return_index=True)[1]] = True  # copies have the same set and the same shingles here
    value = np.zeros((int(long[once].sum()), 8), np.uint8)
    value[:, :7] = low[np.repeat(once, long)]
    value, sets, long = value.view(np.uint64).ravel(), sets[once], long[once]
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    shared = np.r_[False, same] | np.r_[same, False] if len(value) else np.zeros(0, bool)
    value, own = value[shared], sets[np.repeat(np.arange(len(sets)), long)[order[shared]]]
    if not len(value):
        return [np.zeros(0, np.int64)] * 5
    first = _begins(value)
    df, mixed = np.diff(np.r_[first, len(value)]), _mixed(own.view(np.uint64))
    item = _mixed(np.add.reduceat(mixed, first) + df.astype(np.uint64) * _FACTOR)
    lead = np.minimum.reduceat(mixed, first)
    _, at, w = np.unique(item, return_index=True, return_counts=True)
    of = np.repeat(at, df[at])
    return [own[_ranges(first[at], df[at])], item[of].view(np.int64), df[of], np.repeat(w, df[at]), lead[of].view(np.int64)]


def common(batches: Batches) -> Batches:
    """Of packed ranges: (id, set, n) of every text, and (set, item, df, w, lead) for what two or more sets hold, an `item` being w shingles of the range that the same df sets hold; lead picks one of them.

    Copies count once. Rows of one range come together.
    """
    for table in whole_runs(batches, "bucket"):
        buckets = table["bucket"].to_numpy()
        first = _begins(buckets)
        for a, z in zip(first, np.r_[first[1:], len(buckets)]):
            part = table.slice(a, z - a)
            own = _held(*(part[c].to_pylist() for c in ("hashes", "counts", "sets")))
            ids, id_sets, ns = (part[c].combine_chunks().flatten() for c in ("ids", "id_sets", "ns"))
            blank = lambda m, kind: pa.nulls(m, kind)
            for m, columns in ((len(ids), (ids, id_sets, ns, None, None, None, None)), (len(own[0]), (None, own[0], None, *own[1:]))):
                types = (ids.type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                columns = [blank(m, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "set", "n", "item", "df", "w", "lead"])


def _joined(item: np.ndarray, peer_item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal items, peer_item being sorted; about PAIRS at once."""
    begin = np.searchsorted(peer_item, item)
    many = np.searchsorted(peer_item, item, side="right") - begin
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS)) + 1
    for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(item)]):
        if a < z:
            yield np.repeat(np.arange(a, z), many[a:z]), _ranges(begin[a:z], many[a:z])


def _group_best(node: np.ndarray, n: np.ndarray, role: np.ndarray, row: np.ndarray, item: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, peer, similarity) of one group: common weights in a table of probes and peers, items of many by a product of matrices."""
    p, q = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    q = q[np.argsort(node[q])]
    at = np.zeros((2, len(node)), np.int64)
    at[0, p], at[1, q] = np.arange(len(p)), np.arange(len(q))
    _, item = np.unique(item, return_inverse=True)
    probes, peers = (role[row] & 1) > 0, (role[row] & 2) > 0
    many = np.bincount(item[probes], minlength=item.max() + 1) * np.bincount(item[peers], minlength=item.max() + 1)
    column = np.cumsum(many * 128 > len(p) * len(q)) - 1
    heavy = many * 128 > len(p) * len(q)
    c = np.zeros((len(p), len(q)), np.float32)  # whole numbers up to 2^24
    for k in range(0, int(heavy.sum()), 512):
        here = heavy[item] & (column[item] >= k) & (column[item] < k + 512)
        a, b = np.zeros((len(p), 512), np.float32), np.zeros((len(q), 512), np.float32)
        mine, theirs = here & probes, here & peers
        a[at[0, row[mine]], column[item[mine]] - k] = w[mine]
        b[at[1, row[theirs]], column[item[theirs]] - k] = 1
        c += a @ b.T
    light = ~heavy[item] & (many[item] > 0)
    mine, theirs = np.flatnonzero(light & probes), np.flatnonzero(light & peers)
    theirs = theirs[np.argsort(item[theirs], kind="stable")]
    for x, y in _joined(item[mine], item[theirs]):
        np.add.at(c.reshape(-1), at[0, row[mine[x]]] * len(q) + at[1, row[theirs[y]]], w[mine[x]])
    own = np.searchsorted(node[q], node[p])
    met = np.flatnonzero((own < len(q)) & (node[q][np.minimum(own, len(q) - 1)] == node[p])) if len(q) else np.zeros(0, np.int64)
    c[met, own[met]] = 0
    best, score = np.zeros(len(p), np.int64), np.zeros(len(p))
    for k in range(0, len(p) if len(q) else 0, 256):
        part = c[k : k + 256].astype(np.float64)
        part /= n[p[k : k + 256], None] + n[q][None, :] - part
        best[k : k + 256] = part.argmax(1)  # the first is the least node
        score[k : k + 256] = part.max(1)
    some = score > 0
    return node[p[some]], node[q[best[some]]], score[some]


def _small_best(node: np.ndarray, n: np.ndarray, role: np.ndarray, row: np.ndarray, key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, peer, similarity) over many small groups at once, `key` being an item of one group."""
    mine, theirs = np.flatnonzero(role[row] & 1), np.flatnonzero(role[row] & 2)
    theirs = theirs[np.argsort(key[theirs], kind="stable")]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.float64))]
    for x, y in _joined(key[mine], key[theirs]):
        a, b = row[mine[x]], row[theirs[y]]
        other = node[a] != node[b]
        pair, back = np.unique(a[other] * len(node) + b[other], return_inverse=True)
        out.append((pair, np.bincount(back, w[mine[x]][other], len(pair))))
    pair, back = np.unique(np.concatenate([p for p, _ in out]), return_inverse=True)
    c = np.bincount(back, np.concatenate([c for _, c in out]), len(pair))
    a, b = pair // len(node), pair % len(node)
    score = c / (n[a] + n[b] - c)
    order = np.lexsort((node[b], -score, a))
    order = order[_begins(a[order])] if len(order) else order
    return node[a[order]], node[b[order]], score[order]


def meet(batches: Batches) -> Batches:
    """(node, peer, similarity): each probe's best peer in its group, the least node of equals, from rows (g, role, node, n, items, ws) that come sorted by group; role 1 is a probe, 2 a peer, 3 both."""
    for table in whole_runs(batches, "g"):
        g, role, node, n = (table[c].to_numpy() for c in ("g", "role", "node", "n"))
        items, ws = (table[c].combine_chunks() for c in ("items", "ws"))
        ends = items.offsets.to_numpy()
        item, w = items.values.to_numpy()[ends[0] : ends[-1]], ws.values.to_numpy()[ws.offsets[0].as_py() :][: ends[-1] - ends[0]]
        ends, n = ends - ends[0], n.astype(np.int64)
        first = _begins(g)
        sizes = np.diff(np.r_[first, len(g)])
        found = []
        for a, m in zip(first[sizes >= DENSE], sizes[sizes >= DENSE]):
            e = slice(ends[a], ends[a + m])
            found.append(_group_best(node[a : a + m], n[a : a + m], role[a : a + m], np.repeat(np.arange(m), np.diff(ends[a : a + m + 1])), item[e], w[e]))
        small = np.repeat(sizes < DENSE, sizes)
        if small.any():
            rows = np.flatnonzero(small)
            long = np.diff(ends)[rows]
            of, row = _ranges(ends[:-1][rows], long), np.repeat(np.arange(len(rows)), long)
            group = np.cumsum(np.r_[True, g[rows][1:] != g[rows][:-1]])[row]
            order = np.lexsort((item[of], group))
            new = np.r_[True, (np.diff(group[order]) != 0) | (np.diff(item[of][order]) != 0)]
            key = np.empty(len(order), np.int64)
            key[order] = np.cumsum(new)
            found.append(_small_best(node[rows], n[rows], role[rows], row, key, w[of]))
        columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "peer", "similarity"])
