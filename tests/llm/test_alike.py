"""Operators 11 to 13 against brute force: tensored MinHash, token alignment and hard negatives."""

from __future__ import annotations

import hashlib
from collections import Counter
from math import floor, isfinite, nan

import numpy as np
import pytest

from scrivia.llm import alignment, hard_negatives, tensor_minhash
from scrivia.llm.ngram_join import shingles
from scrivia.llm.queries import QUERIES, tokenizer_file
from tests.conftest import DATA
from tests.llm.test_operators import documents, similar_brute  # noqa: F401


def test_op11_equals_all_pairs(spark, documents):
    rows = QUERIES["op11_minhash_near_dedup"](spark, DATA).collect()
    brute = similar_brute(documents, size=4)
    assert {r.doc_id: r.component_id for r in rows} == {i: c for i, (c, _) in brute.items()}
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(documents[r.doc_id].encode(), 4)) for r in rows)


def chain(words: int, own: int, steps: int, first: int = 0) -> dict[int, str]:
    """Texts of which each drops `own` words of the one before and adds as many: neighbours are alike, others less and less."""
    return {first + k: " ".join(f"c{first}w{i}" for i in range(k * own, k * own + words)) for k in range(steps)}


@pytest.mark.parametrize(("star_nodes", "group_nodes"), [(512, 1024), (3, 8)])
def test_op11_chains_in_small_tasks(spark, star_nodes, group_nodes):
    """Neighbours that are not their bucket's leader's neighbours are found in the second step, and across blocks; near misses are no links."""
    near, far = chain(200, 15, 60), chain(200, 30, 60, 1000)
    base = [f"b{i}" for i in range(150)]
    copies = {2000 + k: " ".join([*base[:k], f"own{k}", *base[k:]]) for k in range(80)} | {2100 + k: " ".join(base) for k in range(20)}
    texts = near | far | copies
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in tensor_minhash.near_duplicates(rows, star_nodes=star_nodes, group_nodes=group_nodes).collect()}
    assert found == {i: c for i, (c, _) in similar_brute(texts, size=4).items()}
    assert {found[i] for i in near} == {0} and len({found[i] for i in far}) == 60


def test_op11_tables_are_pairs_of_halves():
    halves = tensor_minhash.Halves(25, 4)
    draw = np.random.default_rng(1)
    common = draw.integers(0, 1 << 63, 900, dtype=np.uint64)
    keys = np.stack([halves(np.append(common, draw.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(40)])
    assert keys.shape == (40, 50) and len({(i, k) for row in keys[:1] for i, k in enumerate(row)}) == 50
    meet = tensor_minhash._meeting(keys, keys, 25)
    for a in range(40):
        for b in range(40):
            assert meet[a, b] == (any(keys[a][:25] == keys[b][:25]) and any(keys[a][25:] == keys[b][25:]))
    assert meet.all()  # similarity is 0.82: 4 in a million are missed


def aligned_brute(texts: dict) -> dict:
    """By the tokenizers' own encoders and all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    bpe, piece = Tokenizer.from_file(tokenizer_file()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    bpe.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found, counts = {}, Counter()
    for key, text in texts.items():
        a = bpe.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in bpe.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found[key] = ([], [], [], "")
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, begin = [], 0
        for i, end in zip(a, a_end):
            at = 0
            for j, stop in zip(b, b_end):
                if at < end and begin < stop:
                    links.append((i, j))
                at = stop
            begin = end
        groups, p, q = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            x, y = a_end.index(end) + 1, b_end.index(end) + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            p, q = x, y
        found[key] = (a, b, links, ";".join(groups))
        counts.update(links)
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return {
        k: (len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for k, (a, b, links, groups) in found.items()
    }


def aligned(df) -> dict:
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_op12_equals_all_pairs_of_tokens(spark, duck, block_bytes):
    odd = [
        None, "", " ", "  ", "a", " a", "a ", "a  b", "a\tb\nc  d\r\n", "<|endoftext|> and <s> and <unk> </s> <0x41>", "one▁two ▁ three", "é" * 70, "日本語 の テスト 🎉🎉", "ﬁne ½ Ⅷ é", "x" * 300,
        "　wide space thin", "a\x00b", "zero​width ﻿mark", "one one one one", "one one one one", "don't can't it's 12345 67 8.90 !!! ??",
    ]
    texts = dict(enumerate(odd)) | {100 + i: t for i, t in duck.execute("SELECT doc_id, text FROM documents WHERE length(text) < 1500 ORDER BY doc_id LIMIT 120").fetchall()}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = aligned(alignment.align(rows, tokenizer_file(), tokenizer_file("piece_bpe_32k.model"), block_bytes=block_bytes))
    assert found == aligned_brute(texts)
    assert found[0] == found[1] == found[10] == (0, 0, 0, 0, 0, 0, "") and found[4][:4] == (1, 1, 1, 1)


def test_op12_whole_table(spark, documents):
    found = aligned(QUERIES["op12_tokenizer_alignment"](spark, DATA))
    assert set(found) == set(documents)
    for n_a, n_b, n_groups, n_links, n_best, count_sum, shown in found.values():
        assert max(n_a, n_b) <= n_links <= n_a + n_b - n_groups if n_groups else not (n_a or n_b or n_links or shown)
        assert n_best <= n_links <= count_sum


def mined_brute(rows: list, every: int, positives: int = 5, negatives: int = 3) -> list:
    whole = sorted({(i, label, tuple(floor(256 * float(x)) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v)})
    out = []
    for i, label, v in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole)
            for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
                fitting = [x for x in scored if x[2] != label and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
                out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(fitting)]
    return sorted(out)


def mined(df) -> list:
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


VECTORS = "vec_id long, label int, embedding array<float>, key long, block int, score double, left string"


@pytest.mark.parametrize(("row_block", "anchor_block", "sample_rows"), [(8192, 1024, 4096), (64, 7, 50)])
def test_op13_equals_all_pairs(spark, row_block, anchor_block, sample_rows):
    """Clustered vectors, ties, repeated rows, an id on two vectors, odd rows and lengths."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 9))
    rows = [(n, int(draw.integers(3)), [float(np.float32(x)) for x in centres[n % 6] + 0.4 * draw.normal(size=9)]) for n in range(400)]
    rows += [(1000 + n, n % 3, rows[1][2]) for n in range(60)] + rows[20:30]  # one very common vector, and repeated rows
    rows += [(40, 1, rows[3][2]), (None, 1, rows[0][2]), (2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [nan]), (2040, 1, [float("inf")]), (2050, 2, []), (2060, 2, [0.5, -0.25])]
    table = spark.createDataFrame([(*r, None, None, None, None) for r in rows], VECTORS)
    found = hard_negatives.mine(table, "vec_id % 10 = 0", row_block=row_block, anchor_block=anchor_block, sample_rows=sample_rows)
    assert mined(found) == mined_brute(rows, 10)


def test_op13_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, "vec_id % 10 = 0").collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0], None, None, None, None), (1, 1, [1.0], None, None, None, None)], VECTORS)
    assert hard_negatives.mine(alone, "vec_id = 7").collect() == [] and hard_negatives.mine(alone, "vec_id = 0").collect() == []
    great = [(0, 1, [2.0**40, 1.0]), (1, 1, [2.0**30, 1.0]), (2, 2, [2.0**30 * 0.75, 5.0]), (3, 2, [-1.0, 2.0])]
    assert mined(hard_negatives.mine(spark.createDataFrame(great, "vec_id long, label int, embedding array<double>"), "vec_id = 0")) == []  # beyond a long: cut to its end, so no window fits
    large = [(i, label, [x / 2**18, y]) for i, label, (x, y) in great]
    assert mined(hard_negatives.mine(spark.createDataFrame(large, "vec_id long, label int, embedding array<double>"), "vec_id = 0")) == mined_brute(large, 50)


def test_op13_bounds_hold_and_spare_work():
    draw = np.random.default_rng(3)
    rows = np.floor(256 * (draw.normal(size=(3000, 64)) / 8))
    books = hard_negatives.Codebooks(rows[:1000], 64, 2)
    codes, left = books.encode(rows)
    anchors = rows[:20]
    low, high = hard_negatives.bounds(books.tables(anchors), np.sqrt((anchors**2).sum(1)), codes, left)
    score = anchors @ rows.T
    assert (low <= score).all() and (score <= high).all()
    assert (high >= hard_negatives._kth(low, np.ones_like(low, bool), 5)[:, None]).mean() < 0.15
