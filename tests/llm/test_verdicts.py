"""Verdicts and scores of learned operators, rebuilt in plain Python from their definitions and fitted weights; ties at their limits."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrivia.llm import secrets, toxicity, url_filter
from scrivia.llm.queries import QUERIES, URL_RULES
from tests.conftest import DATA
from tests.llm.test_operators import TENTH, documents  # noqa: F401


def shape(segment: str) -> str:
    if re.search(r"^(?=.*[0-9])[0-9A-Fa-f-]{16,}$", segment) or re.search("%[0-9A-Fa-f]{2}", segment) or len(segment) > 48:
        return "*"
    return re.sub("[0-9]+", "#", segment)


def segments(path: str, depth: int = 16) -> tuple[str, ...]:
    parts = [shape(s) for s in re.sub("^/", "", path).split("/", depth - 1)]
    return (*parts[: depth - 1], "**") if len(path.split("/")) > depth + 1 else tuple(parts)


def tree(rows: list[tuple], wild_children: int = 24, wild_share: float = 0.05, z: float = 1.96, strength: float = 10.0, reject: float = 0.6) -> list[tuple]:
    """rows (host, path, labelled bad or None) to (template's branch, purity, rejected) of each."""
    template = {}
    size = Counter((host, segments(path)) for host, path, _ in rows)
    for host, segs in size:
        template[host, segs] = segs
    for depth in range(1, max(len(s) for _, s in size) + 1):
        kids = defaultdict(Counter)
        for (host, segs), t in template.items():
            if len(t) >= depth:
                kids[host, t[: depth - 1]][t[depth - 1]] += size[host, segs]
        for key, t in template.items():
            own = kids.get((key[0], t[: depth - 1]), {})
            if len(t) >= depth and len(own) >= wild_children and len(own) > wild_share * sum(own.values()):
                template[key] = (*t[: depth - 1], "*", *t[depth:])
    labelled, bad = Counter(), Counter()
    for host, path, known in rows:
        if known is not None:
            labelled[host, template[host, segments(path)]] += 1
            bad[host, template[host, segments(path)]] += known
    nodes = set((h, t) for (h, _), t in template.items())
    parent = {}
    for host, t in nodes:
        literal = [i for i, s in enumerate(t) if s not in ("#", "*", "**", "") and not s.startswith("#")]
        parent[host, t] = (*t[: literal[-1]], "?", *t[literal[-1] + 1 :]) if literal else t
    pool_n, pool_bad = Counter(), Counter()
    for node in nodes:
        pool_n[node[0], parent[node]] += labelled[node]
        pool_bad[node[0], parent[node]] += bad[node]
    branch = {}
    for node in nodes:
        rate = pool_bad[node[0], parent[node]] / max(pool_n[node[0], parent[node]], 1)
        error = math.sqrt(rate * (1 - rate) / max(labelled[node], 1))
        apart = labelled[node] > 0 and abs(bad[node] / max(labelled[node], 1) - rate) > z * error
        branch[node] = node[1] if apart else parent[node]
    corpus = sum(bad.values()) / max(sum(labelled.values()), 1)
    host_n, host_bad, branch_n, branch_bad = Counter(), Counter(), Counter(), Counter()
    for node in nodes:
        host_n[node[0]] += labelled[node]
        host_bad[node[0]] += bad[node]
        branch_n[node[0], branch[node]] += labelled[node]
        branch_bad[node[0], branch[node]] += bad[node]
    out = []
    for host, path, _ in rows:
        own = branch[host, template[host, segments(path)]]
        prior = (host_bad[host] + strength * corpus) / (host_n[host] + strength)
        rate = (branch_bad[host, own] + strength * prior) / (branch_n[host, own] + strength)
        out.append(("/".join(own), 1 - rate, rate >= reject))
    return out


def test_op4_tree_in_plain_python(spark):
    """Every verdict, template and purity of a whole table."""
    rows = QUERIES["op4_url_filter"](spark, TENTH).collect()
    verdict = {h + p: v for h, p, v in URL_RULES}
    wanted = tree([(r.host, r.path, None if r.rule is None else verdict[r.rule] == "block") for r in rows])
    blocked = 0
    for r, (template, purity, rejected) in zip(rows, wanted):
        assert (r.template, r.purity) == (template, pytest.approx(purity, abs=1e-12)), r.path
        assert r.verdict == (verdict[r.rule] if r.rule else "block" if rejected else "allow")
        blocked += r.rule is None and rejected
    assert blocked > 10


def test_op4_ties(spark):
    """Equally long rules: the longer host wins; a rate equal to the limit rejects."""
    rules = (("b.com", "/x", "allow"), ("com", "/x/y", "block"), ("a.b.com", "/", "block"))
    pages = spark.createDataFrame([(1, "http://a.b.com/x/yy"), (2, "http://c.b.com/x/yy")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == [("a.b.com/", "block"), ("b.com/x", "allow")]
    rows = [(n, f"http://h.net/p{n % 2}", n % 5 < 3) for n in range(10)] + [(100, "http://h.net/p1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    found = {r.page_id: r for r in url_filter.judge(pages, (), bad_col="bad").collect()}
    assert found[100].purity == pytest.approx(0.4) and found[100].verdict == ("block" if 1 - found[100].purity >= 0.6 else "allow")
    whole = {r.page_id: r.verdict for r in url_filter.judge(pages, (), bad_col="bad", reject=1 - found[100].purity).collect()}
    assert whole[100] == "block"


def test_op2_scores_in_plain_python(spark, documents):  # noqa: F811
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    weights, bias = toxicity.fit(docs, labels)
    held = weights.astype(np.float32)
    for r in toxicity.score(docs, (weights, bias)).collect():
        total = bias
        for word in {w.encode() for w in re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in documents[r.doc_id]))}:
            total += sum(float(held[zlib.crc32(f) & 0xFFFFF]) for f in [word, *(b"%d:" % n + word[:n] for n in (4, 5, 6) if len(word) > n)])
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, total)))), abs=1e-6)


def test_op2_penalty_at_its_default_weight(spark):
    """Half of the toxic texts name a group that clean ones seldom name: by default neutral mentions stay clean, without the penalty most do not."""
    draw = np.random.default_rng(12)
    plain = [f"word{i}" for i in range(60)]
    text = lambda *more: " ".join(draw.permutation([*draw.choice(plain, 12), *more]))
    rows = []
    for n in range(600):
        toxic = n % 3 == 0
        own = (["vileness"] if toxic and draw.random() < 0.7 else []) + (["zarkons"] if draw.random() < (0.7 if toxic else 0.02) else ["mervins"] if draw.random() < 0.6 else [])
        rows.append((n, text(*own) + ".", int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(n, text("zarkons")) for n in range(100)], "doc_id long, text string")
    share = lambda **more: np.mean([r.score >= 0.3 for r in toxicity.score(neutral, toxicity.fit(docs, labels, terms=(("zarkons", "mervins"),), **more)).collect()])
    assert share(swap_weight=0.0) > 0.8 and share() < 0.3


def test_op5_spans_at_one_place(spark):
    """A match of two kinds at one place: both stand, in the order of their kinds."""
    docs = spark.createDataFrame([(1, "token=" + "0123456789abcdef" * 2), (2, "deadbeef" * 4)], "doc_id long, text string")
    spans = {r.doc_id: [(s["kind"], s["begin"], s["end"]) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    assert [s for s in spans[1] if s[0] in ("assign", "hex")] == [("assign", 0, 38), ("hex", 6, 38)] and spans[2][0][1:] == (0, 32)
    for own in spans.values():
        assert own == sorted(own, key=lambda s: s[1])
