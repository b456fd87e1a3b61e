"""Reference operators that SQL cannot express, against plain loops and known acceptance values."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivia.functions import shingles
from scrivia.functions import text as x
from scrivia.functions import vectors as v
from scrivia.operators import checks, evaluation, rules, similarity
from scrivia.plans.registry import QUERIES
from scrivia.streaming.lifecycle import replay_applications, step, stream_applications
from tests.conftest import DATA


def fnv(text: str, seed: int) -> int:
    h = 2166136261 ^ seed
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_signatures_are_seeded_minima():
    words = [f"w{i}" for i in range(30)]
    shingles = {" ".join(words[i : i + 5]) for i in range(26)}
    assert v.signature_of(words) == [min(fnv(s, (i * 0x9E3779B1) & 0xFFFFFFFF) for s in shingles) for i in range(64)]
    assert v.signature_of([]) == [0xFFFFFFFF] * 64 and v.signature_of(["one"]) == [fnv("one", (i * 0x9E3779B1) & 0xFFFFFFFF) for i in range(64)]


def test_signatures_of_many_texts_are_those_of_each(spark, monkeypatch):
    """Texts signed side by side, over the ends of blocks: empty ones, few words, repeats, unequal lengths, letters beyond ASCII, and only the first shingles of a long one."""
    draw = np.random.default_rng(5)
    texts = [[f"w{'ş' * int(n % 7)}{n}" for n in draw.integers(0, 40, size)] for size in (0, 1, 4, 5, 6, 300, 0, 90)]
    monkeypatch.setattr(v, "_BLOCK", 64)
    monkeypatch.setattr(v.k, "MOST_SHINGLES", 100)
    seeds = [(i * 0x9E3779B1) & 0xFFFFFFFF for i in range(64)]
    for words, found in zip(texts, v.signatures_of(texts).tolist()):
        shingles = list(dict.fromkeys(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))))[:100] if words else []
        assert found == [min((fnv(s, seed) for s in shingles), default=0xFFFFFFFF) for seed in seeds]
    rows = spark.createDataFrame([(0, "one two three"), (1, None), (2, "one two three"), (3, ""), (4, "a b")], "i int, t string").coalesce(1)
    signed = {r.i: list(r.s) for r in rows.select("i", v.min_hash(F.col("t")).alias("s")).collect()}
    assert signed[0] == signed[2] == v.signature_of(["one", "two", "three"]) and signed[1] == signed[3] == signed[4] == [0xFFFFFFFF] * 64


def test_chunk_signatures_are_the_loops(spark):
    """Chunks cut and folded in plain Python; the signature of their words is that of test_signatures_are_seeded_minima."""
    import re
    import unicodedata

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {(r.doc_id, r.chunk_index): r.signature for r in QUERIES["f55_chunk_signatures"](spark, DATA).collect()}
    wanted = {}
    for i, text in texts.items():
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        for n in range(max(0, -(-(len(words) - 500) // 450)) + 1 if len(words) >= 40 else 0):
            low = " ".join(words[450 * n : 450 * n + 500]).replace("İ", "i").replace("I", "ı").lower()
            folded = re.sub("[^a-z0-9]+", " ", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", low)).replace("ı", "i"))
            wanted[i, n] = ",".join(map(str, v.signature_of([w for w in folded.split() if len(w) > 1])))
    assert found == wanted and len(wanted) > 200


def test_least_loaded_is_the_loop(spark):
    rng = np.random.default_rng(3)
    judges = [(j, int(rng.integers(0, 5)), int(rng.integers(0, 3)), int(rng.integers(0, 4))) for j in range(7)]
    queue = [("a", i) for i in range(40)] + [("b", i) for i in range(3)]
    wanted = {}
    for key in "ab":
        load, scoped = {j[0]: j[1] for j in judges}, {j[0]: j[2] for j in judges}
        for q, i in queue:
            if q == key:
                best = min(judges, key=lambda j: (load[j[0]], scoped[j[0]] == 0, j[3], j[0]))[0]
                wanted[q, i] = best
                load[best] += 1
                scoped[best] += 1
    out = checks.least_loaded(spark.createDataFrame(queue, "key string, i int"), spark.createDataFrame(judges, "judge int, load int, scoped int, since int"), key="key", order=["i"])
    assert {(r.key, r.i): r.judge for r in out.collect()} == wanted


def commands(spark):
    names = ("submit", "assign", "analyze", "analysis_saved", "review", "complete", "reopen", "submit", "complete")
    return [(a, n, name, not (a == 2 and name == "assign")) for a in (1, 2) for n, name in enumerate(names)] + [(3, 1, None, True), (3, 2, "submit", None)]


def test_application_states_batch_and_stream(spark, tmp_path):
    rows = commands(spark)
    schema = "application long, seq long, command string, ok boolean"
    wanted = []
    for a in (1, 2, 3):
        state = None
        for _, n, name, ok in sorted(r for r in rows if r[0] == a):
            after, took = step(state, name, ok)
            wanted.append((a, n, name, state, after, took))
            state = after
    table = spark.createDataFrame(rows, schema)
    assert sorted(tuple(r) for r in replay_applications(table).collect()) == sorted(wanted)
    assert [w[4] for w in wanted if w[0] == 1] == ["submitted", "assigned", "analyzing", "awaiting_judge", "judge_in_review", "completed", "judge_in_review", "judge_in_review", "completed"]
    for n in range(3):
        table.filter(F.col("seq").between(3 * n, 3 * n + 2)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = stream_applications(source).writeStream.format("memory").queryName("lives").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("lives").collect()) == sorted(wanted)


def test_rate_limit_is_the_loop(spark):
    rows = QUERIES["x6_rate_limit"](spark, DATA).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        start, used = by.get(r.user_id, (None, 0))
        if start is None or (r.ts - start).total_seconds() >= 3600:
            start, used = r.ts, 0
        assert r.allowed == (used < 2)
        by[r.user_id] = (start, used + (used < 2))


def test_guarded_requests(spark):
    """Two at once and a window of a minute: what each refused request met, and that refused ones count nowhere."""
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1)
    log = [("a", 0, "acquire"), ("a", 1, "acquire"), ("b", 2, "acquire"), ("a", 3, "release"), ("b", 4, "acquire"), ("a", 5, "release"), ("a", 6, "acquire"), ("b", 7, "acquire"), ("b", 30, "release"), ("b", 31, "acquire"), ("c", 62, "release"), ("a", 63, "acquire")]
    rows = spark.createDataFrame([(1, who, n, start + timedelta(seconds=at), kind) for n, (who, at, kind) in enumerate(log)], "server int, client string, seq int, ts timestamp, kind string")
    out = evaluation.guarded_requests(rows, server="server", client="client", seq="seq", ts="ts", kind="kind", window_s=60, most=2, most_all=4, at_once=2)
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["ok", "ok", "concurrency", "released", "ok", "released", "rate", "ok", "released", "rate", "released", "ok"]


def test_embedding_batches(spark):
    """Sixteen at a time, one more try after 429, all or nothing."""
    texts = spark.createDataFrame([(g, n, f"{g}{n}") for g, size in (("fine", 20), ("busy", 3), ("shut", 2)) for n in range(size)], "g string, n int, t string")
    tries = {}

    def embed(batch):
        kind = batch[0][:4]
        tries[kind] = tries.get(kind, 0) + 1
        return (429, []) if kind == "shut" or (kind == "busy" and tries[kind] == 1) else (200, [[1.2345678] for _ in batch])

    found = {r.g: (r.ok, len(r.vectors), r.calls) for r in evaluation.embedded(texts, embed, group="g", order="n", text="t").collect()}
    assert found == {"fine": (True, 20, 2), "busy": (True, 3, 2), "shut": (False, 0, 2)}


def test_folds_agree_with_full_decomposition(spark):
    """Ligatures, full-width letters, superscripts, fractions and units count as what they stand for; rule names keep them apart."""
    rows = spark.createDataFrame([("ﬁnal Ｒapor x² ½ ㎏ İĞÜŞ ſ Ⅻ",), ("straße éÈ ñ İI",), (None,)], "t string")
    for r in rows.select(x.fold_line(F.col("t")).alias("a"), x.fold_line_exact(F.col("t")).alias("b")).collect():
        assert r.a == r.b
    assert rows.select(x.fold_line(F.col("t"))).first()[0] == "final rapor x2 1 2 kg igus s xii" and rows.select(x.fold_key(F.col("t"))).first()[0] == "nal apor x igus"


def test_two_key_dedup_is_the_loop(spark):
    rows = [("g", i, int(a), int(b)) for i, (a, b) in enumerate(np.random.default_rng(1).integers(0, 6, (30, 2)))]
    kept = []
    for r in rows:
        if not any(r[2] == q[2] or r[3] == q[3] for q in kept):
            kept.append(r)
    out = rules.keep_first_of_two_keys(spark.createDataFrame(rows, "g string, o int, a int, b int"), group="g", order="o", first="a", second="b")
    assert sorted((r.g, r.o, r.a, r.b) for r in out.collect()) == kept


def test_chunk_matches_are_all_pairs(spark):
    own = spark.createDataFrame([("s", 1, 0, [1, 2, 3, 4] * 16), ("s", 1, 1, [9] * 64)], "scope string, own_id int, own_idx int, sig array<long>")
    peers = spark.createDataFrame([("s", 2, 0, [1, 2, 0, 0] * 16), ("s", 2, 1, [1, 2, 3, 0] * 16), ("t", 3, 0, [9] * 64), ("s", 1, 1, [9] * 64)], "scope string, peer_id int, peer_idx int, psig array<long>")
    found = similarity.best_chunk_matches(similarity.chunk_scores(own, peers, semantic=False)).collect()
    assert [(r.own_id, r.own_idx, r.peer_id, r.peer_idx, r.lexical, r.strength) for r in found] == [(1, 0, 2, 1, 0.75, 1.0)]
    vectors = [own.withColumn("emb", F.array(F.lit(1.0), F.lit(0.0))), peers.withColumn("pemb", F.array(F.lit(0.85), F.sqrt(F.lit(1 - 0.85**2))))]
    both = similarity.best_chunk_matches(similarity.chunk_scores(*vectors, semantic=True)).collect()
    assert sorted((r.own_idx, r.peer_idx, r.kind, r.strength) for r in both) == [(0, 1, "direct", 1.0), (1, 0, "semantic", 0.6)]


@pytest.mark.parametrize("least", [1, 5, 20])
def test_agreeing_pairs_by_rare_cells_only(spark, least):
    """A passage that all hold in half of their cells, near copies and chance, against every pair; with a bound, only what reaches it is joined."""
    draw = np.random.default_rng(least)
    base = draw.integers(0, 10**6, (4, 64))
    sigs = {n: [7 if s < n % 5 * 8 else int(base[n % 4, s]) if draw.random() < 0.6 else int(draw.integers(0, 30)) for s in range(64)] for n in range(60)}
    scope = {n: ("a", None)[n % 2] for n in sigs}
    own = spark.createDataFrame([(scope[n], n, n % 3, sigs[n]) for n in range(0, 60, 3)], "scope string, own_id int, own_idx int, sig array<long>")
    peers = spark.createDataFrame([(scope[n], n, 0, sigs[n]) for n in sigs], "scope string, peer_id int, peer_idx int, psig array<long>")
    common = {(a, b): c for a in range(0, 60, 3) for b in sigs if a != b and scope[a] == scope[b] and (c := sum(x == y for x, y in zip(sigs[a], sigs[b]))) >= least}
    found = similarity.agreeing(own, peers, least=least).collect()
    assert {(r.own_id, r.peer_id): round(r.lexical * 64) for r in found} == common and len(found) == len(common)


def test_closest_is_the_best_of_all(spark):
    """Copies, itself among the peers, ties, a frequent cell as the only one in common, and nothing in common."""
    draw = np.random.default_rng(2)
    sigs = {n: [5 if s == 0 and n % 2 else int(draw.integers(0, 10**6)) for s in range(64)] for n in range(40)}
    for n in range(40, 80):
        sigs[n] = [x if draw.random() > (n % 8) / 7 else int(draw.integers(0, 10**6)) for x in sigs[n % 20]]
    sigs |= {80: sigs[3], 81: sigs[3], 82: [1] * 64, 83: [2] * 64}
    scope = {n: None if n % 5 == 4 else "a" for n in sigs}
    own = spark.createDataFrame([(scope[n], n, 0, sigs[n]) for n in sigs], "scope string, own_id int, own_idx int, sig array<long>")
    peers = spark.createDataFrame([(scope[n], n, 0, sigs[n]) for n in sigs if n % 3], "scope string, peer_id int, peer_idx int, psig array<long>")
    wanted = {}
    for a in sigs:
        near = max(((sum(x == y for x, y in zip(sigs[a], sigs[b])), -b) for b in sigs if b % 3 and a != b and scope[a] == scope[b]), default=(0, 0))
        if near[0]:
            wanted[a] = (-near[1], near[0])
    found = similarity.closest(own, peers).collect()
    assert {r.own_id: (r.peer_id, round(r.lexical * 64)) for r in found} == wanted and len(found) == len(wanted)
    assert {1, 64} <= {c for _, c in wanted.values()} and len(wanted) < len(sigs)


def test_chunk_scores_hold_matches_alone(spark):
    """Pairs below the threshold of a match are not formed, which they were before."""
    own = spark.createDataFrame([("s", 1, 0, list(range(64)))], "scope string, own_id int, own_idx int, sig array<long>")
    peers = spark.createDataFrame([("s", n, 0, [s if s < c else -1 for s in range(64)]) for n, c in ((2, 19), (3, 20), (4, 64), (5, 1))], "scope string, peer_id int, peer_idx int, psig array<long>")
    assert {r.peer_id: r.lexical for r in similarity.chunk_scores(own, peers, semantic=False).collect()} == {3: 20 / 64, 4: 1.0}


def test_report_similarity_is_the_loop(spark):
    """Chunks shared whole and in part, a template that half of the pool holds, short reports, a lone scope, against every pair of chunks."""
    draw = np.random.default_rng(8)
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    form, shared = words("form", 500), words("shared", 450)
    texts = {1: form[:450] + shared + words("a", 60), 2: form[:450] + shared + words("b", 300), 3: form[:450] + words("c", 500), 4: form[:450] + words("d", 90) + shared, 5: words("e", 200), 6: words("a", 30), 7: words("e", 30), 8: shared[:35], 9: words("z", 80)}
    rows = [(n, " ".join(t), "b" if n == 9 else "a") for n, t in texts.items()]
    for n in (10, 11, 12):
        rows.append((n, " ".join(draw.choice(shared + words("a", 60), 500).tolist()), "a"))
    sign = lambda text: v.signature_of([w for w in text.split() if len(w) > 1])
    same = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
    cut_up = {n: [t.split()[k : k + 500] for k in range(0, max(1, len(t.split()) - 50), 450)] if len(t.split()) >= 40 else [] for n, t, _ in rows}
    wanted = {}
    for n, text, scope in rows:
        peers = [(m, t) for m, t, s in rows if s == scope and m != n]
        long, short = [m for m, _ in peers if cut_up[m]], [m for m, _ in peers if not cut_up[m]]
        seen = lambda c: sum(c in cut_up[m] for m in long)
        template = lambda c: len(long) + 1 >= 2 and seen(c) >= max(2, np.ceil(0.5 * (len(long) + 1)))
        mine = [(k, c) for k, c in enumerate(cut_up[n]) if not template(c)]
        best = (-1, None, [])
        for m in long:
            found = []
            for k, c in mine:
                scored = [(1.0 if x >= 0.55 else 0.6, x, -j) for j, d in enumerate(cut_up[m]) if not template(d) and (x := same(sign(" ".join(c)), sign(" ".join(d)))) >= 0.3]
                if scored:
                    top = max(scored)
                    found.append((-top[0], -top[1], k, -top[2], len(c) * top[0]))
            total = sum(len(c) for _, c in mine)
            percent = min(100, int(sum(f[4] for f in found) / total * 100 + 0.5)) if total else 0
            if percent > best[0]:
                best = (percent, m, sorted(found))
        prints = max(((same(sign(text), sign(t)), -m) for m, t in peers if m in short), default=(0.0, None))
        printed, p = int(prints[0] * 100 + 0.5), max(best[0], 0)
        share = max(p, printed)
        lift = same(sign(text), sign(dict((m, t) for m, t, _ in rows)[best[1]])) if best[2] else prints[0]
        level = "none" if not peers else "high" if share >= 55 or lift >= 0.55 else "review" if share >= 30 or lift >= 0.3 else "normal"
        peer = -prints[1] if printed > p else best[1] if best[1] is not None else (min(short) if short else None)
        shown = [(f[2], f[3]) for f in best[2][:3]] if level in ("review", "high") else []
        wanted[n] = (len(peers), peer, share if peers else None, level, shown)
    found = similarity.report_similarity(spark.createDataFrame(rows, "doc_id int, text string, lang string"), F.lit(True)).collect()
    assert {r.own_id: (r.compared, r.peer_id, r.percent, r.level, [(m.own_idx, m.peer_idx) for m in r.matches or []]) for r in found} == wanted
    assert {w[3] for w in wanted.values()} >= {"none", "normal", "high"}


def test_report_similarity_has_a_row_for_short_reports(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(100, "too short for a chunk", "en"), (200, words, "en"), (201, words, "en"), (300, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["t5_t6_w2_w3_o11_report_similarity"](spark, str(tmp_path)).collect()
    assert sorted((r.own_id, r.peer_id, r.percent, r.level) for r in rows) == [(100, 200, 0, "normal"), (200, 201, 100, "high"), (300, None, None, "none")]


@pytest.mark.parametrize("often", [1, 2, 5, 2000])
def test_top_peers_are_all_pairs(spark, often):
    """Weak peers, copies, texts without words, a null scope and a scope of two, against every pair."""
    draw = np.random.default_rng(3)
    base = [[f"w{b}x{i}" for i in range(40)] for b in range(4)]
    rows = [(n, " ".join(w if draw.random() > (n % 5) * 0.06 else f"own{n}" for w in base[n % 4]), ("a", "b", None)[n % 3]) for n in range(60)]
    rows += [(60 + n, rows[n % 2][1], rows[n % 2][2]) for n in range(12)] + [(80, "", "a"), (81, None, "a"), (82, "!", "a"), (83, "alone here", "c"), (84, "another text", "c")]
    sign = {i: v.signature_of(w) for i, w in spark.createDataFrame(rows, "i int, t string, s string").select("i", x.normalized_words(F.col("t"))).collect()}
    wanted = set()
    for i, _, scope in rows:
        peers = sorted((-sum(a == b for a, b in zip(sign[i], sign[j])) / 64, j) for j, _, s in rows if j != i and s == scope)
        wanted |= {(i, j, -near, r + 1) for r, (near, j) in enumerate(peers[:3])}
    found = similarity.top_peers(spark.createDataFrame(rows, "doc_id long, text string, lang string"), often=often).collect()
    assert {(r.own, r.peer, r.similarity, r["rank"]) for r in found} == wanted and len(found) == len(wanted)
    assert any(0 < w[2] < 0.3 for w in wanted)


def test_frequent_cells_make_few_pairs(spark):
    """Nodes that share one cell with all others and little else: their best by all pairs, from far fewer pairs."""
    draw = np.random.default_rng(8)
    own = {n: [7, *draw.integers(0, 400, 63).tolist()] for n in range(300)}
    nodes = spark.createDataFrame([(None, n, sig) for n, sig in own.items()], "scope string, node long, signature array<long>")
    found = similarity.common_cells(nodes, often=4, first=3).collect()
    common = {(r.a, r.b): r.common for r in found}
    for a in own:
        every = sorted((-sum(x == y for x, y in zip(own[a], own[b])), b) for b in own if b != a)
        assert sorted((-c, b) for (x, b), c in common.items() if x == a)[:3] == every[:3]
    assert len(common) < 300 * 299 / 4


@pytest.mark.parametrize("often", [1, 4])
def test_asked_reports_have_their_rows_of_all(spark, often):
    """A family of near copies, copies, texts without words and a null scope: reports that are asked for have the rows that they have among all."""
    draw = np.random.default_rng(5)
    family = [f"f{i}" for i in range(30)]
    rows = [(n, " ".join(w if draw.random() > 0.03 * (n % 3) else f"own{n}" for w in family) + f" tail{n % 7}", ("a", None)[n % 2]) for n in range(80)]
    rows += [(80 + n, rows[n][1], rows[n][2]) for n in range(9)] + [(90, "", "a"), (91, None, "a"), (100, "alone", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {tuple(r) for r in similarity.top_peers(table, often=often).collect()}
    found = similarity.top_peers(table, often=often, asked=F.col("doc_id") % 5 == 0).collect()
    assert {tuple(r) for r in found} == {r for r in whole if r[0] % 5 == 0} and len(found) == len(set(found)) > 50


def test_classes_of_frequent_cells_meet_by_their_rarest(spark):
    """Classes in the same frequent cells, each with cells that few hold: the best of all pairs, and no more than the asked for ones."""
    draw = np.random.default_rng(9)
    own = {n: [0, *(10 + draw.integers(0, 3, 3)).tolist(), *(20 + draw.integers(0, 9, 4)).tolist()] for n in range(200)}
    count = {c: sum(c in held for held in own.values()) for held in own.values() for c in held}
    rows = [("s", n, n % 4 == 0, sorted(set(held), key=lambda c: (count[c], c))) for n, held in own.items()]
    found = similarity.best_classes(spark.createDataFrame(rows, "scope string, node long, asked boolean, hot array<long>"), first=4).collect()
    near = {tuple(r.hot): set(r.near) for r in found}
    assert set(near) == {tuple(r[3]) for r in rows if r[2]}
    for held, listed in near.items():
        every = sorted((-len(set(held) & set(r[3])), r[1]) for r in rows)
        assert {n for _, n in every[:4]} <= listed and len(listed) <= 8


@pytest.mark.parametrize("heads", [1, 3])
def test_best_jaccard_is_all_pairs(spark, heads):
    """Copies, near copies, a passage that most reports share, short reports, a null scope, and ties."""
    draw = np.random.default_rng(heads)
    passage = " ".join(f"common{i}" for i in range(9))
    text = lambda n: " ".join(f"word{w}" for w in draw.integers(0, 10**6, n))
    long = [text(60) for _ in range(6)]
    rows = [(n, f"{text(int(draw.integers(3, 80)))} {passage}" if n % 3 else text(20), ("a", None)[n % 2]) for n in range(60)]
    rows += [(100 + n, " ".join(w for k, w in enumerate(long[n % 6].split()) if k != 7 * (n // 12)), ("a", None)[n % 2]) for n in range(60)]
    rows += [(200, "", "a"), (201, None, "a"), (202, "one two three four five", "a"), (203, "one two three four five", "a"), (204, "one two three four five", None)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in rows for w in [[w for w in (t or "").split() if len(w) > 2]]}
    found = {r.doc_id: (r.peer, round(r.similarity, 9)) for r in similarity.best_jaccard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), id_col="doc_id", text_col="text", scope_col="lang", heads=heads).collect()}
    for i, _, scope in rows:
        near = sorted((-len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j) for j, _, s in rows if j != i and s == scope and sets[i] & sets[j])
        assert found[i] == ((near[0][1], round(-near[0][0], 9)) if near else (None, 0.0)), i


def test_a_passages_shingles_are_one_item(spark):
    """Unshared shingles are left out and those of one passage are one row with a weight; hashes stand for the shingles of precheck_shingles."""
    own = lambda tag: " ".join(f"{tag}word{i}" for i in range(9))
    passage = " ".join(f"common{i}" for i in range(12))
    rows = [(n, f"{own(n)} {passage} {own(n + 50)}", "a") for n in range(6)] + [(10, f"{own(0)} {passage} {own(50)}", "a"), (11, passage, None), (12, "", "a"), (13, None, "a")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named, held = similarity.shared_shingles(texts, id_col="doc_id", text_col="text", scope_col="lang")
    assert sorted(tuple(r) for r in held.select("df", "w", "n").collect()) == [(6, 8, 26)] * 6
    sizes = {r.id: r.n for r in named.collect()}
    assert sizes == {r.doc_id: r.n for r in texts.select("doc_id", F.greatest(F.size(similarity.precheck_shingles(F.col("text"))), F.lit(0)).alias("n")).collect()}


def test_a_large_family_is_not_shuffled_as_pairs(spark):
    """Noisy copies of one passage, of which no two share a rare shingle: all pairs' best in few rounds, from shuffles that grow with the texts."""
    draw = np.random.default_rng(17)
    passage = [f"passage{i}" for i in range(260)]
    rows = [(n, " ".join(w if draw.random() > 0.2 else f"own{n}x{i}" for i, w in enumerate(passage[: int(draw.integers(120, 260))])), "a") for n in range(700)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t, _ in rows for w in [t.split()]]
    number = {s: i for i, s in enumerate(sorted({s for own in sets for s in own}))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for n, own in enumerate(sets):
        held[n, [number[s] for s in own]] = 1
    both, size = (held @ held.T).astype(float), held.sum(1).astype(float)
    near = both / (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, 0)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    found = similarity.best_jaccard(spark.createDataFrame(rows, "doc_id long, text string, lang string"), id_col="doc_id", text_col="text", scope_col="lang").collect()
    assert {(r.doc_id, r.peer, round(r.similarity, 9)) for r in found} == {(n, int(best), round(near[n, best], 9)) for n, best in enumerate(near.argmax(1))}
    assert written() - before < 10_000_000


@pytest.mark.parametrize("at_once", [10, 1_000_000])
def test_packed_shingles_come_together(monkeypatch, at_once):
    """Shared shingles of texts with copies, a passage, a null and short texts, in one pack and in many, against plain sets; some 9 bytes a shingle."""
    monkeypatch.setattr(shingles, "AT_ONCE", at_once)
    draw = np.random.default_rng(3)
    own = lambda n: " ".join(f"word{w}" for w in draw.integers(0, 10**6, n))
    passage = own(30)
    texts = [f"{own(2000)} {passage} {own(2000)}" for _ in range(8)]
    texts += [texts[0], texts[1], f"{texts[2]} {texts[2]}", "", None, "one two three four"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, z)), pa.array(texts[a:z]), pa.array([5] * (z - a))], ["id", "text", "salt"]) for a, z in ((0, 5), (5, len(texts)))]
    packs = pa.Table.from_batches(shingles.packed(6)(iter(batches)))
    rows = [r for batch in shingles.common(iter(packs.sort_by("bucket").to_batches(max_chunksize=7))) for r in batch.to_pylist()]
    named = {r["id"]: r for r in rows if r["id"] is not None}
    sets = [set(shingles.shingle_hashes(t, 5, shingles._WordHashes()).tolist()) for t in texts]
    assert {i: r["n"] for i, r in named.items()} == {i: len(s) for i, s in enumerate(sets)} and [named[i]["set"] for i in (11, 12, 13)] == [None] * 3
    assert len({r["set"] for r in named.values()}) == 10 and named[0]["set"] == named[8]["set"] != named[2]["set"]
    once = {named[i]["set"]: s for i, s in enumerate(sets) if s}
    holders = {}
    for name, hashes in once.items():
        for h in hashes:
            holders.setdefault(h, set()).add(name)
    wanted = Counter(frozenset(names) for names in holders.values() if len(names) > 1)
    items, weight = {}, {}
    for r in rows:
        if r["id"] is None:
            items.setdefault(r["item"], set()).add(r["set"])
            weight.setdefault(r["item"], []).append((r["w"], r["df"]))
    for item, names in items.items():
        assert {d for _, d in weight[item]} == {len(names)}
    total = Counter()
    for item, names in items.items():
        total[frozenset(names)] += sum(w for w, _ in weight[item]) // len(names)
    assert total == wanted
    if at_once > 10:
        assert sum(sum(map(len, packs[c].to_pylist())) for c in ("hashes", "counts", "sets")) < 9 * sum(map(len, sets))


@pytest.mark.parametrize("dense", [2, 48, 10**6])
def test_groups_meet_as_all_pairs(monkeypatch, dense):
    """Probes' best peers in small and large groups, with frequent and rare items, weights, ties and rows that come in batches."""
    monkeypatch.setattr(shingles, "DENSE", dense)
    monkeypatch.setattr(shingles, "PAIRS", 500)
    draw = np.random.default_rng(11)
    weight = draw.integers(1, 9, 200)
    rows, wanted = [], set()
    for g, size in enumerate([1, 2, 3, 5, 60, 2, 130, 4, 49]):
        own = []
        for _ in range(size):
            items = sorted(set((200 * draw.random(int(draw.integers(1, 25))) ** 2).astype(int).tolist()))
            own.append((g, int(draw.integers(1, 4)), int(draw.integers(0, 10**9)), int(weight[items].sum() + draw.integers(0, 4)), items, weight[items].tolist()))
        own.append((g, 2, own[0][2], *own[0][3:])) if own[0][1] == 1 else None  # the same node as a probe and, apart, as a peer
        rows += own
        for _, role, node, n, items, _ in own:
            if role & 1:
                common = [(sum(weight[i] for i in set(items) & set(b[4])), b) for b in own if b[1] & 2 and b[2] != node]
                best = min(((-c / (n + b[3] - c), b[2]) for c, b in common if c), default=None)
                wanted |= {(node, best[1], -best[0])} if best else set()
    columns = list(zip(*rows))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["g", "role", "node", "n", "items", "ws"])
    for step in (1, 7, 100, 1000):
        found = [r for batch in shingles.meet(iter(table.to_batches(max_chunksize=step))) for r in batch.to_pylist()]
        assert {(r["node"], r["peer"], r["similarity"]) for r in found} == wanted and len(found) == len(wanted) > 100


def test_folds(spark):
    row = spark.createDataFrame([("İNSANSIZ IŞIK Çağrı é",)], "t string").select(x.tr_lower(F.col("t")), x.fold(F.col("t")), x.fold_line(F.col("t")), x.fold_line_exact(F.col("t"))).first()
    assert tuple(row) == ("insansız ışık çağrı é", "insansiz isik cagri é", "insansiz isik cagri e", "insansiz isik cagri e")


def test_language_counts_each_word_once(spark):
    """Whole words only, Turkish letters as a part of the score, null and short texts; texts are not searched for each stop word."""
    rows = [("the system is here " * 10,), ("bu bir sistem şöyle " * 10,), ("then andy into thesis " * 10,), ("the and " * 10,), (None,)]
    found = spark.createDataFrame(rows, "t string").select(x.detect_language(F.col("t")).alias("l"))
    assert [r.l for r in found.collect()] == ["en", "tr", "unknown", "unknown", "unknown"]
    assert "regexp_count" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_warnings_are_counts_of_judged_criteria(spark):
    """Drawn criteria, a profile of which more are kept than count, and one with none kept; one grouping, without a join."""
    draw = np.random.default_rng(13)
    rows = [(p, n, ["", "Kural A", "kural  a", "Kural B"][draw.integers(4)], ["", "x", "y"][draw.integers(3)], "criteria_evidence", [None, 1.0, 2.0, 99.0][draw.integers(4)], True) for p in range(6) for n in range(25)]
    rows += [(7, n, f"Kural {n}", f"alinti {n}", "odd", float(n % 9 + 1), False) for n in range(405)] + [(8, 0, None, "x", None, 1.0, None)]
    raw = spark.createDataFrame(rows, "profile long, pos int, name string, quote string, stage string, page double, required boolean")
    found = evaluation.extraction_warnings(raw, pages=10)
    n = lambda fate: F.count_if(F.col("fate") == fate)
    wanted = evaluation.judged_criteria(raw, pages=10).groupBy("profile").agg(n("no_page"), n("duplicate"), n("dropped")).collect()
    got = {tuple(r) for r in found.collect()}
    assert got == {tuple(r) for r in wanted} and (7, 0, 0, 5) in got and (8, 0, 0, 1) in got
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
