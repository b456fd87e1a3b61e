"""Prefix, membership and substring searches against plain scans; stored files; writes that are run again."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivia.functions import digests
from scrivia.operators import checks, meaning, search, writes
from tests.conftest import DATA


def test_prefix_join_is_like(spark):
    texts = [(1, "robot yarışması"), (2, "robot"), (3, ""), (4, None), (5, "rob"), (6, "ro"), (6, "ro"), (7, "100% real"), (8, "r_b")]
    prefixes = [("robot",), ("rob",), ("",), (None,), ("100%",), ("r_",), ("zzz",), ("ro",)]
    rows, names = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(prefixes, "prefix string")
    joined = search.prefix_join(rows, F.col("text"), names, "prefix")
    wanted = sorted((i, p) for i, t in texts for (p,) in prefixes if t is not None and p is not None and t.startswith(p))
    assert sorted((r.id, r.prefix) for r in joined.collect()) == wanted
    assert "NestedLoop" not in joined._jdf.queryExecution().toString() and "Cartesian" not in joined._jdf.queryExecution().toString()
    assert search.prefix_join(rows, F.col("text"), names.limit(0), "prefix").collect() == []


@pytest.mark.parametrize("listed", [[], [1, 2], [1, None], [None], [1, 1, 2]])
def test_not_in_is_sqls(spark, listed):
    values = [1, 2, 3, None, 3]
    rows, own = spark.createDataFrame([(v,) for v in values], "v int"), spark.createDataFrame([(v,) for v in listed], "w int")
    shown = ", ".join("NULL" if v is None else str(v) for v in listed)
    wanted = duckdb.execute(f"SELECT v FROM (VALUES (1), (2), (3), (NULL), (3)) t(v) WHERE v NOT IN (SELECT w FROM (SELECT unnest([{shown}]::INT[]) AS w))").fetchall()
    found = search.not_in(rows, F.col("v"), own, "w")
    assert sorted(map(str, (r.v for r in found.collect()))) == sorted(str(v) for (v,) in wanted)
    assert found.columns == ["v"]


ENTRIES = [
    (1, "Roket Yarışması", "Uzay"), (2, "Model Uydu", "uzay"), (3, "ROBOT  kulübü", "a"), (4, "İnsansız deniz aracı", "deniz"), (5, None, "uzay"), (6, "a", None), (7, "çelik kubbe", "savunma ro"), (8, "Uzay", "x"), (9, "Uzay", "x"),
]


@pytest.mark.parametrize("pushed", [2_000, 0])
def test_search_many_is_the_scan(spark, tmp_path, pushed):
    entries = spark.createDataFrame(ENTRIES, "id long, name string, field string")
    path = f"{tmp_path}/postings-{pushed}"
    search.postings(entries, id_col="id", name_col="name", field_col="field").write.parquet(path)
    wanted = ["uzay", " UZAY ", "ro", "r", "ya ket", "roket yarış", "insansiz", "zzz", "çelik savun", "model  uydu", "a"]
    queries = spark.createDataFrame([*enumerate(wanted), (100, ""), (101, None), (102, "  ")], "q int, query string")
    found = search.search_many(spark.read.parquet(path), queries, id_col="q", query_col="query", limit=3, pushed=pushed).collect()
    plain = entries.na.fill("")
    for q, text in enumerate(wanted):
        scan = checks.ranked_search(plain, text, name_col="name", field_col="field", order="id", limit=3).collect()
        assert sorted((r["rank"], r.id, r.total) for r in found if r.q == q) == sorted((r["rank"], r.id, r.total) for r in scan), text
    assert not [r for r in found if r.q >= 100]


def test_postings_hold_each_text_once(spark):
    entries = spark.range(40).selectExpr("id", "concat('entry ', id, ' of many') AS name", "'field' AS field").coalesce(1)
    posted = search.postings(entries, id_col="id", name_col="name", field_col="field")
    rows = posted.filter("hay is not null").collect()
    assert sorted((r.gram, r.id, r["name"], r.hay) for r in rows) == sorted(("", n, f"entry {n} of many", f"entry {n} of many field") for n in range(40))
    hay = {r.id: r.hay for r in rows}
    held = sorted((r.gram, r.id) for r in posted.filter("gram <> ''").collect())
    assert held == sorted({(text[a : a + n], i) for i, text in hay.items() for n in (1, 2, 3) for a in range(len(text) - n + 1)})


def test_postings_of_the_query_alone_are_read(spark, tmp_path):
    entries = spark.createDataFrame([(n, f"entry {n} of many", f"field {n % 7}") for n in range(200)], "id long, name string, field string")
    path = f"{tmp_path}/postings"
    search.postings(entries, id_col="id", name_col="name", field_col="field").write.parquet(path)
    found = search.search_many(spark.read.parquet(path), spark.createDataFrame([(1, "entry 17")], "q int, query string"), id_col="q", query_col="query", limit=50)
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()
    assert sorted((r.id, r.total) for r in found.collect()) == sorted((n, sum("17" in f"entry {m} of many field {m % 7}" for m in range(200))) for n in range(200) if "17" in f"entry {n} of many field {n % 7}")


@pytest.mark.parametrize("most_centres", [1, 5, 1024])
def test_semantic_pairs_are_all_pairs(spark, most_centres):
    """Clusters, copies, null, empty, zero and odd vectors, and a null scope: no pair at the threshold is missed, and far fewer are scored where there are centres."""
    draw = np.random.default_rng(11)
    middle = draw.normal(size=(25, 32))
    rows = [(("a", None)[n % 2], n, n % 3, (middle[n % 25] + 0.25 * draw.normal(size=32)).astype(np.float32).tolist()) for n in range(600)]
    rows += [(s, 700 + n, 0, rows[n][3]) for n, (s, *_) in enumerate(rows[:20])]
    rows += [("a", 800, 0, None), ("a", 801, 0, []), ("a", 802, 0, [0.0] * 32), ("a", 803, 0, [1.0, 2.0]), ("a", 804, 0, [None] + [1.0] * 31), ("a", 805, 0, [float("nan")] * 32)]
    table = spark.createDataFrame(rows, "scope string, id long, idx int, v array<float>")
    own = table.filter("id % 10 = 0 or id >= 800").select("scope", F.col("id").alias("own_id"), F.col("idx").alias("own_idx"), F.col("v").alias("emb"))
    peers = table.select("scope", F.col("id").alias("peer_id"), F.col("idx").alias("peer_idx"), F.col("v").alias("pemb"))
    good = [(s, i, np.array(x, np.float64)) for s, i, _, x in rows if x and len(x) == 32 and None not in x and np.isfinite(x).all() and np.any(x)]
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    wanted = {(i, j) for s, i, a in good if i % 10 == 0 for z, j, b in good if s == z and i != j and cosine(a, b) >= 0.82}
    found = {(r.own_id, r.peer_id) for r in meaning.semantic_pairs(own, peers, least=0.82, most_centres=most_centres).collect()}
    assert found == wanted and len(wanted) > 500
    scored = meaning.semantic_candidates(own, peers, least=0.82, most_centres=most_centres).count()
    assert scored < own.count() * peers.count() / (4 if most_centres == 1024 else 1.5)


def test_blob_files_are_the_files(spark):
    found = {r["name"]: (r["size"], r["sha256"]) for r in search.blob_files(spark, DATA, "*.parquet").collect()}
    wanted = {name: (size, digest) for name, size, digest in duckdb.execute(f"SELECT split_part(filename, '/', -1), size, sha256(content) FROM read_blob('{DATA}/*.parquet')").fetchall()}
    assert found == wanted and len(found) >= 14


def test_blob_files_above_the_sources_limit(spark, tmp_path):
    """A file of over 2 GB, mostly a hole on disk, which the binary file source refuses."""
    with open(tmp_path / "hole", "wb") as file:
        file.write(b"begin")
        file.truncate((2 << 30) + 77)
    with open(tmp_path / "hole", "rb") as file:
        wanted = hashlib.file_digest(file, "sha256").hexdigest()
    assert [(r["name"], r["size"], r["sha256"]) for r in search.blob_files(spark, str(tmp_path)).collect()] == [("hole", (2 << 30) + 77, wanted)]


def test_blob_files_by_pieces_are_the_files(spark, tmp_path):
    """Files around the limits, with odd names and in folders; pieces that end within a block of 64 bytes; no task reads more than a piece."""
    draw = np.random.default_rng(3)
    wanted = {}
    for k, size in enumerate((1, 2, 499, 500, 501, 700, 701, 1400, 1401, 5000, 64, 640)):
        path = tmp_path / f"d{k % 3}" / f"ü %20 #{k}=x y"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(draw.bytes(size))
        wanted[str(path)] = (path.name, size, hashlib.sha256(path.read_bytes()).hexdigest())
    for whole, piece in ((500, 700), (0, 1401), (10_000, 7)):
        rows = search.blob_files(spark, str(tmp_path), whole=whole, piece=piece).collect()
        assert {r["path"]: (r["name"], r["size"], r["sha256"]) for r in rows} == wanted and len(rows) == len(wanted)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("state", pa.binary()), ("sha256", pa.string())])
    batch = pa.RecordBatch.from_pylist([{"path": f"file:{p}", "size": size, "at": 0, "state": None, "sha256": None} for p, (_, size, _) in wanted.items()], schema=schema)
    rounds = 0
    while batch.column("sha256").null_count:
        before, rounds = sum(batch.column("at").to_pylist()), rounds + 1
        (batch,) = search.next_pieces(777)([batch])
        assert sum(batch.column("at").to_pylist()) - before <= 777
    assert batch.column("sha256").to_pylist() == [digest for *_, digest in wanted.values()] and rounds >= sum(size for _, size, _ in wanted.values()) / 777


def test_hash_on_without_openssl_and_on_a_shorter_file(tmp_path, monkeypatch):
    path = tmp_path / "file"
    path.write_bytes(bytes(range(256)) * 9)
    wanted = hashlib.sha256(path.read_bytes()).hexdigest()
    at, state, digest = digests.hash_on(str(path), 2304, 0, None, 1000)
    assert (at, digest) == (1000, None) and digests.hash_on(str(path), 2304, at, state, 5000) == (2304, None, wanted)
    with pytest.raises(RuntimeError, match="ends at byte 2304"):
        digests.hash_on(str(path), 2305, at, state, 5000)
    monkeypatch.setattr(digests, "openssl", lambda: None)
    assert digests.hash_on(str(path), 2304, 0, None, 1000) == digests.hash_on(str(path), 2304, at, state, 1000) == (2304, None, wanted)


def test_partitions_are_replaced_again_and_after_a_break(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    writes.replace_partitions(rows, path, ["k"])
    new = spark.createDataFrame([("a", 9), ("d", 5)], "k string, v int")
    wanted = [("a", 9), ("b", 3), ("c", 4), ("d", 5)]
    for _ in range(2):
        writes.replace_partitions(new, path, ["k"])
        assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == wanted

    def broken(batches):
        yield next(batches)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        writes.replace_partitions(new.mapInArrow(broken, "k string, v int"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == wanted
    writes.replace_partitions(new, path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == wanted


def test_purge_cascade_again_and_after_a_break(spark, tmp_path):
    parent, child = f"{tmp_path}/parent", f"{tmp_path}/child"
    writes.store(spark.createDataFrame([(n, n % 3) for n in range(40)], "id long, state int"), parent, "id", 8)
    writes.store(spark.createDataFrame([(n % 40, n) for n in range(100)], "parent long, n long"), child, "parent", 8)

    def gone():  # told by the parent, as long as it is there
        return writes.stored(spark, parent, "id").filter("state = 1").select(F.col("id").alias("k"))

    writes.purge(spark, child, "parent", gone(), "k")  # the break: the child is purged, the parent not yet
    assert gone().count() == 13
    for _ in range(2):
        writes.purge_cascade(spark, [(child, "parent")], (parent, "id"), gone(), "k")
    assert sorted(r.id for r in writes.stored(spark, parent, "id").collect()) == [n for n in range(40) if n % 3 != 1]
    assert sorted(r.n for r in writes.stored(spark, child, "parent").collect()) == [n for n in range(100) if n % 40 % 3 != 1]
    every = spark.createDataFrame([(n,) for n in range(-5, 60)], "k long")
    writes.purge_cascade(spark, [(child, "parent")], (parent, "id"), every, "k")
    assert writes.stored(spark, parent, "id").count() == writes.stored(spark, child, "parent").count() == 0


def test_only_wanted_beginnings_become_rows(spark):
    """Words that begin no keyword are not rows of the join; pages of a scope without headings and null texts change nothing."""
    pages = spark.createDataFrame([(1, "a", 0, "other words stand here"), (1, "a", 1, "REPORTS of Methods"), (2, "a", 0, None), (3, "b", 0, "methods")], "id int, scope string, page int, line string")
    heads = spark.createDataFrame([("a", "Methodology reporting")], "scope string, heading string")
    out = search.heading_pages(pages, heads, id_col="id", scope_col="scope", page_col="page", text_col="line")
    assert sorted((r.id, r.page, r.hits, r.found) for r in out.collect()) == [(1, 1, 2, True), (2, None, 0, False)]
    assert "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()
