"""The bounded cache, the rate limit and guarded commands against plain loops, in blocks far smaller than a key's log."""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivia.operators import logs
from scrivia.plans.registry import ORACLE_SQL, QUERIES
from scrivia.streaming.lifecycle import stream_rate_limited
from tests.conftest import rows_of, rows_of_sql

TEN = "/root/testdata/sf0.01"
DAY = dt.datetime(2024, 5, 1)


def accesses_loop(keys: list, limit: int) -> list[tuple]:
    held, out = OrderedDict(), []
    for pos, key in enumerate(keys):
        hit, gone = key in held, None
        held[key] = held[key] + 1 if hit else 1
        held.move_to_end(key)
        if len(held) > limit:
            gone = held.popitem(last=False)[0]
        out.append((pos, key, hit, held[key], gone))
    return out


@pytest.mark.parametrize(("limit", "block_rows"), [(1, 7), (5, 3), (5, 16), (40, 8), (200, 64), (3, 5000)])
def test_cache_is_the_loop(spark, limit, block_rows):
    """A key with a third of all accesses, stretches of one key alone that are longer than blocks, and a null key."""
    draw = np.random.default_rng(limit)
    keys = [*draw.integers(0, 60, 500).tolist(), *[7] * 100, *draw.integers(0, 12, 300).tolist(), *[7, 8] * 40]
    keys = [7 if n % 3 == 0 else k for n, k in enumerate(keys)]
    keys = [None if k == 11 else k for k in keys]
    table = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "seq long, key long")
    found = logs.cache_accesses(table, key="key", order=["seq"], limit=limit, block_rows=block_rows).collect()
    assert sorted(((r.pos, r.key, r.hit, r.use_count, r.evicted) for r in found), key=lambda r: r[0]) == accesses_loop(keys, limit)


def test_cache_of_nothing(spark):
    assert logs.cache_accesses(spark.createDataFrame([], "seq long, key string"), key="key", order=["seq"], limit=3).collect() == []


def limited_loop(rows: list, window_s: int, most: int) -> list:
    windows, out = {}, []
    for who, tie, at in sorted(rows, key=lambda r: (r[2], r[1])):
        begin, used = windows.get(who, (None, 0))
        if begin is None or (at - begin).total_seconds() >= window_s:
            begin, used = at, 0
        out.append((who, tie, at, used < most))
        windows[who] = (begin, used + (used < most))
    return out


def requests(seed: int) -> list:
    """Bursts, pauses of many windows, times at a window's very end, and one client with most requests."""
    draw = np.random.default_rng(seed)
    rows, at = [], {None: 0, 1: 0, 2: 0, 3: 0}
    for n in range(900):
        who = 1 if n % 3 else [None, 2, 3][n // 3 % 3]
        at[who] += int(draw.choice([0, 1, 5, 10, 20, 60, 300], p=[0.2, 0.3, 0.2, 0.15, 0.1, 0.04, 0.01]))
        rows.append((who, n, DAY + dt.timedelta(seconds=at[who])))
    return rows


@pytest.mark.parametrize(("window_s", "most"), [(60, 3), (10, 1), (3600, 20)])
def test_rate_limit_is_the_loop(spark, window_s, most):
    rows = requests(window_s)
    table = spark.createDataFrame(rows, "client long, tie long, at timestamp")
    found = logs.rate_limited(table, client="client", ts="at", tie="tie", window_s=window_s, most=most).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == sorted(limited_loop(rows, window_s, most), key=lambda r: r[1])
    plan = logs.rate_limited(table, client="client", ts="at", tie="tie", window_s=window_s, most=most)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rate_limit_of_odd_rows(spark):
    rows = [(1, 1, None), (1, 2, DAY), (None, 3, None), (None, 4, DAY)]
    table = spark.createDataFrame(rows, "client long, tie long, at timestamp")
    found = logs.rate_limited(table, client="client", ts="at", tie="tie", window_s=60, most=1)
    assert {r.tie: r.allowed for r in found.collect()} == {1: False, 2: True, 3: False, 4: True}
    assert logs.rate_limited(table.limit(0), client="client", ts="at", tie="tie", window_s=60, most=1).collect() == []


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = [r for r in sorted(requests(5), key=lambda r: (r[2], r[1])) if r[0] is not None]
    schema = "client long, tie long, at timestamp"
    for n in range(0, len(rows), 200):
        spark.createDataFrame(rows[n : n + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    limited = stream_rate_limited(source, client="client", ts="at", tie="tie", window_s=60, most=3)
    run = limited.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(180)
    batch = logs.rate_limited(spark.createDataFrame(rows, schema), client="client", ts="at", tie="tie", window_s=60, most=3)
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, batch.collect()))


WAYS = {("open", "lock"): "locked", ("locked", "unlock"): "open", ("locked", "close"): "closed", ("open", "touch"): "open", ("closed", "reopen"): "open"}


@pytest.mark.parametrize("block_rows", [2, 5, 64, 4096])
def test_replay_is_the_loop(spark, block_rows):
    draw = np.random.default_rng(block_rows)
    rows = []
    for n in range(700):
        key = None if n % 50 == 0 else "hot" if n % 3 else f"k{n % 11}"
        rows.append((key, n, draw.choice(["lock", "unlock", "close", "touch", "reopen", "unknown"]) if n % 17 else None, bool(draw.random() < 0.8) if n % 13 else None))
    rows = [(k, n, None if c is None else str(c), ok) for k, n, c, ok in rows]
    table = spark.createDataFrame(rows, "key string, seq long, command string, ok boolean")
    found = logs.guarded_replay(table, WAYS, key="key", order=["seq"], command="command", ok=F.col("ok"), start="open", block_rows=block_rows).collect()
    states, wanted = {}, []
    for key, n, command, ok in rows:
        before = states.get(key, "open")
        after = WAYS.get((before, command)) if ok else None
        states[key] = after or before
        wanted.append((key, n, command, ok, before, states[key], after is not None))
    assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted


@pytest.mark.parametrize("name", ["x4_analysis_cache", "x4_cache_rows", "x6_rate_limit", "d4_commands"])
def test_equals_sql_where_the_cache_is_full(name, spark):
    import duckdb

    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{TEN}/events.parquet'")
    found = rows_of(QUERIES[name](spark, TEN))
    assert found == rows_of_sql(duck, ORACLE_SQL[name])
    if name == "x4_analysis_cache":
        place = found[0].index("evicted")
        assert sum(n for row, n in found[1].items() if row[place] is not None) > 1000


def test_guarded_replay_of_one_block_joins_nothing(spark):
    """Rows come out of their own block; where no log is longer than a block, nothing is joined, and the rows are those of many blocks."""
    commands = [c for _, c in WAYS] + [None, "odd"]
    table = spark.createDataFrame([(n % 3, n, commands[n * 7 % len(commands)], n % 5 > 0) for n in range(60)], "key int, seq int, command string, ok boolean")
    replay = lambda rows: logs.guarded_replay(table, WAYS, key="key", order=["seq"], command="command", ok=F.col("ok"), start="open", block_rows=rows)
    whole = replay(256)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, replay(4).collect()))
