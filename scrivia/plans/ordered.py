"""Queries over ordered logs: the bounded cache, the rate limit and guarded updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.operators import logs
from scrivia.plans.registry import query

_LRU = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS n, event_id, ts, user_id || '/' || event_type AS k FROM events),
s AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST('' AS VARCHAR) AS k, CAST([] AS VARCHAR[]) AS held, false AS hit, CAST(NULL AS VARCHAR) AS evicted
UNION ALL SELECT e.n, e.event_id, e.ts, e.k, list_prepend(e.k, list_filter(s.held, lambda y: y <> e.k))[:{k.CACHE_ROWS}], list_contains(s.held, e.k), CASE WHEN NOT list_contains(s.held, e.k) THEN s.held[{k.CACHE_ROWS}] END FROM s JOIN e ON e.n = s.n + 1),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY n) AS life FROM s WHERE n > 0),
u AS (SELECT *, row_number() OVER (PARTITION BY k, life ORDER BY n) AS use_count FROM g)
"""


def _accesses(t):
    return t.events.select("event_id", "ts", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("cache_key"))


@query(_LRU + "SELECT event_id, k AS cache_key, hit, use_count, evicted FROM u")
def x4_analysis_cache(t):
    """Every access of a cache of the most recently used analyses: found or not, how often its entry was used so far, and the entry that went for it."""
    found = logs.cache_accesses(_accesses(t), key="cache_key", order=["ts", "event_id"], limit=k.CACHE_ROWS)
    return found.select("event_id", "cache_key", "hit", "use_count", "evicted")


@query(_LRU + f"SELECT k AS cache_key, ts AS last_used, use_count FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM u) WHERE r = 1 ORDER BY last_used DESC, n DESC LIMIT {k.CACHE_ROWS}")
def x4_cache_rows(t):
    """What the cache holds in the end: the entries, when each was last used, and how often since it came in."""
    found = logs.cache_accesses(_accesses(t), key="cache_key", order=["ts", "event_id"], limit=k.CACHE_ROWS)
    last = found.groupBy("cache_key").agg(F.max_by(F.struct("ts", "use_count", "pos"), "pos").alias("l"))
    return last.orderBy(F.desc("l.pos")).limit(k.CACHE_ROWS).select("cache_key", F.col("l.ts").alias("last_used"), "l.use_count")


@query("""WITH RECURSIVE c AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, ts, n, ts AS start, 1 AS used, true AS allowed FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.event_id, c.ts, c.n, CASE WHEN c.ts >= s.start + INTERVAL 1 HOUR THEN c.ts ELSE s.start END, CASE WHEN c.ts >= s.start + INTERVAL 1 HOUR THEN 1 ELSE least(s.used + 1, 2) END, c.ts >= s.start + INTERVAL 1 HOUR OR s.used < 2 FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1)
SELECT user_id, event_id, ts, allowed FROM s""")
def x6_rate_limit(t):
    """Windows of an hour from a client's first request, two requests each."""
    return logs.rate_limited(t.events, client="user_id", ts="ts", tie="event_id", window_s=3600, most=2)


#: Guarded updates of an application's state, as (states that the WHERE names, the state that it sets).
_UPDATES = {
    "analysis_saved": (("submitted", "analysis_failed", "awaiting_judge", "judge_in_review"), "awaiting_judge"),
    "analysis_failed": (("submitted", "analysis_failed", "awaiting_judge", "judge_in_review"), "analysis_failed"),
    "review_saved": (("awaiting_judge", "judge_in_review", "completed"), "judge_in_review"),
    "review_completed": (("awaiting_judge", "judge_in_review", "completed"), "completed"),
    "reupload_requested": (("submitted", "analysis_failed", "awaiting_judge", "judge_in_review"), "submitted"),
}
_WAYS = {(state, name): after for name, (states, after) in _UPDATES.items() for state in states}


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id, [{", ".join(f"'{n}'" for n in _UPDATES)}][CAST(hash_of % 5 AS INTEGER) + 1] AS command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, (event_id * 7919 // 13) % 1000003 AS hash_of FROM events)),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST('' AS VARCHAR) AS command, CAST('' AS VARCHAR) AS before, CAST('submitted' AS VARCHAR) AS after, CAST(0 AS INTEGER) AS changes FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT c.user_id, c.n, c.event_id, c.command, s.after, coalesce(t, s.after), CASE WHEN t IS NULL THEN 0 ELSE 1 END FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1 LEFT JOIN (VALUES {", ".join(f"('{f}', '{c}', '{t}')" for (f, c), t in _WAYS.items())}) w(f, c, t) ON f = s.after AND w.c = c.command)
SELECT user_id AS application, event_id, command, before, after, changes, CASE WHEN changes = 0 THEN 'conflict' END AS error FROM s WHERE n > 0""")
def d4_commands(t):
    """Updates of each application's state in order, each only if the state is still one that its WHERE names; those that change nothing are conflicts and stay as rows."""
    which = F.expr("(event_id * 7919 div 13) % 1000003 % 5 + 1").cast("int")
    commands = t.events.select(F.col("user_id").alias("application"), "ts", "event_id", F.element_at(F.array(*map(F.lit, _UPDATES)), which).alias("command"))
    replayed = logs.guarded_replay(commands, _WAYS, key="application", order=["ts", "event_id"], command="command", ok=F.lit(True), start="submitted")
    return replayed.select("application", "event_id", "command", "before", "after", F.col("accepted").cast("int").alias("changes"), F.when(~F.col("accepted"), "conflict").alias("error"))
