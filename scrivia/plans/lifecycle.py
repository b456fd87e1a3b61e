"""Queries over state: upserts, versions, current rows, transitions and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.operators import evaluation, rules
from scrivia.plans.registry import query


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL
SELECT l_orderkey, l_linestatus FROM (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def d1_upsert(t):
    new = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    order = [F.desc("l_shipdate"), F.desc("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return rules.upsert(t.orders.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"], order)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND l_orderkey IS NOT NULL THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def d2_d4_guarded_update(t):
    hit = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    state = F.when(F.col("o_orderstatus").isin("O", "P") & F.col("l_orderkey").isNotNull(), "X").otherwise(F.col("o_orderstatus"))
    return t.orders.join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", state.alias("o_orderstatus"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT c_custkey, 'MOVED' FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def d3_replace_partition(t):
    c = t.customer.select("c_nationkey", "c_custkey", "c_mktsegment")
    moved = c.join(F.broadcast(t.nation.filter("n_regionkey = 1")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").withColumn("c_mktsegment", F.lit("MOVED"))
    return rules.replace_partition(c, moved, ["c_nationkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'deleted' ELSE 'active' END AS state FROM supplier")
def d6_d7_soft_delete(t):
    return t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") < 0, "deleted").otherwise("active").alias("state"))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def d8_immutable_versions(t):
    return rules.append_versions(t.events.select("user_id", "event_id", "ts", "event_type"), key="user_id", order=["ts", "event_id"], content=F.col("event_type")).select("user_id", "event_id", F.col("version").cast("long").alias("version"))


@query("SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def d11_current_rows(t):
    return rules.current_rows(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), key="o_custkey", order=["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "valid_from", "valid_to", "active")


@query("SELECT event_id, substr(props, 1, 6) AS detail FROM events")
def d12_truncated_log(t):
    return t.events.select("event_id", F.substring("props", 1, 6).alias("detail"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR >= (SELECT max(ts) FROM events)")
def d13_session_expiry(t):
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.join(F.broadcast(t.events.agg(F.max("ts").alias("now"))), F.expr("last_seen + interval 1 hour >= now")).select("user_id", "last_seen")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'HOUSEHOLD' WHEN 'HOUSEHOLD' THEN 'MACHINERY' ELSE c_mktsegment END AS segment FROM customer")
def d14_simultaneous_swap(t):
    s = F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.when(s == "MACHINERY", "HOUSEHOLD").when(s == "HOUSEHOLD", "MACHINERY").otherwise(s).alias("segment"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def d15_cascaded_purge(t):
    return t.lineitem.join(t.orders.filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS rejected FROM customer")
def d17_uniqueness_checks(t):
    taken = t.orders.select("o_custkey").distinct()
    return t.customer.join(taken, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("rejected"))


_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, own in k.COMPETITION_TRANSITIONS.items() for b in own) + ") tr(f, t)"
_LOCKED = "('decisions_frozen', 'results_published', 'archived')"


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id, [{", ".join(f"'{n}'" for n in k.COMPETITION_TRANSITIONS)}][row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 9 + 1] AS target, event_id % 3 AS unresolved, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST('' AS VARCHAR) AS target, CAST('' AS VARCHAR) AS before, CAST('draft_criteria' AS VARCHAR) AS after, false AS accepted FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT c.user_id, c.n, c.event_id, c.target, s.after, CASE WHEN f IS NOT NULL AND NOT (c.target = 'decisions_frozen' AND unresolved > 0) THEN c.target ELSE s.after END, f IS NOT NULL AND NOT (c.target = 'decisions_frozen' AND unresolved > 0) FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1 LEFT JOIN {_PAIRS} ON f = s.after AND t = c.target)
SELECT user_id AS competition, seq, target, before, after, accepted, after IN {_LOCKED} AS locked FROM s WHERE n > 0""")
def x1_competition_stages(t):
    """Each user's events as stage commands, replayed in order against the transition table; freezing waits until no application is open."""
    names = F.array(*map(F.lit, k.COMPETITION_TRANSITIONS))
    target = F.element_at(names, (F.pmod(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(9)) + 1).cast("int"))
    return rules.replay_stages(t.events.select(F.col("user_id").alias("competition"), F.col("event_id").alias("seq"), target.alias("target"), (F.col("event_id") % 3).alias("unresolved")))


@query()
def x6_guarded_requests(t):
    """Every user's own server, kinds of events as its clients, with windows for a client and for all, and places at once; tested against a loop. The cap on all is a fold in order, so a server's log is one group."""
    rows = t.events.select(F.col("user_id").alias("server"), F.col("event_type").alias("client"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "view", "release").otherwise("acquire").alias("kind"))
    return evaluation.guarded_requests(rows, server="server", client="client", seq="seq", ts="ts", kind="kind", window_s=86_400, most=3, most_all=20, at_once=2)


@query("""WITH i AS (SELECT l_orderkey, list({'a': [l_partkey], 'b': [l_suppkey], 'o': [place]} ORDER BY place) AS items FROM (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place FROM lineitem) GROUP BY 1),
o AS (SELECT l_orderkey, list_reduce(items, lambda acc, y: CASE WHEN list_has_any(acc.a, y.a) OR list_has_any(acc.b, y.b) THEN acc ELSE {'a': list_concat(acc.a, y.a), 'b': list_concat(acc.b, y.b), 'o': list_concat(acc.o, y.o)} END) AS k FROM i)
SELECT l_orderkey, unnest(k.a) AS l_partkey, unnest(k.b) AS l_suppkey, unnest(k.o) AS place FROM o""")
def w8_two_key_dedup(t):
    """Lines of an order kept unless part or supplier is that of a line kept before."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("place"))
    return rules.keep_first_of_two_keys(rows, group="l_orderkey", order="place", first="l_partkey", second="l_suppkey")
