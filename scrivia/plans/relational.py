"""Queries over records: predicates, joins, aggregations, windows, order and sets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia.functions import records as r
from scrivia.functions import text as x
from scrivia.operators.similarity import rounded
from scrivia.plans.registry import query

ROLES = ("01", "02", "03", "04", "05")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def p1_point_lookup(t):
    return t.orders.filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5 OR (c_name IS NOT NULL AND c_name = 'Customer#000000009')")
def p2_disjunctive_lookup(t):
    c = t.customer
    return c.filter((F.col("c_custkey") == 5) | (F.col("c_name").isNotNull() & (F.col("c_name") == "Customer#000000009"))).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = lower(trim(' HouseHold '))")
def p3_case_insensitive_equality(t):
    return t.customer.filter(F.lower(F.trim("c_mktsegment")) == F.lower(F.trim(F.lit(" HouseHold ")))).select("c_custkey", "c_mktsegment")


def visible(app, role: str, account: int, competitions):
    """Row-level visibility: organisers see their competitions', participants and judges their own, operations all."""
    if role == "01":
        return app.join(competitions, "competition_key", "left_semi")
    if role == "02":
        return app.filter(F.col("participant_id") == account)
    if role == "03":
        return app.filter(F.col("judge_id") == account)
    return app if role == "04" else app.filter(F.lit(False))


@query("""SELECT '01' AS role, count(*) AS n FROM app WHERE competition_key IN (SELECT o_orderpriority FROM orders WHERE o_custkey % 50 = 7)
UNION ALL SELECT '02', count(*) FROM app WHERE participant_id = 7 UNION ALL SELECT '03', count(*) FROM app WHERE judge_id = 7
UNION ALL SELECT '04', count(*) FROM app UNION ALL SELECT '05', count(*) FROM app WHERE false""")
def p4_row_visibility(t):
    own = t.orders.filter("o_custkey % 50 = 7").select(F.col("o_orderpriority").alias("competition_key")).distinct()
    return reduce(lambda a, b: a.unionByName(b), (visible(t.app, r, 7, own).agg(F.count("*").alias("n")).select(F.lit(r).alias("role"), "n") for r in ROLES))


@query("SELECT application_id, status, CASE WHEN status = 'completed' THEN judge_id END AS judge_id, CASE WHEN status = 'completed' THEN amount ELSE 0 END AS amount FROM app")
def p5_participant_view(t):
    done = F.col("status") == "completed"
    return t.app.select("application_id", "status", F.when(done, F.col("judge_id")).alias("judge_id"), F.when(done, F.col("amount")).otherwise(0.0).alias("amount"))


@query("""SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_returnflag || ':', ',' ORDER BY l_linenumber, l_returnflag) AS findings, 0 AS quotes, '' AS report_name, CASE WHEN l_orderkey % 2 = 0 THEN 'review' END AS similarity FROM lineitem GROUP BY 1""")
def p6_redaction(t):
    """Nested evaluations with every text blanked and every quotation emptied; states and verdicts stay."""
    finding = F.struct("l_linenumber", F.col("l_returnflag").alias("verdict"), F.col("l_linestatus").alias("rationale"), F.array(F.lit("quote")).alias("evidence"))
    similarity = F.when(F.col("id") % 2 == 0, F.struct(F.lit("review").alias("level"), F.lit("someone").alias("closest"), F.lit(40).alias("percent")))
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    docs = docs.select("id", F.struct(F.struct(F.lit("rapor.pdf").alias("name")).alias("report"), "findings", similarity.alias("similarity")).alias("e"))
    hidden = r.redacted_evaluation(F.col("e"))
    shown = F.transform(hidden["findings"], lambda f: F.concat_ws(":", f["l_linenumber"].cast("string"), f["verdict"], f["rationale"]))
    quotes = F.aggregate(hidden["findings"], F.lit(0), lambda n, f: n + F.size(f["evidence"]))
    return docs.select("id", F.array_join(shown, ",").alias("findings"), quotes.alias("quotes"), hidden["report"]["name"].alias("report_name"), hidden["similarity"]["level"].alias("similarity"))


@query("SELECT application_id, status FROM app WHERE status = 'submitted' AND judge_id IS NOT NULL AND amount > 0")
def p7_open_predicate(t):
    return t.app.filter("status = 'submitted' and judge_id is not null and amount > 0").select("application_id", "status")


@query("SELECT application_id FROM app WHERE status IN ('submitted', 'judge_in_review') AND competition_key <> '1-URGENT'")
def p8_p9_status_lists(t):
    return t.app.filter(F.col("status").isin("submitted", "judge_in_review") & (F.col("competition_key") != "1-URGENT")).select("application_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red ' || '%'")
def p10_prefix(t):
    return t.part.filter(F.startswith("p_name", F.lit("red "))).select("p_partkey", "p_name")


@query("SELECT application_id FROM app WHERE status = 'completed' AND amount >= 1000 AND judge_id = 4")
def p14_dynamic_conjunction(t):
    wanted = {"status": "completed", "judge_id": 4, "participant_id": None}
    preds = [F.col(c) == v for c, v in wanted.items() if v is not None] + [F.col("amount") >= 1000]
    return t.app.filter(reduce(and_, preds, F.lit(True))).select("application_id")


@query("""SELECT l_orderkey, l_linenumber, l_linenumber < m AS outdated FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = k""")
def p15_outdated_versions(t):
    latest = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("m"))
    return t.lineitem.join(latest, F.col("l_orderkey") == F.col("k")).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") < F.col("m")).alias("outdated"))


@query("SELECT c_custkey, coalesce(c_name, 'customer-' || c_custkey) AS label, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def p17_coalesce(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("c_name", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))).alias("label"), F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM app WHERE judge_id = s_suppkey AND status = 'judge_in_review')")
def p18_j10_exists(t):
    return t.supplier.join(t.app.filter("status = 'judge_in_review'"), F.col("s_suppkey") == F.col("judge_id"), "left_semi").select("s_suppkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name || ' ' || p_type) LIKE '%red%' AND lower(p_name || ' ' || p_type) LIKE '%eco%'")
def p20_p21_token_search(t):
    hay = x.fold(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.filter(F.forall(F.split(F.lit("red eco"), " "), lambda w: F.contains(hay, w))).select("p_partkey", "p_name", "p_type")


@query("SELECT application_id, c_name, s_name, n_name FROM app LEFT JOIN customer ON participant_id = c_custkey LEFT JOIN supplier ON judge_id = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_j3_left_joins(t):
    return t.app.join(t.customer, F.col("participant_id") == F.col("c_custkey"), "left").join(t.supplier, F.col("judge_id") == F.col("s_suppkey"), "left").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("application_id", "c_name", "s_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN app ON l_orderkey = application_id WHERE judge_id = 3")
def j2_members_of_visible(t):
    return t.lineitem.join(t.app.filter("judge_id = 3"), F.col("l_orderkey") == F.col("application_id")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT s_suppkey, s_name, n_name FROM (SELECT s_suppkey, s_name, n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS r FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) WHERE r = 1""")
def j4_distinct_on_name(t):
    first = Window.partitionBy("n_name").orderBy("s_suppkey")
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("r", F.row_number().over(first)).filter("r = 1").select("s_suppkey", "s_name", "n_name")


@query("SELECT application_id, updated_at FROM app WHERE status = 'submitted' AND judge_id IS NULL ORDER BY updated_at, application_id LIMIT 100")
def j5_o4_oldest_queue(t):
    return t.app.filter("status = 'submitted' and judge_id is null").orderBy("updated_at", "application_id").limit(100).select("application_id", "updated_at")


@query("""SELECT a.l_orderkey AS own, b.l_orderkey AS peer, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2""")
def j8_peer_pool(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("own"), "l_partkey", "l_suppkey")
    b = t.lineitem.select(F.col("l_orderkey").alias("peer"), "l_partkey", "l_suppkey")
    return a.join(b, ["l_partkey", "l_suppkey"]).filter("own != peer").groupBy("own", "peer").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT competition_key FROM app WHERE participant_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j9_u3_semi_distinct(t):
    own = t.customer.filter("c_mktsegment = 'MACHINERY'")
    return t.app.join(own, F.col("participant_id") == F.col("c_custkey"), "left_semi").select("competition_key").distinct()


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'REVIZYON' WHEN l.quality = 1 THEN 'BASARILI' ELSE 'KRITIK_HATA' END AS verdict, l.doc_id IS NULL AS evidence_missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j15_finding_per_criterion(t):
    found = t.labels.select(F.col("doc_id").alias("_id"), "quality")
    verdict = F.when(F.col("_id").isNull(), "REVIZYON").when(F.col("quality") == 1, "BASARILI").otherwise("KRITIK_HATA")
    return t.documents.select("doc_id").join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", verdict.alias("verdict"), F.col("_id").isNull().alias("evidence_missing"))


@query("""SELECT coalesce(a.k, b.k) AS nation_key, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def j17_full_outer_merge(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer").select(F.col("k").alias("nation_key"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT s_suppkey, count(application_id) FILTER (status <> 'completed') AS open_n, count(application_id) FILTER (status = 'completed') AS done_n FROM supplier LEFT JOIN app ON judge_id = s_suppkey GROUP BY 1""")
def j19_a7_judge_workload(t):
    n = t.app.groupBy("judge_id").agg(F.count(F.when(F.col("status") != "completed", 1)).alias("o"), F.count(F.when(F.col("status") == "completed", 1)).alias("d"))
    return t.supplier.join(n, F.col("s_suppkey") == F.col("judge_id"), "left").select("s_suppkey", F.coalesce("o", F.lit(0)).alias("open_n"), F.coalesce("d", F.lit(0)).alias("done_n"))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'submitted') AS submitted, count(*) FILTER (status = 'judge_in_review') AS in_review, count(*) FILTER (status = 'completed') AS completed,
CAST(floor(100.0 * count(*) FILTER (status = 'completed') / greatest(count(*), 1) + 0.5) AS BIGINT) AS percent FROM app""")
def a1_status_summary(t):
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return t.app.agg(F.count("*").alias("total"), count("submitted").alias("submitted"), count("judge_in_review").alias("in_review"), count("completed").alias("completed"), rounded(100.0 * count("completed") / F.greatest(F.count("*"), F.lit(1))).alias("percent"))


@query("SELECT o_orderkey, (SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS latest, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def a2_a3_a4_scalar_aggregates(t):
    m = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("latest"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"))
    return t.orders.join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "latest", F.coalesce("returned", F.lit(0)).alias("returned"))


@query("SELECT count(*) = 0 AS may_freeze, count(*) AS unresolved FROM app WHERE status <> 'completed' AND competition_key = '1-URGENT'")
def a5_a6_barrier_count(t):
    return t.app.filter("status != 'completed' and competition_key = '1-URGENT'").agg((F.count("*") == 0).alias("may_freeze"), F.count("*").alias("unresolved"))


@query("""SELECT competition_key, count(*) AS total, count(*) FILTER (judge_id IS NULL) AS unassigned, count(*) FILTER (judge_id IS NOT NULL) AS assigned, count(*) FILTER (status = 'completed') AS completed,
count(DISTINCT participant_id) AS participants, count(DISTINCT judge_id) AS judges, max(updated_at) AS last_update FROM app GROUP BY 1""")
def a8_j18_competition_dashboard(t):
    w = lambda c: F.count(F.when(c, 1))
    return t.app.groupBy("competition_key").agg(F.count("*").alias("total"), w(F.col("judge_id").isNull()).alias("unassigned"), w(F.col("judge_id").isNotNull()).alias("assigned"), w(F.col("status") == "completed").alias("completed"), F.count_distinct("participant_id").alias("participants"), F.count_distinct("judge_id").alias("judges"), F.max("updated_at").alias("last_update"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS uygun, count(*) FILTER (quality = 0) AS olumsuz, count(*) FILTER (quality IS NULL) AS pending, count(*) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def a9_a13_a14_decision_counters(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    w = lambda c: F.count(F.when(c, 1))
    return d.groupBy("lang").agg(w(F.col("quality") == 1).alias("uygun"), w(F.col("quality") == 0).alias("olumsuz"), w(F.col("quality").isNull()).alias("pending"), F.count("*").alias("total"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def a17_a18_distinct_frequency(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(role || ':' || text, ' | ' ORDER BY turn) AS members, count(*) AS n FROM conversations GROUP BY 1")
def a19_ordered_children(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("v"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["v"]), " | ").alias("members"), F.count("*").alias("n"))


@query("""SELECT count(*) AS requests, CAST(floor(avg(value) * 1000 + 0.5) AS BIGINT) AS mean_ms, floor(1000.0 * count(*) FILTER (event_type = 'error') / greatest(count(*), 1) + 0.5) / 10 AS error_rate,
floor(100.0 * count(*) / greatest(count(*) FILTER (event_type <> 'view'), 1) + 0.5) / 100 AS calls FROM events""")
def a20_usage_totals(t):
    w = lambda c: F.count(F.when(c, 1))
    return t.events.agg(F.count("*").alias("requests"), rounded(F.avg("value") * 1000).alias("mean_ms"), (rounded(1000.0 * w(F.col("event_type") == "error") / F.greatest(F.count("*"), F.lit(1))) / 10).alias("error_rate"), (rounded(100.0 * F.count("*") / F.greatest(w(F.col("event_type") != "view"), F.lit(1))) / 100).alias("calls"))


@query("SELECT l_orderkey, sha256(string_agg(f, '␞' ORDER BY f)) AS content_hash FROM (SELECT l_orderkey, l_linenumber || '␟' || l_partkey || '␟' || l_suppkey AS f FROM lineitem) GROUP BY 1")
def a22_order_free_hash(t):
    line = F.concat_ws("␟", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return t.lineitem.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "␞"), 256).alias("content_hash"))


@query("""SELECT l_orderkey, min_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS first_supplier, max_by(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS last_supplier FROM lineitem GROUP BY 1""")
def a25_a26_first_and_latest(t):
    by = F.struct("l_linenumber", "l_suppkey")
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", by).alias("first_supplier"), F.max_by("l_suppkey", by).alias("last_supplier"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a27_child_count(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT application_id, participant_id FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY status = 'completed' DESC, judge_id IS NOT NULL DESC, updated_at DESC, application_id) AS r FROM app) WHERE r = 1")
def w5_best_by_usability(t):
    best = Window.partitionBy("participant_id").orderBy(F.desc(F.col("status") == "completed"), F.desc(F.col("judge_id").isNotNull()), F.desc("updated_at"), "application_id")
    return t.app.withColumn("r", F.row_number().over(best)).filter("r = 1").select("application_id", "participant_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem")
def w1_w4_w7_rank_and_renumber(t):
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(by).alias("position"))


@query("""SELECT user_id, event_id, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type AND lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN 0 ELSE 1 END AS changed FROM events)""")
def w9_version_numbers(t):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.when(F.lag("event_type").over(by).eqNullSafe(F.col("event_type")) & F.lag("event_id").over(by).isNotNull(), 0).otherwise(1)
    return t.events.withColumn("changed", changed).select("user_id", "event_id", F.sum("changed").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("version"))


@query("SELECT user_id, last_used FROM (SELECT user_id, max(ts) AS last_used FROM events GROUP BY 1) ORDER BY last_used DESC, user_id LIMIT 200")
def w10_o13_x4_recent_200(t):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_used")).orderBy(F.desc("last_used"), "user_id").limit(200)


@query("SELECT application_id, status, updated_at FROM app ORDER BY updated_at DESC, application_id LIMIT 60")
def o1_o2_o5_recent(t):
    return t.app.orderBy(F.desc("updated_at"), "application_id").limit(60).select("application_id", "status", "updated_at")


@query("SELECT s_suppkey, coalesce(o, 0) AS open_n, coalesce(c, 0) > 0 AS scoped FROM supplier LEFT JOIN (SELECT judge_id, count(*) FILTER (status <> 'completed') AS o, count(*) FILTER (competition_key = '1-URGENT') AS c FROM app GROUP BY 1) ON s_suppkey = judge_id ORDER BY 2, 3 DESC, s_nationkey, s_suppkey LIMIT 1")
def o7_least_loaded(t):
    """The judge for the next application of a competition: fewest open files, then some file of it, then longest service, then id."""
    n = t.app.groupBy("judge_id").agg(F.count_if(F.col("status") != "completed").alias("o"), F.count_if(F.col("competition_key") == "1-URGENT").alias("c"))
    rows = t.supplier.join(n, F.col("s_suppkey") == F.col("judge_id"), "left").select("s_suppkey", "s_nationkey", F.coalesce("o", F.lit(0)).alias("open_n"), (F.coalesce("c", F.lit(0)) > 0).alias("scoped"))
    return rows.orderBy("open_n", F.desc("scoped"), "s_nationkey", "s_suppkey").limit(1).drop("s_nationkey")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 8 ORDER BY ts, event_id LIMIT 200")
def o6_x8_timeline(t):
    return t.events.filter("user_id = 8").orderBy("ts", "event_id").limit(200).select("event_id", "ts", "event_type")


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def u1_union_distinct(t):
    return t.orders.select(F.col("o_custkey").alias("id")).union(t.customer.select("c_custkey")).distinct()


@query("SELECT 'competition' AS kind, competition_key AS name, max(updated_at) AS at FROM app GROUP BY 2 UNION ALL SELECT 'application', CAST(application_id AS VARCHAR), updated_at FROM app WHERE status = 'completed'")
def u2_o12_archive_trail(t):
    a = t.app.groupBy(F.col("competition_key").alias("name")).agg(F.max("updated_at").alias("at")).select(F.lit("competition").alias("kind"), "name", "at")
    return a.unionByName(t.app.filter("status = 'completed'").select(F.lit("application").alias("kind"), F.col("application_id").cast("string").alias("name"), F.col("updated_at").alias("at")))


@query("SELECT s_suppkey AS id FROM supplier EXCEPT SELECT judge_id FROM app WHERE status = 'submitted'")
def u5_j14_difference(t):
    return t.supplier.select(F.col("s_suppkey").alias("id")).join(t.app.filter("status = 'submitted'"), F.col("id") == F.col("judge_id"), "left_anti").distinct()


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u7_d16_insert_or_ignore(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""SELECT application_id, status, updated_at FROM app WHERE application_id = 7 AND judge_id = 7
    UNION ALL SELECT application_id, status, updated_at FROM app WHERE application_id = 8 AND judge_id = 7""")
def p24_visible_and_id(t):
    own = visible(t.app, "03", 7, None)
    return own.filter(F.col("application_id").isin(7, 8)).select("application_id", "status", "updated_at")


@query("""SELECT 'customer' AS name, count(*) AS n_before, CAST(coalesce(sum(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_after FROM customer
    UNION ALL SELECT 'orders', count(*), CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) FROM orders
    UNION ALL SELECT 'events', count(*), CAST(coalesce(sum(CASE WHEN user_id % 10 <> 3 THEN 1 ELSE 0 END), 0) AS BIGINT) FROM events""")
def a24_counts_around_cleanup(t):
    """Rows of each table before and after a cleanup's predicate, in one scan of each."""
    kept = (("customer", "c_acctbal >= 0"), ("orders", "o_orderstatus != 'F'"), ("events", "user_id % 10 != 3"))
    counts = [getattr(t, name).agg(F.count("*").alias("n_before"), F.count_if(F.expr(rule)).alias("n_after")).select(F.lit(name).alias("name"), "n_before", "n_after") for name, rule in kept]
    return reduce(lambda a, b: a.unionByName(b), counts)
