"""Queries over document checks, reviews, search, report comparison and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivia.functions import text as x
from scrivia.functions import vectors as v
from scrivia.operators import checks as c
from scrivia.operators import similarity as s
from scrivia.plans.registry import query
from scrivia.streaming.lifecycle import APPLICATION_COMMANDS, replay_applications

_FILES = "(SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '.docx' WHEN doc_id % 7 = 0 THEN '' ELSE '.pdf' END AS name, n_chars * 8000 AS size, doc_id % 5 AS existing FROM documents)"


@query(f"""SELECT doc_id, 'engine-format' AS id, CASE WHEN name LIKE '%.pdf' THEN 'passed' ELSE 'failed' END AS status FROM {_FILES}
UNION ALL SELECT doc_id, 'engine-size', CASE WHEN size / 1048576.0 <= 50 THEN 'passed' ELSE 'failed' END FROM {_FILES}
UNION ALL SELECT doc_id, 'gate-format', CASE WHEN name LIKE '%.pdf' THEN 'passed' ELSE 'warning' END FROM {_FILES}
UNION ALL SELECT doc_id, 'gate-size', CASE WHEN size / 1048576.0 <= 20 THEN 'passed' ELSE 'warning' END FROM {_FILES}
UNION ALL SELECT doc_id, 'gate-count', CASE WHEN existing + 1 <= 3 THEN 'passed' ELSE 'warning' END FROM {_FILES}""")
def t8_f21_file_gate(t):
    end = F.when(F.col("doc_id") % 3 == 0, ".docx").when(F.col("doc_id") % 7 == 0, "").otherwise(".pdf")
    files = t.documents.select("doc_id", F.concat("source", end).alias("name"), (F.col("n_chars") * 8000).alias("size"), (F.col("doc_id") % 5).alias("existing"))
    gate = c.file_gate(F.col("name"), F.col("size"), formats=("pdf",), max_mb=20, max_files=3, existing=F.col("existing"), on_violation="warning")
    return files.select("doc_id", F.inline(gate))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber % 4 AS st, l_quantity, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS r, l_linestatus = 'F' AS required FROM lineitem),
g AS (SELECT id, st, max(r) AS r, bool_or(required) AS strict FROM l GROUP BY 1, 2)
SELECT e.id, 's' || e.st AS stage, CASE WHEN r = 2 AND strict THEN 'KRITIK_HATA' WHEN r >= 1 THEN 'REVIZYON' ELSE 'BASARILI' END AS verdict
FROM (SELECT DISTINCT id, s.st FROM l, (VALUES (0), (1), (2), (3)) s(st)) e LEFT JOIN g ON e.id = g.id AND e.st = g.st""")
def a11_f29_stage_verdicts(t):
    verdict = F.when(F.col("l_returnflag") == "R", "KRITIK_HATA").when(F.col("l_returnflag") == "A", "REVIZYON").otherwise("BASARILI")
    stage = F.concat(F.lit("s"), (F.col("l_linenumber") % 4).cast("string"))
    findings = t.lineitem.select(F.col("l_orderkey").alias("id"), stage.alias("stage"), verdict.alias("verdict"), (F.col("l_linestatus") == "F").alias("required"))
    return c.stage_verdicts(findings, ("s0", "s1", "s2", "s3"), id_col="id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_type || ':' || event_id AS line, CASE event_type WHEN 'view' THEN 's' ELSE 'i' END AS side FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY event_id) AS n FROM e)
SELECT user_id, coalesce(string_agg(line, '|' ORDER BY n) FILTER (side = 's' AND n <= 6), '') AS strengths, coalesce(string_agg(line, '|' ORDER BY n) FILTER (side = 'i' AND n <= 8), '') AS improvements,
coalesce(string_agg(CASE event_type WHEN 'error' THEN '“e' || event_id || '” zorunlu kuralı için şartnamedeki koşulu karşılayan, kanıtlanabilir bir bölüm ekleyin.' ELSE '“e' || event_id || '” bölümündeki eksik kanıtları ölçüm, tablo veya doğrulama sonucu ile tamamlayın.' END, '|' ORDER BY n) FILTER (side = 'i' AND n <= 6), '') AS suggestions FROM r GROUP BY 1""")
def t14_feedback(t):
    verdict = F.when(F.col("event_type") == "view", "BASARILI").when(F.col("event_type") == "error", "KRITIK_HATA").otherwise("REVIZYON")
    rows = t.events.select("user_id", "event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("line"), verdict.alias("verdict"))
    return c.feedback(rows, id_col="user_id", order="event_id").select("user_id", *(F.array_join(n, "|").alias(n) for n in ("strengths", "improvements", "suggestions")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN '' WHEN o_orderkey % 3 = 0 THEN 'result' WHEN o_orderkey % 5 = 0 THEN 'reason' WHEN o_orderkey % 7 = 0 THEN 'mode'
WHEN o_orderkey % 2 = 0 AND o_orderkey % 11 = 0 THEN 'page' WHEN o_orderkey % 2 = 1 AND o_orderkey % 13 = 0 THEN 'missing' ELSE '' END AS error FROM orders""")
def t16_decision_validation(t):
    n = F.col("o_orderkey")
    judge = F.when(n % 4 == 0, "pending").when(n % 4 == 1, "approved").otherwise("rejected")
    mode = F.when(n % 7 != 0, F.when(n % 2 == 0, "PDF_KONUMU").otherwise("RAPORDA_BULUNAMADI"))
    error = c.decision_error(judge, F.when(n % 3 != 0, "UYGUN"), F.when(n % 5 == 0, "  ").otherwise("because"), mode, F.when(n % 11 != 0, 4), F.lit("quote"), F.when(n % 13 != 0, "part"))
    return t.orders.select("o_orderkey", error.alias("error"))


@query("""SELECT p_partkey, p_name, rank, total FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY rank, p_partkey) AS n FROM
(SELECT p_partkey, p_name, CASE WHEN starts_with(lower(p_name), 're') THEN 0 WHEN regexp_matches(lower(p_name), '(^|\\s)re') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name) || ' ' || lower(p_type), 're'))) WHERE n <= 20""")
def t18_o8_ranked_search(t):
    """A top-k report: twenty entries and how many there are."""
    return c.ranked_search(t.part, " RE ", name_col="p_name", field_col="p_type", order="p_partkey", limit=20).select("p_partkey", "p_name", "rank", "total")


@query()
def t5_t6_w2_w3_o11_report_similarity(t):
    """The reports whose id is divisible by 100 against all others of their language; in SQL too slow, compared with all pairs in the tests."""
    found = s.report_similarity(t.documents, F.col("doc_id") % 100 == 0)
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["kind"], m["own_idx"].cast("string"), m["peer_idx"].cast("string"), F.sha2(F.concat(m["own_quote"], m["peer_quote"]), 256))), ",")
    return found.select("own_id", "compared", "peer_id", "percent", "level", shown.alias("matches"))


@query("""WITH n AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
w AS (SELECT vec_id, i, sum(CAST(e AS DOUBLE)) OVER (PARTITION BY i ORDER BY vec_id RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM n), c AS (SELECT vec_id, vec_id // 2000 AS scope, list(s ORDER BY i) AS v FROM w GROUP BY vec_id),
p AS (SELECT a.vec_id AS own, b.vec_id AS peer, list_cosine_similarity(a.v, b.v) AS c FROM c a JOIN c b ON a.scope = b.scope AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT own, peer, CAST(CASE WHEN c >= 0.9 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS strength FROM p WHERE c >= 0.82""")
def j12_semantic_chunk_matches(t):
    """Chunks of ten sentences' vectors, one begun at each sentence, without a lexical trace: pairs of a scope that their meaning makes a match. Queries are the ids divisible by 100."""
    parts = t.embeddings.select(F.explode(F.sequence(F.col("vec_id") - 9, F.col("vec_id"))).alias("id"), F.struct("vec_id", "embedding").alias("s"))
    ten = parts.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.min("s.vec_id").alias("first")).filter("id = first")
    none = F.transform(F.element_at("s", 1)["embedding"], lambda x: F.lit(0.0))
    total = F.aggregate("s", none, lambda acc, s: F.zip_with(acc, s["embedding"], lambda a, b: a + b.cast("double")))
    rows = ten.select(F.floor(F.col("id") / 2000).alias("scope"), "id", total.alias("emb"))
    own = rows.filter("id % 100 = 0").select("scope", F.col("id").alias("own_id"), F.lit(0).alias("own_idx"), F.array(F.lit(1)).alias("sig"), "emb")
    peers = rows.select("scope", F.col("id").alias("peer_id"), F.lit(0).alias("peer_idx"), F.array(F.lit(2)).alias("psig"), F.col("emb").alias("pemb"))
    return s.best_chunk_matches(s.chunk_scores(own, peers, semantic=True)).select(F.col("own_id").alias("own"), F.col("peer_id").alias("peer"), "strength")


_TAKES = "(VALUES " + ", ".join(f"('{c}', '{s or ''}', '{after}')" for c, (states, after) in APPLICATION_COMMANDS.items() for s in states) + ") tr(c, f, t)"


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id, [{", ".join(f"'{n}'" for n in APPLICATION_COMMANDS)}][event_id % {len(APPLICATION_COMMANDS)} + 1] AS command, event_id % 10 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST('' AS VARCHAR) AS command, CAST('' AS VARCHAR) AS before, CAST('' AS VARCHAR) AS after, false AS accepted FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT c.user_id, c.n, c.event_id, c.command, s.after, CASE WHEN ok AND t IS NOT NULL THEN t ELSE s.after END, ok AND t IS NOT NULL FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1 LEFT JOIN {_TAKES} ON tr.c = c.command AND f = s.after)
SELECT user_id AS application, seq, command, nullif(before, '') AS before, nullif(after, '') AS after, accepted FROM s WHERE n > 0""")
def x2_application_states(t):
    """Each user's events as commands, replayed against the transition table."""
    names = F.array(*map(F.lit, APPLICATION_COMMANDS))
    command = F.element_at(names, (F.pmod("event_id", F.lit(len(APPLICATION_COMMANDS))) + 1).cast("int"))
    return replay_applications(t.events.select(F.col("user_id").alias("application"), F.col("event_id").alias("seq"), command.alias("command"), (F.col("event_id") % 10 != 0).alias("ok")))


@query("""WITH app AS (SELECT o_orderkey AS application_id, o_orderpriority AS competition_key, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 3 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY competition_key ORDER BY updated_at, application_id) AS n FROM app), m AS (SELECT competition_key, max(n) AS most FROM q GROUP BY 1),
j AS (SELECT s_suppkey AS judge, s_suppkey % 4 AS load, s_suppkey % 3 AS scoped, s_nationkey AS since FROM supplier), d AS (SELECT min(load) AS base, count(*) AS c, max(load) AS top FROM j),
s AS (SELECT competition_key, judge, row_number() OVER (PARTITION BY competition_key ORDER BY level, load < level OR scoped > 0 DESC, since, judge) AS n FROM (SELECT m.competition_key, j.*, unnest(range(load, top + 2 + CAST(ceil(most / c) AS BIGINT))) AS level FROM m, d, j))
SELECT q.competition_key, application_id, updated_at, judge FROM q JOIN s ON q.competition_key = s.competition_key AND q.n = s.n""")
def x3_least_loaded_assignment(t):
    """Unassigned applications of each competition to all suppliers as judges, their load by key."""
    judges = t.supplier.select(F.col("s_suppkey").alias("judge"), (F.col("s_suppkey") % 4).alias("load"), (F.col("s_suppkey") % 3).alias("scoped"), F.col("s_nationkey").alias("since"))
    return c.least_loaded(t.app.filter("judge_id is null").select("competition_key", "application_id", "updated_at"), judges, key="competition_key", order=["updated_at", "application_id"])
