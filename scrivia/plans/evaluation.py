"""Queries over evaluations: pages, criteria, findings, decisions, dashboards, profiles, contexts, guards and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.functions import records as r
from scrivia.functions import text as x
from scrivia.functions import vectors as v
from scrivia.operators import evaluation as e
from scrivia.operators import rules
from scrivia.plans.registry import APP, query
from scrivia.plans.scalars import LIMIT_SQL, tr_lower_sql
from scrivia.sources.views import ACCOUNTS, CRITERIA, FINDINGS, View, pick, quoted

_RANK = "CASE {} WHEN 'KRITIK_HATA' THEN 2 WHEN 'REVIZYON' THEN 1 WHEN 'BASARILI' THEN 0 ELSE -1 END"
_NAME = "CASE {} WHEN 2 THEN 'KRITIK_HATA' WHEN 1 THEN 'REVIZYON' ELSE 'BASARILI' END"

_PAGES = View("conversations", report="conv_id", page="turn", text="concat('Yarışma Raporu (2026)', chr(10), chr(10), 'Ekip  Ufuk: ', role, chr(10), 'Sayfa ', CAST(turn + 1 AS STRING), ' / 9', chr(10), text, chr(10), ' ', CAST(turn AS STRING))")


@query(rf"""WITH p AS (SELECT report, page, string_split_regex(regexp_replace(regexp_replace(text, 'ekip  ufuk', ' ', 'gi'), 'yarışma raporu \(2026\)', ' ', 'gi'), '\n+') AS w FROM {_PAGES.sql}),
l AS (SELECT report, page, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM p),
f AS (SELECT *, CASE WHEN length(trim(line)) <= 120 THEN nullif(trim(regexp_replace(translate(lower(translate(trim(line), 'Iİ', 'ıi')), '{k.ACCENTED}ğşı', '{k.PLAIN}gsi'), '[^a-z0-9]+', ' ', 'g')), '') END AS key FROM l),
n AS (SELECT report, count(*) AS pages FROM p GROUP BY 1), s AS (SELECT report, key FROM f JOIN n USING (report) WHERE key IS NOT NULL GROUP BY report, key, pages HAVING count(DISTINCT page) >= greatest(3, ceil(0.6 * pages))),
kept AS (SELECT f.* FROM f LEFT JOIN s ON f.report = s.report AND f.key = s.key WHERE s.key IS NULL AND trim(line) <> '' AND NOT regexp_matches(trim(line), '(?i)^(sayfa\s*)?\d{{1,4}}(\s*[/-]\s*\d{{1,4}})?$'))
SELECT p.report, p.page, coalesce(t, '') AS text FROM p LEFT JOIN (SELECT report, page, trim(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '[ \t]+', ' ', 'g')) AS t FROM kept GROUP BY 1, 2) q ON p.report = q.report AND p.page = q.page""")
def t1_a18_f14_f15_normalize_pages(t):
    """Turns of a conversation as pages of a report, with a header, a team line and page numbers."""
    names = F.array(F.lit("Yarışma raporu (2026)"), F.lit("ekip  ufuk"), F.lit("abc"))
    return e.normalize_pages(_PAGES.of(t).withColumn("names", names), id_col="report", page_col="page", text_col="text", names_col="names")


@query(r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))""")
def s2_pages(t):
    """Lines of a text as its pages, white space collapsed, numbered from 1."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "_t")).select("doc_id", (F.col("_p") + 1).alias("page"), r.flat(F.col("_t")).alias("text"))


_REPORTS = View("part", profile="CAST(floor(p_partkey / 40) AS BIGINT)", first="p_partkey % 40 = 0", page_count="CAST(floor(p_partkey / 40) AS BIGINT) * 7 % 9", mismatch="CAST(floor(p_partkey / 40) AS BIGINT) % 3 = 0", missing_headings="CAST(floor(p_partkey / 40) AS BIGINT) % 2")
_REPORT_SQL = f"(SELECT DISTINCT profile, page_count, mismatch, missing_headings FROM {_REPORTS.sql})"


def _reports(t):
    return _REPORTS.of(t).select("profile", "page_count", "mismatch", "missing_headings").distinct()


@query(f"""WITH l AS (SELECT profile, {LIMIT_SQL} AS lim FROM {CRITERIA.sql} WHERE active AND stage = 'language_template'), g AS (SELECT l.profile, count(lim) AS limits, count(*) FILTER (page_count > lim) AS violated FROM l JOIN {_REPORT_SQL} p ON l.profile = p.profile GROUP BY 1)
SELECT p.profile, CASE WHEN limits IS NULL THEN 'skipped' WHEN limits = 0 THEN 'warning' WHEN violated > 0 THEN 'flagged' ELSE 'passed' END AS status, coalesce(limits, 0) AS limits, coalesce(violated, 0) AS violated FROM {_REPORT_SQL} p LEFT JOIN g ON p.profile = g.profile""")
def t10_template_check(t):
    return e.template_check(CRITERIA.of(t), _reports(t))


_RAW = View(
    "lineitem", profile="CAST(floor(l_orderkey / 4) AS BIGINT)", a="l_orderkey", b="l_linenumber", c="l_partkey", d="l_suppkey", name="CASE WHEN l_partkey % 29 = 0 THEN '  ' ELSE concat('Kural  ', CAST(l_partkey % 3 AS STRING)) END", quote="CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE concat('Alıntı ', CAST(l_suppkey % 2 AS STRING)) END",
    stage=pick("l_partkey", *quoted("headings_content", "criteria_evidence", "odd", None)), page="CASE WHEN l_partkey % 7 > 0 THEN l_quantity / 4 END", required="l_linestatus = 'F'",
)
_JUDGED = f"""WITH raw AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY a, b, c, d, page) AS pos FROM {_RAW.sql}),
c AS (SELECT profile, pos, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, quote, CASE WHEN stage IN ('language_template', 'headings_content', 'category_similarity', 'criteria_evidence') THEN stage ELSE 'criteria_evidence' END AS stage, CAST(floor(page + 0.5) AS BIGINT) AS page, required FROM raw),
v AS (SELECT *, CASE WHEN name = '' OR quote = '' THEN 'dropped' WHEN page IS NULL OR page NOT BETWEEN 1 AND 10 THEN 'no_page' END AS fate FROM c),
i AS (SELECT profile, list({{'k': [stage || name || 'p' || page, stage || name || 't' || quote], 'o': [pos]}} ORDER BY pos) AS items FROM v WHERE fate IS NULL GROUP BY 1),
o AS (SELECT profile, list_reduce(list_prepend({{'k': CAST([] AS VARCHAR[]), 'o': CAST([] AS BIGINT[])}}, items), lambda acc, y: CASE WHEN list_has_any(acc.k, y.k) THEN acc ELSE {{'k': list_concat(acc.k, y.k), 'o': list_concat(acc.o, y.o)}} END).o AS keep FROM i),
j AS (SELECT v.*, coalesce(fate, CASE WHEN list_contains(keep, pos) THEN CASE WHEN list_position(keep, pos) > 400 THEN 'dropped' ELSE 'kept' END ELSE 'duplicate' END) AS last FROM v LEFT JOIN o USING (profile))"""


def _numbered(t):
    pos = F.row_number().over(Window.partitionBy("profile").orderBy("a", "b", "c", "d", "page"))
    return _RAW.of(t).withColumn("pos", pos)


@query(_JUDGED + """ SELECT profile, 'criterion-' || row_number() OVER (PARTITION BY profile ORDER BY CASE stage WHEN 'headings_content' THEN 2 ELSE 4 END, page, pos) AS id, name, stage, page, required FROM j WHERE last = 'kept'""")
def t11_w8_w7_w13_extracted_criteria(t):
    return e.extracted_criteria(e.judged_criteria(_numbered(t), pages=10))


@query(_JUDGED + " SELECT profile, count(*) FILTER (last = 'no_page') AS no_page, count(*) FILTER (last = 'duplicate') AS duplicates, count(*) FILTER (last = 'dropped') AS dropped FROM j GROUP BY 1")
def t11_extraction_warnings(t):
    return e.extraction_warnings(_numbered(t), pages=10)


_MODEL = View("part", profile="CAST(floor(p_partkey / 40) AS BIGINT)", id="concat('criterion-', CAST(p_partkey AS STRING))", there="p_partkey % 9 > 0", verdict=pick("p_size", *quoted("BASARILI", "REVIZYON", "KRITIK_HATA", "ODD", "BASARILI")), evidence="p_size % 3")
_FOUND = f"""WITH c AS (SELECT c.*, page_count, CASE WHEN stage = 'language_template' THEN {LIMIT_SQL} END AS lim FROM {CRITERIA.sql} c JOIN {_REPORT_SQL} p USING (profile) WHERE active),
f AS (SELECT c.profile, c.id, stage, required, CASE WHEN page_count > lim THEN CASE WHEN required THEN 'KRITIK_HATA' ELSE 'REVIZYON' END WHEN m.verdict = 'KRITIK_HATA' AND NOT required THEN 'REVIZYON' WHEN m.verdict IN ('BASARILI', 'REVIZYON', 'KRITIK_HATA') THEN m.verdict ELSE 'REVIZYON' END AS verdict,
lim IS NULL AND coalesce(m.evidence, 0) = 0 AS evidence_missing, m.id IS NULL AS model_silent FROM c LEFT JOIN (SELECT * FROM {_MODEL.sql} WHERE there) m ON c.profile = m.profile AND c.id = m.id WHERE coalesce(c.verifiability = 'PDF_DENETLENEBILIR', true)),
off AS (SELECT profile, id, stage, required, CASE WHEN verifiability <> 'PDF_DENETLENEBILIR' THEN 'DEGERLENDIRILEMEDI' WHEN lim IS NULL THEN 'REVIZYON' WHEN page_count <= lim THEN 'BASARILI' WHEN required THEN 'KRITIK_HATA' ELSE 'REVIZYON' END AS verdict FROM c)"""


def _findings(t):
    return e.findings_of(CRITERIA.of(t), _MODEL.of(t).filter("there"), _reports(t))


@query(_FOUND + " SELECT * FROM f")
def t12_j15_p13_f44_findings(t):
    return _findings(t)


def _assembled(source: str) -> str:
    worst = ", ".join(f"greatest(0, coalesce(max({_RANK.format('verdict')}) FILTER (stage = '{s}'), 0)) AS w{n}, coalesce(bool_or(required AND verdict <> 'DEGERLENDIRILEMEDI') FILTER (stage = '{s}'), false) AS s{n}" for n, s in enumerate(k.STAGES))
    lifts = ("CASE WHEN mismatch THEN 1 ELSE 0 END", "CASE WHEN missing_headings > 0 THEN 1 ELSE 0 END", "0", "0")
    capped = ", ".join(f"CASE WHEN greatest(coalesce(w{n}, 0), {lift}) = 2 AND NOT coalesce(s{n}, false) THEN 1 ELSE greatest(coalesce(w{n}, 0), {lift}) END AS c{n}" for n, lift in enumerate(lifts))
    count = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {n}" for v, n in (("BASARILI", "basarili"), ("REVIZYON", "revizyon"), ("KRITIK_HATA", "kritik"), ("DEGERLENDIRILEMEDI", "dis_kanit")))
    return f"""{_FOUND}, g AS (SELECT profile, count(*) AS total, {count}, max({_RANK.format('verdict')}) AS worst, {worst} FROM {source} GROUP BY 1), h AS (SELECT p.profile, total, basarili, revizyon, kritik, dis_kanit, worst, {capped} FROM {_REPORT_SQL} p LEFT JOIN g USING (profile))
SELECT profile, coalesce(total, 0) AS total, coalesce(basarili, 0) AS basarili, coalesce(revizyon, 0) AS revizyon, coalesce(kritik, 0) AS kritik, coalesce(dis_kanit, 0) AS dis_kanit, {", ".join(f"{_NAME.format(f'c{n}')} AS {s}" for n, s in enumerate(k.STAGES))}, {_NAME.format('greatest(c0, c1, c2, c3, coalesce(worst, 0), 0)')} AS overall FROM h"""


@query(_assembled("f"))
def t12_f30_f45_evaluation(t):
    return e.evaluated(_findings(t), _reports(t))


@query(_assembled("off"))
def t13_offline_evaluation(t):
    return e.evaluated(e.offline_findings(CRITERIA.of(t), _reports(t)), _reports(t))


@query(f"""SELECT report, count(*) || ' kural kontrol edildi: ' || count(*) FILTER (verdict = 'BASARILI') || ' BAŞARILI, ' || count(*) FILTER (verdict = 'REVIZYON') || ' REVİZYON, ' || count(*) FILTER (verdict = 'KRITIK_HATA') || ' KRİTİK HATA'
|| CASE WHEN count(*) FILTER (verdict = 'DEGERLENDIRILEMEDI') > 0 THEN ', ' || count(*) FILTER (verdict = 'DEGERLENDIRILEMEDI') || ' kural PDF dışı kanıt gerektiriyor' ELSE '' END || '.' AS summary FROM {FINDINGS.sql} GROUP BY 1""")
def f46_stage_summary(t):
    n = FINDINGS.of(t).groupBy("report").agg(*rules.verdict_counts(F.col("verdict")))
    return n.select("report", e.stage_summary(F.col("total"), F.col("basarili"), F.col("revizyon"), F.col("kritik"), F.col("dis_kanit"), k.STAGE_TITLES[0]).alias("summary"))


_DECIDED = View("lineitem", report="l_orderkey", criterion=FINDINGS.columns["criterion"], judge="CASE WHEN l_partkey % 4 = 0 THEN 'odd' ELSE " + FINDINGS.columns["judge"] + " END", **{c: FINDINGS.columns[c] for c in ("judge_result", "reason", "mode", "page", "section", "quote", "missing")})
_RESTORED = f"""WITH r AS (SELECT f.report, f.criterion, f.name, f.verdict, f.rationale, CASE WHEN d.judge IN ('approved', 'rejected') THEN d.judge ELSE 'pending' END AS judge, d.judge_result, d.reason, d.mode, d.page, d.section, d.quote, d.missing, CASE WHEN f.verdict = 'BASARILI' THEN 'UYGUN' ELSE 'OLUMSUZ' END AS ai
FROM (SELECT * FROM {FINDINGS.sql} WHERE verdict <> 'DEGERLENDIRILEMEDI') f LEFT JOIN (SELECT DISTINCT * FROM {_DECIDED.sql} WHERE criterion % 3 > 0) d ON f.report = d.report AND f.criterion = d.criterion),
e AS (SELECT *, CASE judge WHEN 'approved' THEN ai WHEN 'rejected' THEN judge_result END AS effective FROM r),
l AS (SELECT *, CASE WHEN judge = 'rejected' THEN name || ' — ' || trim(reason) || CASE WHEN mode = 'PDF_KONUMU' AND page > 0 THEN ' (rapor s. ' || page || CASE WHEN section <> '' THEN ' · ' || section ELSE '' END || ')' ELSE '' END || CASE WHEN mode = 'PDF_KONUMU' AND quote <> '' THEN ' “' || quote || '”' ELSE '' END
|| CASE WHEN mode = 'RAPORDA_BULUNAMADI' THEN ' (Raporda bulunamadı: ' || missing || ')' ELSE '' END ELSE name || ' — ' || rationale || CASE WHEN page > 0 THEN ' (rapor s. ' || page || CASE WHEN section <> '' THEN ' · ' || section ELSE '' END || ')' ELSE '' END || CASE WHEN quote <> '' THEN ' “' || quote || '”' ELSE '' END END AS line FROM e)"""


def _restored(t):
    return e.restored_decisions(FINDINGS.of(t), _DECIDED.of(t).filter("criterion % 3 > 0").distinct())


@query(_RESTORED + """ SELECT report, coalesce(string_agg('✓ ' || name, '|' ORDER BY criterion, name) FILTER (effective = 'UYGUN'), '') AS strengths, coalesce(string_agg('✕ ' || line, '|' ORDER BY criterion, line) FILTER (effective = 'OLUMSUZ'), '') AS improvements, count(*) FILTER (effective IS NULL) AS pending FROM l GROUP BY 1""")
def t15_j16_p12_judge_feedback(t):
    f = e.judge_feedback(_restored(t))
    return f.select("report", F.array_join("strengths", "|").alias("strengths"), F.array_join("improvements", "|").alias("improvements"), "pending")


@query(_RESTORED + """ SELECT report, criterion, 'judge_score_adjusted' AS event, name || ' · AI bulgusu (' || CASE ai WHEN 'UYGUN' THEN 'Uygun' ELSE 'Olumsuz' END || ') reddedildi → Hakem sonucu: ' || CASE judge_result WHEN 'UYGUN' THEN 'Uygun' ELSE 'Olumsuz' END || ' · Gerekçe: ' || trim(reason) AS detail FROM r WHERE judge = 'rejected'""")
def t24_decision_events(t):
    return e.decision_events(_restored(t))


@query(_RESTORED + " SELECT report, criterion, judge, effective FROM e")
def f50_a13_default_decisions(t):
    return _restored(t).select("report", "criterion", "judge", "effective")


_DASH = ("total", "analysis_completed", "analysis_pending", "evaluated", "pending", "unassigned")


@query(APP.rstrip() + """, s AS (SELECT 'summary' AS section, 'all' AS subject, count(*) AS total, count(*) FILTER (status <> 'submitted') AS analysis_completed, count(*) FILTER (status = 'submitted') AS analysis_pending, count(*) FILTER (status = 'completed') AS evaluated, count(*) FILTER (status <> 'completed') AS pending, count(*) FILTER (judge_id IS NULL AND status <> 'completed') AS unassigned, max(updated_at) AS at FROM app),
c AS (SELECT 'competition', competition_key, count(*), count(*) FILTER (status <> 'submitted'), count(*) FILTER (status = 'submitted'), count(*) FILTER (status = 'completed'), count(*) FILTER (status <> 'completed'), count(*) FILTER (judge_id IS NULL AND status <> 'completed'), max(updated_at) FROM app GROUP BY 2),
j AS (SELECT 'judge', CAST(s_suppkey AS VARCHAR), count(application_id), count(*) FILTER (status <> 'submitted'), count(*) FILTER (status = 'submitted'), count(*) FILTER (status = 'completed'), count(*) FILTER (status <> 'completed'), CAST(0 AS BIGINT), max(updated_at) FROM supplier LEFT JOIN app ON judge_id = s_suppkey GROUP BY 2),
t AS (SELECT 'archive', CAST(application_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, updated_at FROM app WHERE status = 'completed' ORDER BY updated_at DESC, application_id LIMIT 40)
SELECT * FROM s UNION ALL SELECT * FROM c UNION ALL SELECT * FROM j UNION ALL SELECT * FROM t""")
def t17_operations_dashboard(t):
    """One answer: the summary, each competition, each judge, and the forty latest entries of the archive trail."""
    n = lambda cond: F.count_if(cond)
    status = F.col("status")
    measures = [F.count("application_id").alias("total"), n(status != "submitted").alias("analysis_completed"), n(status == "submitted").alias("analysis_pending"), n(status == "completed").alias("evaluated"), n(status != "completed").alias("pending"), n(F.col("judge_id").isNull() & (status != "completed")).alias("unassigned"), F.max("updated_at").alias("at")]
    named = lambda df, section, subject: df.select(F.lit(section).alias("section"), subject.cast("string").alias("subject"), *(F.coalesce(c, F.lit(0)).alias(c) for c in _DASH), "at")
    summary = named(t.app.agg(*measures), "summary", F.lit("all"))
    competitions = named(t.app.groupBy("competition_key").agg(*measures), "competition", F.col("competition_key"))
    judges = named(t.supplier.join(t.app.groupBy("judge_id").agg(*measures), F.col("s_suppkey") == F.col("judge_id"), "left"), "judge", F.col("s_suppkey"))
    none = F.lit(None).cast("bigint")
    trail = t.app.filter("status = 'completed'").orderBy(F.desc("updated_at"), "application_id").limit(40)
    trail = trail.select(F.lit("archive").alias("section"), F.col("application_id").cast("string").alias("subject"), *(none.alias(c) for c in _DASH), F.col("updated_at").alias("at"))
    return reduce(lambda a, b: a.unionByName(b), (summary, competitions, judges, trail))


_EXPECTED = [("red", ["red", "raporu"]), ("type", ["eco", "plated"]), ("again", ["raporu"]), ("none", ["yok", "hiç"])]


def _expected_sql() -> str:
    steps, claimed = [], "CAST([] AS BIGINT[])"
    text = tr_lower_sql("name || ' ' || description || ' ' || quote")
    steps.append(f"p AS (SELECT profile, pos, {text} AS text FROM {CRITERIA.sql}), q0 AS (SELECT DISTINCT profile, {claimed} AS done FROM p)")
    for n, (_, words) in enumerate(_EXPECTED):
        hits = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in words)
        steps.append(f"h{n} AS (SELECT p.profile, max(CASE WHEN list_contains(done, pos) THEN 0 ELSE {hits} END) AS hits, arg_max(pos, (CASE WHEN list_contains(done, pos) THEN 0 ELSE {hits} END) * 1000 - pos) AS pos FROM p JOIN q{n} USING (profile) GROUP BY 1)")
        steps.append(f"q{n + 1} AS (SELECT profile, CASE WHEN hits = {len(words)} THEN list_append(done, pos) ELSE done END AS done FROM q{n} JOIN h{n} USING (profile))")
    out = " UNION ALL ".join(f"SELECT profile, '{name}' AS expected, CASE WHEN hits = {len(words)} THEN 'tam' WHEN hits > 0 THEN 'kismi' ELSE 'eksik' END AS verdict, hits, CASE WHEN hits > 0 THEN pos END AS pos FROM h{n}" for n, (name, words) in enumerate(_EXPECTED))
    return f"WITH {', '.join(steps)}, m AS ({out})"


def _matched(t):
    text = x.tr_lower(F.concat_ws(" ", "name", "description", "quote"))
    return e.matched_expectations(CRITERIA.of(t).select("profile", F.col("pos").cast("bigint").alias("pos"), text.alias("text")), _EXPECTED)


@query(_expected_sql() + " SELECT * FROM m")
def t19_j20_f37_matched_expectations(t):
    return _matched(t)


@query(_expected_sql() + " SELECT profile, avg(CASE WHEN verdict = 'tam' THEN 1.0 ELSE 0.0 END) AS recall, count(*) FILTER (verdict = 'kismi') AS partial, count(*) FILTER (verdict = 'eksik') AS missing FROM m GROUP BY 1")
def a21_t19_recall(t):
    n = lambda v: F.count_if(F.col("verdict") == v)
    return _matched(t).groupBy("profile").agg((n("tam") / F.count("*")).alias("recall"), n("kismi").alias("partial"), n("eksik").alias("missing"))


@query(f"""SELECT profile, {", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in k.STAGES)}, count(*) FILTER (stage IS NULL OR stage = 'unknown') AS unknown, count(*) FILTER (required) AS required, count(*) FILTER (NOT required) AS other FROM {CRITERIA.sql} GROUP BY 1""")
def a12_t19_stage_distribution(t):
    n = lambda c: F.count_if(c)
    return CRITERIA.of(t).groupBy("profile").agg(*(n(F.col("stage") == s).alias(s) for s in k.STAGES), n(F.col("stage").isNull() | ~F.col("stage").isin(*k.STAGES)).alias("unknown"), n(F.col("required")).alias("required"), n(~F.col("required")).alias("other"))


_PROFILE = View("orders", id="o_orderkey", version=pick("o_orderkey", *quoted("2.0", "2.0", "1.0", "2.0", "2.0", "2.0", "0.9", None, "2.0", "2.0", "2.0")), status="CASE WHEN o_orderkey % 31 = 0 THEN 'draft' ELSE 'approved' END", competition="CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END", year="CASE WHEN o_orderkey % 17 > 0 THEN '2026' END", formats="CASE WHEN o_orderkey % 19 > 0 THEN 'PDF' END", max_mb="CASE WHEN o_orderkey % 23 > 0 THEN o_custkey - 3 END", action=pick("o_custkey", *quoted("block", "warn", "jury", "unspecified", "block", "odd")), n="o_custkey % 9", stage=pick("o_orderkey", *quoted("language_template", "headings_content", None, "criteria_evidence", "criteria_evidence")), source="CASE WHEN o_orderkey % 29 > 0 THEN 'kaynak.pdf' END")


@query(f"""SELECT id, CASE WHEN version IS NULL OR version NOT IN ('1.0', '2.0') OR status <> 'approved' THEN 'version' WHEN competition IS NULL THEN 'setup' WHEN year IS NULL THEN 'texts' WHEN formats IS NULL THEN 'formats' WHEN max_mb IS NULL OR max_mb < 0 THEN 'numbers'
WHEN action NOT IN ('block', 'warn', 'jury', 'unspecified') THEN 'action' WHEN n = 0 THEN 'criteria' WHEN version = '2.0' AND stage IS NULL THEN 'criterion' WHEN source IS NULL THEN 'source' ELSE '' END AS error FROM {_PROFILE.sql}""")
def t20_f56_profile_errors(t):
    one = F.struct(F.lit("c").alias("id"), F.lit("n").alias("name"), F.lit(True).alias("active"), F.col("stage").alias("stage"), F.lit(False).alias("required"))
    profile = F.struct("version", "status", "competition", F.lit("k").alias("category"), "year", F.when(F.col("formats").isNotNull(), F.array("formats")).alias("formats"), "max_mb", F.lit(1).alias("max_files"), "action", F.array_repeat(one, F.col("n").cast("int")).alias("criteria"), "source")
    return _PROFILE.of(t).select("id", e.profile_error(profile).alias("error"))


_LEGACY = View("part", id="p_partkey", kind=pick("p_partkey", *quoted("format_rule", "technical_upload", "mandatory_content", "qualitative_score", None, "elimination_review")), effect=pick("p_size", *quoted("gate", "score", "advisory", "penalty", None)), scope=pick("p_size", *quoted("report", "upload", None, "physical", "informational", "external", "report")), stage="CASE WHEN p_partkey % 8 = 0 THEN 'category_similarity' END", required="CASE WHEN p_partkey % 5 = 0 THEN p_size % 2 = 0 END", active="p_partkey % 4 > 0", given="CASE WHEN p_partkey % 9 = 0 THEN 'HARICI_KANIT_GEREKLI' END")


@query(f"""WITH l AS (SELECT *, coalesce(scope, 'report') AS sc, coalesce(scope, 'report') IN ('report', 'upload') AS pdf, coalesce(scope, 'report') = 'informational' OR coalesce(effect, '') = 'advisory' AS info FROM {_LEGACY.sql})
SELECT id, coalesce(stage, CASE WHEN kind IN ('format_rule', 'technical_upload') THEN 'language_template' WHEN kind = 'mandatory_content' THEN 'headings_content' ELSE 'criteria_evidence' END) AS stage, coalesce(required, coalesce(effect, '') IN ('gate', 'threshold', 'penalty') OR coalesce(kind, '') = 'elimination_review') AS required,
active AND pdf AND NOT info AS active, coalesce(given, CASE WHEN info THEN 'HAKEM_KONTROLU_GEREKLI' WHEN pdf THEN 'PDF_DENETLENEBILIR' ELSE 'HARICI_KANIT_GEREKLI' END) AS verifiability FROM l""")
def f32_f52_upgraded_criteria(t):
    c = F.col
    return _LEGACY.of(t).select("id", e.upgraded(c("kind"), c("effect"), c("scope"), c("stage"), c("required"), c("active"), c("given")).alias("u")).select("id", "u.stage", "u.required", "u.active", "u.verifiability")


_HISTORY = View("lineitem", profile="l_suppkey", id="l_partkey", version="l_orderkey * 10 + l_linenumber", page="CAST(floor(l_quantity) AS BIGINT)", quote="concat('s', CAST(l_linenumber AS STRING))")
_ASKED = View("part", profile="p_partkey % 50 + 1", id="p_partkey", page="p_size", quote="'s1'")


@query(f"""WITH f AS (SELECT profile, id, page, quote FROM (SELECT *, row_number() OVER (PARTITION BY profile, id ORDER BY version, page) AS n FROM {_HISTORY.sql}) WHERE n = 1)
SELECT a.profile, a.id, CASE WHEN f.id IS NULL THEN a.page ELSE f.page END AS page, CASE WHEN f.id IS NULL THEN a.quote ELSE f.quote END AS quote, f.id IS NOT NULL AND (a.page IS DISTINCT FROM f.page OR a.quote IS DISTINCT FROM f.quote) AS reverted FROM {_ASKED.sql} a LEFT JOIN f ON a.profile = f.profile AND a.id = f.id""")
def t21_d9_a25_source_lock(t):
    history = _HISTORY.of(t).withColumn("version", F.struct("version", "page"))
    return e.locked_sources(history, _ASKED.of(t), version="version")


@query(APP.rstrip() + """, v AS (SELECT c_custkey AS pid, c_custkey % 5 AS v, 'h' || c_custkey % 3 AS h FROM customer)
SELECT application_id, CASE WHEN status = 'completed' THEN 'completed' WHEN pid IS NULL THEN 'criteria_missing' WHEN application_id % 5 <> v OR 'h' || application_id % 3 <> h THEN 'criteria_changed' WHEN application_id % 7 = 0 THEN 'other_document' ELSE '' END AS error, CASE WHEN status <> 'completed' AND pid IS NOT NULL AND application_id % 5 = v AND 'h' || application_id % 3 = h AND application_id % 7 > 0 THEN 'awaiting_judge' ELSE status END AS status FROM app LEFT JOIN v ON participant_id = pid""")
def t22_save_evaluation(t):
    """A result is saved only where it was made from the current criteria version, its hash and the current document."""
    current = t.customer.select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 5).alias("v"), F.concat(F.lit("h"), (F.col("c_custkey") % 3).cast("string")).alias("h"))
    rows = t.app.join(current, F.col("participant_id") == F.col("pid"), "left")
    n = F.col("application_id")
    error = F.when(F.col("status") == "completed", "completed").when(F.col("pid").isNull(), "criteria_missing").when((n % 5 != F.col("v")) | (F.concat(F.lit("h"), (n % 3).cast("string")) != F.col("h")), "criteria_changed").when(n % 7 == 0, "other_document").otherwise("")
    return rows.select("application_id", error.alias("error"), F.when(error == "", "awaiting_judge").otherwise(F.col("status")).alias("status"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'changes_requested' END AS status, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE substr(trim('  not ' || o_custkey), 1, 2000) END AS review_note, o_orderstatus = 'F' AS refused FROM orders""")
def t23_profile_review(t):
    done = F.col("o_orderstatus") == "F"
    note = F.substring(F.trim(F.concat(F.lit("  not "), F.col("o_custkey").cast("string"))), 1, 2000)
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(done | (F.col("o_orderkey") % 2 == 0), "approved").otherwise("changes_requested").alias("status"), F.when(~done, note).alias("review_note"), done.alias("refused"))


@query(APP.rstrip() + """, v AS (SELECT l_suppkey AS k, max(l_linenumber * 1000000 + l_partkey) AS latest FROM lineitem GROUP BY 1)
SELECT application_id, CASE WHEN c_custkey IS NULL THEN 'document_missing' WHEN n_nationkey = 3 THEN 'competition_archived' WHEN latest IS NULL THEN 'criteria_missing' ELSE 'ok' END AS context, latest AS criteria_version, coalesce(c_name, 'yok') AS file_key FROM app LEFT JOIN customer ON participant_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN v ON judge_id = k""")
def j6_evaluation_context(t):
    """An application with its participant's document, its competition and the newest criteria version, or why there is no context."""
    latest = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.max(F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("latest"))
    rows = t.app.join(t.customer, F.col("participant_id") == F.col("c_custkey"), "left").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(latest, F.col("judge_id") == F.col("k"), "left")
    why = F.when(F.col("c_custkey").isNull(), "document_missing").when(F.col("n_nationkey") == 3, "competition_archived").when(F.col("latest").isNull(), "criteria_missing").otherwise("ok")
    return rows.select("application_id", why.alias("context"), F.col("latest").alias("criteria_version"), F.coalesce("c_name", F.lit("yok")).alias("file_key"))


@query(APP.rstrip() + """, m AS (SELECT l_orderkey AS k, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey) AS members FROM lineitem GROUP BY 1) SELECT application_id, competition_key, coalesce(c_name, 'katılımcı') || coalesce('|' || members, '') AS names FROM app LEFT JOIN customer ON participant_id = c_custkey LEFT JOIN m ON application_id = k""")
def j7_similarity_context(t):
    members = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda m: m["l_partkey"].cast("string")), "|").alias("members"))
    rows = t.app.join(t.customer, F.col("participant_id") == F.col("c_custkey"), "left").join(members, F.col("application_id") == F.col("k"), "left")
    return rows.select("application_id", "competition_key", F.concat_ws("|", F.coalesce("c_name", F.lit("katılımcı")), "members").alias("names"))


@query("""SELECT o_orderkey AS id, v, CASE WHEN v IS NULL THEN NULL WHEN v <> '2.0' OR NOT full_ THEN true ELSE false END AS legacy, CASE WHEN v IS NOT NULL AND (v <> '2.0' OR NOT full_) AND o_orderstatus = 'O' THEN 'analysis_failed' ELSE o_orderstatus END AS status FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '2.0' WHEN 1 THEN '1.0' WHEN 2 THEN '2.0' END AS v, o_orderkey % 4 = 0 AS full_ FROM orders)""")
def p16_legacy_evaluations(t):
    key = F.col("o_orderkey") % 4
    doc = F.when(key == 0, '{"version":"2.0","findings":[],"stages":[],"summary":{"total":0}}').when(key == 1, '{"version":"1.0","findings":[]}').when(key == 2, '{"version":"2.0","findings":{},"stages":[]}')
    part = lambda p: F.get_json_object("doc", f"$.{p}")
    rows = t.orders.withColumn("doc", doc).withColumn("v", part("version"))
    sound = F.coalesce((F.col("v") == "2.0") & F.startswith(part("findings"), F.lit("[")) & F.startswith(part("stages"), F.lit("[")) & part("summary").isNotNull(), F.lit(False))
    legacy = F.when(F.col("doc").isNotNull(), ~sound)
    return rows.select(F.col("o_orderkey").alias("id"), "v", legacy.alias("legacy"), F.when(legacy & (F.col("o_orderstatus") == "O"), "analysis_failed").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"SELECT id, role, created FROM {ACCOUNTS.sql} ORDER BY CASE status WHEN 'active' THEN 0 ELSE 1 END, role, created DESC, id LIMIT 60")
def o3_accounts_in_order(t):
    return ACCOUNTS.of(t).orderBy(F.when(F.col("status") == "active", 0).otherwise(1), "role", F.desc("created"), "id").limit(60).select("id", "role", "created")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size > 40 DESC, p_name, p_partkey LIMIT 50")
def o9_priority_then_name(t):
    """Priority first, then names by the Turkish alphabet; names of ASCII letters sort alike everywhere."""
    return t.part.orderBy(F.desc(F.col("p_size") > 40), F.collate("p_name", "tr"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("SELECT application_id FROM app ORDER BY judge_id IS NULL DESC, application_id LIMIT 50")
def o10_unassigned_first(t):
    return t.app.orderBy(F.desc(F.col("judge_id").isNull()), "application_id").limit(50).select("application_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey LIMIT 5")
def o14_changes_first(t):
    return t.orders.orderBy(F.desc(F.col("o_orderstatus") == "P"), F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def o15_latest_result(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT l_orderkey AS id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS together FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS a, list(DISTINCT l_suppkey % 20) AS b FROM lineitem GROUP BY 1)")
def u4_set_sizes(t):
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    return sets.select("id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("together"))


@query(f"""WITH h AS (SELECT profile, 0 AS src, pos, name FROM {CRITERIA.sql} WHERE active AND stage = 'headings_content' UNION ALL SELECT profile, 1, pos, upper(replace(name, 'i', 'İ')) FROM {CRITERIA.sql} WHERE pos < 5),
w AS (SELECT *, array_to_string(list_filter(regexp_split_to_array({tr_lower_sql("name")}, '[^a-zçğıöşüâîû0-9]+'), lambda y: y <> ''), ' ') AS key FROM h), f AS (SELECT profile, trim(name) AS heading, row_number() OVER (PARTITION BY profile, key ORDER BY src, pos) AS n, src, pos FROM w WHERE key <> '')
SELECT profile, heading, row_number() OVER (PARTITION BY profile ORDER BY src, pos) AS place FROM f WHERE n = 1""")
def u6_required_headings(t):
    """Headings that a profile asks for: its active criteria of stage two, then its template's; each once, by its words."""
    rows = CRITERIA.of(t).select("profile", "pos", "name", "active", "stage")
    both = rows.filter("active and stage = 'headings_content'").select("profile", F.lit(0).alias("src"), "pos", "name").unionByName(rows.filter("pos < 5").select("profile", F.lit(1).alias("src"), "pos", F.upper(F.replace("name", F.lit("i"), F.lit("İ"))).alias("name")))
    keyed = both.withColumn("key", F.array_join(x.words_of(F.col("name")), " ")).filter("key != ''")
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("profile", "key").orderBy("src", "pos"))).filter("n = 1")
    return first.select("profile", F.trim("name").alias("heading"), F.row_number().over(Window.partitionBy("profile").orderBy("src", "pos")).alias("place"))


@query(f"""WITH a AS (SELECT *, role = '00' AND status = 'active' AS admin FROM {ACCOUNTS.sql}), n AS (SELECT count(*) FILTER (admin) AS admins FROM a), c AS (SELECT id, admin, status, row_number() OVER (PARTITION BY admin ORDER BY id) AS place FROM a WHERE id % 2 = 0 OR admin)
SELECT id, CASE WHEN status <> 'active' THEN 'not_found' WHEN admin AND place >= admins THEN 'last_moderator' ELSE 'revoked' END AS outcome FROM c, n""")
def d5_last_admin_stays(t):
    """Accounts revoked in order of their ids: of the active administrators one always stays."""
    accounts = ACCOUNTS.of(t).withColumn("admin", (F.col("role") == "00") & (F.col("status") == "active"))
    return rules.revoked_in_order(accounts, accounts.filter("id % 2 = 0 or admin").select("id"), order="id")


@query(APP.rstrip() + """, v AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT application_id, coalesce(n, 0) + CASE WHEN ok THEN 1 ELSE 0 END AS version, CASE WHEN NOT ok THEN status WHEN judge_id IS NOT NULL THEN 'assigned' ELSE 'resubmitted' END AS status, CASE WHEN NOT ok THEN amount END AS evaluation, ok AS accepted
FROM (SELECT *, status = 'judge_in_review' OR (status = 'completed' AND application_id % 2 = 0) AS ok FROM app) LEFT JOIN v ON application_id = k""")
def d10_new_submission_version(t):
    """A new version of a document where one was asked for: the next number, the state set back, what was derived emptied."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("n"))
    ok = (F.col("status") == "judge_in_review") | ((F.col("status") == "completed") & (F.col("application_id") % 2 == 0))
    rows = t.app.withColumn("ok", ok).join(n, F.col("application_id") == F.col("k"), "left")
    state = F.when(~F.col("ok"), F.col("status")).when(F.col("judge_id").isNotNull(), "assigned").otherwise("resubmitted")
    return rows.select("application_id", (F.coalesce("n", F.lit(0)) + F.col("ok").cast("int")).alias("version"), state.alias("status"), F.when(~F.col("ok"), F.col("amount")).alias("evaluation"), F.col("ok").alias("accepted"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS must_change FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)")
def d18_delete_and_flag(t):
    gone = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left_anti")
    return gone.select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("must_change"))


@query("SELECT event_id, event_type || ':' || user_id % 7 AS cache_key, event_id = min(event_id) OVER (PARTITION BY event_type, user_id % 7) AS computed FROM events")
def x5_coalesced_requests(t):
    """Equal requests share one computation: the first computes, the rest read."""
    rows = t.events.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string")).alias("cache_key"))
    first = rows.groupBy(F.col("cache_key").alias("_k")).agg(F.min("event_id").alias("_first"))
    return rows.join(first, F.col("cache_key") == F.col("_k")).select("event_id", "cache_key", (F.col("event_id") == F.col("_first")).alias("computed"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS w FROM conversations), p AS (SELECT conv_id, sum(CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 16 + 1) AS profile FROM w GROUP BY 1),
c AS (SELECT conv_id, count(*) AS vectors, CAST(ceil(count(*) / 16.0) AS BIGINT) AS calls FROM conversations GROUP BY 1)
SELECT c.conv_id, true AS ok, vectors, calls, CAST(coalesce(profile, 0) AS DOUBLE) AS profile FROM c LEFT JOIN p USING (conv_id)""")
def x7_embedded_batches(t):
    """A conversation's turns in batches of sixteen through an embedder that counts words by hash; each vector's components weighed by their place."""
    out = e.embedded(t.conversations, v.word_count_vectors, group="conv_id", order="turn", text="text")
    weighed = F.aggregate(F.flatten(F.transform("vectors", lambda own: F.transform(own, lambda x, i: x * (i + 1)))), F.lit(0.0), lambda a, x: a + x)
    return out.select("conv_id", "ok", F.size("vectors").alias("vectors"), "calls", weighed.alias("profile"))


@query("SELECT event_id, ts, event_type, CASE WHEN user_id % 3 = 0 THEN '' ELSE props END AS detail FROM events WHERE user_id IN (8, 9) ORDER BY ts, event_id LIMIT 200")
def x8_masked_timeline(t):
    """A subject's events in order; the operations role (here users divisible by 3) sees no free text."""
    return t.events.filter(F.col("user_id").isin(8, 9)).orderBy("ts", "event_id").limit(200).select("event_id", "ts", "event_type", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("props")).alias("detail"))


@query("SELECT event_id, user_id, value, 'none' AS note, CAST(NULL AS BIGINT) AS version FROM events")
def s12_s13_conformed_events(t):
    """Older rows under a newer schema: added columns take their default, unknown ones go."""
    from pyspark.sql import types as T

    from scrivia.sources.tables import conform

    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, value double, note string, version bigint")
    return conform(t.events, schema, {"note": "none"})


@query("SELECT user_id, event_id AS blob FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n = 1 AND event_type <> 'error'")
def s5_blobs(t):
    """A log of puts and deletes (errors) as the objects that are there."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("b")
    return t.events.filter("event_type != 'view'").groupBy("user_id").agg(last).filter("b.event_type != 'error'").select("user_id", F.col("b.event_id").alias("blob"))


@query("SELECT doc_id, title, n_chars FROM (SELECT doc_id, coalesce(nullif(trim(source), ''), 'adsız') AS title, n_chars FROM documents WHERE text IS NOT NULL) ORDER BY n_chars DESC, doc_id")
def s8_document_library(t):
    return t.documents.filter("text is not null").select("doc_id", F.coalesce(F.expr("nullif(trim(source), '')"), F.lit("adsız")).alias("title"), "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'a|b' ELSE 'a' END AS stages, item_id % 3 = 0 AS required FROM benchmark")
def s11_ground_truth(t):
    """Expectations read from JSON whose `stage` is a text or a list."""
    stage = F.when(F.col("item_id") % 2 == 0, '["a","b"]').otherwise('"a"')
    doc = F.concat(F.lit('{"stage":'), stage, F.lit(',"required":'), (F.col("item_id") % 3 == 0).cast("string"), F.lit("}"))
    part = lambda p: F.get_json_object("doc", f"$.{p}")
    stages = F.when(F.startswith(part("stage"), F.lit("[")), F.from_json(part("stage"), "array<string>")).otherwise(F.array(part("stage")))
    return t.benchmark.withColumn("doc", doc).select("item_id", F.array_join(stages, "|").alias("stages"), part("required").cast("boolean").alias("required"))


@query(f"""SELECT p_partkey AS id, coalesce(nullif(substr(trim(regexp_replace('  ' || p_name || '   ' || p_type, '\\s+', ' ', 'g')), 1, 20), ''), 'yok') AS competition, array_to_string(list_sort(list_distinct(['PDF', upper(substr(p_brand, 1, 3))])), ',') AS formats,
CASE WHEN p_size - 20 > 0 THEN least((p_size - 20) * 1000, 10000) ELSE 0 END AS max_mb, CASE WHEN p_size - 10 > 0 THEN least((p_size - 10) * 4, 100) ELSE 0 END AS max_files, CAST(greatest(0, least(500, floor(p_retailprice / 3 + 0.5))) AS BIGINT) AS pages FROM part""")
def f22_f23_document_setup(t):
    number = F.col("p_size")
    formats = F.array_sort(F.array_distinct(F.transform(r.string_list(F.array(F.lit(" .pdf "), F.lit(""), F.substring("p_brand", 1, 3), F.lit("pdf")), 12), lambda f: F.upper(F.regexp_replace(f, r"^\.", "")))))
    return t.part.select(
        F.col("p_partkey").alias("id"), r.clean_text(F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_type")), "yok", 20).alias("competition"), F.array_join(formats, ",").alias("formats"),
        F.when(number > 20, F.least((number - 20) * 1000, F.lit(10_000))).otherwise(0).alias("max_mb"), F.when(number > 10, F.least((number - 10) * 4, F.lit(100))).otherwise(0).alias("max_files"),
        F.greatest(F.lit(0), F.least(F.lit(500), F.floor(F.col("p_retailprice") / 3 + 0.5))).alias("pages"),
    )
