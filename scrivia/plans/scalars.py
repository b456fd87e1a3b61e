"""Queries over single records: accounts, files, usage, guards, languages, limits and generated lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.functions import records as r
from scrivia.functions import text as x
from scrivia.functions import vectors as v
from scrivia.plans.registry import query
from scrivia.sources.tables import spread
from scrivia.sources.views import ACCOUNTS, CRITERIA, FINDINGS, USAGE, View, pick, quoted


def tr_lower_sql(column: str) -> str:
    return f"lower(translate({column}, 'Iİ', 'ıi'))"


def values_sql(*rows: tuple) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if c is None else f"'{c}'" for c in row) + ")" for row in rows) + ")"


@query(f"""SELECT id, lower(trim(email)) AS email, nullif(substr(regexp_replace(lower(trim(username)), '[^a-z0-9._-]', '', 'g'), 1, 64), '') AS username,
CASE WHEN role IN ('00', '01', '02', '03', '04') THEN role ELSE '01' END AS role, CASE WHEN status = 'revoked' THEN 'revoked' ELSE 'active' END AS status, must_change = 1 AS must_change FROM {ACCOUNTS.sql}""")
def f33_p23_accounts(t):
    return ACCOUNTS.of(t).select("id", r.email(F.col("email")).alias("email"), r.username(F.col("username")).alias("username"), r.one_of(F.col("role"), ("00", "01", "02", "03", "04"), "01").alias("role"), r.one_of(F.col("status"), ("revoked",), "active").alias("status"), (F.col("must_change") == 1).alias("must_change"))


@query(f"""SELECT id, role, (SELECT string_agg(p, ',' ORDER BY p) FROM {values_sql(*((p, c) for p, own in k.PERMISSIONS.items() for c in own))} m(p, c) WHERE m.c = a.role) AS permissions,
id % 7 = 0 OR id % 7 = 1 AS may_update FROM {ACCOUNTS.sql} a""")
def p22_permissions(t):
    """Each account's permissions by the matrix, a small table of fixed size, and whether it may overwrite a profile without owner or its own."""
    matrix = t.spark.createDataFrame([(p, c) for p, own in k.PERMISSIONS.items() for c in own], "permission string, role string")
    by_role = matrix.groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("permission")), ",").alias("permissions"))
    owner = F.when(F.col("id") % 7 == 1, F.col("id")).when(F.col("id") % 7 > 1, F.col("id") + 1)
    return ACCOUNTS.of(t).join(F.broadcast(by_role), "role", "left").select("id", "role", "permissions", (owner.isNull() | (owner == F.col("id"))).alias("may_update"))


_FILES = View(
    "part", id="p_partkey", name="concat(p_name, " + pick("p_partkey", *quoted(".pdf", ".DOCX", ".tar.7z", "", ".", ".odt", ".unknown", ".webp")) + ")",
    mime=pick("p_partkey", *quoted(None, None, None, "", "image/png", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/pdf", None, "text/csv", "application/x-zip-compressed", None)),
)
_EXT = values_sql(*((e, kind) for kind, (_, own) in k.FILE_KINDS.items() for e in own))


@query(f"""SELECT id, kind, CASE WHEN kind IN ('word', 'excel', 'powerpoint', 'archive', 'other') AND length(e) BETWEEN 1 AND 4 THEN upper(e) ELSE l END AS label FROM
(SELECT id, e, CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN m LIKE 'image/%' THEN 'image' WHEN m LIKE 'video/%' THEN 'video' WHEN m LIKE 'text/%' THEN 'text' WHEN m LIKE '%wordprocessingml%' OR m = 'application/msword' THEN 'word'
WHEN m LIKE '%spreadsheetml%' OR m = 'application/vnd.ms-excel' THEN 'excel' WHEN m LIKE '%presentationml%' THEN 'powerpoint' WHEN m LIKE '%zip%' OR m LIKE '%compressed%' THEN 'archive' ELSE coalesce(x.kind, 'other') END AS kind
FROM (SELECT id, mime AS m, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS e FROM {_FILES.sql}) f LEFT JOIN {_EXT} x(ext, kind) ON f.e = x.ext) g
JOIN {values_sql(*((kind, label) for kind, (label, _) in k.FILE_KINDS.items()))} n(kk, l) ON g.kind = n.kk""")
def s9_file_kind(t):
    return _FILES.of(t).select("id", r.file_kind(F.col("name"), F.col("mime")).alias("f")).select("id", "f.kind", "f.label")


_PDF = View(
    "part", id="p_partkey",
    body=pick("p_partkey", *quoted("%PDF-1.7 1 0 obj /Type /Page /Type /Page /Type /Pages /Count 2 xref startxref 61 %%EOF", "%PD", "not a pdf at all", "%PDF-1.4 xref cut", "%PDF-1.4 xref %%EOF", "%PDF-1.4 xref startxref 9999 %%EOF", "%PDF-1.4 xref startxref 2 %%EOF", "%PDF-1.4 /Count 7 and then /Type /Pages xref startxref 42 %%EOF", "%PDF-1.4 startxref 1 then 3 0 obj startxref 26 %%EOF /Type/Pages /Count 1200")),
    stated="p_size",
)


@query(f"""SELECT id, CASE WHEN length(body) < 5 THEN 'short' WHEN NOT contains(body, '%PDF-') THEN 'header' WHEN NOT contains(body, '%%EOF') THEN 'truncated' WHEN o IS NULL THEN 'no_xref' WHEN o >= length(body) THEN 'xref_range'
WHEN NOT regexp_matches(ltrim(substr(body, o + 1, 96)), '^(xref\\b|\\d+\\s+\\d+\\s+obj\\b)') THEN 'xref_target' END AS error FROM (SELECT id, body, TRY_CAST(regexp_extract_all(body, 'startxref\\s+(\\d+)', 1)[-1] AS BIGINT) AS o FROM {_PDF.sql})""")
def s4_pdf_integrity(t):
    return _PDF.of(t).select("id", r.integrity_error(F.col("body").cast("binary")).alias("error"))


@query(f"""SELECT id, CASE WHEN d > 0 THEN d WHEN c > 0 THEN c ELSE stated END AS pages, (d > 0 AND (c = 0 OR c = d)) OR (d = 0 AND c > 0) AS trusted, greatest(d, c, stated, 1) AS upper FROM
(SELECT id, stated, len(regexp_extract_all(body, '/Type\\s*/Page\\b')) AS d, coalesce(list_max(list_filter(list_transform(list_concat(regexp_extract_all(body, '/Type\\s*/Pages\\b[\\s\\S]{{0,500}}?/Count\\s+(\\d+)', 1), regexp_extract_all(body, '/Count\\s+(\\d+)[\\s\\S]{{0,500}}?/Type\\s*/Pages\\b', 1)), lambda y: CAST(y AS BIGINT)), lambda y: y BETWEEN 1 AND 1000)), 0) AS c FROM {_PDF.sql})""")
def s3_page_count(t):
    return _PDF.of(t).select("id", x.page_count(F.col("body"), F.col("stated")).alias("c")).select("id", "c.pages", "c.trusted", "c.upper")


@query(f"""SELECT id, coalesce(nullif(substr(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), ''), 'rapor.pdf') AS file_name, 'p' || CAST(id % 9 AS VARCHAR) || ':' || id || ':' || CASE WHEN name LIKE 'r%' THEN 'kriter' ELSE name END AS row_id FROM {_FILES.sql}""")
def f34_f40_names(t):
    key = F.when(F.startswith("name", F.lit("r")), "").otherwise(F.col("name"))
    row_id = F.concat_ws(":", F.concat(F.lit("p"), (F.col("id") % 9).cast("string")), F.col("id").cast("string"), F.when(key == "", "kriter").otherwise(key))
    return _FILES.of(t).select("id", r.safe_file_name(F.col("name")).alias("file_name"), row_id.alias("row_id"))


@query(f"""SELECT id, coalesce(prompt, 0) AS prompt, coalesce(candidates, 0) + coalesce(thoughts, 0) AS output, CASE WHEN pages >= 80 THEN 'HIGH' WHEN pages >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS thinking,
CASE WHEN cached THEN 0 ELSE coalesce(prompt, 0) END AS fresh_prompt, '[usage] {{"id":' || id || ',"cached":' || cached || ',"error":' || error || '}}' AS line FROM {USAGE.sql}""")
def f39_f47_f49_s7_s10_usage(t):
    """Tokens of a call, the thinking level of its document, zeroed diagnostics of cached answers and the log line."""
    u = r.usage(F.col("prompt"), F.col("candidates"), F.col("thoughts"))
    line = F.concat(F.lit("[usage] "), F.to_json(F.struct("id", "cached", "error")))
    return USAGE.of(t).select("id", u["prompt"].alias("prompt"), u["output"].alias("output"), r.thinking_level(F.col("pages")).alias("thinking"), F.when(F.col("cached"), 0).otherwise(u["prompt"]).alias("fresh_prompt"), line.alias("line"))


_GUARD = View("orders", id="o_orderkey", action=pick("o_orderkey", *quoted("block", "warn", "jury", "odd", None)), number=pick("o_custkey", *quoted("12", "0", "-3", "2.5", "x", "", "  7 ", None)), length=pick("o_orderkey", *quoted("5000", "20000", "", "abc", None)))


@query(f"""SELECT id, CASE action WHEN 'block' THEN 'failed' WHEN 'warn' THEN 'warning' ELSE 'flagged' END AS status, CASE WHEN TRY_CAST(number AS DOUBLE) > 0 AND TRY_CAST(number AS DOUBLE) = floor(TRY_CAST(number AS DOUBLE)) THEN CAST(TRY_CAST(number AS DOUBLE) AS BIGINT) ELSE 20 END AS allowed,
coalesce(TRY_CAST(length AS DOUBLE) > 10000, false) AS too_large, CASE WHEN action IN ('block', 'warn', 'jury', 'unspecified') THEN action ELSE 'unspecified' END AS known FROM {_GUARD.sql}""")
def f21_f51_f54_guards(t):
    return _GUARD.of(t).select("id", r.violation_status(F.col("action")).alias("status"), r.positive_integer(F.col("number"), 20).alias("allowed"), r.body_too_large(F.col("length"), 10_000).alias("too_large"), r.one_of(F.col("action"), k.VIOLATION_ACTIONS, "unspecified").alias("known"))


_WANTED = "CASE doc_id % 5 WHEN 0 THEN 'Türkçe' WHEN 1 THEN 'ENGLISH' WHEN 2 THEN 'Klingonca' WHEN 3 THEN 'ingilizce' END"
_WORDS = f"list_filter(regexp_split_to_array({tr_lower_sql('text')}, '[^a-zçğıöşüâîû0-9]+'), lambda y: y <> '')"
_HITS = "len(list_filter({w}, lambda y: list_contains([{l}], y)))"


@query(f"""WITH d AS (SELECT doc_id, {_WANTED} AS wanted, {_WORDS} AS w, list_filter(regexp_split_to_array(lower(text), '[^a-zçğıöşüâîû0-9]+'), lambda y: y <> '') AS e, len(regexp_extract_all(lower(text), '[çğıöşü]')) AS c FROM documents),
h AS (SELECT doc_id, wanted, len(w) AS n, {_HITS.format(w="w", l=", ".join(f"'{s}'" for s in k.TURKISH_STOPWORDS))} AS th, {_HITS.format(w="e", l=", ".join(f"'{s}'" for s in k.ENGLISH_STOPWORDS))} AS eh, c FROM d),
g AS (SELECT doc_id, wanted, CASE WHEN n < 40 THEN 'unknown' WHEN s > eh THEN 'tr' WHEN eh > s THEN 'en' ELSE 'unknown' END AS found FROM (SELECT *, th + CASE WHEN th = 0 THEN 0 ELSE least(c / 40, th + 5) END AS s FROM h)),
b AS (SELECT *, CASE WHEN regexp_matches({tr_lower_sql('wanted')}, 'türk|turk') THEN 'tr' WHEN regexp_matches({tr_lower_sql('wanted')}, 'ingiliz|english') THEN 'en' END AS code FROM g)
SELECT doc_id, CASE found WHEN 'tr' THEN 'Türkçe' WHEN 'en' THEN 'İngilizce' END AS label, CASE WHEN found = 'unknown' THEN 'warning' WHEN code IS NOT NULL AND code <> found THEN 'flagged' ELSE 'passed' END AS status FROM b""")
def f17_t25_language_check(t):
    found = spread(t.documents).select("doc_id", F.expr(_WANTED).alias("wanted"), x.detect_language(F.col("text")).alias("found"))
    return found.select("doc_id", r.language_label(F.col("found")).alias("label"), r.language_status(F.col("found"), F.col("wanted")).alias("status"))


_LIMIT = "TRY_CAST(nullif(regexp_extract({}, '(?:en fazla|azami|maksimum|en çok)\\s*(\\d{{1,3}})\\s*(?:\\([^)]{{1,24}}\\)\\s*)?sayfa', 1), '') AS INTEGER)"
LIMIT_SQL = f"coalesce({_LIMIT.format(tr_lower_sql('concat_ws(chr(32), name, quote)'))}, {_LIMIT.format(tr_lower_sql('description'))})"


@query(f"SELECT profile, id, {LIMIT_SQL} AS page_limit FROM {CRITERIA.sql}")
def f18_page_limits(t):
    return CRITERIA.of(t).select("profile", "id", r.page_limit_of(F.col("name"), F.col("quote"), F.col("description")).alias("page_limit"))


_KEYS = View("part", id="p_partkey", heading="concat(p_name, ' Bölümü ve ', p_type)", word="concat(substr(lower(p_name), 1, 5), 'lar')")


@query(f"""SELECT id, array_to_string(keys, ',') AS keys, len(list_filter(keys, lambda w: length(word) >= least(5, length(w)) AND substr(w, 1, least(5, length(w))) = substr(word, 1, least(5, length(w))))) AS matched FROM
(SELECT id, word, list_filter(regexp_split_to_array({tr_lower_sql('heading')}, '[^a-zçğıöşüâîû0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains([{", ".join(f"'{s}'" for s in k.KEYWORD_STOPWORDS)}], w)) AS keys FROM {_KEYS.sql})""")
def f19_f20_keywords(t):
    rows = _KEYS.of(t).select("id", "word", x.keywords_of(F.col("heading")).alias("keys"))
    return rows.select("id", F.array_join("keys", ",").alias("keys"), F.size(F.filter("keys", lambda w: x.words_match(w, F.col("word")))).alias("matched"))


@query(f"""SELECT id, verifiability FROM (SELECT id, CASE WHEN v IN ('PDF_DENETLENEBILIR', 'HARICI_KANIT_GEREKLI', 'HAKEM_KONTROLU_GEREKLI') THEN v WHEN len(list_filter([{", ".join(f"'{m}'" for m in k.EXTERNAL_EVIDENCE_MARKERS)}], lambda m: contains(h, m))) > 0 THEN 'HARICI_KANIT_GEREKLI'
WHEN len(list_filter([{", ".join(f"'{m}'" for m in k.JUDGE_REVIEW_MARKERS)}], lambda m: contains(h, m))) > 0 THEN 'HAKEM_KONTROLU_GEREKLI' ELSE 'PDF_DENETLENEBILIR' END AS verifiability
FROM (SELECT p_partkey AS id, CASE WHEN p_size = 7 THEN 'PDF_DENETLENEBILIR' END AS v, trim(regexp_replace(lower(p_name || ' ' || ([{", ".join(f"'{m}'" for m in (*k.EXTERNAL_EVIDENCE_MARKERS, *k.JUDGE_REVIEW_MARKERS))}, 'hepsi'])[p_partkey % 22 + 1] || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS h FROM part))""")
def f24_all_markers(t):
    """Every marker of either list, and none, inside names of parts."""
    markers = F.array(*map(F.lit, (*k.EXTERNAL_EVIDENCE_MARKERS, *k.JUDGE_REVIEW_MARKERS, "hepsi")))
    given = F.when(F.col("p_size") == 7, "PDF_DENETLENEBILIR")
    return t.part.select(F.col("p_partkey").alias("id"), x.resolve_verifiability(given, F.col("p_name"), F.element_at(markers, (F.col("p_partkey") % 22 + 1).cast("int")), F.col("p_type")).alias("verifiability"))


_CHECK = View("orders", id="o_orderkey", kind=pick("o_orderkey", *quoted("similarity", "similarity", "similarity", "language")), status=pick("o_custkey", *quoted("passed", "skipped", "flagged")), detail="concat(" + pick("o_orderkey", *quoted("Havuz boş. ", "En yakın eşleşme: Takım Ufuk (%", '"Mavi Takım" ile %')) + ", CAST(o_custkey % 150 AS STRING), ' benzer)')")


@query(f"""SELECT id, CASE WHEN kind = 'similarity' AND status <> 'skipped' AND contains(detail, '%') THEN least(100, TRY_CAST(nullif(regexp_extract(detail, '%\\s?(\\d{{1,3}})', 1), '') AS INTEGER)) END AS percent,
CASE WHEN kind = 'similarity' THEN coalesce(nullif(regexp_extract(detail, 'En yakın eşleşme:\\s*(.+?)\\s*\\(%', 1), ''), nullif(regexp_extract(detail, '"(.+?)"\\s+ile\\s+%', 1), '')) END AS closest FROM {_CHECK.sql}""")
def f36_similarity_result(t):
    return _CHECK.of(t).select("id", r.similarity_result(F.col("kind"), F.col("status"), F.col("detail")).alias("s")).select("id", "s.percent", "s.closest")


@query("""WITH i AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_quantity - 3 AS page, l_linenumber - 2 AS paragraph, CASE WHEN l_partkey % 4 > 0 THEN '  alıntı   ' || l_partkey ELSE '  ' END AS quote FROM lineitem)
SELECT id, string_agg(CAST(least(20, greatest(1, floor(page + 0.5))) AS BIGINT) || '/' || coalesce(CAST(CASE WHEN paragraph >= 1 THEN CAST(floor(paragraph + 0.5) AS BIGINT) END AS VARCHAR), '') || '/' || trim(regexp_replace(quote, '\\s+', ' ', 'g')), ';' ORDER BY pos) FILTER (pos <= 4 AND trim(quote) <> '') AS evidence FROM i GROUP BY 1""")
def f25_f26_evidence(t):
    """Lines of an order as pieces of evidence: at most four, cleaned, pages held to 1..20, those without a text left out."""
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_quantity") - 3).alias("page"), (F.col("l_linenumber") - 2).cast("double").alias("paragraph"), F.lit("").alias("section"), F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("  alıntı   "), F.col("l_partkey").cast("string"))).otherwise("  ").alias("text"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(own)), lambda e: F.struct(e["page"].alias("page"), e["paragraph"].alias("paragraph"), e["section"].alias("section"), e["text"].alias("text"))).alias("items"))
    kept = r.evidence_list(F.col("items"), F.lit(20))
    shown = F.transform(kept, lambda e: F.concat_ws("/", e["page"].cast("bigint").cast("string"), F.coalesce(e["paragraph"].cast("bigint").cast("string"), F.lit("")), e["text"]))
    return rows.select("id", F.when(F.size(shown) > 0, F.array_join(shown, ";")).alias("evidence"))


@query(f"""SELECT id, CASE WHEN origin = 'document' AND (trim(quote) = '' OR page IS NULL OR page < 1 OR page > 40) THEN array_to_string(list_filter([CASE WHEN trim(quote) = '' THEN 'alıntı yok' END, CASE WHEN page IS NULL THEN 'sayfa yok' WHEN page < 1 OR page > 40 THEN 'sayfa ' || page || ' PDF dışında' END], lambda y: y IS NOT NULL), ', ') END AS reasons FROM {CRITERIA.sql}""")
def f38_unsupported(t):
    reasons = r.unsupported_reasons(F.col("quote"), F.col("page"), F.lit(40))
    return CRITERIA.of(t).select("id", F.when((F.col("origin") == "document") & (F.size(reasons) > 0), F.array_join(reasons, ", ")).alias("reasons"))


@query("""SELECT o_orderkey AS id, array_to_string(list_slice(a, 1, 3), ',') AS first_three, len(list_distinct(a)) AS kinds, list_contains(a, CAST(3 AS BIGINT)) AS has_three, len(flatten([a, a])) AS flat_size, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
o_orderdate < TIMESTAMP '1995-01-01 00:00:00' AS before, CAST(floor(o_totalprice / 7 + 0.5) AS BIGINT) AS rounded, CAST(ceil(o_totalprice / 7) AS BIGINT) AS up, round(sqrt(o_totalprice), 6) AS root, CAST(least(100, greatest(0, o_custkey - 500)) AS BIGINT) AS clamped
FROM (SELECT *, [o_orderkey % 5, o_custkey % 5, o_orderkey % 3, CAST(3 AS BIGINT)] AS a FROM orders)""")
def f41_f42_f43_builtins(t):
    a = F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5, F.col("o_orderkey") % 3, F.lit(3).cast("bigint"))
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.array_join(F.slice(a, 1, 3), ",").alias("first_three"), F.size(F.array_distinct(a)).alias("kinds"), F.array_contains(a, 3).alias("has_three"), F.size(F.flatten(F.array(a, a))).alias("flat_size"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), (F.col("o_orderdate") < F.to_timestamp(F.lit("1995-01-01 00:00:00"))).alias("before"), F.floor(F.col("o_totalprice") / 7 + 0.5).alias("rounded"),
        F.ceil(F.col("o_totalprice") / 7).alias("up"), F.round(F.sqrt("o_totalprice"), 6).alias("root"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("o_custkey") - 500)).alias("clamped"),
    )


@query("""WITH h AS (SELECT p_type, i, list_reduce(list_prepend(xor(CAST(2166136261 AS BIGINT), (i * 2654435761) % 4294967296), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS v FROM part, range(0, 4) r(i))
SELECT p_type, i AS seed, min(xor(v, v >> 16)) AS least FROM h GROUP BY 1, 2""")
def f7_a16_seeded_minima(t):
    """Seeded FNV-1a over the characters of a name, and its least value for each type and seed."""
    seeded = t.part.select("p_type", "p_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seed"))
    return seeded.select("p_type", "seed", v.fnv1a(F.col("p_name"), F.col("seed")).alias("h")).groupBy("p_type", "seed").agg(F.min("h").alias("least"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, round((CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 2 = l_suppkey % 2 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 5 = l_suppkey % 5 THEN 1 ELSE 0 END) / 3, 6) AS similarity FROM lineitem""")
def f8_cell_agreement(t):
    cells = lambda c: F.array(F.col(c) % 3, F.col(c) % 2, F.col(c) % 5)
    longer = F.concat(cells("l_suppkey"), F.array(F.lit(9).cast("bigint")))  # the shorter signature counts
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(v.minhash_similarity(cells("l_partkey"), longer), 6).alias("similarity"))


@query(f"""SELECT report, criterion, CASE WHEN judge = 'rejected' THEN name || ' — ' || trim(reason) || CASE WHEN mode = 'PDF_KONUMU' AND page > 0 THEN ' (rapor s. ' || page || CASE WHEN section <> '' THEN ' · ' || section ELSE '' END || ')' ELSE '' END
|| CASE WHEN mode = 'PDF_KONUMU' AND quote <> '' THEN ' “' || quote || '”' ELSE '' END || CASE WHEN mode = 'RAPORDA_BULUNAMADI' THEN ' (Raporda bulunamadı: ' || missing || ')' ELSE '' END
ELSE name || ' — ' || rationale || CASE WHEN page > 0 THEN ' (rapor s. ' || page || CASE WHEN section <> '' THEN ' · ' || section ELSE '' END || ')' ELSE '' END || CASE WHEN quote <> '' THEN ' “' || quote || '”' ELSE '' END END AS line,
CASE WHEN judge = 'rejected' THEN name || ' · AI bulgusu (' || CASE WHEN verdict = 'BASARILI' THEN 'Uygun' ELSE 'Olumsuz' END || ') reddedildi → Hakem sonucu: ' || CASE judge_result WHEN 'UYGUN' THEN 'Uygun' ELSE 'Olumsuz' END || ' · Gerekçe: ' || trim(reason) END AS audit FROM {FINDINGS.sql}""")
def f27_f31_lines(t):
    c = F.col
    line = r.negative_line(c("judge"), c("name"), c("reason"), c("mode"), c("page"), c("section"), c("quote"), c("missing"), c("rationale"))
    audit = F.when(c("judge") == "rejected", r.audit_line(c("name"), F.when(c("verdict") == "BASARILI", "UYGUN").otherwise("OLUMSUZ"), c("judge_result"), c("reason")))
    return FINDINGS.of(t).select("report", "criterion", line.alias("line"), audit.alias("audit"))


@query(f"""SELECT id, name FROM {CRITERIA.sql} WHERE contains({tr_lower_sql("name || ' ' || description || ' ' || quote")}, {tr_lower_sql("'RED'")}) AND stage = 'language_template'""")
def p19_criterion_filter(t):
    hay = x.tr_lower(F.concat_ws(" ", "name", "description", "quote"))
    return CRITERIA.of(t).filter(F.contains(hay, x.tr_lower(F.lit("RED"))) & (F.col("stage") == "language_template")).select("id", "name")


@query(f"""SELECT id, text IS NULL OR length(text) > 60 OR text NOT LIKE '[%' AS refused, CASE WHEN text LIKE '[%' AND length(text) <= 60 THEN string_split(replace(replace(replace(text, '[', ''), ']', ''), '"', ''), ',') END[1] AS first FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '["a' || o_custkey || '",3]' WHEN 1 THEN 'no json' WHEN 2 THEN '["' || repeat('x', 70) || '"]' ELSE '["only"]' END AS text FROM orders)""")
def f48_page_texts(t):
    """Page texts out of JSON: null beyond the size limit or where it is no array; at most a thousand, what is no text is empty."""
    key = F.col("o_orderkey") % 4
    text = F.when(key == 0, F.concat(F.lit('["a'), F.col("o_custkey").cast("string"), F.lit('",3]'))).when(key == 1, "no json").when(key == 2, F.concat(F.lit('["'), F.repeat(F.lit("x"), 70), F.lit('"]'))).otherwise('["only"]')
    pages = F.when((F.length("text") <= 60) & F.startswith(F.ltrim("text"), F.lit("[")), F.slice(F.from_json("text", "array<string>"), 1, 1000))
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text")).select("id", pages.alias("p")).select("id", F.col("p").isNull().alias("refused"), F.get("p", F.lit(0)).alias("first"))


@query("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'temel|ileri' WHEN 'HOUSEHOLD' THEN 'üniversite' ELSE 'genel' END AS categories, CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'ötr|ktr' ELSE 'rapor' END AS report_types FROM customer""")
def f53_structures(t):
    """Categories and report types of a competition, with a default for those that have no structure of their own: a small table, broadcast."""
    known = t.spark.createDataFrame([("MACHINERY", "temel|ileri", [["ötr"], ["ktr", "ötr"]]), ("HOUSEHOLD", "üniversite", [["ötr", "ktr"]])], "name string, categories string, stages array<array<string>>")
    types = F.array_join(F.array_distinct(F.flatten("stages")), "|")
    return t.customer.join(F.broadcast(known), F.trim("c_mktsegment") == F.col("name"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("categories", F.lit("genel")).alias("categories"), F.coalesce(types, F.lit("rapor")).alias("report_types"))
