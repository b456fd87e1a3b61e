"""Evaluation of reports: page clean-up, criteria, findings, stages, decisions, profiles and their versions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.functions import records as r
from scrivia.functions import text as x
from scrivia.operators import rules


def normalize_pages(pages: DataFrame, *, id_col: str, page_col: str, text_col: str, names_col: str) -> DataFrame:
    """(id_col, page_col, text) of every page without names, page numbers, and short lines that stand on most pages of a report.

    A line counts once a page; the limit is three pages or 60 % of them. A page that loses all its lines is empty.
    """
    stripped = pages.select(id_col, page_col, r.without_names(F.col(text_col), F.col(names_col)).alias("_t"))
    lines = stripped.select(id_col, page_col, F.posexplode(F.split("_t", "\n+")).alias("_pos", "_line"))
    trimmed = F.trim("_line")
    lines = lines.select(id_col, page_col, "_pos", "_line", F.when((F.length(trimmed) <= 120) & (x.fold_line(trimmed) != ""), F.xxhash64(x.fold_line(trimmed))).alias("_key"), ((trimmed == "") | r.page_number_line(F.col("_line"))).alias("_out"))
    seen = lines.filter("_key is not null").groupBy(id_col, "_key").agg(F.count_distinct(page_col).alias("_seen")).filter("_seen >= 3")
    count = pages.groupBy(id_col).agg(F.count("*").alias("_pages"))
    often = seen.join(count, id_col).filter(F.col("_seen") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.6))).select(F.col(id_col).alias("_id"), F.col("_key").alias("_k"))
    kept = lines.filter("not _out").join(often, (F.col(id_col) == F.col("_id")) & (F.col("_key") == F.col("_k")), "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda p: p["_line"]), "\n")
    joined = kept.groupBy(F.col(id_col).alias("_id"), F.col(page_col).alias("_page")).agg(F.trim(F.regexp_replace(text, "[ \t]+", " ")).alias("text"))
    return pages.select(id_col, page_col).join(joined, (F.col(id_col) == F.col("_id")) & (F.col(page_col) == F.col("_page")), "left").select(id_col, page_col, F.coalesce("text", F.lit("")).alias("text"))


def template_check(criteria: DataFrame, pages: DataFrame) -> DataFrame:
    """(profile, status, limits, violated): the page limits of a profile's active language and template rules against a report's pages."""
    own = criteria.filter("active and stage = 'language_template'").withColumn("_limit", r.page_limit_of(F.col("name"), F.col("quote"), F.col("description")))
    ruled = own.join(pages.select(F.col("profile").alias("_p"), "page_count"), F.col("profile") == F.col("_p")).groupBy("profile").agg(F.count("_limit").alias("limits"), F.count_if(F.col("page_count") > F.col("_limit")).alias("violated"))
    status = F.when(F.col("limits").isNull(), "skipped").when(F.col("limits") == 0, "warning").when(F.col("violated") > 0, "flagged").otherwise("passed")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select(F.col("profile").alias("_p")).join(ruled, F.col("_p") == F.col("profile"), "left").select(F.col("_p").alias("profile"), status.alias("status"), zero("limits"), zero("violated"))


def stage_rank(stage: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, k.STAGES)), stage), F.lit(9))


def cleaned_criteria(raw: DataFrame, *, pages: int) -> DataFrame:
    """Raw criteria with texts cleaned, pages rounded, `fate` dropped, no_page or null, and the two keys _a and _b by which they repeat each other."""
    page = F.floor(F.col("page") + 0.5)
    rows = raw.select("profile", "pos", r.clean_text(F.col("name"), "", 200).alias("name"), r.clean_text(F.col("quote"), "", 320).alias("quote"), r.one_of(F.col("stage"), k.STAGES, "criteria_evidence").alias("stage"), page.alias("page"), "required")
    fate = F.when((F.col("name") == "") | (F.col("quote") == ""), "dropped").when(~F.coalesce(F.col("page").between(1, pages), F.lit(False)), "no_page")
    name = F.concat_ws("|", "stage", x.fold_key(F.col("name")))
    return rows.withColumns({"fate": fate, "_a": F.concat(name, F.lit("|p:"), F.col("page").cast("string")), "_b": F.concat(name, F.lit("|t:"), F.substring(x.fold_key(F.col("quote")), 1, 160))})


def extraction_warnings(raw: DataFrame, *, pages: int) -> DataFrame:
    """(profile, no_page, duplicates, dropped): how many raw criteria of each profile have such a fate by judged_criteria; counted in one grouping, since no row of a criterion is needed."""
    rows = cleaned_criteria(raw, pages=pages)
    kept = rules.first_of_two_keys(dict(rows.dtypes), order="pos", first="_a", second="_b", where=F.col("fate").isNull())
    n = lambda fate, name: F.count_if(F.col("fate") == fate).alias(name)
    counted = rows.groupBy("profile").agg(n("no_page", "no_page"), n("dropped", "_bad"), F.count_if(F.col("fate").isNull()).alias("_good"), F.size(kept).alias("_kept"))
    return counted.select("profile", "no_page", (F.col("_good") - F.col("_kept")).alias("duplicates"), (F.col("_bad") + F.greatest(F.col("_kept") - k.MOST_CRITERIA, F.lit(0))).alias("dropped"))


def judged_criteria(raw: DataFrame, *, pages: int) -> DataFrame:
    """Raw criteria with `fate`: kept, duplicate, no_page or dropped; texts cleaned, pages rounded.

    A criterion repeats another of its profile and stage with an equal folded name where the page or the start of the quotation is equal too; what came
    first stays. The fold goes over one profile's criteria, whose number a document bounds.
    """
    rows = cleaned_criteria(raw, pages=pages)
    keyed, rows = rows.filter("fate is null").select("profile", "pos", "_a", "_b"), rows.drop("_a", "_b")
    kept = rules.keep_first_of_two_keys(keyed, group="profile", order="pos", first="_a", second="_b")
    kept = kept.select(F.col("profile").alias("_p"), F.col("pos").alias("_q"), F.row_number().over(Window.partitionBy("profile").orderBy("pos")).alias("_n"))
    joined = rows.join(kept, (F.col("profile") == F.col("_p")) & (F.col("pos") == F.col("_q")), "left")
    return joined.withColumn("fate", F.when(F.col("fate").isNotNull(), F.col("fate")).when(F.col("_n").isNull(), "duplicate").when(F.col("_n") > k.MOST_CRITERIA, "dropped").otherwise("kept")).drop("_p", "_q", "_n")


def extracted_criteria(judged: DataFrame) -> DataFrame:
    """Kept criteria numbered anew, by stage, then page, then place."""
    by = Window.partitionBy("profile").orderBy(stage_rank(F.col("stage")), F.coalesce("page", F.lit(2**31 - 1)), "pos")
    return judged.filter("fate = 'kept'").select("profile", F.concat(F.lit("criterion-"), F.row_number().over(by).cast("string")).alias("id"), "name", "stage", "page", "required")


def findings_of(criteria: DataFrame, raw: DataFrame, pages: DataFrame) -> DataFrame:
    """A finding for every active criterion that a PDF can show: the model's, else REVIZYON without evidence.

    Only a required criterion may be a KRITIK_HATA. A page limit settles its own finding: broken it fails, kept it needs no evidence.
    raw: (profile, id, verdict, evidence: number of pieces); pages: (profile, page_count).
    """
    own = criteria.filter("active").filter(F.coalesce(F.col("verifiability") == "PDF_DENETLENEBILIR", F.lit(True)))
    own = own.withColumn("_limit", F.when(F.col("stage") == "language_template", r.page_limit_of(F.col("name"), F.col("quote"), F.col("description"))))
    given = raw.select(F.col("profile").alias("_p"), F.col("id").alias("_i"), F.col("verdict").alias("_v"), F.col("evidence").alias("_e"))
    count = pages.select(F.col("profile").alias("_q"), "page_count")
    rows = own.join(given, (F.col("profile") == F.col("_p")) & (F.col("id") == F.col("_i")), "left").join(count, F.col("profile") == F.col("_q"), "left")
    said = r.one_of(F.col("_v"), ("BASARILI", "REVIZYON", "KRITIK_HATA"), "REVIZYON")
    fair = F.when((said == "KRITIK_HATA") & ~F.col("required"), "REVIZYON").otherwise(said)
    broken = F.col("page_count") > F.col("_limit")
    verdict = F.when(broken, F.when(F.col("required"), "KRITIK_HATA").otherwise("REVIZYON")).otherwise(fair)
    return rows.select("profile", "id", "stage", "required", verdict.alias("verdict"), (F.col("_limit").isNull() & (F.coalesce("_e", F.lit(0)) == 0)).alias("evidence_missing"), F.col("_i").isNull().alias("model_silent"))


def offline_findings(criteria: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings without a model: page limits are measured, what a PDF cannot show is not judged, all else is left to the judge as REVIZYON."""
    rows = criteria.filter("active").join(pages.select(F.col("profile").alias("_q"), "page_count"), F.col("profile") == F.col("_q"), "left")
    limit = F.when(F.col("stage") == "language_template", r.page_limit_of(F.col("name"), F.col("quote"), F.col("description")))
    outside = F.coalesce(F.col("verifiability") != "PDF_DENETLENEBILIR", F.lit(False))
    verdict = F.when(outside, "DEGERLENDIRILEMEDI").when(limit.isNull(), "REVIZYON").when(F.col("page_count") <= limit, "BASARILI").when(F.col("required"), "KRITIK_HATA").otherwise("REVIZYON")
    return rows.select("profile", "id", "stage", "required", verdict.alias("verdict"), (~outside & limit.isNull()).alias("evidence_missing"))


def evaluated(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """A report's four stage verdicts, counts and overall verdict.

    reports (profile, mismatch, missing_headings): a language mismatch lifts stage one, missing headings stage two, to REVIZYON at least; a stage
    without a required finding is REVIZYON at most.
    """
    rank = rules.verdict_rank(F.col("verdict"))
    parts = []
    for n, stage in enumerate(k.STAGES):
        here = F.col("stage") == stage
        parts += [F.greatest(F.lit(0), F.coalesce(F.max(F.when(here, rank)), F.lit(0))).alias(f"_w{n}"), F.coalesce(F.bool_or(F.when(here, F.col("required") & ~r.outside_pdf(F.col("verdict")))), F.lit(False)).alias(f"_s{n}")]
    own = findings.groupBy(F.col("profile").alias("_p")).agg(*rules.verdict_counts(F.col("verdict")), *parts)
    rows = reports.join(own, F.col("profile") == F.col("_p"), "left")
    floor = {0: F.when(F.col("mismatch"), 1).otherwise(0), 1: F.when(F.col("missing_headings") > 0, 1).otherwise(0)}
    capped = []
    for n in range(len(k.STAGES)):
        lifted = F.greatest(F.coalesce(F.col(f"_w{n}"), F.lit(0)), floor.get(n, F.lit(0)))
        capped.append(F.when((lifted == 2) & ~F.coalesce(F.col(f"_s{n}"), F.lit(False)), 1).otherwise(lifted))
    overall = F.greatest(*capped, F.coalesce(rules.verdict_rank(F.col("overall")), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("profile", *map(zero, ("total", "basarili", "revizyon", "kritik", "dis_kanit")), *(rules.verdict_of_rank(c).alias(s) for c, s in zip(capped, k.STAGES)), rules.verdict_of_rank(overall).alias("overall"))


def stage_summary(total: Column, good: Column, revise: Column, bad: Column, outside: Column, title: str) -> Column:
    text = F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in (total.cast("string"), " kural kontrol edildi: ", good.cast("string"), f" {k.VERDICT_LABELS['BASARILI']}, ", revise.cast("string"), f" {k.VERDICT_LABELS['REVIZYON']}, ", bad.cast("string"), f" {k.VERDICT_LABELS['KRITIK_HATA']}")))
    more = F.when(outside > 0, F.concat(F.lit(", "), outside.cast("string"), F.lit(" kural PDF dışı kanıt gerektiriyor"))).otherwise("")
    return F.when(total == 0, F.lit(f"{title}: bu aşamaya bağlı aktif kriter yok.")).otherwise(F.concat(text, more, F.lit(".")))


def restored_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Visible findings with the judge's stored decision on each; without one, or with an unknown one, it is pending. The AI's verdict is always the finding's."""
    stored = decisions.select(F.col("report").alias("_r"), F.col("criterion").alias("_c"), "judge", "judge_result", "reason", "mode", "page", "section", "quote", "missing")
    shown = findings.filter(~r.outside_pdf(F.col("verdict"))).select("report", "criterion", "name", "verdict", "rationale")
    rows = shown.join(stored, (F.col("report") == F.col("_r")) & (F.col("criterion") == F.col("_c")), "left").drop("_r", "_c")
    ai = F.when(F.col("verdict") == "BASARILI", "UYGUN").otherwise("OLUMSUZ")
    judge = r.one_of(F.col("judge"), ("approved", "rejected"), "pending")
    return rows.withColumn("ai", ai).withColumn("judge", judge).withColumn("effective", rules.effective_verdict(judge, ai, F.col("judge_result")))


def judge_feedback(restored: DataFrame) -> DataFrame:
    """(report, strengths, improvements, pending): lines of what is settled, in the criteria's order."""
    c = F.col
    line = r.negative_line(c("judge"), c("name"), c("reason"), c("mode"), c("page"), c("section"), c("quote"), c("missing"), c("rationale"))
    rows = restored.withColumn("_line", F.when(c("effective") == "UYGUN", F.concat(F.lit("✓ "), c("name"))).when(c("effective") == "OLUMSUZ", F.concat(F.lit("✕ "), line)))
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(c("effective") == side, F.struct("criterion", "_line")))), lambda p: p["_line"])
    return rows.groupBy("report").agg(listed("UYGUN").alias("strengths"), listed("OLUMSUZ").alias("improvements"), F.count_if(c("effective").isNull()).alias("pending"))


def decision_events(restored: DataFrame) -> DataFrame:
    """One audit event for each finding that its judge rejected."""
    c = F.col
    return restored.filter("judge = 'rejected'").select("report", "criterion", F.lit("judge_score_adjusted").alias("event"), r.audit_line(c("name"), c("ai"), c("judge_result"), c("reason")).alias("detail"))


def locked_sources(history: DataFrame, asked: DataFrame, *, version: str) -> DataFrame:
    """asked (profile, id, page, quote) with page and quote of each criterion's first version, and whether that changed them."""
    first = history.groupBy(F.col("profile").alias("_p"), F.col("id").alias("_i")).agg(F.min_by(F.struct("page", "quote"), version).alias("_s"))
    rows = asked.join(first, (F.col("profile") == F.col("_p")) & (F.col("id") == F.col("_i")), "left")
    known = F.col("_p").isNotNull()
    changed = known & ~(F.col("page").eqNullSafe(F.col("_s.page")) & F.col("quote").eqNullSafe(F.col("_s.quote")))
    return rows.select("profile", "id", F.when(known, F.col("_s.page")).otherwise(F.col("page")).alias("page"), F.when(known, F.col("_s.quote")).otherwise(F.col("quote")).alias("quote"), changed.alias("reverted"))


def matched_expectations(criteria: DataFrame, expected: list[tuple[str, list[str]]]) -> DataFrame:
    """(profile, expected, verdict, hits, pos): each expectation's best criterion, greedily: a full match claims its criterion.

    One profile's criteria are one group; their number is bounded by the document (MOST_CRITERIA).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        texts, claimed, out = list(rows["text"]), set(), []
        for name, keywords in expected:
            hits = [-1 if n in claimed else sum(w in t for w in keywords) for n, t in enumerate(texts)]
            best = max(range(len(hits)), key=lambda n: (hits[n], -n))
            found = max(hits[best], 0)
            if found == len(keywords):
                claimed.add(best)
            out.append((rows["profile"].iloc[0], name, "tam" if found == len(keywords) else "kismi" if found else "eksik", found, int(rows["pos"].iloc[best]) if found else None))
        return pd.DataFrame(out, columns=["profile", "expected", "verdict", "hits", "pos"]).astype({"pos": "Int64"})

    kind = dict(criteria.dtypes)["profile"]
    return criteria.select("profile", "pos", "text").groupBy("profile").applyInPandas(fold, f"profile {kind}, expected string, verdict string, hits int, pos bigint")


def profile_error(p: Column) -> Column:
    """The first rule that a profile breaks (version, setup, texts, formats, numbers, action, criteria, criterion, source), or an empty text."""
    legacy = p["version"] == "1.0"
    bad = lambda c: F.coalesce(c, F.lit(True))
    broken = F.exists(p["criteria"], lambda c: c["id"].isNull() | c["name"].isNull() | c["active"].isNull() | (~legacy & (bad(~c["stage"].isin(*k.STAGES)) | c["required"].isNull())))
    return (
        F.when(bad(~(p["version"].isin("1.0", "2.0") & (p["status"] == "approved"))), "version").when(p["competition"].isNull(), "setup").when(p["category"].isNull() | p["year"].isNull(), "texts")
        .when(p["formats"].isNull() | F.exists(p["formats"], lambda f: f.isNull()), "formats").when(bad(p["max_mb"] < 0) | bad(p["max_files"] < 0), "numbers").when(bad(~p["action"].isin(*k.VIOLATION_ACTIONS)), "action")
        .when(F.coalesce(F.size(p["criteria"]), F.lit(0)) < 1, "criteria").when(broken, "criterion").when(p["source"].isNull(), "source").otherwise("")
    )


def upgraded(kind: Column, effect: Column, applicability: Column, stage: Column, required: Column, active: Column, given: Column) -> Column:
    """struct<stage,required,active,verifiability> of a criterion of the scored model of before."""
    scope = F.coalesce(applicability, F.lit("report"))
    report, info = scope.isin("report", "upload"), (scope == "informational") | (F.coalesce(effect, F.lit("")) == "advisory")
    by_kind = F.when(kind.isin("format_rule", "technical_upload"), k.STAGES[0]).when(kind == "mandatory_content", k.STAGES[1]).otherwise(k.STAGES[3])
    must = F.coalesce(required, effect.isin("gate", "threshold", "penalty") | (kind == "elimination_review"), F.lit(False))
    shown = F.when(F.coalesce(given.isin(*k.VERIFIABILITY), F.lit(False)), given).when(info, k.VERIFIABILITY[2]).when(report, k.VERIFIABILITY[0]).otherwise(k.VERIFIABILITY[1])
    return F.struct(F.when(F.coalesce(stage.isin(*k.STAGES), F.lit(False)), stage).otherwise(by_kind).alias("stage"), must.alias("required"), (F.coalesce(active, F.lit(False)) & report & ~info).alias("active"), shown.alias("verifiability"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], tuple[int, list[list[float]]]], *, group: str, order: str, text: str) -> DataFrame:
    """(group, ok, vectors, calls): a document's texts in batches through `embed`, which gives (status, vectors).

    A batch that meets status 429 is tried once more; one batch without sound vectors fails the whole document.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wanted, out, calls = list(rows.sort_values(order)[text]), [], 0
        for at in range(0, len(wanted), k.EMBEDDING_BATCH):
            batch = wanted[at : at + k.EMBEDDING_BATCH]
            status, vectors = embed(batch)
            calls += 1
            if status == 429:
                status, vectors = embed(batch)
                calls += 1
            if status != 200 or len(vectors) != len(batch):
                return pd.DataFrame([(rows[group].iloc[0], False, [], calls)], columns=[group, "ok", "vectors", "calls"])
            out += [[float(f"{e:.5f}") for e in vector] for vector in vectors]
        return pd.DataFrame([(rows[group].iloc[0], True, out, calls)], columns=[group, "ok", "vectors", "calls"])

    return texts.select(group, order, text).groupBy(group).applyInPandas(run, f"{group} {dict(texts.dtypes)[group]}, ok boolean, vectors array<array<double>>, calls int")


def guarded_requests(requests: DataFrame, *, server: str, client: str, seq: str, ts: str, kind: str, window_s: int, most: int, most_all: int, at_once: int) -> DataFrame:
    """Requests of each server with `outcome`: ok, rate or concurrency; releases free a place.

    Windows begin at the first request that was let in, for a client and for all clients; a refused request counts nowhere. A server's own log is one group.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(seq)
        windows, busy, out = {}, 0, []
        for who, at, what in zip(rows[client], rows[ts], rows[kind]):
            if what == "release":
                busy = max(0, busy - 1)
                out.append("released")
                continue
            live = {key: w for key in (None, who) if (w := windows.get(key)) and (at - w[0]).total_seconds() < window_s}
            if any(key in live and live[key][1] >= cap for key, cap in ((None, most_all), (who, most))):
                out.append("rate")
            elif busy >= at_once:
                out.append("concurrency")
            else:
                for key in (None, who):
                    windows[key] = (live[key][0], live[key][1] + 1) if key in live else (at, 1)
                busy += 1
                out.append("ok")
        return rows[[server, seq]].assign(outcome=out)

    types = dict(requests.dtypes)
    return requests.select(server, seq, client, ts, kind).groupBy(server).applyInPandas(fold, f"{server} {types[server]}, {seq} {types[seq]}, outcome string")
