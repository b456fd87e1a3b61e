"""Document gates, heading search, stage verdicts, review validation, ranked search and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.functions import text as x
from scrivia.functions import vectors as v
from scrivia.lineage import cut
from scrivia.operators import rules
from scrivia.operators.logs import numbered
from scrivia.operators.similarity import rounded

#: The engine's own limit, in MB.
ENGINE_MB = 50


def file_gate(name: Column, size: Column, *, formats: tuple[str, ...] = (), max_mb: float = 0, max_files: int = 0, existing: Column | None = None, on_violation: str = "failed") -> Column:
    """array<struct<id,status>>: two checks of the engine, and those rules that are set."""
    extension = F.upper(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    mb = size / 1024 / 1024
    check = lambda key, ok, bad="failed": F.struct(F.lit(key).alias("id"), F.when(ok, "passed").otherwise(bad).alias("status"))
    checks = [check("engine-format", F.endswith(x.tr_lower(name), F.lit(".pdf"))), check("engine-size", mb <= ENGINE_MB)]
    if formats:
        checks.append(check("gate-format", extension.isin(*(f.removeprefix(".").upper() for f in formats)), on_violation))
    if max_mb > 0:
        checks.append(check("gate-size", mb <= max_mb, on_violation))
    if max_files > 0:
        checks.append(check("gate-count", (F.lit(0) if existing is None else existing) + 1 <= max_files, on_violation))
    return F.array(*checks)


def stage_verdicts(findings: DataFrame, stages: tuple[str, ...], *, id_col: str) -> DataFrame:
    """Every stage of every report, also those without findings; without a required rule a stage is REVIZYON at most."""
    own = findings.groupBy(id_col, "stage").agg(rules.worst_verdict(F.col("verdict")).alias("worst"), F.max(F.col("required") & (F.col("verdict") != "DEGERLENDIRILEMEDI")).alias("strict"))
    every = findings.select(id_col).distinct().select(id_col, F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    capped = F.when((F.col("worst") == "KRITIK_HATA") & ~F.coalesce("strict", F.lit(False)), "REVIZYON").otherwise(F.coalesce("worst", F.lit("BASARILI")))
    return every.join(own, [id_col, "stage"], "left").select(id_col, "stage", capped.alias("verdict"))


def feedback(findings: DataFrame, *, id_col: str, order: str) -> DataFrame:
    """(id_col, strengths, improvements, suggestions): at most six, eight and six lines, in the findings' order; what a PDF cannot show is left out."""
    side = F.when(F.col("verdict") == "BASARILI", "s").when(F.col("verdict") != "DEGERLENDIRILEMEDI", "i")
    rows = findings.withColumn("_side", side).filter("_side is not null")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(id_col, "_side").orderBy(order))).filter(F.col("_r") <= F.when(F.col("_side") == "s", 6).otherwise(8))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == s, F.struct("_r", "line")))), lambda p: p["line"])
    advice = F.when(F.col("verdict") == "KRITIK_HATA", F.concat(F.lit("“"), F.col("name"), F.lit("” zorunlu kuralı için şartnamedeki koşulu karşılayan, kanıtlanabilir bir bölüm ekleyin.")))
    advice = F.coalesce(advice, F.concat(F.lit("“"), F.col("name"), F.lit("” bölümündeki eksik kanıtları ölçüm, tablo veya doğrulama sonucu ile tamamlayın.")))
    suggested = F.transform(F.array_sort(F.collect_list(F.when((F.col("_side") == "i") & (F.col("_r") <= 6), F.struct("_r", advice.alias("line"))))), lambda p: p["line"])
    return rows.groupBy(id_col).agg(listed("s").alias("strengths"), listed("i").alias("improvements"), suggested.alias("suggestions"))


def decision_error(judge: Column, result: Column, reason: Column, mode: Column, page: Column, quote: Column, missing: Column) -> Column:
    """The first rule that a decision breaks, or an empty text; pending and approved ones break none."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = F.coalesce(result.isin("UYGUN", "OLUMSUZ"), F.lit(False))
    known = F.coalesce(mode.isin("PDF_KONUMU", "RAPORDA_BULUNAMADI"), F.lit(False))
    return (
        F.when(judge.isin("pending", "approved"), "").when(~own, "result").when(blank(reason), "reason").when(~known, "mode")
        .when((mode == "PDF_KONUMU") & (F.coalesce(page, F.lit(0)) < 1), "page").when((mode == "PDF_KONUMU") & blank(quote), "quote")
        .when((mode == "RAPORDA_BULUNAMADI") & blank(missing), "missing").otherwise("")
    )


def ranked_search(entries: DataFrame, wanted: str, *, name_col: str, field_col: str, order: str, limit: int) -> DataFrame:
    """Entries that hold every token, names that begin with the query first, then those with a word that begins with its first token; total counts all."""
    import re

    # The fold of a query is taken by the same rule as that of a column.
    query = wanted.strip().replace("İ", "i").replace("I", "ı").lower().translate(str.maketrans(k.SEARCH_FROM, k.SEARCH_TO))
    tokens = query.split()
    name = x.fold(F.col(name_col))
    hay = F.concat_ws(" ", name, x.fold(F.col(field_col)))
    rows = entries
    for token in tokens:
        rows = rows.filter(F.contains(hay, F.lit(token)))
    java = re.sub(r"([^\w\s])", r"\\\1", tokens[0]) if tokens else ""
    rank = F.when(F.startswith(name, F.lit(query)), 0).when(name.rlike(rf"(?:^|\s){java}"), 1).otherwise(2) if tokens else F.lit(0)
    ranked = rows.withColumn("rank", rank)
    best = ranked.orderBy("rank", order).limit(limit)
    return best.join(F.broadcast(ranked.agg(F.count("*").alias("total"))))


def least_loaded(queue: DataFrame, judges: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """Queue rows with the judge that taking the least loaded one, row after row, would give them; without judges, no rows.

    judges: (judge, load, scoped, since). Of equally loaded judges those go first who have a file of the competition (scoped > 0, or one given before in
    this queue), then longer service. A judge of load l has one slot at each level l, l + 1, ...; the n-th row takes the n-th slot. How many slots
    lie below a level is arithmetic, and above the greatest load every level is the same list, so no slot is ever written out. Queues of different keys are apart.
    """
    loads = judges.groupBy("load").agg(F.count("*").alias("_c"))
    ends = judges.agg(F.min("load").alias("_low"), F.max("load").alias("_high"), F.count("*").alias("_all"))
    levels = ends.filter("_all > 0").select("_low", "_high", F.explode(F.sequence("_low", F.col("_high") + 1)).alias("_level"))
    # slots below a level: every judge of less load has one at each level from their own on
    below = levels.join(F.broadcast(loads), F.col("load") < F.col("_level"), "left").groupBy("_level", "_high").agg(F.coalesce(F.sum((F.col("_level") - F.col("load")) * F.col("_c")), F.lit(0)).alias("_below"))
    # levels that begin beyond the longest queue are never reached, so there are no more places than rows of that queue and judges
    most = queue.groupBy(key).agg(F.count("*").alias("_rows")).agg(F.max("_rows").alias("_most"))
    table = below.join(F.broadcast(most), F.col("_below") < F.col("_most")).agg(F.array_sort(F.collect_list(F.struct("_below", "_level"))).alias("_levels"), F.first("_high").alias("_top")).join(ends.select("_all"))
    table = cut(table)
    reached = table.select(F.transform("_levels", lambda v: v["_level"])).scalar()
    places = judges.withColumn("_reached", reached).withColumn("_level", F.explode(F.filter("_reached", lambda n: n >= F.col("load"))))
    after = ~((F.col("load") < F.col("_level")) | (F.col("scoped") > 0))
    places = numbered(places.select("_level", after.alias("_after"), "since", "judge"), "_level", ["_after", "since", "judge"]).select(F.col("_level").alias("_l"), F.col("_n").alias("_q"), "judge")
    of = lambda c: table.select(c).scalar()
    rows = numbered(queue, key, order).withColumns({"_levels": of("_levels"), "_top": of("_top"), "_all": of("_all")})
    at = F.element_at(F.filter("_levels", lambda v: v["_below"] <= F.col("_n")), -1)
    rows = rows.withColumn("_at", at).withColumn("_off", F.col("_n") - F.col("_at._below"))
    rows = rows.withColumn("_off", F.when(F.col("_at._level") > F.col("_top"), F.col("_off") % F.col("_all")).otherwise(F.col("_off")))
    return rows.join(places, (F.col("_at._level") == F.col("_l")) & (F.col("_off") == F.col("_q"))).select(*queue.columns, "judge")
