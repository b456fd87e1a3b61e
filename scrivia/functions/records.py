"""Scalar functions of records: file kinds, accounts, evidence, findings, usage and generated lines, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.functions import text as x


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, or null."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in table.items())), key)


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column, fallback: str = "", most: int = 900) -> Column:
    """White space collapsed and cut; a null or empty text is the fallback."""
    cleaned = F.substring(flat(F.coalesce(text, F.lit(""))), 1, most)
    return F.when(cleaned == "", F.lit(fallback)).otherwise(cleaned)


def one_of(value: Column, allowed: tuple[str, ...], fallback: str | None) -> Column:
    return F.when(F.coalesce(value.isin(*allowed), F.lit(False)), value).otherwise(F.lit(fallback))


def page_or_null(page: Column, pages: Column) -> Column:
    """Rounded and held to 1..pages."""
    return F.least(pages, F.greatest(F.lit(1), F.floor(page + 0.5)))


def extension_of(name: Column) -> Column:
    """The part behind the last dot, if there is something on either side of it."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def file_kind(name: Column, mime: Column) -> Column:
    """struct<kind,label>: by MIME type, else by extension; some families show their short extension."""
    m = F.coalesce(mime, F.lit(""))
    by_mime = (
        F.when(m == "application/pdf", "pdf").when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("text/"), "text")
        .when(F.contains(m, F.lit("wordprocessingml")) | (m == "application/msword"), "word").when(F.contains(m, F.lit("spreadsheetml")) | (m == "application/vnd.ms-excel"), "excel")
        .when(F.contains(m, F.lit("presentationml")) | (m == "application/vnd.ms-powerpoint"), "powerpoint").when(F.contains(m, F.lit("zip")) | F.contains(m, F.lit("compressed")), "archive")
    )
    extension = extension_of(name)
    kind = F.coalesce(by_mime, lookup({e: kind for kind, (_, own) in k.FILE_KINDS.items() for e in own}, extension), F.lit("other"))
    shown = kind.isin(*k.SHOWS_EXTENSION) & F.length(extension).between(1, 4)
    return F.struct(kind.alias("kind"), F.when(shown, F.upper(extension)).otherwise(lookup({kind: label for kind, (label, _) in k.FILE_KINDS.items()}, kind)).alias("label"))


def integrity_error(content: Column) -> Column:
    """Why bytes are no sound PDF (short, header, damaged, truncated, no_xref, xref_range, xref_target), or null."""
    data = F.decode(content, "ISO-8859-1")
    size, tail = F.length(data), F.substring(data, F.greatest(F.length(data) - 65535, F.lit(1)), F.lit(65536))
    offset = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"startxref\s+(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")
    target = F.ltrim(F.regexp_replace(F.substring(data, (offset + 1).cast("int"), F.lit(96)), r"^\s+", ""))
    return (
        F.when(size < 5, "short").when(~F.contains(F.substring(data, 1, 1024), F.lit("%PDF-")), "header")
        .when(F.regexp_count(data, F.lit("ï¿½")) > F.greatest(F.lit(1024), F.floor(size * 0.01)), "damaged").when(~F.contains(tail, F.lit("%%EOF")), "truncated")
        .when(~tail.rlike(r"startxref\s+\d+"), "no_xref").when(F.coalesce(offset >= size, F.lit(True)), "xref_range").when(~target.rlike(r"^(?:xref\b|\d+\s+\d+\s+obj\b)"), "xref_target")
    )


def email(value: Column) -> Column:
    return F.lower(F.trim(value))


def username(value: Column) -> Column:
    """Letters, digits, dots, underscores and dashes; null where none is left."""
    kept = F.substring(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9._-]", ""), 1, 64)
    return F.when(kept != "", kept)


def safe_file_name(name: Column) -> Column:
    kept = F.substring(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""), 1, 120)
    return F.when(kept == "", "rapor.pdf").otherwise(kept)


def violation_status(action: Column) -> Column:
    return F.when(action == "block", "failed").when(action == "warn", "warning").otherwise("flagged")


def thinking_level(pages: Column) -> Column:
    return F.when(pages >= 80, "HIGH").when(pages >= 40, "MEDIUM").otherwise("LOW")


def usage(prompt: Column, candidates: Column, thoughts: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct(zero(prompt).alias("prompt"), (zero(candidates) + zero(thoughts)).alias("output"))


def positive_integer(value: Column, fallback: int) -> Column:
    """A whole number above 0 out of a text, else the fallback."""
    number = F.trim(value).try_cast("double")
    return F.when((number > 0) & (number == F.floor(number)), number.cast("bigint")).otherwise(F.lit(fallback).cast("bigint"))


def body_too_large(length: Column, most: int) -> Column:
    return F.coalesce(length.try_cast("double") > most, F.lit(False))


def page_limit_of(name: Column, quote: Column, description: Column) -> Column:
    """The page limit of a rule: from its name and quotation, else from its description."""
    return F.coalesce(x.parse_page_limit(F.concat_ws(" ", name, quote)), x.parse_page_limit(description))


def language_label(code: Column) -> Column:
    return lookup(k.LANGUAGE_LABELS, code)


def language_status(detected: Column, expected: Column) -> Column:
    return F.when(detected == "unknown", "warning").when(x.language_mismatch(detected, expected), "flagged").otherwise("passed")


def page_number_line(line: Column) -> Column:
    return F.trim(line).rlike(r"(?i)^(sayfa\s*)?\d{1,4}(\s*[/-]\s*\d{1,4})?$")


def without_names(text: Column, names: Column) -> Column:
    """The text with every name of four characters or more blanked, whatever its case."""
    wanted = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n) >= 4)
    return F.aggregate(wanted, text, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\Q"), F.replace(n, F.lit(r"\E"), F.lit("")), F.lit(r"\E")), F.lit(" ")))


def outside_pdf(verdict: Column) -> Column:
    return verdict == "DEGERLENDIRILEMEDI"


def similarity_result(kind: Column, status: Column, detail: Column) -> Column:
    """struct<percent,closest> out of a check's message; null for other checks."""
    percent = F.regexp_extract(detail, r"%\s?(\d{1,3})", 1)
    first = F.regexp_extract(detail, r"En yakın eşleşme:\s*(.+?)\s*\(%", 1)
    closest = F.when(first != "", first).otherwise(F.regexp_extract(detail, "\"(.+?)\"\\s+ile\\s+%", 1))
    number = F.when((percent != "") & (status != "skipped"), F.least(F.lit(100), percent.try_cast("int")))
    return F.when(kind == "similarity", F.struct(number.alias("percent"), F.when(closest != "", F.trim(closest)).alias("closest")))


def evidence_list(items: Column, pages: Column) -> Column:
    """At most four pieces of evidence (page, paragraph, section, text), cleaned; those without a text go."""
    one = lambda e: F.struct(
        page_or_null(e["page"], pages).alias("page"), F.when(e["paragraph"] >= 1, F.floor(e["paragraph"] + 0.5)).alias("paragraph"), clean_text(e["section"], "", 140).alias("section"), clean_text(e["text"], "", 360).alias("text")
    )
    return F.filter(F.transform(F.slice(F.coalesce(items, F.array().cast("array<struct<page:double,paragraph:double,section:string,text:string>>")), 1, 4), one), lambda e: e["text"] != "")


def string_list(items: Column, most: int) -> Column:
    """Trimmed non-empty entries, at most so many."""
    return F.slice(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: F.coalesce(s != "", F.lit(False))), 1, most)


def negative_line(judge: Column, name: Column, reason: Column, mode: Column, page: Column, section: Column, quote: Column, missing: Column, rationale: Column) -> Column:
    """The line that tells a participant why a criterion failed: the judge's reason where they rejected the finding, else the finding's."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    place = F.concat(F.lit("(rapor s. "), page.cast("string"), F.when(has(section), F.concat(F.lit(" · "), F.trim(section))).otherwise(""), F.lit(")"))
    quoted = F.when(has(quote), F.concat(F.lit("“"), F.trim(quote), F.lit("”")))
    own = F.concat_ws(
        " ", F.concat(name, F.lit(" — "), F.trim(reason)), F.when((mode == "PDF_KONUMU") & (page > 0), place), F.when(mode == "PDF_KONUMU", quoted),
        F.when(mode == "RAPORDA_BULUNAMADI", F.concat(F.lit("(Raporda bulunamadı: "), F.trim(missing), F.lit(")"))),
    )
    ai = F.concat_ws(" ", F.concat(name, F.lit(" — "), F.when(has(rationale), F.trim(rationale)).otherwise("Hakem tarafından olumsuz kesinleştirildi.")), F.when(page > 0, place), quoted)
    return F.when(judge == "rejected", own).otherwise(ai)


def audit_line(name: Column, ai: Column, result: Column, reason: Column) -> Column:
    label = {"UYGUN": "Uygun", "OLUMSUZ": "Olumsuz"}
    why = F.trim(F.coalesce(reason, F.lit("")))
    return F.concat(name, F.lit(" · AI bulgusu ("), lookup(label, ai), F.lit(") reddedildi → Hakem sonucu: "), F.coalesce(lookup(label, result), F.lit("—")), F.when(why != "", F.concat(F.lit(" · Gerekçe: "), F.substring(why, 1, 300))).otherwise(""))


def unsupported_reasons(quote: Column, page: Column, pages: Column) -> Column:
    """What a document's criterion lacks: its quotation, its page, or a page inside the document."""
    return F.filter(
        F.array(
            F.when(F.trim(F.coalesce(quote, F.lit(""))) == "", F.lit("alıntı yok")), F.when(page.isNull(), F.lit("sayfa yok")),
            F.when((pages > 0) & ((page < 1) | (page > pages)), F.concat(F.lit("sayfa "), page.cast("string"), F.lit(" PDF dışında"))),
        ), lambda r: r.isNotNull(),
    )


def hit_count(text: Column, keywords: Column) -> Column:
    low = x.tr_lower(text)
    return F.size(F.filter(keywords, lambda w: F.contains(low, x.tr_lower(w))))


def redacted_evaluation(evaluation: Column) -> Column:
    """An evaluation (report, findings, similarity) as operations may see it: no names, reasons, quotations or percents."""
    findings = F.transform(evaluation["findings"], lambda f: f.withField("rationale", F.lit("")).withField("evidence", F.array().cast("array<string>")))
    similarity = F.when(evaluation["similarity"].isNotNull(), evaluation["similarity"].withField("closest", F.lit(None).cast("string")).withField("percent", F.lit(None).cast("int")))
    return evaluation.withField("report.name", F.lit("")).withField("findings", findings).withField("similarity", similarity)
