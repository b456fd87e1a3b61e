"""Text normalisers and document checks as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivia import constants as k


def tr_lower(text: Column) -> Column:
    """Lower case by the Turkish rule: I to dotless i, I with dot to i."""
    dotted = F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("İ"), F.lit("i"))
    return F.lower(F.replace(dotted, F.lit("I"), F.lit("ı")))


def fold(text: Column) -> Column:
    """The fold of search and slugs; punctuation stays."""
    return F.translate(tr_lower(text), k.SEARCH_FROM, k.SEARCH_TO)


def _letters_of(char: str) -> str:
    """The ASCII letters and digits of a character's compatibility decomposition, other signs as spaces."""
    marks = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", char.lower()))
    return re.sub("[^a-z0-9]+", " ", marks.replace("ı", "i"))


#: By rule: every character of the basic plane beyond ASCII that stands for letters or digits, one or several.
_FOLDED = {c: own for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if c not in "İ" and (own := _letters_of(c)).strip()}
_ONE = {c: own for c, own in _FOLDED.items() if len(own) == 1}
_MANY = {c: own for c, own in _FOLDED.items() if len(own) > 1}
#: Ranges around the characters of _MANY; a text without any of them is not searched for each.
_SPELLED = "[¼-¾Ĳ-ŉǄ-ǳẚ₨℀-↉⑩-⒵㉑-㋎㍘-㏿ﬀ-ﬆ]"


def _plain(text: Column) -> Column:
    return F.replace(F.regexp_replace(F.translate(tr_lower(text), k.ACCENTED + "ğş", k.PLAIN + "gs"), "[̀-ͯ]", ""), F.lit("ı"), F.lit("i"))


def fold_line(text: Column) -> Column:
    """The fold of lines, chunk keys and signatures: compatibility characters count as the letters and digits they stand for."""
    pairs = F.array(*(F.struct(F.lit(c).alias("a"), F.lit(own).alias("b")) for c, own in _MANY.items()))
    spelled = F.when(text.rlike(_SPELLED), F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(text)
    low = F.translate(tr_lower(spelled), "".join(_ONE), "".join(_ONE.values()))
    low = F.replace(F.regexp_replace(low, "[̀-ͯ]", ""), F.lit("ı"), F.lit("i"))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), low).otherwise(F.lower(text))  # in ASCII alone every letter's fold is its lower case
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def fold_key(text: Column) -> Column:
    """The fold of rule names: canonical decompositions only, so ligatures, full-width letters and the like split words here, as any other sign does."""
    return F.trim(F.regexp_replace(_plain(text), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def fold_line_exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold_line by Python's own Unicode decomposition, also beyond the basic plane."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        low = text.replace("İ", "i").replace("I", "ı").replace("İ", "i").lower()
        marks = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", low)).replace("ı", "i")
        return " ".join(re.sub("[^a-z0-9]+", " ", marks).split())

    for series in texts:
        yield series.map(one)


def normalized_words(text: Column) -> Column:
    """Tokens of signatures: folded, longer than one character."""
    return F.filter(F.split(fold_line(text), " "), lambda w: F.length(w) > 1)


def words_of(text: Column) -> Column:
    """Tokens of document checks: accents stay, other letters split words."""
    return F.filter(F.split(tr_lower(text), "[^a-zçğıöşüâîû0-9]+"), lambda w: w != "")


def slug_key(*parts: Column) -> Column:
    """Slugs of the parts that have one, joined by two dashes, at most 220 characters; every run of other characters is one dash inside a slug."""
    slug = lambda p: F.regexp_replace(F.regexp_replace(fold(p), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(F.concat_ws("--", *(F.when(slug(p) != "", slug(p)) for p in parts)), 1, 220)


_LETTER = "[a-zçğıöşüâîû0-9]"


_RUN = re.compile(f"{_LETTER}+")


def _language_of(turkic: str, low: str) -> str:
    words = _RUN.findall(turkic)
    if len(words) < 40:
        return "unknown"
    turkish, english = Counter(words), Counter(_RUN.findall(low))
    turkish, english = sum(turkish[w] for w in k.TURKISH_STOPWORDS), sum(english[w] for w in k.ENGLISH_STOPWORDS)
    score = turkish + (min(sum(map(low.count, "çğıöşü")) / 40, turkish + 5) if turkish else 0)
    return "tr" if score > english else "en" if english > score else "unknown"


@F.arrow_udf(T.StringType())
def _languages(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for turkic, low in texts:
        yield pa.array((_language_of(a or "", b or "") for a, b in zip(turkic.to_pylist(), low.to_pylist())), pa.string())


def detect_language(text: Column) -> Column:
    """tr, en or unknown; each text is cut into words once by either lower case, and its words are counted."""
    return _languages(tr_lower(text), F.lower(text))


def expected_language_code(expected: Column) -> Column:
    low = tr_lower(expected)
    return F.when(low.rlike("türk|turk"), "tr").when(low.rlike("ingiliz|english"), "en")


def language_mismatch(detected: Column, expected: Column) -> Column:
    code = expected_language_code(expected)
    return F.coalesce(code.isNotNull() & (detected != "unknown") & (detected != code), F.lit(False))


def parse_page_limit(text: Column) -> Column:
    found = F.regexp_extract(tr_lower(text), r"(?:en fazla|azami|maksimum|en çok)\s*(\d{1,3})\s*(?:\([^)]{1,24}\)\s*)?sayfa", 1)
    return F.when(found != "", found.cast("int"))


def keywords_of(name: Column) -> Column:
    return F.filter(words_of(name), lambda w: (F.length(w) >= 4) & ~w.isin(*k.KEYWORD_STOPWORDS))


def words_match(keyword: Column, word: Column) -> Column:
    """The page word begins with the keyword's stem of at most five characters."""
    stem = F.least(F.lit(5), F.length(keyword))
    return (F.length(word) >= stem) & (F.substring(keyword, F.lit(1), stem) == F.substring(word, F.lit(1), stem))


def resolve_verifiability(explicit: Column, name: Column, description: Column, source: Column) -> Column:
    hay = fold_key(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(source, F.lit(""))))
    any_of = lambda markers: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(hay, m))
    known = explicit.isin("PDF_DENETLENEBILIR", "HARICI_KANIT_GEREKLI", "HAKEM_KONTROLU_GEREKLI")
    return F.when(known, explicit).when(any_of(k.EXTERNAL_EVIDENCE_MARKERS), "HARICI_KANIT_GEREKLI").when(any_of(k.JUDGE_REVIEW_MARKERS), "HAKEM_KONTROLU_GEREKLI").otherwise("PDF_DENETLENEBILIR")


def quote_of(text: Column, most: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def page_count(source: Column, fallback: Column) -> Column:
    """struct<pages,trusted,upper> of a PDF's bytes read as Latin-1."""
    direct = F.regexp_count(source, F.lit(r"/Type\s*/Page(?!s)\b"))
    pattern = r"(?:/Type\s*/Pages\b[\s\S]{0,500}?/Count\s+(\d+)|/Count\s+(\d+)[\s\S]{0,500}?/Type\s*/Pages\b)"
    counts = F.zip_with(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), F.regexp_extract_all(source, F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a, b).cast("bigint"))
    tree = F.coalesce(F.array_max(F.filter(counts, lambda c: (c > 0) & (c <= 1000))), F.lit(0).cast("bigint"))
    upper = F.greatest(direct.cast("bigint"), tree, fallback.cast("bigint"), F.lit(1).cast("bigint"))
    pages = F.when(direct > 0, direct.cast("bigint")).when(tree > 0, tree).otherwise(fallback.cast("bigint"))
    trusted = ((direct > 0) & ((tree == 0) | (tree == direct))) | ((direct == 0) & (tree > 0))
    return F.struct(pages.alias("pages"), trusted.alias("trusted"), upper.alias("upper"))
