r"""Secret scans through a trigram inverted index; DataFrame and SQL functions only.

From each rule's regex a Boolean trigram query is derived: an OR of alternatives, each an AND of trigrams that every match
must hold. Postings (trigram, document) exist for the trigrams that any query names; they are
intersected per document, which has at most the queries' own trigrams. Only candidates are verified with the
regex itself. A rule without mandatory trigrams scans fully.

Postings stay rows that are dealt out by document, so neither a frequent trigram nor a hot source gathers
in one task, and no list of a trigram's documents is ever built.

Defined results: a null text is empty; equal ids are looked up together and verified one by one; a null id is an id like any other;
spans of different rules may overlap; with keep_text an input column named spans gives way, others pass, whatever their names;
spans that begin at one place are in the order of their rules; repeated rows get equal spans; a very long text is searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many exact strings a part of a regex may stand for before it counts as unknown.
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regex; matches shorter than least characters in group `group` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds and further well-known formats. Greedy runs with a least length are written as {n,}: the same matches.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("google_key", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")


def _strings(items: list) -> tuple[set[str] | None, list[set[str]]]:
    """(all strings the sequence stands for, or None; the sets of strings one of which every match holds)."""
    run: set[str] | None = {""}
    whole, needed = True, []

    def close() -> None:
        if run is not None and run != {""}:
            needed.append(run)

    for code, arg in items:
        exact, inner = None, []
        if code is op.LITERAL:
            exact = {chr(arg).lower()}
        elif code is op.IN and arg[0][0] is not op.NEGATE and all(k in (op.LITERAL, op.RANGE) for k, _ in arg):
            letters = {chr(c).lower() for k, v in arg for c in ([v] if k is op.LITERAL else range(v[0], v[1] + 1))}
            exact = letters if len(letters) <= 8 else None
        elif code is op.SUBPATTERN:
            exact, inner = _strings(arg[-1])
        elif code is op.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = arg
            own, within = _strings(body)
            if own is not None and high != op.MAXREPEAT and high <= 4:
                exact = {"".join(x) for n in range(low, high + 1) for x in product(own, repeat=n)} if len(own) ** high <= _MOST else None
            elif low and own is not None and len(own) ** min(low, 3) <= _MOST:
                inner = [{"".join(x) for x in product(own, repeat=min(low, 3))}]
            elif low:
                inner = within
        joined = {a + b for a in run for b in exact} if run is not None and exact is not None else None
        if joined is not None and len(joined) <= _MOST:
            run = joined
            continue
        close()
        needed += inner
        whole = False
        run = exact if exact is not None and len(exact) <= _MOST else {""}
    close()
    return (run if whole else None), needed


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives (OR) of trigrams (AND) in lower case; empty where the regex names no mandatory trigram."""
    _, needed = _strings(parser.parse(pattern))
    usable = [s for s in needed if all(len(x) >= 3 for x in s)]
    if not usable:
        return []
    best = min(usable, key=lambda s: (-min(map(len, s)), len(s)))
    joined = frozenset().union(*(trigrams(next(iter(s))) for s in usable if len(s) == 1))
    found = {trigrams(x) | joined for x in best}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)  # a wider AND adds nothing to an OR


def postings(docs: DataFrame, grams: list[str], *, id_col: str, text_col: str) -> DataFrame:
    """(id, gram) for the named trigrams that the lower-cased text holds."""
    lowered = F.lower(F.col(text_col))
    held = F.filter(F.array(*(F.when(F.contains(F.col("_t"), F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return docs.select(F.col(id_col).alias("_id"), lowered.alias("_t")).select("_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], *, id_col: str, text_col: str) -> DataFrame:
    """(id, rules): documents with the rules one of whose alternatives has all its trigrams there."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({gram for alternatives in queries.values() for alternative in alternatives for gram in alternative})
    rows = postings(docs, grams, id_col=id_col, text_col=text_col).groupBy("_id").agg(F.collect_set("gram").alias("grams"))  # at most the queries' trigrams each
    holds = lambda alternative: reduce(and_, (F.array_contains("grams", g) for g in sorted(alternative)))
    found = [F.when(reduce(or_, map(holds, alternatives)), F.lit(kind)) for kind, alternatives in queries.items() if alternatives]
    return rows.select("_id", F.filter(F.array(*found), lambda k: k.isNotNull()).alias("rules")).filter(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<begin,kind_rank,kind,end>> of the rule's leftmost non-overlapping matches, in code points, end excluded."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), groups.alias("part"))
    none = F.array().cast("array<struct<begin:long,end:long,part:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.length(x["part"]).cast("long").alias("part")))).alias("out"))

    every = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), F.filter(every, lambda s: s["part"] >= rule.least)).otherwise(none)


SPAN = "array<struct<begin:long,kind:string,end:long,rank:int>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row's id with `spans`, ordered by begin, then as the rules are listed; with keep_text all columns of docs."""
    full = [r for r in rules if not trigram_query(r.pattern)]
    found = candidates(docs, rules, id_col=id_col, text_col=text_col)
    marked = docs.join(found, docs[id_col].eqNullSafe(found["_id"]), "left")  # by DataFrame: docs may have columns of these names
    text = F.coalesce(docs[text_col], F.lit(""))
    none = F.array().cast(SPAN)
    tagged = lambda kind, rank: lambda s: F.struct(s["begin"].alias("begin"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(rank).alias("rank"))
    each = []
    for rank, rule in enumerate(rules):
        own = F.transform(spans_of(text, rule), tagged(rule.kind, rank))
        each.append(own if rule in full else F.when(F.array_contains(found["rules"], rule.kind), own).otherwise(none))
    by_place = lambda a, b: F.when(a["begin"] != b["begin"], F.when(a["begin"] < b["begin"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    spans = F.array_sort(F.concat(*each), by_place)
    columns = [c for c in docs.columns if c != "spans"] if keep_text else [id_col]
    return marked.select(*(docs[c] for c in columns), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """`kind:begin:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every maximal run of spans replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["begin"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
