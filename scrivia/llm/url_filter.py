"""URL filters by a path-template tree; DataFrame and SQL functions only.

Per host, paths are a tree of segments. Variable segments become wildcards: first by shape
(digits, long or encoded tokens), then, level by level, where a node has so many different children that
they must be values. Sibling branches whose labelled rates do not differ significantly from their parent's pool
are merged into it. A template is rejected when its labelled purity, smoothed towards its host's and the corpus's
rate, shows it to be bad.

Explicit rules come first: (host, path) pairs that fit a host and its subdomains and paths that start with
theirs; the longest wins. URLs that a rule fits are the labelled examples, and so are those of the optional label column.

The tree lives in counts per (host, path shape), made by partial aggregation; a hot host is only as heavy as its
number of different shapes. Verdicts go back to the rows by a broadcast while they are few, else by a shuffle join that AQE splits.

Defined results: a null url, or one without `://`, has empty host and path and is judged as that host's empty template;
empty segments are segments; segments beyond max_depth count as one tail wildcard; repeated rows are judged one by one and count each.
Of equally long rules the one with the longer host wins, then the greater text; a bad rate equal to the limit rejects; a null id is carried along; a very long url is cut into
segments like others; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivia.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct<rule,verdict> of the longest fitting rule, or null; of equally long ones the longer host, then the greater text."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[0] + r[1]), reverse=True)
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered))


def shape(segment: Column) -> Column:
    """A segment with what varies by its form made `#` (digits) or `*` (hex, encoded or very long tokens)."""
    token = segment.rlike("^(?=.*[0-9])[0-9A-Fa-f-]{16,}$") | segment.rlike("%[0-9A-Fa-f]{2}") | (F.length(segment) > 48)
    return F.when(token, F.lit("*")).otherwise(F.regexp_replace(segment, "[0-9]+", "#"))


def segments(path: Column, max_depth: int) -> Column:
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", max_depth), shape)
    return F.when(F.size(F.split(path, "/")) > max_depth + 1, F.concat(F.slice(parts, 1, max_depth - 1), F.array(F.lit("**")))).otherwise(parts)


def generalise(shapes: DataFrame, *, wild_children: int, wild_share: float) -> DataFrame:
    """shapes (host, segs, n, ...) with `template`: segs whose variable places are wildcards."""
    out = shapes.withColumn("template", F.col("segs"))
    deepest = out.agg(F.max(F.size("segs"))).first()[0] or 0
    for depth in range(1, deepest + 1):
        node = out.filter(F.size("template") >= depth).select("host", F.slice("template", 1, depth - 1).alias("above"), F.get("template", F.lit(depth - 1)).alias("own"), "n")
        kids = node.groupBy("host", "above", "own").agg(F.sum("n").alias("n"))
        wild = kids.groupBy("host", "above").agg(F.count("*").alias("kids"), F.sum("n").alias("n")).filter((F.col("kids") >= wild_children) & (F.col("kids") > wild_share * F.col("n")))
        wild = wild.select(F.col("host").alias("_host"), F.col("above").alias("_above"))
        joined = out.join(wild, (F.col("host") == F.col("_host")) & (F.slice("template", 1, depth - 1) == F.col("_above")) & (F.size("template") >= depth), "left")
        starred = F.concat(F.slice("template", 1, depth - 1), F.array(F.lit("*")), F.slice("template", depth + 1, deepest + 1))
        out = cut(joined.withColumn("template", F.when(F.col("_host").isNotNull(), starred).otherwise(F.col("template"))).drop("_host", "_above"))
    return out


def merge_branches(templates: DataFrame, *, z: float) -> DataFrame:
    """templates (host, template, labelled, bad) with `branch`: the parent's pool for siblings that do not stand out from it."""
    literal = F.array_max(F.transform("template", lambda s, i: F.when(~s.isin("#", "*", "**", "") & ~s.startswith("#"), i)))
    parent = F.when(literal.isNull(), F.col("template")).otherwise(F.transform("template", lambda s, i: F.when(i == literal, F.lit("?")).otherwise(s)))
    rows = templates.withColumn("parent", parent)
    pool = rows.groupBy(F.col("host").alias("_host"), F.col("parent").alias("_parent")).agg(F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
    rate = F.col("_bad") / F.greatest(F.col("_labelled"), F.lit(1))
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
    apart = (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - rate) > z * error)
    joined = rows.join(pool, (F.col("host") == F.col("_host")) & (F.col("parent") == F.col("_parent")), "left")
    return joined.withColumn("branch", F.when(apart, F.col("template")).otherwise(F.col("parent"))).drop("_host", "_parent", "_labelled", "_bad", "parent")


def template_verdicts(shapes: DataFrame, *, z: float = 1.96, strength: float = 10.0, reject: float = 0.6, wild_children: int = 24, wild_share: float = 0.05) -> DataFrame:
    """(host, segs, template, branch, purity, rejected) for every (host, shape)."""
    grown = generalise(shapes, wild_children=wild_children, wild_share=wild_share)
    templates = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    merged = cut(merge_branches(templates, z=z))
    total = merged.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("p")).first()
    corpus = float(total.p or 0.0)
    smooth = lambda bad, n, prior: (bad + strength * prior) / (n + strength)
    host = merged.groupBy(F.col("host").alias("_host")).agg(smooth(F.sum("bad"), F.sum("labelled"), F.lit(corpus)).alias("host_rate"))
    branch = merged.groupBy(F.col("host").alias("_bhost"), F.col("branch").alias("_branch")).agg(F.sum("bad").alias("bb"), F.sum("labelled").alias("bn"))
    rated = merged.join(host, F.col("host") == F.col("_host")).join(branch, (F.col("host") == F.col("_bhost")) & (F.col("branch") == F.col("_branch")))
    bad_rate = smooth(F.col("bb"), F.col("bn"), F.col("host_rate"))
    rated = rated.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "branch", (1 - bad_rate).alias("purity"), (bad_rate >= reject).alias("rejected"))
    return grown.join(rated, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select("host", "segs", "template", "branch", "purity", "rejected")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...], *, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None, max_depth: int = 16, broadcast_shapes: int = 50_000, **fit) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) of every row; rules are (host, path, allow|block).

    bad_col, if given, is a boolean column of further labelled examples (null: unlabelled).
    """
    host, path = host_and_path(F.col(url_col))
    bad = F.col(bad_col) if bad_col else F.lit(None).cast("boolean")
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), bad.alias("_bad"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_segs", segments(F.col("path"), max_depth))
    known = F.coalesce(F.col("_rule.verdict") == "block", F.col("_bad"))
    counts = [F.count("*").alias("n"), F.count(known).alias("labelled"), F.count(F.when(known, 1)).alias("bad")]
    shapes = cut(rows.groupBy("host", F.col("_segs").alias("segs")).agg(*counts))
    verdicts = cut(template_verdicts(shapes, **fit))
    few = verdicts.count() <= broadcast_shapes
    verdicts = verdicts.withColumnsRenamed({"host": "_vhost", "segs": "_vsegs"})
    out = rows.join(F.broadcast(verdicts) if few else verdicts, (F.col("host") == F.col("_vhost")) & (F.col("_segs") == F.col("_vsegs")), "left")
    method = F.when(F.coalesce(F.col("rejected"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), F.array_join("branch", "/").alias("template"), "purity")
