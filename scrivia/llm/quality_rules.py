"""Quality rules with adaptive thresholds.

Each document's measures are taken once. Their distribution per language and source, over the documents that pass the base rule, is kept in quantile sketches with fixed cells: a positive value falls into cell
ceil(log(value) / log(GAMMA)), zeros are counted apart. A cell's edges are within 2 % of its values, sketches merge by adding counts, and the same documents give the same sketch in every run.

An upper limit is the greater of two values read from the sketch: the upper quartile plus `spread` interquartile ranges, and a quantile of the positive values alone. The second decides
where a measure is 0 in most documents: for a measure that ordinary text does not have at all (symbols) it is the foot of the positive values, for one that it may have (repetition) their upper
end. A lower limit is the lower quartile less `spread` ranges. Every limit is drawn towards that of the next wider group, language then corpus, with the weight of `borrow` documents (`borrow_tail` for the
quantile of positive values), so a small group mostly follows its language and no group has a cutoff of its own making. Documents are joined with their group's limits.

Defined results: a null or empty text has zero measures and fails the base rule; null language or source is a group of its own; repeated rows
count each; a measure equal to its limit passes; of several broken rules the first listed is named; a very long text is measured whole in one task; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.llm.common import CONTINUATION, SPACES, cut, slices, texts

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
#: Upper limits: of the positive values, the quantile that a limit reaches at least; none where ordinary text always has some.
RULES: dict[str, float | None] = {"symbol_share": 0.02, "upper_share": None, "dup_line_share": 0.99, "repeat_share": 0.99, "word_length": None}
#: Lower limits.
LOW_RULES = {"short_words": "word_length"}
GAMMA = 1.02
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """How many words stand in windows of `size` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    spread = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0xD1B54A32D192ED03) + spread[k : k + n]
    if len(np.unique(mixed)) == n:  # equal windows have equal sums
        return 0
    names, width = ids.astype(np.int64), 1
    while width < size:  # exact names of windows, doubling their width
        both = names[:-width] * (int(names.max()) + 1) + names[width:]
        names = np.unique(both, return_inverse=True)[1]
        width *= 2
    hot = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hot
    edge[size : size + n] -= hot
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (
        len(words), len(text.translate(None, SPACES + CONTINUATION)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(text) - len(text.translate(None, _UPPER)), len(lines),
    )


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = np.array([measure(t) for t in texts(batch.column(0))], np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(found[:, k]) for k in range(7))], names=names)

    kept = [F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(F.col(g) for g in groups)]
    names = [id_col, *groups, *(x.split()[0] for x in MEASURES.split(", "))]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *groups))
    return docs.select(*kept).mapInArrow(run, f"{types}, {MEASURES}")


def shares() -> dict[str, Column]:
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars, "upper_share": F.col("n_upper") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words,
    }


def sketches(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, measure, cell, n): how many values of each measure fall into each cell; cell is null for zeros."""
    each = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in RULES))
    cell = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.log(F.lit(GAMMA)) - 1e-9).cast("int"))
    return rows.select(*groups, F.inline(each)).groupBy(*groups, "measure", cell.alias("cell")).agg(F.count("*").alias("n"))


def read_limits(cells: DataFrame, keys: tuple[str, ...], spread: float) -> DataFrame:
    """(keys, measure, n, positive, high, tail, low) of every sketch: how many values, how many above zero, and what the limits start from."""
    of = Window.partitionBy(*keys, "measure")
    upto = of.orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    zeros = F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("n"))).over(of), F.lit(0))
    placed = summed.select(*keys, "measure", "cell", F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("n"), zeros.alias("zeros"))
    edge = lambda down: F.coalesce(F.pow(F.lit(GAMMA), F.col("cell") - down), F.lit(0.0))
    at = lambda q, down: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("n")), edge(down)))
    share = F.create_map(*(x for c, q in RULES.items() if q is not None for x in (F.lit(c), F.lit(q))))
    positive = F.col("n") - F.col("zeros")
    in_tail = F.col("cell").isNotNull() & (F.col("upto") - F.col("zeros") >= F.ceil(F.try_element_at(share, F.col("measure")) * positive))
    read = placed.groupBy(*keys, "measure").agg(F.max("n").alias("n"), F.max(positive).alias("positive"), at(0.25, 0).alias("q1"), at(0.75, 0).alias("q3"), at(0.25, 1).alias("low_q1"), F.min(F.when(in_tail, edge(0))).alias("tail"))
    width = spread * (F.col("q3") - F.col("q1"))
    return read.select(*keys, "measure", "n", "positive", (F.col("q3") + width).alias("high"), F.coalesce("tail", F.lit(0.0)).alias("tail"), (F.col("low_q1") - width).alias("low"))


def thresholds(rows: DataFrame, groups: tuple[str, ...], *, borrow: float, borrow_tail: float, spread: float) -> DataFrame:
    """One row per group with max_ and min_ columns, its own limits drawn towards the next wider ones."""
    cells = cut(sketches(rows, groups))
    wider = read_limits(cells, (), spread)
    for deep in range(1, len(groups) + 1):
        keys = groups[:deep]
        own = read_limits(cells, keys, spread)
        above = wider.select(*(F.col(g).alias(f"_{g}") for g in keys[:-1]), F.col("measure").alias("_measure"), *(F.col(c).alias(f"_{c}") for c in ("high", "tail", "low")))
        on = [own["measure"] == above["_measure"], *(own[g].eqNullSafe(above[f"_{g}"]) for g in keys[:-1])]
        drawn = lambda c, n, k: ((F.col(n) * F.col(c) + k * F.col(f"_{c}")) / (F.col(n) + k)).alias(c)
        wider = own.join(above, on).select(*keys, "measure", "n", "positive", drawn("high", "n", borrow), drawn("tail", "positive", borrow_tail), drawn("low", "n", borrow))
    limit = lambda value, measure: F.max(F.when(F.col("measure") == measure, value))
    return wider.groupBy(*groups).agg(*(limit(F.greatest("high", "tail"), c).alias(f"max_{c}") for c in RULES), *(limit(F.col("low"), m).alias(f"min_{c}") for c, m in LOW_RULES.items()))


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), borrow: float = 30, borrow_tail: float = 20, spread: float = 4.0, broadcast_groups: int = 20_000
) -> DataFrame:
    """Every document with its measures, its group's limits, base_failed, the first measure beyond its limit and kept.

    Limits are broadcast while there are at most broadcast_groups of them, else joined by a shuffle that AQE splits where a group is hot.
    """
    rows = cut(measures(docs, id_col=id_col, text_col=text_col, groups=groups))
    rows = rows.withColumns(shares())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = cut(thresholds(rows.filter(~base), groups, borrow=borrow, borrow_tail=borrow_tail, spread=spread))
    few = limits.count() <= broadcast_groups
    limits = limits.withColumnsRenamed({g: f"_{g}" for g in groups})
    joined = rows.join(F.broadcast(limits) if few else limits, [rows[g].eqNullSafe(limits[f"_{g}"]) for g in groups], "left")
    hair = 1e-9  # cells' edges are computed, and a value on an edge is not beyond it
    over = [F.when(F.col(c) > F.col(f"max_{c}") * (1 + hair), F.lit(c)) for c in RULES]
    under = [F.when(F.col(m) < F.col(f"min_{c}") * (1 - hair), F.lit(c)) for c, m in LOW_RULES.items()]
    broken = F.coalesce(*over, *under)
    return joined.withColumn("base_failed", base).withColumn("broken_rule", broken).withColumn("kept", ~F.col("base_failed") & F.col("broken_rule").isNull()).drop(*(f"_{g}" for g in groups))
