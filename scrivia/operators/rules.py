"""Rule and verdict algebra, and keyed state changes, as DataFrame functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia import constants as k
from scrivia.operators.logs import guarded_replay


def verdict_rank(verdict: Column) -> Column:
    ranks = F.create_map(*chain.from_iterable((F.lit(n), F.lit(r)) for n, r in k.VERDICT_RANK.items()))
    return ranks[verdict]


def verdict_of_rank(rank: Column) -> Column:
    names = {r: n for n, r in k.VERDICT_RANK.items()}
    return F.when(rank >= 2, names[2]).when(rank == 1, names[1]).otherwise(names[0])


def worst_verdict(verdict: Column) -> Column:
    """Aggregate: the worst verdict, never better than BASARILI, which an empty group is."""
    return verdict_of_rank(F.greatest(F.lit(0), F.coalesce(F.max(verdict_rank(verdict)), F.lit(0))))


def verdict_counts(verdict: Column) -> list[Column]:
    count = lambda name: F.count(F.when(verdict == name, 1))
    return [F.count("*").alias("total"), count("BASARILI").alias("basarili"), count("REVIZYON").alias("revizyon"), count("KRITIK_HATA").alias("kritik"), count("DEGERLENDIRILEMEDI").alias("dis_kanit"), worst_verdict(verdict).alias("overall")]


def effective_verdict(judge: Column, ai: Column, own: Column) -> Column:
    return F.when(judge == "approved", ai).when(judge == "rejected", own)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: an update replaces the base row, the last update wins."""
    latest = Window.partitionBy(*keys).orderBy(*order)
    new = updates.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return base.join(new, keys, "left_anti").unionByName(new.select(base.columns))


def replace_partition(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key, then insert."""
    return base.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)


def append_versions(history: DataFrame, *, key: str, order: list[str], content: Column) -> DataFrame:
    """Rows that change a key's content, numbered from 1: equal content after equal content makes no version."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = ~F.lag("_hash").over(by).eqNullSafe(F.col("_hash")) | (F.row_number().over(by) == 1)
    rows = history.withColumn("_hash", F.sha2(content, 256)).withColumn("_new", changed)
    return rows.withColumn("version", F.sum(F.col("_new").cast("int")).over(by)).filter("_new").drop("_new")


def current_rows(history: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """SCD-2: each row with valid_from, valid_to and whether it is the key's current row."""
    by = Window.partitionBy(key).orderBy(*order)
    return history.withColumn("valid_from", F.col(order[0])).withColumn("valid_to", F.lead(order[0]).over(by)).withColumn("active", F.lead(order[0]).over(by).isNull())


def replay_stages(commands: DataFrame, *, key: str = "competition", order: str = "seq", target: str = "target", unresolved: str = "unresolved", start: str = "draft_criteria") -> DataFrame:
    """Commands in order per competition, with the state before, the state after, whether the transition was allowed, and whether decisions are locked.

    Decisions freeze only where no application is unresolved.
    """
    ways = {(state, wanted): wanted for state, own in k.COMPETITION_TRANSITIONS.items() for wanted in own}
    free = ~((F.col(target) == "decisions_frozen") & (F.coalesce(F.col(unresolved), F.lit(0)) > 0))
    replayed = guarded_replay(commands.select(key, order, target, unresolved), ways, key=key, order=[order], command=target, ok=free, start=start)
    return replayed.drop(unresolved).withColumn("locked", F.col("after").isin("decisions_frozen", "results_published", "archived"))


def first_of_two_keys(types: dict[str, str], *, order: str, first: str, second: str, where: Column | None = None) -> Column:
    """Aggregate: the group's rows (o, a, b) kept in order unless one of their two keys is that of a kept row before; types are those of the columns."""
    row = F.struct(F.col(order).alias("o"), F.col(first).alias("a"), F.col(second).alias("b"))
    items = F.array_sort(F.collect_list(row if where is None else F.when(where, row)))
    none = F.array().cast(f"array<struct<o:{types[order]},a:{types[first]},b:{types[second]}>>")

    def step(kept: Column, item: Column) -> Column:
        seen = F.exists(kept, lambda x: (x["a"] == item["a"]) | (x["b"] == item["b"]))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(item)))

    return F.aggregate(items, none, step)


def keep_first_of_two_keys(rows: DataFrame, *, group: str, order: str, first: str, second: str) -> DataFrame:
    """Rows kept in order unless one of their two keys is that of a kept row before; a group is one document's rules."""
    kept = rows.groupBy(group).agg(first_of_two_keys(dict(rows.dtypes), order=order, first=first, second=second).alias("_kept"))
    return kept.select(group, F.explode("_kept").alias("_k")).select(group, F.col("_k.a").alias(first), F.col("_k.b").alias(second), F.col("_k.o").alias(order))


def revoked_in_order(accounts: DataFrame, commands: DataFrame, *, order: str) -> DataFrame:
    """(id, outcome) of commands that revoke accounts (id, status, admin), one after another: the last active administrator stays.

    With n active administrators the first n - 1 of them in order may go, so all but the one that comes last where every one of them is asked to go: one comparison with that account, and nothing is numbered.
    """
    rows = commands.select(F.col("id").alias("_id")).distinct().join(accounts, F.col("_id") == F.col("id"), "left")
    asked = rows.filter("admin").agg(F.count("*").alias("_asked"), F.max_by("_id", order).alias("_last"))
    totals = accounts.agg(F.count_if("admin").alias("_n")).join(asked)
    gone = F.coalesce(F.col("status") != "active", F.lit(True))
    stays = F.col("admin") & (F.col("_asked") >= F.col("_n")) & (F.col("_id") == F.col("_last"))
    outcome = F.when(gone, "not_found").when(stays, "last_moderator").otherwise("revoked")
    return rows.join(F.broadcast(totals)).select(F.col("_id").alias("id"), outcome.alias("outcome"))
