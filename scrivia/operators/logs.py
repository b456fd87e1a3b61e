"""Ordered logs without one task that holds a whole log or a whole key: a bounded cache, a rate limit and guarded commands.

All of them cut a log into blocks, describe what a block does to any state before it, combine the descriptions in about log2(blocks) joins, and replay the blocks side by side.
"""

from __future__ import annotations

from collections import OrderedDict
from itertools import chain

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivia.lineage import cut


def numbered(rows: DataFrame, key: str, order: list[str], *, parts: int = 0) -> DataFrame:
    """rows with `_n`, their place within key from 0, without gathering a key in one task: ranges are counted first, then numbered one by one."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_k", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_i", inside).join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("_n", F.col("_before") + F.col("_i")).drop("_part", "_k", "_p", "_before", "_i")


def _replayed(limit: int):
    """One block's accesses after the keys held before it: hit, the key that goes, accesses since the last miss in the block, and whether there was one."""

    def run(rows: pa.Table) -> pa.Table:
        held: OrderedDict = OrderedDict()
        used: dict = {}
        order = pa.compute.sort_indices(rows, [("pos", "ascending")])
        out = []
        for pos, key, seed in zip(*(rows.column(c).take(order).to_pylist() for c in ("pos", "key", "seed"))):
            hit, gone = key in held, None
            held[key] = None
            held.move_to_end(key)
            if seed:
                continue
            if len(held) > limit:
                gone = held.popitem(last=False)[0]
            n, fresh = used.get(key, (0, False))
            used[key] = (n + 1, fresh) if hit else (1, True)
            out.append((pos, hit, gone, *used[key]))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.bool_(), rows.schema.field("key").type, pa.int64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["pos", "hit", "evicted", "used", "fresh"])

    return run


def held_before(recent: DataFrame, limit: int, last_block: int) -> DataFrame:
    """recent (block, key, last): each block's own most recent keys; returns what is held before each block: the `limit` most recent keys of all blocks before it.

    Spans double: what 2n blocks leave is what the later n leave, filled up from the n before. It ends as soon as every block has its full number or all blocks before it.
    """
    latest = Window.partitionBy("block").orderBy(F.desc("last"))
    top = lambda df: df.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= limit).drop("_r")
    shifted = lambda df, by: df.select((F.col("block") + by).alias("block"), "key", "last").filter(F.col("block") <= last_block)
    state, span = cut(shifted(recent, 1)), 1
    while span < last_block and not state.groupBy("block").agg(F.count("*").alias("n")).filter((F.col("n") < limit) & (F.col("block") > span)).isEmpty():
        both = state.unionByName(shifted(state, span)).groupBy("block", "key").agg(F.max("last").alias("last"))
        state, span = cut(top(both)), 2 * span
    return state


def cache_accesses(accesses: DataFrame, *, key: str, order: list[str], limit: int, block_rows: int = 4096) -> DataFrame:
    """accesses with `pos` (their place from 0), `hit`, `use_count` (accesses since the key came in) and `evicted`, for a cache that holds the `limit` most recently used keys.

    An access of a held key touches it; of another key brings it in and, where the cache is full, sends the least recently used one away. The log is numbered by ranges and cut into
    blocks; a task holds one block and the keys held before it. Counts run over blocks, not over a key's accesses. A null key is a key; accesses of equal order come in any order.
    """
    placed = numbered(accesses.withColumn("_all", F.lit(0)), "_all", order).drop("_all").withColumnRenamed("_n", "pos")
    placed = cut(placed.withColumn("block", F.floor(F.col("pos") / block_rows)))
    log = placed.select("pos", "block", F.col(key).alias("key"))
    last_block = log.agg(F.max("block")).first()[0] or 0
    latest = Window.partitionBy("block").orderBy(F.desc("last"))
    recent = log.groupBy("block", "key").agg(F.max("pos").alias("last")).withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= limit).drop("_r")
    state = held_before(recent, limit, last_block)

    kind = accesses.schema[key].dataType.simpleString()
    rows = log.select("block", "pos", "key", F.lit(False).alias("seed")).unionByName(state.select("block", F.col("last").alias("pos"), "key", F.lit(True).alias("seed")))
    found = rows.groupBy("block").applyInArrow(_replayed(limit), f"pos long, hit boolean, evicted {kind}, used long, fresh boolean")
    found = cut(log.join(found.withColumnRenamed("pos", "_pos"), F.col("pos") == F.col("_pos")).drop("_pos"))

    # what a key's count is at the end of each block: its own tail, and those of the blocks before up to its last miss
    tails = found.groupBy("key", "block").agg(F.max_by("used", "pos").alias("tail"), F.max("fresh").alias("fresh"))
    blocks = Window.partitionBy("key").orderBy("block")
    tails = tails.withColumn("_g", F.sum(F.col("fresh").cast("int")).over(blocks))
    tails = tails.withColumn("_end", F.sum("tail").over(Window.partitionBy("key", "_g").orderBy("block")))
    tails = tails.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.coalesce(F.lag("_end").over(blocks), F.lit(0)).alias("_before"))
    counted = found.join(tails, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")))
    counted = counted.select(F.col("pos").alias("_pos"), "hit", (F.col("used") + F.when(F.col("fresh"), 0).otherwise(F.col("_before"))).alias("use_count"), "evicted")
    return placed.drop("block").join(counted, F.col("pos") == F.col("_pos")).drop("_pos")


def rate_limited(requests: DataFrame, *, client: str, ts: str, tie: str, window_s: int, most: int) -> DataFrame:
    """(client, tie, ts, allowed) of every request: a window opens with a client's first request after the one before has passed, and takes `most`; rejected ones do not count.

    Time is cut into stretches as long as a window, so that at most one window opens in each. A request points to the first request that lies a window later; the requests that open
    windows are those met on the way from a client's first one, found by doubling the pointers. No task holds more of a client than a stretch and the window before.
    A null client is a client; requests of equal time are taken in the order of `tie`, which is unique for a client and time. A null time is never allowed.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width = window_s * 1_000_000
    rows = requests.select(F.col(client).alias("client"), F.struct(us.alias("at"), F.col(tie).alias("tie")).alias("own"), F.floor(us / width).alias("stretch"))
    rows = cut(rows.filter("stretch is not null"))
    here = Window.partitionBy("client", "stretch").orderBy("at", "probe", "tie")
    later = here.rowsBetween(1, Window.unboundedFollowing)
    events = rows.select("client", "stretch", "own.at", F.lit(1).alias("probe"), "own.tie", "own")
    probes = rows.select("client", (F.col("stretch") + 1).alias("stretch"), (F.col("own.at") + width).alias("at"), F.lit(0).alias("probe"), "own.tie", "own")
    inside = F.first(F.when(F.col("probe") == 1, F.col("own")), ignorenulls=True).over(later)
    aimed = events.unionByName(probes).withColumn("inside", inside).filter("probe = 0").select("client", "stretch", "own", "inside")
    # where a stretch holds no request late enough, the first one of the client's next stretch with any
    first = rows.groupBy("client", "stretch").agg(F.min("own").alias("first"))
    marks = first.select("client", "stretch", "first").unionByName(first.select("client", (F.col("stretch") + 1).alias("stretch"), F.lit(None).cast(first.schema["first"].dataType).alias("first")))
    marks = marks.groupBy("client", "stretch").agg(F.min("first").alias("first"))
    after = F.first("first", ignorenulls=True).over(Window.partitionBy("client").orderBy("stretch").rowsBetween(1, Window.unboundedFollowing))
    marks = marks.select(F.col("client").alias("_client"), F.col("stretch").alias("_stretch"), after.alias("after"))
    near = F.col("client").eqNullSafe(F.col("_client")) & (F.col("stretch") == F.col("_stretch"))
    jumps = aimed.join(marks, near).select("client", "own", F.coalesce("inside", "after").alias("next")).filter("next is not null")

    jumps = cut(jumps)
    opened = cut(rows.groupBy("client").agg(F.min("own").alias("own")))
    same = F.col("client").eqNullSafe(F.col("_client"))
    while not jumps.isEmpty():
        hop = jumps.select(F.col("client").alias("_client"), F.col("own").alias("_own"), F.col("next").alias("_next"))
        reached = opened.join(hop, same & (F.col("own") == F.col("_own"))).select("client", F.col("_next").alias("own"))
        opened = cut(opened.unionByName(reached))
        jumps = cut(jumps.join(hop, same & (F.col("next") == F.col("_own"))).select("client", "own", F.col("_next").alias("next")))

    begun = opened.withColumn("_s", F.floor(F.col("own.at") / width)).select(F.col("client").alias("_client"), F.col("own").alias("begun"), F.explode(F.array("_s", F.col("_s") + 1)).alias("_stretch"))
    of = rows.join(begun, near).filter("begun <= own").groupBy("client", "own").agg(F.max("begun").alias("begun"))
    place = F.row_number().over(Window.partitionBy("client", "begun").orderBy("own"))
    judged = of.select(F.col("client").alias("_client"), F.col("own.at").alias("_at"), F.col("own.tie").alias("_tie"), (place <= most).alias("allowed"))
    out = requests.select(client, tie, ts).join(judged, F.col(client).eqNullSafe(F.col("_client")) & F.col(tie).eqNullSafe(F.col("_tie")) & (us == F.col("_at")), "left")
    return out.select(client, tie, ts, F.coalesce("allowed", F.lit(False)).alias("allowed"))


def guarded_replay(commands: DataFrame, transitions: dict[tuple[str | None, str], str], *, key: str, order: list[str], command: str, ok: Column, start: str | None, block_rows: int = 256) -> DataFrame:
    """commands with `before`, `after` and `accepted`: each is taken if the state before it takes it and its guard `ok` holds; a rejected one changes nothing and stays as a row.

    A command is a map from states to states. Each key's log is cut into blocks; a block's map is the composition of its commands', and maps of stretches of blocks are composed in doubling spans,
    so a key with a third of all commands is dealt out like any other. Rows stay in their block, so nothing is joined back to the log; a log of one block makes no map. Null commands and null
    guards are rejected; commands of equal order come in any order; columns are of types that can be ordered.
    """
    states = list(dict.fromkeys([start, *(s for s, _ in transitions), *transitions.values()]))
    names = list(dict.fromkeys(c for _, c in transitions))
    place = {s: n for n, s in enumerate(states)}
    table = lambda cell: F.array(*(F.array(*(F.lit(cell(s, c)) for s in states)) for c in names))
    to = table(lambda s, c: place[transitions.get((s, c), s)])
    takes = table(lambda s, c: (s, c) in transitions)
    number = F.create_map(*chain.from_iterable((F.lit(c), F.lit(n)) for n, c in enumerate(names)))
    step = lambda c, s: F.when(c.isNull(), s).otherwise(F.get(F.get(to, c), s))

    named = commands.withColumn("_c", F.when(ok, F.try_element_at(number, F.col(command))))
    placed = numbered(named, key, order).withColumn("_block", F.floor(F.col("_n") / block_rows))
    items = F.array_sort(F.collect_list(F.struct("_n", "_c", F.struct(*commands.columns).alias("_row"))))
    blocks = cut(placed.groupBy(F.col(key).alias("_key"), "_block").agg(items.alias("_items")))
    last = blocks.agg(F.max("_block")).first()[0] or 0
    long = blocks.filter("_block > 0").select(F.col("_key").alias("_k")).distinct()  # in a log of one block nothing comes before
    same = F.array(*(F.lit(n) for n in range(len(states))))
    spans = blocks.join(long, F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    spans = spans.select("_key", "_block", F.aggregate("_items", same, lambda m, i: F.transform(m, lambda s: step(i["_c"], s))).alias("_map"))

    # _map: from the state before the span's first block to the one after this block
    upto, span = cut(spans) if last else spans, 1
    while span <= last:
        left = upto.select(F.col("_key").alias("_k"), (F.col("_block") + span).alias("_b"), F.col("_map").alias("_first"))
        joined = upto.join(left, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
        composed = F.when(F.col("_first").isNull(), F.col("_map")).otherwise(F.transform("_first", lambda s: F.get("_map", s)))
        upto, span = cut(joined.select("_key", "_block", composed.alias("_map"))), 2 * span

    begun = blocks.withColumn("_state", F.lit(place[start]))
    if last:
        entered = upto.select(F.col("_key").alias("_k"), (F.col("_block") + 1).alias("_b"), F.get("_map", F.lit(place[start])).alias("_entered"))
        begun = blocks.join(entered, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")), "left").withColumn("_state", F.coalesce("_entered", F.lit(place[start])))
    path = F.aggregate("_items", F.array("_state"), lambda p, i: F.concat(p, F.array(step(i["_c"], F.element_at(p, -1)))))
    each = begun.select(path.alias("_path"), F.posexplode("_items").alias("_at", "_item"))
    out = each.select("_item._row.*", F.col("_item._c").alias("_c"), F.get("_path", F.col("_at")).alias("_s"), F.get("_path", F.col("_at") + 1).alias("_t"))
    name = F.array(*map(F.lit, states)) if start is not None else F.array(*(F.lit(s).cast("string") for s in states))
    accepted = F.coalesce(F.get(F.get(takes, F.col("_c")), F.col("_s")), F.lit(False))
    return out.select(*commands.columns, F.get(name, F.col("_s")).alias("before"), F.get(name, F.col("_t")).alias("after"), accepted.alias("accepted"))
