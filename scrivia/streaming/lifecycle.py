"""The life of an application: commands per application against a transition table, in batch and as a stream.

A command is (application, seq, command, ok): `ok` is what the command's own guard found (the decisions are not locked,
the review is complete, an approved analysis is the newest). A command that its state does not take, or whose guard
failed, is rejected and changes nothing. Batch and stream give the same rows; the stream keeps one short string per application.

Defined results: a null command or a null guard is rejected; commands of equal seq are taken in order of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scrivia.operators.logs import guarded_replay

# Command, the states that take it, the state after.
APPLICATION_COMMANDS = {
    "submit": ((None,), "submitted"),
    "assign": (("submitted", "resubmitted"), "assigned"),
    "analyze": (("assigned", "resubmitted", "analysis_failed"), "analyzing"),
    "analysis_saved": (("submitted", "assigned", "resubmitted", "analyzing", "analysis_failed", "awaiting_judge", "judge_in_review", "document_reupload_requested"), "awaiting_judge"),
    "analysis_error": (("submitted", "assigned", "resubmitted", "analyzing", "analysis_failed", "awaiting_judge", "judge_in_review", "document_reupload_requested"), "analysis_failed"),
    "review": (("awaiting_judge", "judge_in_review", "completed"), "judge_in_review"),
    "complete": (("awaiting_judge", "judge_in_review", "completed"), "completed"),
    "reopen": (("completed",), "judge_in_review"),
    "delete_analysis": (("assigned", "analyzing", "analysis_failed", "awaiting_judge", "judge_in_review"), "assigned"),
    "requeue": (("analysis_failed",), "assigned"),
    "request_reupload": (("submitted", "assigned", "resubmitted", "analyzing", "analysis_failed", "awaiting_judge", "judge_in_review"), "document_reupload_requested"),
    "resubmit": (("document_reupload_requested",), "resubmitted"),
}
COLUMNS = "seq long, command string, before string, after string, accepted boolean"


def step(state: str | None, command: str | None, ok: bool | None) -> tuple[str | None, bool]:
    """(the state after, whether the command was accepted)."""
    taken, after = APPLICATION_COMMANDS.get(command, ((), None))
    accepted = bool(ok) and state in taken
    return (after if accepted else state), accepted


def _fold(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
    rows = rows.sort_values(["seq", "command"])
    before, after, accepted = [], [], []
    for command, ok in zip(rows["command"], rows["ok"]):
        before.append(state)
        state, took = step(state, command, None if pd.isna(ok) else ok)
        after.append(state)
        accepted.append(took)
    return rows[["seq", "command"]].assign(before=before, after=after, accepted=accepted), state


def _plain(commands: DataFrame, key: str) -> DataFrame:
    return commands.select(F.col(key).alias("application"), F.col("seq").cast("long").alias("seq"), "command", "ok")


def replay_applications(commands: DataFrame, *, key: str = "application") -> DataFrame:
    """Every command with the state before and after it and whether it was accepted."""
    ways = {(state, command): after for command, (states, after) in APPLICATION_COMMANDS.items() for state in states}
    rows = _plain(commands, key)
    return guarded_replay(rows, ways, key="application", order=["seq", "command"], command="command", ok=F.col("ok"), start=None).select("application", "seq", "command", "before", "after", "accepted")


class ApplicationStates(StatefulProcessor):
    """Keeps each application's state between micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        out, state = _fold(pd.concat(list(rows)), held[0] if held else None)
        if state is not None:
            self.state.update((state,))
        out.insert(0, "application", key[0])
        yield out

    def close(self) -> None:
        pass


def stream_applications(commands: DataFrame, *, key: str = "application") -> DataFrame:
    """As replay_applications over a stream whose micro-batches hold each application's commands in order. Needs the RocksDB state store."""
    kind = commands.schema[key].dataType.simpleString()
    return _plain(commands, key).groupBy("application").transformWithStateInPandas(ApplicationStates(), f"application {kind}, {COLUMNS}", "append", "none")


def live_sessions(events: DataFrame, *, key: str, ts: str, ttl: str, watermark: str) -> DataFrame:
    """Session windows per key that close after `ttl` without an event; late events beyond the watermark are dropped. An addition to the reference's expiry purge."""
    return events.withWatermark(ts, watermark).groupBy(F.session_window(ts, ttl), key).agg(F.count("*").alias("events"), F.max(ts).alias("last_seen")).drop("session_window")


class ClientWindows(StatefulProcessor):
    """Keeps each client's open window, its begin and how many requests it let in, until a timer closes it."""

    def __init__(self, window_s: int, most: int):
        self.window_us, self.most = window_s * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "begin long, used long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "tie"])
        begin, used = self.window.get() if self.window.exists() else (None, 0)
        allowed = []
        for at in batch["ts"].astype("datetime64[us]").astype("int64"):
            if begin is None or at - begin >= self.window_us:
                begin, used = at, 0
            allowed.append(used < self.most)
            used += used < self.most
        self.window.update((int(begin), int(used)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(begin) + self.window_us) // 1000 + 1)
        out = batch[["tie", "ts"]].assign(allowed=allowed)
        out.insert(0, "client", key[0])
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_rate_limited(requests: DataFrame, *, client: str, ts: str, tie: str, window_s: int, most: int, watermark: str = "0 seconds") -> DataFrame:
    """As operators.logs.rate_limited over a stream whose micro-batches come in order of time; a client's state goes when the watermark passes its window. Needs the RocksDB state store."""
    kind = {c: requests.schema[c].dataType.simpleString() for c in (client, tie)}
    named = requests.withWatermark(ts, watermark).select(F.col(client).alias("client"), F.col(tie).alias("tie"), F.col(ts).alias("ts"))
    return named.groupBy("client").transformWithStateInPandas(ClientWindows(window_s, most), f"client {kind[client]}, tie {kind[tie]}, ts timestamp, allowed boolean", "append", "eventtime")
