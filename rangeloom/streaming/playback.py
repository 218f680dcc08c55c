"""Step navigation as a fold over events: in batches, and over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: A number above any step: a move that nothing holds back.
_FAR = 1 << 40


def _move(idle: Column, shift: Column, low: Column, high: Column) -> Column:
    """A function of the state: `idle` if nothing plays, else the state and `shift`, held from `low` to `high`."""
    return F.struct(idle.cast("long").alias("idle"), shift.cast("long").alias("shift"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def _joined(moves: str) -> Column:
    """An array of structs with a move m as one move.  A move that leaves a single state, as start does, has low = high."""
    after = lambda state: f"if({state} < 0, x.m.idle, least(greatest({state} + x.m.shift, x.m.low), x.m.high))"
    still = f"named_struct('idle', -1L, 'shift', 0L, 'low', 0L, 'high', {_FAR}L)"
    return F.expr(
        f"aggregate({moves}, {still}, (a, x) -> named_struct('idle', {after('a.idle')}, 'shift', a.shift + x.m.shift, 'low', {after('a.low')}, 'high', {after('a.high')}))"
    )


def _move_of(steps: Column, event: Column, target: Column) -> Column:
    """An event as a move: start, next, prev, jump, tick (next, from autoplay) or exit; others change nothing.

    -1 means that nothing plays; then only start counts.  Moves are held inside the plan, and a plan
    without steps doesn't start.
    """
    last = F.coalesce(steps - 1, F.lit(_FAR))
    set_to = lambda idle, at: _move(idle, F.lit(0), at, at)
    none, far = F.lit(-1), F.lit(_FAR)
    return (
        F.when(steps <= 0, set_to(none, none))
        .when(event == "start", set_to(F.lit(0), F.lit(0)))
        .when(event == "exit", set_to(none, none))
        .when(event.isin("next", "tick"), _move(none, F.lit(1), F.lit(0), last))
        .when(event == "prev", _move(none, F.lit(-1), F.lit(0), last))
        .when(event == "jump", set_to(none, F.least(F.greatest(target, F.lit(0)), last)))
        .otherwise(_move(none, F.lit(0), F.lit(0), far))
    )


def replayed(events: DataFrame, session: str = "session_id", seconds: int = 3600) -> DataFrame:
    """(session, state, n_events) after all events (session, ts, seq, event, target, steps) in order of ts and seq.

    Moves are associative, so the events of each span of `seconds` become one move, and those of a
    session are put together after: a task holds a span of a session, never a whole one.
    """
    span = F.floor(F.col("ts").cast("timestamp").cast("double") / seconds)
    move = _move_of(F.col("steps"), F.col("event"), F.coalesce(F.col("target"), F.lit(0)))
    rows = events.select(session, span.alias("span"), F.struct("ts", "seq", move.alias("m")).alias("e"))
    spans = rows.groupBy(session, "span").agg(F.array_sort(F.collect_list("e")).alias("e")).select(session, "span", _joined("e").alias("m"), F.size("e").alias("n"))
    whole = spans.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("span", "m"))).alias("e"), F.sum("n").alias("n_events"))
    return whole.select(session, _joined("e")["idle"].cast("int").alias("state"), "n_events")


def latest(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, seq, event): the navigation that wins, which is the last one asked for."""
    last = F.max_by(F.struct("seq", "event"), F.struct("ts", "seq"))
    return events.groupBy(session).agg(last.alias("l")).select(session, "l.seq", "l.event")


def ticks(plays: DataFrame, least_ms: int = 1_000) -> DataFrame:
    """Autoplay as events: (session_id, ts, event) of plays (session_id, from_ms, until_ms, interval_ms, state, steps).

    A tick comes every interval, of a second at least, until the last step shows or until_ms, which is
    when someone moves by hand.
    """
    gap = F.greatest(F.lit(least_ms), F.col("interval_ms"))
    room = F.least(F.floor((F.col("until_ms") - F.col("from_ms")) / gap), F.col("steps") - 1 - F.col("state"))
    rows = plays.filter(room > 0).withColumn("k", F.explode(F.sequence(F.lit(1), room.cast("int"))))
    return rows.select("session_id", (F.col("from_ms") + F.col("k") * gap).cast("long").alias("ts"), F.lit("tick").alias("event"))


STATE = "state int, n_events bigint"


class Playback(StatefulProcessor):
    """The same fold with its state kept for each session.

    Events of one micro-batch are taken in order of (ts, seq); across batches in order of arrival.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("playback", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, n = self.kept.get() if self.kept.exists() else (-1, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for event, target, steps in zip(batch["event"], batch["target"], batch["steps"]):
            n += 1
            last = int(steps) - 1
            if last < 0:
                state = -1
            elif event == "start":
                state = 0
            elif state >= 0:
                to = {"next": state + 1, "tick": state + 1, "prev": state - 1, "jump": 0 if pd.isna(target) else int(target)}.get(event, state)
                state = -1 if event == "exit" else min(max(to, 0), last) if event in ("next", "tick", "prev", "jump") else state
        self.kept.update((int(state), int(n)))
        yield pd.DataFrame({"session_id": [key[0]], "state": [int(state)], "n_events": [int(n)]})

    def close(self) -> None:
        return


def played(stream: DataFrame) -> DataFrame:
    """(session_id, state, n_events) of a stream of playback events; needs the RocksDB state store."""
    return stream.groupBy("session_id").transformWithStateInPandas(
        Playback(), outputStructType="session_id bigint, state int, n_events bigint", outputMode="update", timeMode="none"
    )

