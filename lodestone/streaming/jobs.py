"""Jobs watched as a stream: transitions that may not be, and jobs that stay in a state for too long.

The stream keeps a key's events until the watermark has passed them, and judges them in order of time then, so the result doesn't depend on how
they arrive within the allowed lateness. A timer wakes a key whose next event is due or whose patience is over. ``watched`` gives the same rows from a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.metrics import TERMINAL

BAD, IDLE = "bad_transition", "timeout"


class Watcher(StatefulProcessor):
    """A key's last judged event and the events that wait for the watermark."""

    def __init__(self, allowed: set[tuple[str, str]], patience: int, names: list[str]):
        self.allowed, self.patience, self.names = allowed, patience, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        event = "at bigint, id bigint, state string"
        self.handle, self.last, self.waiting = handle, handle.getValueState("last", f"{event}, alerted boolean"), handle.getListState("waiting", event)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        new = [(r["at"], r["id"], r["state"]) for r in rows]
        return self._judge(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._judge(key, [], timerValues)

    def close(self) -> None:
        pass

    def _judge(self, key: tuple, new: list[tuple], timers) -> Iterator[Row]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        events = sorted([*map(tuple, self.waiting.get()), *new], key=lambda e: (e[0], e[1]))
        last = tuple(self.last.get()) if self.last.exists() else None
        found = []
        for at, number, state in (e for e in events if e[0] < passed):
            if last is not None:
                if not last[3] and last[2] not in TERMINAL and at - last[0] > self.patience:
                    found.append((IDLE, last[1], None, last[2], last[0]))
                if (last[2], state) not in self.allowed:
                    found.append((BAD, number, last[2], state, at))
            last = (at, number, state, False)
        if last is not None and not last[3] and last[2] not in TERMINAL and passed - last[0] > self.patience:
            found.append((IDLE, last[1], None, last[2], last[0]))
            last = (*last[:3], True)
        rest = [e for e in events if e[0] >= passed]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if last is not None:
            self.last.update(last)
        due = [e[0] for e in rest[:1]] + ([last[0] + self.patience] if last is not None and not last[3] and last[2] not in TERMINAL else [])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        for row in found:
            yield Row(*self.names)(key[0], *row)


def watch(events: DataFrame, allowed: set[tuple[str, str]], patience_seconds: int, key: str = "user_id", state: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, kind, event_id, before, state, at) from a stream with a watermark on ``ts``; its state store has to be RocksDB, which :func:`drained` sees to.

    A null key is a key like others. Events that are later than the watermark are dropped, as in any stateful stream.
    """
    kind = dict(events.dtypes)[key]
    names = [key, "kind", tie, "before", state, "at"]
    told = events.select(key, ts, F.unix_micros(ts).alias("at"), F.col(tie).cast("bigint").alias("id"), F.col(state).alias("state"))
    schema = f"{key} {kind}, kind string, {tie} bigint, before string, {state} string, at bigint"
    found = told.groupBy(key).transformWithState(Watcher(allowed, patience_seconds * 1_000_000, names), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def watched(events: DataFrame, allowed: set[tuple[str, str]], patience_seconds: int, late_seconds: int, key: str = "user_id", state: str = "event_type", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same rows from a batch: what a stream has told once it has read all events, its watermark being ``late_seconds`` behind the last one."""
    at = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("bigint").alias(tie), state)
    until = at.agg((F.floor(F.max("at") / 1000) * 1000 - late_seconds * 1_000_000).alias("until"))  # one row; a watermark has milliseconds
    w = Window.partitionBy(key).orderBy("at", tie)
    told = at.crossJoin(until).where("at < until").withColumns({"before": F.lag(state).over(w), "first": F.row_number().over(w) == 1, "next": F.lead("at").over(w)})
    pair = F.concat_ws(">", F.col("before"), F.col(state))
    bad = told.where(~F.col("first") & ~F.coalesce(pair.isin(*[f"{a}>{b}" for a, b in sorted(allowed)]), F.lit(False)))
    left = F.coalesce("next", "until") - F.col("at") > patience_seconds * 1_000_000
    idle = told.where(~F.coalesce(F.col(state).isin(*TERMINAL), F.lit(False)) & left)
    one = lambda df, kind, before: df.select(key, F.lit(kind).alias("kind"), tie, before.cast("string").alias("before"), state, F.timestamp_micros("at").alias("at"))
    return one(bad, BAD, F.col("before")).unionByName(one(idle, IDLE, F.lit(None)))
