"""Admission of a stream of calls: the day's counts and undecided calls are keyed state, timers decide in event time."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.operators.metering import Caps

#: The store that keyed state with timers needs, as a session setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CALL = "at long, event_id long, user string, op string, cap long, failed boolean, refund_of long"
DECISION = "event_id long, day date, admitted boolean, reason string"


class DayAdmission(StatefulProcessor):
    """One day's calls in order of time and id.

    Calls wait in state until the watermark has passed them, as an earlier one may still
    come; then they are decided in order, so the split of the stream into batches changes
    nothing. Of the decided ones only counts and the admitted ids are kept, bounded by the caps,
    and nothing once the day is over.
    """

    def __init__(self, caps: dict[str, int]):
        self.caps = Caps(**caps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", CALL)
        self.counts = handle.getMapState("counts", "user string, op string", "n long")
        self.shared = handle.getValueState("shared", "n long, aux long")
        self.admitted = handle.getMapState("admitted", "event_id long", "user string, op string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            calls = [(int(r.at), int(r.event_id), r.user, r.op, int(r.cap), bool(r.failed), None if r.refund_of is None else int(r.refund_of)) for r in part.itertuples(index=False)]
            if calls:
                self.waiting.appendList(calls)
                first = min([c[0] for c in calls] + ([first] if first is not None else []))
        if first is not None:
            self.wake(first, timerValues)
        return iter([])

    def wake(self, at: int, timerValues) -> None:
        """Ask to be called when the watermark is past ``at`` (microseconds), or in the next batch if it is."""
        self.handle.registerTimer(max(at // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        calls = sorted((tuple(c) for c in self.waiting.get()), key=lambda c: (c[0], c[6] is not None, c[1])) if self.waiting.exists() else []
        due, rest = [c for c in calls if c[0] < passed], [c for c in calls if c[0] >= passed]
        if due:
            yield self.decisions(key[0], due)
        if rest:
            self.waiting.put(rest)
            self.wake(rest[0][0], timerValues)
            return
        self.waiting.clear()
        over = int(datetime.datetime.combine(key[0] + datetime.timedelta(days=1), datetime.time(), datetime.timezone.utc).timestamp()) * 1000
        if timerValues.getCurrentWatermarkInMs() >= over:
            for state in (self.counts, self.shared, self.admitted):
                state.clear()
        else:
            self.handle.registerTimer(over)

    def decisions(self, day, calls: list[tuple]) -> pd.DataFrame:
        n, aux = self.shared.get() if self.shared.exists() else (0, 0)
        own: dict[tuple, int] = {}
        out = []

        def count(user, op) -> int:
            if (user, op) not in own:
                own[user, op] = self.counts.getValue((user, op))[0] if self.counts.containsKey((user, op)) else 0
            return own[user, op]

        for _, event_id, user, op, cap, failed, refund_of in calls:
            if refund_of is not None:
                if self.admitted.containsKey((refund_of,)):
                    user, op = self.admitted.getValue((refund_of,))
                    self.admitted.removeKey((refund_of,))
                    own[user, op] = count(user, op) - 1
                    n, aux = n - 1, aux - (op == "aux")
                continue
            reason = "global" if n >= self.caps.total else "aux_global" if op == "aux" and aux >= self.caps.total_aux else "user" if count(user, op) >= cap else None
            if reason is None and not failed:
                own[user, op] += 1
                n, aux = n + 1, aux + (op == "aux")
                self.admitted.updateValue((event_id,), (user, op))
            out.append((event_id, day, reason is None, reason))
        self.shared.update((n, aux))
        for key, value in own.items():
            self.counts.updateValue(key, (value,))
        return pd.DataFrame(out, columns=["event_id", "day", "admitted", "reason"])

    def close(self) -> None:
        pass


def admission_stream(calls: DataFrame, caps: Caps, ts: str = "ts", user: str = "user", op: str = "op", event_id: str = "event_id", cap: Column | None = None, failed: Column | None = None, refund_of: Column | None = None, late: str = "1 hour") -> DataFrame:
    """event_id, day, admitted, reason of a stream of calls, as ``metering.admission`` gives them.

    A call is decided when the watermark (``late`` behind the latest call) has passed it.
    A row with ``refund_of`` is no call: it gives back the admitted call of that id, from its own
    time on (after calls of the same moment), on the same day. ``cap`` is the user's
    own cap; ids are whole numbers, a null user is one like any other. The session
    needs STATE_STORE. A day's calls are decided by one task, since one cap covers them all.
    """
    own = F.when(F.col(op) == "aux", caps.user_aux).otherwise(caps.user) if cap is None else cap
    no = lambda c, other: F.coalesce(c, other) if c is not None else other
    slim = calls.withWatermark(ts, late).select(F.col(ts), F.to_date(ts).alias("day"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(event_id).cast("long").alias("event_id"), F.coalesce(F.col(user).cast("string"), F.lit("")).alias("user"), F.col(op).alias("op"), own.cast("long").alias("cap"), no(failed, F.lit(False)).alias("failed"), (F.lit(None) if refund_of is None else refund_of).cast("long").alias("refund_of"))
    return slim.groupBy("day").transformWithStateInPandas(DayAdmission(asdict(caps)), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")
