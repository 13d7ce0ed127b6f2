"""Symbols whose requests fail too often rest for some days: value state and a timer per symbol."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.store import BENCH_DAYS, FAILURES
from .state import with_state

EVENTS = "symbol string, at timestamp, event string, failures int, until timestamp, error string"
_EVENTS = [x.split()[0] for x in EVENTS.split(", ")]


def _ms(at: datetime) -> int:
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000)


class Bench(StatefulProcessor):
    """Counts a symbol's failures in a row; enough of them bench it, and a timer releases it."""

    def __init__(self, failures: int, days: int) -> None:
        self.failures, self.days = failures, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("failures", "failures int, until long")  # until: milliseconds, 0 if not benched

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, until = self.count.get() if self.count.exists() else (0, 0)
        out = []
        for r in sorted((r for part in rows for r in part.to_dict("records")), key=lambda r: r["at"]):
            at, failed = pd.Timestamp(r["at"]).to_pydatetime(), isinstance(r["error"], str)
            if until and _ms(at) >= until:  # its time was up before the timer ran
                out.append((key[0], datetime.fromtimestamp(until / 1000, timezone.utc).replace(tzinfo=None), "released", failures, None, None))
                until = self._rest(until, 0)
            failures = failures + 1 if failed else 0
            if failed and failures >= self.failures:
                end = at + timedelta(days=self.days)
                out.append((key[0], at, "rests longer" if until else "benched", failures, end, r["error"]))
                until = self._rest(until, _ms(end))
            elif not failed and until:
                out.append((key[0], at, "released", 0, None, None))
                until = self._rest(until, 0)
        self.count.update((failures, until))
        yield pd.DataFrame(out, columns=_EVENTS, dtype=object)

    def _rest(self, old: int, new: int) -> int:
        """Move the timer."""
        if old:
            self.handle.deleteTimer(old)
        if new:
            self.handle.registerTimer(new)
        return new

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until = self.count.get() if self.count.exists() else (0, 0)
        if until and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.count.update((failures, 0))
            yield pd.DataFrame([(key[0], datetime.fromtimestamp(until / 1000, timezone.utc).replace(tzinfo=None), "released", failures, None, None)], columns=_EVENTS, dtype=object)

    def close(self) -> None:
        pass


def benching(attempts: DataFrame, failures: int = FAILURES, days: int = BENCH_DAYS, late: str = "1 hour") -> DataFrame:
    """attempts (symbol, at, error: null if it went well), a stream, to the bench's events (symbol, at, event, failures, until, error).

    A symbol is benched by its `failures`-th failure in a row, for `days` from it; another failure
    meanwhile (a forced request) makes it rest longer, a success releases it. The count stays when
    its time is up, so the next failure benches it again.
    """
    with_state(attempts.sparkSession)
    rows = attempts.where("symbol IS NOT NULL AND at IS NOT NULL").select("symbol", F.col("at").cast("timestamp").alias("at"), F.col("error").cast("string").alias("error"))
    return rows.withWatermark("at", late).groupBy("symbol").transformWithStateInPandas(Bench(failures, days), EVENTS, "Append", "EventTime")


def resting(events: DataFrame, now) -> DataFrame:
    """symbol, until: the symbols on the bench at a time, from the events so far."""
    at = F.lit(now).cast("timestamp")
    order = F.struct("at", (F.col("event") != "released").alias("later"))
    last = events.where(F.col("at") <= at).groupBy("symbol").agg(F.max_by(F.struct("event", "until"), order).alias("last"))
    return last.where((F.col("last.event") != "released") & (F.col("last.until") > at)).select("symbol", "last.until")
