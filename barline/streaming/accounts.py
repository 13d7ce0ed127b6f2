"""Accounts as streams: trades arrive, each account's books are kept in state, its ledger goes on.

The state of an account is its equity (a value), its open positions (a map) and the trades of
days that are not over yet (a map of days). A day is closed by an event-time timer once the
watermark says that no more of its trades will come, so trades may arrive in any order within
the watermark's delay, in any number of pieces; what is emitted is the ledger of the batch replay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.portfolio import LEDGER, Account, usable
from ..plans.config import AccountConfig
from .state import with_state

TRADE = "symbol string, setup string, direction int, exit_date date, fill double, stop double, r_multiple double, score double"
_TRADE = [x.split()[0] for x in TRADE.split(", ")]
HELD = f"{TRADE}, fill_date date, shares double, risk double"
_HELD = [x.split()[0] for x in HELD.split(", ")]
_LEDGER = [x.split()[0] for x in LEDGER.split(", ")]
#: What a trade has if the stream lacks it.
ABSENT = {"stop": 0.0, "score": 0.0, "direction": 1, "setup": ""}


def over_at(day: date) -> int:
    """Milliseconds at which a day is over (UTC)."""
    return int(datetime.combine(day + timedelta(days=1), datetime.min.time(), timezone.utc).timestamp() * 1000)


class Books(StatefulProcessor):
    """The state of an account and how trades and the ends of days change it."""

    def __init__(self, cfg: AccountConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "equity double, seq long, places long")
        self.held = handle.getMapState("positions", "place long", HELD)
        self.days = handle.getMapState("days", "day date", f"trades array<struct<{TRADE.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[date, list[tuple]] = {}
        for part in rows:
            for r in part.to_dict("records"):
                if isinstance(r["symbol"], str):  # else it only moves the clock
                    new.setdefault(r["fill_date"], []).append(tuple(int(r[k]) if k == "direction" else r[k] for k in _TRADE))
                    new.setdefault(r["exit_date"], [])
        for day, trades in new.items():
            if self.days.containsKey((day,)):
                trades = [*map(tuple, self.days.getValue((day,))[0]), *trades]
            else:
                self.handle.registerTimer(over_at(day))
            self.days.updateValue((day,), (trades,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = sorted(d for (d,) in self.days.keys() if over_at(d) <= expiredTimerInfo.getExpiryTimeInMs())
        if not over:
            return
        equity, seq, places = self.book.get() if self.book.exists() else (self.cfg.starting_equity, 0, 0)
        account = Account(self.cfg, key[0], equity, seq=seq)
        account.held = [dict(zip(("place", *_HELD), (k[0], *v), strict=True)) for k, v in sorted(self.held.iterator())]
        before, out = {p["place"] for p in account.held}, []
        for day in over:
            out += account.turn(day)
            for t in sorted(self.days.getValue((day,))[0], key=lambda t: (-t[_TRADE.index("score")], t[0])):
                out += account.take({**dict(zip(_TRADE, t, strict=True)), "day": day, "place": places})
                places += 1
            self.days.removeKey((day,))
            out.append(account.closed())
        after = {p["place"]: p for p in account.held}
        for place in before - after.keys():
            self.held.removeKey((place,))
        for place in after.keys() - before:
            self.held.updateValue((place,), tuple(after[place][k] for k in _HELD))
        self.book.update((account.equity, account.seq, places))
        yield pd.DataFrame(out, columns=_LEDGER, dtype=object)

    def close(self) -> None:
        pass


def live_ledger(trades: DataFrame, cfg: AccountConfig | None = None, account: str | None = None, late: str = "1 day") -> DataFrame:
    """The ledger of a stream of trades (as the batch replay takes them), a day's rows once the watermark has passed it.

    A trade may come after trades of fill dates that are less than `late` after its own, so by
    default a day may come in several pieces; one that comes later still is left out, as is the
    way of watermarks. A row without a symbol but with a fill_date moves the
    clock, which closes all days before it.
    """
    with_state(trades.sparkSession)
    name = F.col(account).cast("string") if account else F.lit("main")
    clock = F.col("symbol").isNull() & F.col("fill_date").isNotNull()
    kinds = {k: t for k, t in (x.split() for x in TRADE.split(", "))}
    value = {k: F.coalesce(F.col(k), F.lit(v)) if k in trades.columns else F.lit(v) for k, v in ABSENT.items()}
    rows = usable(trades).unionByName(trades.where(clock))
    rows = rows.select(name.alias("account"), F.col("fill_date").cast("date").alias("fill_date"), *(value.get(k, F.col(k)).cast(t).alias(k) for k, t in kinds.items()), F.col("fill_date").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy("account").transformWithStateInPandas(Books(cfg or AccountConfig()), LEDGER, "Append", "EventTime")
