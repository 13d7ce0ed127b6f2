"""Price providers over HTTP as a Python data source: one partition per few symbols, errors as rows."""

from __future__ import annotations

import csv
import io
import json
import os
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import DataError

Bar = tuple[date, float, float, float, float, float]
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, error string"


class ProviderError(RuntimeError):
    """A provider has no usable answer."""


def _get(url: str, timeout: int = 30) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "*/*"}), timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def parse_csv(text: str) -> Iterator[Bar]:
    """Bars of a CSV answer (Date, Open, High, Low, Close, Volume)."""
    if not text.strip() or text.lstrip().startswith("<"):
        raise ProviderError("no data")
    rows = csv.DictReader(io.StringIO(text))
    if "Date" not in (rows.fieldnames or []):
        raise ProviderError("unexpected answer")
    for r in rows:
        yield (date.fromisoformat(r["Date"]), *(float(r.get(k) or "nan") for k in ("Open", "High", "Low", "Close", "Volume")))


def parse_json(text: str) -> Iterator[Bar]:
    """Bars of a JSON answer with adjusted prices."""
    rows = json.loads(text)
    if not rows:
        raise ProviderError("no rows")
    for r in rows:
        yield (date.fromisoformat(r["date"][:10]), *(float(r[k]) for k in ("adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume")))


def stooq(symbol: str, start: date, end: date) -> Iterator[Bar]:
    name = symbol.lower().replace(".", "-")
    yield from (b for b in parse_csv(_get(f"https://stooq.com/q/d/l/?s={name}.us&i=d")) if start <= b[0] <= end)


def tiingo(symbol: str, start: date, end: date) -> Iterator[Bar]:
    if not (token := os.environ.get("TIINGO_API_KEY")):
        raise ProviderError("TIINGO_API_KEY is not set")
    yield from parse_json(_get(f"https://api.tiingo.com/tiingo/daily/{symbol}/prices?startDate={start}&endDate={end}&format=json&token={token}"))


def yfinance(symbol: str, start: date, end: date) -> Iterator[Bar]:
    try:
        import yfinance as yf
    except ImportError as e:
        raise ProviderError("yfinance is not installed") from e
    df = yf.download(symbol, start=str(start), end=str(end), interval="1d", auto_adjust=True, progress=False)
    df.columns = [c[0] if isinstance(c, tuple) else c for c in df.columns]
    for day, r in df.iterrows():
        yield (day.date(), *(float(r[k]) for k in ("Open", "High", "Low", "Close", "Volume")))


def by_url(template: str, symbol: str, start: date, end: date) -> Iterator[Bar]:
    """CSV bars from any address; {symbol}, {start} and {end} stand for what is asked."""
    yield from (b for b in parse_csv(_get(template.format(symbol=symbol, start=start, end=end))) if start <= b[0] <= end)


PROVIDERS: dict[str, Callable[[str, date, date], Iterator[Bar]]] = {"stooq": stooq, "tiingo": tiingo, "yfinance": yfinance}


def default_window(years: float = 3, today: date | None = None) -> tuple[date, date]:
    """Enough days for `years` and the indicators' run-up."""
    today = today or date.today()
    return today + timedelta(days=1) - timedelta(days=int(365.25 * years + 200)), today + timedelta(days=1)


def with_retry(fetch: Callable[[], list[Bar]], tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[Bar]:
    """The answer, after up to `tries` attempts with doubling, jittered pauses."""
    for k in range(tries):
        try:
            return fetch()
        except Exception:
            if k == tries - 1:
                raise
            sleep(pause * 2**k * (0.5 + random.random()))
    return []


def asked(options: dict) -> Callable[[str, date, date], Iterator[Bar]]:
    """The request that the options name: a provider, or the address of one (`url`)."""
    if template := options.get("url"):
        return lambda symbol, start, end: by_url(template, symbol, start, end)
    return PROVIDERS[options["provider"]]


def named(options: dict) -> list[str]:
    return [x for x in options.get("symbols", "").split(",") if x]


class Requests(InputPartition):
    """(symbol, first day, last day) each."""

    def __init__(self, each: list[tuple[str, str, str]]) -> None:
        self.each = each


def dealt(each: list[tuple[str, str, str]], options: dict) -> list[Requests]:
    n = int(options.get("per_partition", "20"))
    return [Requests(each[i : i + n]) for i in range(0, len(each), n)]


def answers(options: dict, partition: Requests, tolerant: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA; a symbol's failure is a row too, or the task's if not tolerant."""
    fetch = asked(options)
    for s, start, end in partition.each:
        time.sleep(float(options.get("pause", "0")))
        try:
            for b in with_retry(lambda s=s, a=start, z=end: list(fetch(s, date.fromisoformat(a), date.fromisoformat(z))), pause=float(options.get("retry_pause", "1"))):
                yield (s, *b, None)
        except Exception as e:
            if not tolerant:
                raise
            yield (s, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Requests]:
        return dealt([(s, self.options["start"], self.options["end"]) for s in named(self.options)], self.options) or [Requests([])]

    def read(self, partition: Requests) -> Iterator[tuple]:
        yield from answers(self.options, partition)


class StreamReader(DataSourceStreamReader):
    """Bars day by day: the offset is the next day to be asked for, of each symbol.

    A batch asks for the days between two offsets, which Spark logs before it reads, so a query
    that stops asks for the same days again until their batch is committed, and for none twice
    after that. Symbols may be added from one start to the next (they begin at `start`) or left
    out (their place is kept). The last day asked for is `today` (by default the day on which the
    batch is planned). With failures="raise" a symbol that fails after all tries fails the batch,
    which then is asked for again; with failures="rows" (the default) it is a row with `error`, and the day
    it was asked from is in `date`, so that it can be asked for by other means.
    """

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {s: self.options["start"] for s in named(self.options)}

    def latestOffset(self) -> dict:
        today = date.fromisoformat(self.options["today"]) if self.options.get("today") else date.today()
        return {s: str(max(today + timedelta(days=1), date.fromisoformat(self.options["start"]))) for s in named(self.options)}

    def partitions(self, start: dict, end: dict) -> list[Requests]:
        first = self.options["start"]
        each = [(s, start.get(s, first), str(date.fromisoformat(z) - timedelta(days=1))) for s, z in sorted(end.items()) if start.get(s, first) < z]
        return dealt(each, self.options) or [Requests([])]

    def read(self, partition: Requests) -> Iterator[tuple]:
        if self.options.get("failures", "rows") == "raise":
            yield from answers(self.options, partition, tolerant=False)
            return
        since = {s: date.fromisoformat(a) for s, a, _ in partition.each}
        for r in answers(self.options, partition):
            yield r if r[-1] is None else (r[0], since[r[0]], *r[2:])

    def commit(self, end: dict) -> None:
        """Nothing is held for days that are done."""


class PriceBars(DataSource):
    """spark.read or spark.readStream .format("price_bars").option("provider", ...) (or "url") .option("symbols", "A,B")"""

    @classmethod
    def name(cls) -> str:
        return "price_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def fetch(spark: SparkSession, provider: str, symbols: list[str], start: date, end: date, **options) -> tuple[DataFrame, DataFrame]:
    """Bars, and the symbols that failed (symbol, error)."""
    if provider not in PROVIDERS and "url" not in options:
        raise DataError(f"unknown provider {provider!r}; there are {sorted(PROVIDERS)}")
    spark.dataSource.register(PriceBars)
    given = {"provider": provider, "symbols": ",".join(symbols), "start": str(start), "end": str(end)} | {k: str(v) for k, v in options.items()}
    got = spark.read.format("price_bars").options(**given).load()
    return got.where("error IS NULL").drop("error"), got.where("error IS NOT NULL").select("symbol", "error")


def bars_stream(spark: SparkSession, provider: str, symbols: list[str], start: date, **options) -> DataFrame:
    """SCHEMA rows of the days from start on, as they come to be; options: url, today, failures, pause, per_partition."""
    if provider not in PROVIDERS and "url" not in options:
        raise DataError(f"unknown provider {provider!r}; there are {sorted(PROVIDERS)}")
    spark.dataSource.register(PriceBars)
    given = {"provider": provider, "symbols": ",".join(symbols), "start": str(start)} | {k: str(v) for k, v in options.items()}
    return spark.readStream.format("price_bars").options(**given).load()
