"""Bars fetched through a provider and kept: fresh ones are not asked for again, stale ones stand in for a failed request."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from . import providers
from .files import csv_folder

#: Hours after which cached bars are asked for again.
MAX_AGE_HOURS = 12
STORED = "symbol string, date date, open double, high double, low double, close double, volume double, fetched timestamp"


class CachedBars:
    """A cache under root/provider: every request appends a batch, the newest batch of a symbol counts.

    csv_dir puts a folder of TICKER.csv in a provider's place; it is read each time and not kept.
    """

    def __init__(self, spark: SparkSession, root: str, provider: str = "stooq", csv_dir: str | None = None, offline: bool = False, max_age_hours: float = MAX_AGE_HOURS) -> None:
        if csv_dir is None and provider not in providers.PROVIDERS:
            raise DataError(f"unknown provider {provider!r}; there are {sorted(providers.PROVIDERS)}")
        self.spark, self.provider, self.csv_dir, self.offline = spark, provider, csv_dir, offline
        self.path, self.max_age = f"{root.rstrip('/')}/{provider}", timedelta(hours=max_age_hours)

    def stored(self) -> DataFrame:
        """STORED rows of each symbol's newest batch; an unreadable cache counts as none."""
        try:
            rows = self.spark.read.schema(STORED).option("ignoreCorruptFiles", True).parquet(self.path)
        except Exception:
            return self.spark.createDataFrame([], STORED)
        newest = F.max("fetched").over(Window.partitionBy("symbol"))
        return rows.withColumn("_newest", newest).where("fetched = _newest").drop("_newest")

    def get(self, symbols: Iterable[str], start: date, end: date, refresh: bool = False, on_error: Callable[[str, str], None] | None = None, now: datetime | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """Bars of the symbols between two days, and the symbols without any (symbol, error); on_error hears of every failed request."""
        names = sorted({s.upper() for s in symbols})
        asked = self.spark.createDataFrame([(s,) for s in names], "symbol string")
        inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        if self.csv_dir is not None:
            bars = csv_folder(self.spark, self.csv_dir)[0].join(asked, "symbol", "left_semi").where(inside)
            missing = asked.join(bars, "symbol", "left_anti").select("symbol", F.lit("no CSV").alias("error"))
            return bars, missing
        now = now or datetime.now(timezone.utc)
        have = self.stored().groupBy("symbol").agg(F.max("fetched").alias("fetched"))
        fresh = F.lit(True) if self.offline else F.col("fetched") > F.lit(now - self.max_age)
        good = have.where(fresh) if not refresh or self.offline else have.where(F.lit(False))
        ask = [] if self.offline else [r["symbol"] for r in asked.join(good, "symbol", "left_anti").collect()]  # the list of requests
        failed = self.spark.createDataFrame([], "symbol string, error string")
        if ask:
            got, errors = providers.fetch(self.spark, self.provider, ask, start, end, **options)
            kept = got.withColumn("fetched", F.lit(now).cast("timestamp"))
            kept.unionByName(errors, allowMissingColumns=True).write.mode("append").parquet(f"{self.path}-requests/at={now:%Y%m%d%H%M%S%f}")
            back = self.spark.read.schema(f"{STORED}, error string").parquet(f"{self.path}-requests/at={now:%Y%m%d%H%M%S%f}")  # a request is made once
            back.where("error IS NULL").drop("error").repartitionByRange("symbol", "date").write.mode("append").parquet(self.path)
            failed = back.where("error IS NOT NULL").select("symbol", "error")
            if on_error:
                for r in failed.toLocalIterator():
                    on_error(r["symbol"], r["error"])
        bars = self.stored().drop("fetched").join(asked, "symbol", "left_semi")
        without = asked.join(bars.select("symbol").distinct(), "symbol", "left_anti")
        told = without.join(failed, "symbol", "left").select("symbol", F.coalesce("error", F.lit("not in the cache")).alias("error"))
        return bars.where(inside), told
