"""Bars: derivation from line items, cleaning, keep-last merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import finite, ratio
from ..functions.indicators import with_bar

OHLC = ("open", "high", "low", "close")
CANONICAL = ("symbol", "date", *OHLC, "volume")

DERIVED = """
WITH daily AS (
  SELECT cast(l_suppkey AS STRING) AS symbol, cast(l_shipdate AS DATE) AS date,
         avg(l_discount) AS disc, avg(l_tax) AS tax, sum(l_quantity) AS q,
         CASE WHEN max(l_extendedprice) >= 102000 THEN 0.15D ELSE 0.0D END AS gap
  FROM {lines} GROUP BY 1, 2),
walk AS (
  SELECT *, 20 * exp(sum(0.9D * (disc - 0.05D) + gap - (SELECT avg(gap) FROM daily)) OVER (
    PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS c FROM daily),
opened AS (
  SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY date), 20.0D) * exp(gap) AS o FROM walk)
SELECT symbol, date, round(o, 4) AS open, round(greatest(o, c) * (1 + tax / 2), 4) AS high,
       round(least(o, c) * (1 - tax / 2), 4) AS low, round(c, 4) AS close,
       q * 1e5D * CASE WHEN gap > 0 THEN 6 ELSE 1 END AS volume
FROM opened
"""


#: Rows that a task takes: the number of tasks grows with the table, their memory does not.
ROWS = 250_000


def parts_for(df: DataFrame) -> int:
    """Tasks for the rows of a table, which are counted (files of Parquet say how many they have)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def derived_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars per supplier made from line items, which are shuffled once: days and series are made of the same partitions."""
    lines = lineitem.select(F.col("l_suppkey").cast("string").alias("l_suppkey"), "l_shipdate", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    return lineitem.sparkSession.sql(DERIVED, lines=lines.repartition(parts_for(lineitem), "l_suppkey"))


def tidy_names(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names; spellings of the adjusted close are made one. A name given twice counts once, the first."""
    same = {"adj_close": "adj close", "adjclose": "adj close"}
    names, seen = [], set()
    for c in df.columns:
        n = c.strip().lower()
        n = same.get(n, n)
        names.append(None if n in seen else n)
        seen.add(n)
    df = df.toDF(*[f"_{i}" for i in range(len(names))])
    return df.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names) if n])


def adjusted(df: DataFrame) -> DataFrame:
    """Prices scaled by adjusted / raw close where the ratio is usable; volume stays."""
    if "adj close" not in df.columns:
        return df
    if "close" not in df.columns:
        return df.withColumnRenamed("adj close", "close")
    factor = finite(ratio(F.col("adj close").cast("double"), F.col("close").cast("double")))
    factor = F.when(factor != 0, factor)
    return df.withColumn("_f", F.coalesce(factor, F.lit(1.0))).withColumns({c: F.col(c).cast("double") * F.col("_f") for c in OHLC if c in df.columns}).drop("_f", "adj close")


def keep_last(df: DataFrame, order: str = "ord") -> DataFrame:
    """The row of each (symbol, date) that arrived last, by column `order`."""
    w = Window.partitionBy("symbol", "date").orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def day_of(c: str) -> Column:
    """The day of a date written in one of the usual ways; NULL if in none."""
    text = F.col(c).cast("string")
    return F.to_date(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("M/d/yyyy"))))


def normalized(df: DataFrame, order: str | None = None) -> DataFrame:
    """Canonical bars from messy rows: names, adjustment, types, keep-last, bad prices out, extremes widened.

    A missing column is an error that names it. Rows are de-duplicated before bad prices
    leave, so a later bad row hides an earlier good one.
    """
    df = adjusted(tidy_names(df))
    if missing := [c for c in CANONICAL if c not in df.columns]:
        raise DataError(f"missing columns: {missing}")
    number = lambda c: finite(F.col(c).try_cast("double")).alias(c)
    rows = df.select(F.col("symbol").cast("string").alias("symbol"), day_of("date").alias("date"), *[number(c) for c in (*OHLC, "volume")], *([F.col(order)] if order else [])).where("date IS NOT NULL")
    if order:
        rows = keep_last(rows, order).drop(order)
    good = rows.where(" AND ".join(f"{c} > 0" for c in OHLC))
    return good.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored and fresh bars, the fresh row where both have one."""
    both = stored.select(*CANONICAL, F.lit(0).alias("_o")).unionByName(fresh.select(*CANONICAL, F.lit(1).alias("_o")))
    return keep_last(both, "_o").drop("_o")


def drift(stored: DataFrame, fresh: DataFrame, tolerance: float = 0.002, least: int = 3) -> DataFrame:
    """symbol, shared, drift, readjusted: median relative change of the closes both have; a provider has rewritten history if it exceeds tolerance."""
    old, new = stored.select("symbol", "date", F.col("close").alias("old")), fresh.select("symbol", "date", F.col("close").alias("new"))
    change = ratio(F.abs(F.col("new") - F.col("old")), F.col("old"))
    out = old.join(new, ["symbol", "date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("shared"), F.round(F.median(change), 9).alias("drift"))
    return out.withColumn("readjusted", F.coalesce((F.col("shared") >= least) & (F.col("drift") > tolerance), F.lit(False)))


def last_bars(bars: DataFrame) -> DataFrame:
    """The newest bar of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return bars.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_history(bars: DataFrame, least: int) -> DataFrame:
    """Bars of symbols that have at least so many."""
    return bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("_n") >= least).drop("_n")


def next_bar(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """wanted (symbol, wanted date `on`) with the first bar on or after the date, else the last bar; symbols without bars are left out.

    Wanted dates stand among the bars of their symbol, newest first, and take the last bar
    passed, so each row is sorted once and none is multiplied.
    """
    have = with_bar(bars).select("symbol", "date", F.lit(None).cast("date").alias("on"), "bar")
    ask = wanted.select("symbol", F.col("on").alias("date"), "on", F.lit(None).cast("int").alias("bar"))
    order = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("bar").desc_nulls_last())
    at = F.struct("bar", "date")
    ahead = F.last(F.when(F.col("bar").isNotNull(), at), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max(F.when(F.col("bar").isNotNull(), at)).over(Window.partitionBy("symbol"))
    found = have.unionByName(ask).withColumn("_at", F.coalesce(ahead, newest))
    return found.where(F.col("on").isNotNull() & F.col("_at").isNotNull()).select("symbol", F.col("_at.bar").alias("bar"), "on", F.col("_at.date").alias("date"))


def lookback(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol, with bar and history counted before: for scans of the newest bar, whose windows reach no further."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    df = with_bar(bars).withColumn("history", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
