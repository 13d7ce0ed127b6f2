"""Trailing indicators over one (symbol, date) order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import BreakoutConfig, SetupConfig
from .columns import measure
from .series import Series, by_symbol, over, rounded


def by_bar():
    """The order of a symbol's bars."""
    return Window.partitionBy("symbol").orderBy("bar")


HORIZONS = (("1m", 21), ("3m", 63), ("6m", 126))


def trailing(n: int, skip: int = 0):
    """The last n bars, the newest `skip` bars ago."""
    return by_bar().rowsBetween(-n - skip + 1, -skip)


def with_bar(bars: DataFrame) -> DataFrame:
    """bars with bar: the position in its symbol's series, from 0."""
    return bars.withColumn("bar", F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1)


def true_range() -> Column:
    before = F.lag("close", 1).over(by_bar())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float, int]]) -> DataFrame:
    """df with exponentially weighted means: name -> (column, alpha, least bars).

    The recursion needs every earlier bar, so each symbol is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        return pdf.assign(**{k: pdf[c].ewm(alpha=a, adjust=False, min_periods=n).mean() for k, (c, a, n) in columns.items()})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema} | dict.fromkeys(columns, "double")
    out = df.groupBy("symbol").applyInPandas(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    return out.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in columns})


def annotate(bars: DataFrame, cfg: SetupConfig | None = None, atr: bool = False, more: tuple[dict[str, str], Callable[[Series], dict[str, np.ndarray]]] | None = None, newest: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """bars (symbol, date, OHLCV) with bar, averages, range, volume, returns and slopes, in one pass over each symbol's bars.

    more: further columns that the same pass makes, and how (where averages are simple).
    newest: give back each symbol's last bar only (where averages are simple).
    only: the measures to make, beside bar (where averages are simple; default all).
    """
    cfg = cfg or BreakoutConfig()
    lengths = {"ma_fast": cfg.ma_fast, "ma_mid": cfg.ma_mid, "ma_slow": cfg.ma_slow}
    slopes = {"ma_mid": cfg.ma_mid, "ma_slow": cfg.ma_slow}
    simple = {} if cfg.use_ema else lengths
    measures: dict[str, Callable[[Series], np.ndarray]] = {
        "range_pct": lambda s: over(s["high"], s["low"]) - 1.0,
        "adr20": lambda s: rounded(s.mean(over(s["high"], s["low"]) - 1.0, 20, 10) * 100.0),
        "dollar_vol20": lambda s: rounded(s.mean(s["close"] * s["volume"], 20, 10), 4),
        "vol_avg20": lambda s: rounded(s.mean(s["volume"], 20, 10), 4),
        **{f"ret_{k}": lambda s, n=n: rounded(over(s["close"], s.lag(s["close"], n)) - 1.0) for k, n in HORIZONS},
        **{k: lambda s, n=n: rounded(s.mean(s["close"], n, n)) for k, n in simple.items()},
        **{f"{c}_slope": lambda s, c=c, n=n: rounded(s.slope(s[c], n)) for c, n in slopes.items() if simple},
    }
    names = [k for k in measures if not (only and simple) or k in only]
    sloped = [f"{c}_slope" for c in slopes]

    def run(s: Series) -> dict[str, np.ndarray]:
        s.known["bar"] = s.at.astype("float64")
        for k in names:
            s.known[k] = measures[k](s)
        return s.known | (more[1](s) if more and simple else {})

    kinds = {"bar": "int"} | dict.fromkeys(names, "double") | (more[0] if more and simple else {})
    df = by_symbol(bars, kinds, run, "date", newest and bool(simple))
    if not simple:
        df = smoothed(df, {k: ("close", 2.0 / (n + 1), n) for k, n in lengths.items()})
        df = df.withColumns({k: measure(F.col(k)) for k in lengths})
        df = by_symbol(df, dict.fromkeys(sloped, "double"), lambda s: {f"{c}_slope": rounded(s.slope(s[c], n)) for c, n in slopes.items()})
    if atr:
        df = smoothed(df.withColumn("true_range", true_range()), {"atr14": ("true_range", 1 / 14, 14)}).withColumn("atr14", measure(F.col("atr14"))).drop("true_range")
    return df
