"""What happened after a signal: forward returns, excursions, one trade at a time, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import measure, ratio
from ..functions.indicators import by_bar
from ..plans.config import TradeRules

#: Parts in which the best and worst trades are found first.
PARTS = 64


def dedupe_signals(hits: DataFrame, cooldown: int) -> DataFrame:
    """Hits more than `cooldown` bars after the hit before them, kept or not."""
    gap = F.col("bar") - F.lag("bar").over(Window.partitionBy("symbol").orderBy("bar"))
    return hits.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > cooldown)).drop("_gap")


def forward_returns(bars: DataFrame, direction: int = 1, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """bars (with bar) and fwd_{h}d, mfe_20d, mae_20d, signed so that a gain is positive."""
    ahead = by_bar().rowsBetween(1, 20)
    up = ratio(F.max("high").over(ahead), F.col("close")) - 1.0
    down = ratio(F.min("low").over(ahead), F.col("close")) - 1.0
    out = {f"fwd_{h}d": measure(direction * (ratio(F.lead("close", h).over(by_bar()), F.col("close")) - 1.0)) for h in horizons}
    best, worst = (up, down) if direction > 0 else (-down, -up)
    return bars.withColumns({**out, "mfe_20d": measure(best), "mae_20d": measure(worst)})


def simulate_trades(signals: DataFrame, bars: DataFrame, rules: TradeRules | None = None) -> DataFrame:
    """signals (symbol, bar, state, direction, entry, adr20[, stop_adr_ref]) with fill, exit and result in R.

    Each signal meets its own bars ahead (at most trigger_window + max_hold of them) by one
    equi-join on (symbol, bar); every event is the first bar of a condition over that group. The
    signal's own row travels on its first bar, so that signals are found once.
    bars: symbol, bar, date, OHLC, ma_fast, ma_mid.
    """
    rules = rules or TradeRules()
    trail = "ma_mid" if rules.trail_ma >= 20 else "ma_fast"
    ref = F.coalesce(F.when(F.col("stop_adr_ref") != 0, F.col("stop_adr_ref")), F.col("adr20")) if "stop_adr_ref" in signals.columns else F.col("adr20")
    ask = signals.withColumn("_adr", ref / 100.0).select("symbol", F.col("bar").alias("at"), "state", "direction", "entry", "_adr", F.struct(*signals.columns).alias("_signal"))
    span = rules.trigger_window + rules.max_hold
    path = ask.withColumn("bar", F.explode(F.sequence(F.col("at"), F.col("at") + span))).withColumn("_signal", F.when(F.col("bar") == F.col("at"), F.col("_signal")))
    df = path.join(bars.select("symbol", "bar", "date", "open", "high", "low", "close", F.col(trail).alias("trail")), ["symbol", "bar"])
    w = Window.partitionBy("symbol", "at")
    d, long = F.col("direction"), F.col("direction") > 0
    at_once = F.col("state").isin("breakout", "ep", "short")
    crossed = F.when(long, F.col("high") >= F.col("entry")).otherwise(F.col("low") <= F.col("entry"))
    fills = F.when(at_once, F.col("bar") == F.col("at")).otherwise((F.col("bar") > F.col("at")) & (F.col("bar") <= F.col("at") + rules.trigger_window) & crossed)
    price = F.when(at_once, F.col("entry")).when(long, F.greatest("entry", "open")).otherwise(F.least("entry", "open"))
    extreme = F.when(long, F.col("low")).otherwise(F.col("high"))
    df = df.withColumn("_fill", F.min(F.when(fills, F.struct("bar", price.alias("px"), extreme.alias("extreme"), "date"))).over(w))
    df = df.withColumns({"fill_bar": F.col("_fill.bar"), "fill": F.col("_fill.px")})
    limit = F.col("fill") * (1.0 - d * F.col("_adr") * rules.max_stop_adr_mult)
    df = df.withColumn("stop0", measure(F.when(long, F.greatest(F.col("_fill.extreme"), limit)).otherwise(F.least(F.col("_fill.extreme"), limit))))
    df = df.withColumn("risk", measure((F.col("fill") - F.col("stop0")) * d))
    live = (F.col("bar") > F.col("fill_bar")) & (F.col("bar") <= F.col("fill_bar") + rules.max_hold)
    through = lambda stop: F.when(long, F.col("low") <= stop).otherwise(F.col("high") >= stop)
    gapped = lambda stop: F.when(F.when(long, F.col("open") < stop).otherwise(F.col("open") > stop), F.col("open")).otherwise(stop)
    df = df.withColumn("target", measure(F.col("fill") + d * rules.partial_at_r * F.col("risk")))
    hit = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    half = hit | (F.col("bar") - F.col("fill_bar") >= rules.partial_days)
    first = lambda c, px: F.min(F.when(live & c, F.struct("bar", px.alias("px"), "date", "close"))).over(w)
    df = df.withColumns({"_s0": first(through(F.col("stop0")), gapped(F.col("stop0"))), "_p": first(half, F.when(hit, F.col("target")).otherwise(F.col("close"))), "_last": F.max(F.when(live | (F.col("bar") == F.col("fill_bar")), F.struct("bar", F.col("close").alias("px"), "date", "close"))).over(w)})
    even = F.when(long, F.greatest("stop0", "fill")).otherwise(F.least("stop0", "fill")) if rules.breakeven_after_partial else F.col("stop0")
    took = F.col("_p.bar").isNotNull() & (F.col("_s0.bar").isNull() | (F.col("_p.bar") < F.col("_s0.bar")))
    df = df.withColumns({"stop1": even, "took": took})
    after = F.col("took") & (F.col("bar") > F.col("_p.bar"))
    broke = F.col("trail").isNotNull() & F.when(long, F.col("close") < F.col("trail")).otherwise(F.col("close") > F.col("trail"))
    df = df.withColumns({"_s1": first(after & through(F.col("stop1")), gapped(F.col("stop1"))), "_t": first(after & broke, F.col("close"))})
    by_stop = F.col("_s1.bar").isNotNull() & (F.col("_t.bar").isNull() | (F.col("_s1.bar") <= F.col("_t.bar")))
    stopped = ~F.col("took") & F.col("_s0.bar").isNotNull()
    df = df.withColumn("_exit", F.when(stopped, F.col("_s0")).when(F.col("took") & by_stop, F.col("_s1")).when(F.col("took") & F.col("_t.bar").isNotNull(), F.col("_t")).otherwise(F.col("_last")))
    outcome = F.when(stopped, "stopped").when(F.col("took") & by_stop, "trail_stop").when(F.col("took") & F.col("_t.bar").isNotNull(), "ma_trail").otherwise("max_hold")
    r = lambda px: d * ratio(px - F.col("fill"), F.col("risk"))
    part = rules.partial_fraction
    result = F.when(F.col("took"), part * r(F.col("_p.px")) + (1.0 - part) * r(F.col("_exit.px"))).otherwise(r(F.col("_exit.px")))
    seen = live & (F.col("bar") <= F.col("_exit.bar"))
    good = F.max(F.when(seen, r(F.when(long, F.col("high")).otherwise(F.col("low"))))).over(w)
    bad = F.min(F.when(seen, r(F.when(long, F.col("low")).otherwise(F.col("high"))))).over(w)
    df = df.withColumns({"_good": F.greatest(good, F.lit(0.0)), "_bad": F.least(bad, F.lit(0.0))})
    traded = F.col("fill_bar").isNotNull() & (F.col("risk") > 0)
    some = lambda c: F.when(traded, c)
    return df.where(F.col("bar") == F.col("at")).select(
        "symbol", F.col("at").alias("bar"), *[F.col("_signal")[c].alias(c) for c in signals.columns if c not in ("symbol", "bar")],
        F.when(F.col("fill_bar").isNull(), "no_trigger").when(~(F.col("risk") > 0), "bad_risk").otherwise(outcome).alias("outcome"),
        some(F.col("_fill.date")).alias("fill_date"), some(measure(F.col("fill"))).alias("fill"),
        some(measure(F.when(F.col("took"), F.col("stop1")).otherwise(F.col("stop0")))).alias("sim_stop"),
        some(F.round(measure(result), 3)).alias("r_multiple"), some(F.round(measure(F.col("_good")), 2)).alias("mfe_r"), some(F.round(measure(F.col("_bad")), 2)).alias("mae_r"),
        F.coalesce(some(F.col("_exit.bar") - F.col("fill_bar")), F.lit(0)).cast("int").alias("days_held"),
        some(F.col("_exit.date")).alias("exit_date"), some(F.col("_exit.close")).alias("exit_price"),
    )


def summarise(trades: DataFrame, *by: str) -> DataFrame:
    """Counts, win rate and R statistics; trades: outcome, r_multiple."""
    r = F.when(F.col("outcome").isNotNull() & (F.col("outcome") != "no_trigger"), F.col("r_multiple"))
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"),
        F.count(r).alias("trades"),
        F.count_if(F.col("outcome") == "no_trigger").alias("no_trigger"),
        F.round(F.count(win) / F.nullif(F.count(r), F.lit(0)), 3).alias("win_rate"),
        F.round(measure(F.avg(r)), 3).alias("avg_r"),
        F.round(measure(F.median(r)), 3).alias("median_r"),
        F.round(measure(F.sum(r)), 1).alias("total_r"),
        F.coalesce(F.round(measure(F.avg(win)), 2), F.lit(0.0)).alias("avg_win_r"),
        F.coalesce(F.round(measure(F.avg(loss)), 2), F.lit(0.0)).alias("avg_loss_r"),
        F.round(F.max(r), 2).alias("best_r"),
        F.round(F.min(r), 2).alias("worst_r"),
        F.round(measure(F.avg(r)), 3).alias("expectancy_r"),
    )


def best_and_worst(trades: DataFrame, n: int, by: str = "r_multiple") -> DataFrame:
    """The n best and the n worst trades, each row once; trades are read once, and all but n of either end of each part leave before all meet."""
    keys = ["symbol", "bar"]
    df = trades.where(F.col(by).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    for part in ("_part", F.lit(0)):
        best, worst = (F.row_number().over(Window.partitionBy(part).orderBy(order, *keys)) for order in (F.col(by).desc(), F.col(by).asc()))
        df = df.withColumns({"_best": best, "_worst": worst}).where((F.col("_best") <= n) | (F.col("_worst") <= n))
    return df.drop("_part", "_best", "_worst").dropDuplicates(keys)
