"""The engine's end-to-end plans: scan, history, backtest, explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import annotate, with_bar
from ..operators import bars as B
from ..operators import outcomes as O
from ..operators import portfolio as P
from ..operators.detectors import SETUPS, Setup
from ..operators.strength import composite_rank, latest_ranks
from .config import AccountConfig, SetupConfig, TradeRules, settings

#: Fewest bars of a symbol for a scan of the newest bar and for a sweep.
SCAN_BARS, SWEEP_BARS = 140, 200
#: Bars that the newest bar's measures can reach back over (base, impulse, long returns, slopes).
REACH = 260
FIRST = ("date", "symbol", "setup", "state", "score", "close", "pivot", "dist_from_pivot", "entry", "stop", "risk_pct", "risk_in_adr", "shares", "position_value", "target_2r", "target_3r", "adr20", "dollar_vol20", "impulse_gain", "ret_1m", "ret_3m", "ret_6m", "rs_rank", "base_len", "base_depth", "contraction", "vol_dryup", "surf_ma", "surf_dist", "outcome", "fill_date", "fill", "r_multiple", "mfe_r", "mae_r", "days_held", "exit_date", "exit_price", "fwd_5d", "fwd_10d", "fwd_20d", "fwd_60d", "mfe_20d", "mae_20d")


def _setup(s: str | Setup) -> Setup:
    return SETUPS[s] if isinstance(s, str) else s


def scan(bars: DataFrame, setup: str | Setup, cfg: SetupConfig | None = None, asof: str | None = None, states: tuple[str, ...] = (), min_score: float = 0.0) -> DataFrame:
    """Candidates on each symbol's newest bar, best first.

    Only the last REACH bars of a symbol meet the windows; the bar's position and the
    length of its history are counted before.
    """
    s = _setup(setup)
    cfg = cfg or s.presets["default"]
    if asof:
        bars = bars.where(F.col("date") <= F.lit(asof).cast("date"))
    if cfg.use_ema:  # needs all bars
        near, shift = B.with_history(bars, SCAN_BARS), None
    else:
        near = B.lookback(bars, REACH).where(F.col("history") >= SCAN_BARS)
        shift = near.groupBy("symbol").agg(F.min("bar").alias("first_bar"))
        near = near.drop("bar", "history")
    ann = annotate(near, cfg)
    ranks = latest_ranks(ann, cfg.rs_weights).select("symbol", "rs_rank")
    if cfg.min_rs_rank is not None and len(ranks.where("rs_rank IS NOT NULL").take(2)) < 2:
        cfg = settings(cfg, {"min_rs_rank": None})  # too few symbols to rank: the gate is off
    if shift is not None:
        ann = ann.join(shift, "symbol").withColumn("bar", F.col("bar") + F.col("first_bar")).drop("first_bar")
    ann = ann.join(ranks, "symbol", "left")
    hits = B.last_bars(s.detect(ann, cfg).withColumn("setup", F.lit(s.name))).where("passed").where(F.col("score") >= min_score)
    if states:
        hits = hits.where(F.col("state").isin(*states))
    return hits.orderBy(F.col("score").desc(), "symbol")


def sweep(bars: DataFrame, setup: str | Setup, cfg: SetupConfig | None = None, rules: TradeRules | None = None, start: str | None = None, cooldown: int | None = None) -> DataFrame:
    """Every de-duplicated signal on or after start, with forward returns and its simulated trade."""
    s = _setup(setup)
    cfg = cfg or s.presets["default"]
    ann = composite_rank(annotate(B.with_history(bars, SWEEP_BARS), cfg), cfg.rs_weights)
    hits = s.detect(ann, cfg).where("passed").withColumn("setup", F.lit(s.name))
    if start:
        hits = hits.where(F.col("date") >= F.lit(start).cast("date"))
    kept = O.dedupe_signals(hits, s.cooldown if cooldown is None else cooldown)
    ahead = O.forward_returns(ann.select("symbol", "bar", "high", "low", "close"), s.direction).drop("high", "low", "close")
    return O.simulate_trades(kept.join(ahead, ["symbol", "bar"]), ann, rules)


def backtest(signals: DataFrame, cfg: AccountConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades, equity curve and statistics of one account."""
    ledger = P.replay(signals, cfg)
    return ledger.where("kind = 'trade'").orderBy("fill_date", "symbol"), P.equity_curve(ledger).orderBy("date"), P.account_stats(ledger, cfg)


def explain(bars: DataFrame, setup: str | Setup, symbol: str, on: str | None = None, cfg: SetupConfig | None = None) -> DataFrame:
    """All measures and the first failed gate of one symbol at its first bar on or after a date (else its last)."""
    s = _setup(setup)
    cfg = cfg or s.presets["default"]
    ann = annotate(bars, cfg)
    if cfg.min_rs_rank is not None:
        ann = composite_rank(ann, cfg.rs_weights)
    rows = s.detect(ann.where(F.col("symbol") == symbol), cfg)
    if on:
        at = B.next_bar(bars.sparkSession.createDataFrame([(symbol, on)], "symbol string, `on` string").withColumn("on", F.to_date("on")), bars.where(F.col("symbol") == symbol)).select("symbol", "bar")
        return rows.join(at, ["symbol", "bar"], "left_semi")
    return B.last_bars(rows)


def around(bars: DataFrame, signals: DataFrame, before: int = 90, after: int = 45) -> DataFrame:
    """The bars around each signal (for charts), with `at`, the signal's bar; bars may have their positions already."""
    have = bars if "bar" in bars.columns else with_bar(bars)
    span = signals.select("symbol", F.col("bar").alias("at"), F.explode(F.sequence(F.col("bar") - before, F.col("bar") + after)).alias("bar"))
    return span.join(have, ["symbol", "bar"])
