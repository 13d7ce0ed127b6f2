"""Registered queries of the bar engine and their SQL twins.

Bars come from line items (operators.bars.derived_bars); the twins build them and every
measure again in DuckDB SQL, with self-joins where the engine uses windows over structs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import measure
from .functions.indicators import annotate, smoothed, true_range, with_bar
from .operators import bars as B
from .operators import detectors as D
from .operators import outcomes as O
from .operators import portfolio as P
from .operators.strength import RETURNS, composite_rank, latest_ranks

CFG = D.SETUPS["breakout"].presets["default"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.derived_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def annotated(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return annotate(bars(spark, sf_dir), **how)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite_rank(annotated(spark, sf_dir, only=RETURNS), parts=B.parts_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BARS_SQL = """
daily AS (
  SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS date, avg(l_discount) AS disc, avg(l_tax) AS tax, sum(l_quantity) AS q,
         CASE WHEN max(l_extendedprice) >= 102000 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS gap0
  FROM lineitem GROUP BY 1, 2),
walk AS (
  SELECT *, 20 * exp(sum(0.9::DOUBLE * (disc - 0.05::DOUBLE) + gap0 - (SELECT avg(gap0) FROM daily)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS c FROM daily),
opened AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol ORDER BY date), 20::DOUBLE) * exp(gap0) AS o FROM walk),
bars AS MATERIALIZED (
  SELECT symbol, date, round(o, 4) AS open, round(greatest(o, c) * (1 + tax / 2), 4) AS high, round(least(o, c) * (1 - tax / 2), 4) AS low,
         round(c, 4) AS close, q * 1e5::DOUBLE * CASE WHEN gap0 > 0 THEN 6 ELSE 1 END AS volume,
         (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1)::INTEGER AS bar
  FROM opened)"""


def _win(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n + skip - 1} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def _mean(x: str, n: int, least: int, places: int = 9) -> str:
    return f"round(CASE WHEN count({x}) OVER {_win(n)} >= {least} THEN avg({x}) OVER {_win(n)} END, {places})"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY bar)"


def _slope(x: str, n: int) -> str:
    return f"round(CASE WHEN count({x}) OVER {_win(n)} >= {n} THEN regr_slope({x}, bar) OVER {_win(n)} / nullif(avg({x}) OVER {_win(n)}, 0) * 100 END, 9)"


ANN_SQL = f"""{BARS_SQL},
ann0 AS (
  SELECT *, high / low - 1 AS range_pct,
         round(CASE WHEN count(*) OVER {_win(20)} >= 10 THEN avg(high / low - 1) OVER {_win(20)} * 100 END, 9) AS adr20,
         {_mean("close * volume", 20, 10, 4)} AS dollar_vol20, {_mean("volume", 20, 10, 4)} AS vol_avg20,
         round(close / {_lag("close", 21)} - 1, 9) AS ret_1m, round(close / {_lag("close", 63)} - 1, 9) AS ret_3m, round(close / {_lag("close", 126)} - 1, 9) AS ret_6m,
         {_mean("close", 10, 10)} AS ma_fast, {_mean("close", 20, 20)} AS ma_mid, {_mean("close", 50, 50)} AS ma_slow
  FROM bars),
ann AS MATERIALIZED (SELECT *, {_slope("ma_mid", 20)} AS ma_mid_slope, {_slope("ma_slow", 50)} AS ma_slow_slope FROM ann0)"""


def _pct(x: str, by: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2) * 100.0 / count({x}) OVER (PARTITION BY {by}) END)"


def _ranks(source: str, by: str) -> str:
    return f"""ranks0 AS (SELECT *, {_pct("ret_1m", by)} AS rank_1m, {_pct("ret_3m", by)} AS rank_3m, {_pct("ret_6m", by)} AS rank_6m FROM {source}),
blend AS (
  SELECT *, round((coalesce(rank_1m, 0) * 0.4::DOUBLE + coalesce(rank_3m, 0) * 0.3::DOUBLE + coalesce(rank_6m, 0) * 0.3::DOUBLE)
    / nullif(CASE WHEN rank_1m IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN rank_3m IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN rank_6m IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END, 0), 9) AS mix
  FROM ranks0),
ranked AS (SELECT *, {_pct("mix", by)} AS rs_rank FROM blend)"""


def _tradable(c, dollar: str = "dollar_vol20") -> str:
    return f"""WHEN close IS NULL OR adr20 IS NULL THEN 'nan_inputs' WHEN close < {c.min_price} THEN 'price'
    WHEN {dollar} IS NULL OR {dollar} < {c.min_dollar_volume} THEN 'liquidity' WHEN adr20 < {c.min_adr_pct} OR adr20 > {c.max_adr_pct} THEN 'adr'"""


def _plan(entry: str, raw: str, adr: str, d: int, c) -> str:
    """CTEs plan0..plan from `gated`."""
    side = "greatest" if d > 0 else "least"
    return f"""plan0 AS (SELECT *, round({entry}, 9) AS entry, round({raw}, 9) AS raw_stop FROM gated),
plan1 AS (SELECT *, round({side}(raw_stop, entry * (1 - {d} * ({adr} / 100 * {c.max_stop_adr_mult}))), 9) AS stop FROM plan0),
plan2 AS (SELECT *, round((entry - stop) * {d}, 9) AS risk FROM plan1),
plan AS (
  SELECT *, coalesce(CASE WHEN risk > 0 THEN floor(least({c.account_size * c.risk_pct} / risk, {c.account_size * c.max_position_pct} / entry)) END, 0)::BIGINT AS shares,
         CASE WHEN risk > 0 THEN round(risk / entry, 9) END AS risk_pct,
         CASE WHEN risk > 0 THEN round(entry + {2 * d} * risk, 9) END AS target_2r, CASE WHEN risk > 0 THEN round(entry + {3 * d} * risk, 9) END AS target_3r
  FROM plan2)"""


def _clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 0 ELSE greatest(0, least(1, {x})) END"


def _band(x: str, best: float, worst: float) -> str:
    return _clamp(f"(({x}) - {worst}::DOUBLE) / {best - worst}::DOUBLE")


def _score(*parts: tuple[str, float]) -> str:
    total = sum(w for _, w in parts)
    return f"round(round(({' + '.join(f'({p}) * {w}::DOUBLE' for p, w in parts)}) * 100.0 / {total}::DOUBLE, 6), 1)"


def _breakout_sql(c=CFG) -> str:
    over = lambda first, last: f"OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN greatest(0, coalesce({first}, 0)) PRECEDING AND greatest(0, coalesce({last}, 0)) PRECEDING)"
    base, half = over("base_len", "1"), "greatest(1, base_len // 2)"
    seg = ", ".join(f"round(avg(abs(close - {m}) / close) {base}, 9) AS surf_{m}" for m in ("ma_fast", "ma_mid", "ma_slow"))
    moves = ", ".join(f"(close / {_lag('close', n)} - 1) / {t}::DOUBLE" for n, t in c.move_lookbacks)
    part = lambda x, top, span: _clamp(f"({top}::DOUBLE - ({x})) / {max(1e-9, span)}::DOUBLE")
    given = lambda x, y: f"CASE WHEN {x} IS NULL THEN 0.6 ELSE {y} END"
    score = _score(
        (_clamp("(move_ratio - 0.8::DOUBLE) / 1.2::DOUBLE"), 0.25), (part("base_depth", c.max_base_depth, c.max_base_depth - c.ideal_base_depth), 0.15),
        (given("contraction", part("contraction", c.max_contraction_ratio, c.max_contraction_ratio - 0.45)), 0.12),
        (given("vol_dryup", part("vol_dryup", c.max_volume_dryup_ratio, c.max_volume_dryup_ratio - 0.35)), 0.10),
        (part("surf_dist", c.max_surf_distance, c.max_surf_distance - 0.015), 0.13), (part("dist_from_pivot", c.max_dist_from_pivot, c.max_dist_from_pivot), 0.10),
        (_clamp(f"(adr20 - {c.min_adr_pct}::DOUBLE) / {8.0 - c.min_adr_pct}::DOUBLE"), 0.10),
        (f"CASE WHEN base_len BETWEEN 5 AND 40 THEN 1.0 ELSE {_clamp('1.0 - abs(base_len - 22) / 45.0')} END", 0.05),
    )
    return f"""{ANN_SQL},
top AS (
  SELECT *, round(greatest(0, {moves}), 9) AS move_ratio, max(high) OVER {_win(c.max_base_len, 1)} AS pivot, min(low) OVER {_win(3)} AS low3 FROM ann),
piv AS (
  SELECT t.symbol, t.bar, min(p.bar) AS pivot_bar FROM top t JOIN bars p ON p.symbol = t.symbol AND p.bar BETWEEN t.bar - {c.max_base_len} AND t.bar - 1 AND p.high = t.pivot
  GROUP BY 1, 2),
imp0 AS (SELECT symbol, bar, min(low) OVER {_win(91)} AS impulse_low FROM bars),
imp AS (
  SELECT i.symbol, i.bar AS pivot_bar, any_value(impulse_low) AS impulse_low, min(b.bar) AS impulse_bar
  FROM imp0 i JOIN bars b ON b.symbol = i.symbol AND b.bar BETWEEN i.bar - 90 AND i.bar AND b.low = i.impulse_low GROUP BY 1, 2),
loc AS MATERIALIZED (
  SELECT t.*, pivot_bar, (t.bar - pivot_bar)::INTEGER AS base_len, impulse_low, impulse_bar, round(pivot / impulse_low - 1, 9) AS impulse_gain
  FROM top t LEFT JOIN piv USING (symbol, bar) LEFT JOIN imp USING (symbol, pivot_bar)),
early AS (
  SELECT *, CASE WHEN bar < {max(c.ma_slow, 126, c.max_base_len + 5)} THEN 'warmup' {_tradable(c)}
    WHEN move_ratio IS NULL OR move_ratio < 1 THEN 'no_prior_move' WHEN base_len < {c.min_base_len} THEN 'base_too_short' WHEN base_len > {c.max_base_len} THEN 'base_too_long' ELSE '' END AS early
  FROM loc),
seg AS (
  SELECT *, CASE WHEN base_len >= 2 THEN min(low) {over("base_len - 1", "1")} END AS base_low0,
         round(avg(range_pct) {over("base_len - base_len // 2", "1")} / nullif(avg(range_pct) {over("base_len", "base_len - base_len // 2 + 1")}, 0), 9) AS ratio,
         round(coalesce(regr_slope(low, bar::DOUBLE) {base} / nullif(avg(low) {base}, 0) * 100, 0), 9) AS low_slope0,
         round(CASE WHEN base_len > {half} THEN avg(volume) {over(f"base_len - {half}", "1")} END / nullif(avg(volume) {over("bar - impulse_bar", "base_len")}, 0), 9) AS vol_dryup0, {seg.replace(" AS surf_", " AS near_")}
  FROM early),
segs AS (
  SELECT *, {", ".join(f"CASE WHEN early = '' THEN {x} END AS {y}" for x, y in (("base_low0", "base_low"), ("low_slope0", "low_slope"), ("vol_dryup0", "vol_dryup"), ("near_ma_fast", "surf_ma_fast"), ("near_ma_mid", "surf_ma_mid"), ("near_ma_slow", "surf_ma_slow")))} FROM seg),
meas AS (
  SELECT *, round((pivot - base_low) / pivot, 9) AS base_depth, CASE WHEN base_len >= 6 AND early = '' THEN ratio END AS contraction,
         least(surf_ma_fast, surf_ma_mid, surf_ma_slow) AS surf_dist,
         round(greatest(0, (pivot - close) / pivot), 9) AS dist_from_pivot, round(volume / nullif(vol_avg20, 0), 9) AS vol_mult
  FROM segs),
stated AS (
  SELECT *, CASE WHEN high > pivot AND close > pivot AND coalesce(vol_mult >= {c.breakout_volume_mult}, true) THEN 'breakout' ELSE 'setup' END AS state,
         CASE surf_dist WHEN surf_ma_fast THEN 'fast' WHEN surf_ma_mid THEN 'mid' WHEN surf_ma_slow THEN 'slow' END AS surf_ma FROM meas),
gated AS (
  SELECT *, CASE WHEN early <> '' THEN early WHEN base_depth > {c.max_base_depth} THEN 'base_too_deep' WHEN contraction > {c.max_contraction_ratio} THEN 'no_contraction'
    WHEN low_slope < {c.min_low_slope} THEN 'lows_breaking_down' WHEN base_len > {c.max_bars_since_impulse} THEN 'stale_move' WHEN vol_dryup > {c.max_volume_dryup_ratio} THEN 'volume_not_drying_up'
    WHEN ma_fast IS NULL OR ma_mid IS NULL OR ma_slow IS NULL THEN 'nan_ma' WHEN close < ma_slow THEN 'below_slow_ma' WHEN NOT (ma_fast > ma_mid AND ma_mid > ma_slow) THEN 'ma_not_stacked'
    WHEN ma_mid_slope IS NULL OR ma_mid_slope <= 0 THEN 'mid_ma_not_rising' WHEN surf_dist IS NULL OR surf_dist > {c.max_surf_distance} THEN 'not_surfing_ma'
    WHEN state = 'setup' AND dist_from_pivot > {c.max_dist_from_pivot} THEN 'far_from_pivot' ELSE '' END AS reject
  FROM stated),
{_plan("CASE WHEN state = 'setup' THEN pivot * 1.001::DOUBLE ELSE greatest(pivot, open) END", "CASE WHEN state = 'setup' THEN low3 ELSE low END", "adr20", 1, c)},
hits AS (SELECT *, {score} AS score, 1 AS direction FROM plan WHERE reject = '')"""


def _ep_sql(c) -> str:
    n = c.dormancy_lookback
    score = _score((_band("gap", 0.40, c.min_gap), 0.24), (_band("vol_mult", 10.0, c.min_volume_mult), 0.22), (_band("dormant_band", 0.10, c.max_dormant_band), 0.18), (_band("prior_gain", -0.10, c.max_prior_gain), 0.14), (_clamp("close_position"), 0.12), (_band("adr20", 8.0, c.min_adr_pct), 0.10))
    return f"""{ANN_SQL},
meas0 AS (
  SELECT *, round(avg(close * volume) OVER {_win(20, 1)}, 4) AS prior_dollar_vol, round(open / {_lag("close", 1)} - 1, 9) AS gap, round(volume / nullif(avg(volume) OVER {_win(20, 1)}, 0), 9) AS vol_mult,
         round({_lag("close", 1)} / {_lag("close", n)} - 1, 9) AS prior_gain, max(high) OVER {_win(n, 1)} AS base_high, min(low) OVER {_win(n, 1)} AS dormant_low,
         round(coalesce((close - low) / nullif(high - low, 0), 0.5), 9) AS close_position, round(greatest(adr20, (high - low) / low * 100), 9) AS stop_adr_ref
  FROM ann),
meas AS (SELECT *, round((base_high - dormant_low) / base_high, 9) AS dormant_band FROM meas0),
gated AS (
  SELECT *, 'ep' AS state, CASE WHEN bar < {max(c.ma_slow, n + 25)} THEN 'warmup' {_tradable(c, "prior_dollar_vol")} WHEN gap IS NULL OR gap < {c.min_gap} THEN 'gap_too_small'
    WHEN vol_mult IS NULL OR vol_mult < {c.min_volume_mult} THEN 'no_volume_surge' WHEN prior_gain > {c.max_prior_gain} THEN 'already_extended' WHEN dormant_band > {c.max_dormant_band} THEN 'not_dormant'
    WHEN close < base_high THEN 'still_inside_base' WHEN close_position < {c.min_close_position} THEN 'closed_weak' WHEN close < open THEN 'closed_red' WHEN close < ma_slow THEN 'below_slow_ma' ELSE '' END AS reject
  FROM meas),
{_plan("high", "low", "stop_adr_ref", 1, c)},
hits AS (SELECT *, {score} AS score, 1 AS direction FROM plan WHERE reject = '')"""


STREAK_SQL = """
ups AS (SELECT *, close > lag(close) OVER (PARTITION BY symbol ORDER BY bar) AS up FROM {}),
islands AS (SELECT *, max(CASE WHEN up IS NOT TRUE THEN bar END) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS red FROM ups),
streaks AS (SELECT * EXCLUDE (up, red), least(31, bar - coalesce(red, 0))::INTEGER AS green_streak FROM islands)"""


def _parabolic_sql(c) -> str:
    n = c.run_lookback
    score = _score((_band("run_gain", 3.0, c.min_run_gain), 0.22), (_band("extension", 1.0, c.min_extension), 0.20), (_band("vol_mult", 6.0, c.min_volume_mult), 0.12), (_clamp("1.0 - close_position"), 0.16), ("(reversal_bar::INT + broke_prior_low::INT + red_after_green::INT) / 3.0", 0.12), (_band("days_off_high", 0.0, c.max_days_off_high), 0.10), (_band("adr20", 12.0, c.min_adr_pct), 0.08))
    return f"""{ANN_SQL},{STREAK_SQL.format("ann")},
low0 AS (SELECT symbol, bar, min(low) OVER {_win(n + 1)} AS run_low FROM bars),
low1 AS (SELECT l.symbol, l.bar, any_value(run_low) AS run_low, min(b.bar) AS low_bar FROM low0 l JOIN bars b ON b.symbol = l.symbol AND b.bar BETWEEN l.bar - {n} AND l.bar AND b.low = l.run_low GROUP BY 1, 2),
run0 AS (
  SELECT l.symbol, l.bar, any_value(run_low) AS run_low, any_value(low_bar) AS low_bar, max(b.high) FILTER (WHERE b.bar >= low_bar) AS run_high,
         avg(b.volume) FILTER (WHERE b.bar >= low_bar) / nullif(avg(b.volume) FILTER (WHERE b.bar < low_bar), 0) AS vol_mult
  FROM low1 l JOIN bars b ON b.symbol = l.symbol AND b.bar BETWEEN l.low_bar - 20 AND l.bar GROUP BY 1, 2),
run AS (SELECT r.*, (SELECT min(b.bar) FROM bars b WHERE b.symbol = r.symbol AND b.bar BETWEEN r.low_bar AND r.bar AND b.high = r.run_high) AS high_bar FROM run0 r),
meas AS (
  SELECT s.*, run_high, (s.bar - low_bar)::INTEGER AS run_bars, round(run_high / run_low - 1, 9) AS run_gain, round(close / ma_mid - 1, 9) AS extension, (s.bar - high_bar)::INTEGER AS days_off_high, round(vol_mult, 9) AS vol_mult,
         round(coalesce((close - low) / nullif(high - low, 0), 0.5), 9) AS close_position,
         coalesce(low < {_lag("low", 1)} AND close < {_lag("close", 1)}, false) AS broke_prior_low, coalesce(close < open AND {_lag("green_streak", 1)} >= {c.min_green_streak}, false) AS red_after_green
  FROM streaks s JOIN run USING (symbol, bar)),
meas1 AS (SELECT *, close_position <= {c.max_close_position} AND high >= round(run_high * 0.98::DOUBLE, 9) AS reversal_bar FROM meas),
gated AS (
  SELECT *, 'short' AS state, CASE WHEN bar < {max(c.ma_slow, n + 25)} THEN 'warmup' {_tradable(c)} WHEN run_gain < {c.min_run_gain} THEN 'not_parabolic' WHEN run_bars > {c.max_run_bars} THEN 'run_too_slow'
    WHEN ma_mid IS NULL THEN 'nan_ma' WHEN extension < {c.min_extension} THEN 'not_extended' WHEN vol_mult < {c.min_volume_mult} THEN 'no_climax_volume'
    WHEN NOT (reversal_bar OR broke_prior_low OR red_after_green) THEN 'no_weakness_yet' WHEN days_off_high > {c.max_days_off_high} THEN 'too_late' ELSE '' END AS reject
  FROM meas1),
{_plan("low", "high", "adr20", -1, c)},
hits AS (SELECT *, {score} AS score, -1 AS direction FROM plan WHERE reject = '')"""


SETUP_SQL = {"breakout": re.sub(r"\bpivot\b", '"pivot"', _breakout_sql()), "ep": _ep_sql(D.SETUPS["ep"].presets["default"]), "parabolic": _parabolic_sql(D.SETUPS["parabolic"].presets["default"])}


def _dedupe(cooldown: int) -> str:
    return f"kept AS (SELECT * FROM (SELECT *, bar - lag(bar) OVER (PARTITION BY symbol ORDER BY bar) AS since FROM hits) WHERE since IS NULL OR since > {cooldown})"


def _trades_sql(name: str) -> str:
    """CTE trades: the simulation, bar by bar in a recursive query (the engine has it in closed form)."""
    s = D.SETUPS[name]
    ref = "stop_adr_ref" if name == "ep" else "adr20"
    d = s.direction
    worse, best = ("low", "high") if d > 0 else ("high", "low")
    hit = lambda col, op, x: f"{col} {op if d > 0 else {'<=': '>=', '>=': '<=', '<': '>'}[op]} {x}"
    side, mid = ("greatest", "least") if d > 0 else ("least", "greatest")
    return f"""{SETUP_SQL[name]}, {_dedupe(s.cooldown)},
last_bar AS (SELECT symbol, max(bar) AS n FROM bars GROUP BY 1),
filled AS (
  SELECT k.symbol, k.bar AS sig, min(b.bar) AS fb FROM kept k JOIN bars b ON b.symbol = k.symbol AND
    CASE WHEN k.state <> 'setup' THEN b.bar = k.bar ELSE b.bar BETWEEN k.bar + 1 AND k.bar + 10 AND {hit("b." + best, ">=", "k.entry")} END GROUP BY 1, 2),
start AS (
  SELECT f.symbol, f.sig, f.fb, CASE WHEN k.state <> 'setup' THEN k.entry ELSE {side}(k.entry, b.open) END AS fill, b.{worse} AS extreme, k.{ref} / 100 AS adr
  FROM filled f JOIN kept k ON k.symbol = f.symbol AND k.bar = f.sig JOIN bars b ON b.symbol = f.symbol AND b.bar = f.fb),
risked AS (SELECT *, round({side}(extreme, fill * (1 - {d} * adr)), 9) AS stop0 FROM start),
trade0 AS (SELECT *, round((fill - stop0) * {d}, 9) AS risk FROM risked),
sim AS (
  SELECT symbol, sig, fb, fill, risk, stop0 AS stop, fb AS bar, false AS took, 0::DOUBLE AS r, 1::DOUBLE AS left_, 0::DOUBLE AS mfe, 0::DOUBLE AS mae, '' AS outcome, n
  FROM trade0 JOIN last_bar USING (symbol) WHERE risk > 0
  UNION ALL
  SELECT s.symbol, sig, fb, fill, risk,
    CASE WHEN NOT stopped AND partial THEN {side}(stop, fill) ELSE stop END, b.bar, took OR (NOT stopped AND partial),
    r + CASE WHEN stopped THEN left_ * {d} * ((CASE WHEN {hit("b.open", "<", "stop")} THEN b.open ELSE stop END) - fill) / risk
             WHEN partial THEN 0.5 * {d} * ((CASE WHEN {hit("b." + best, ">=", "target")} THEN target ELSE b.close END) - fill) / risk
             WHEN trailed THEN left_ * {d} * (b.close - fill) / risk ELSE 0 END,
    CASE WHEN stopped OR (NOT partial AND trailed) THEN 0 WHEN partial THEN 0.5 ELSE left_ END,
    greatest(mfe, {d} * (b.{best} - fill) / risk), least(mae, {d} * (b.{worse} - fill) / risk),
    CASE WHEN stopped THEN CASE WHEN took THEN 'trail_stop' ELSE 'stopped' END WHEN NOT partial AND trailed THEN 'ma_trail' ELSE '' END, n
  FROM (
    SELECT s.*, x.bar AS nb, round(fill + {d} * 3 * risk, 9) AS target, {hit("x." + worse, "<=", "stop")} AS stopped,
      NOT took AND ({hit("x." + best, ">=", f"round(fill + {d} * 3 * risk, 9)")} OR x.bar - fb >= 4) AS partial,
      took AND x.ma_mid IS NOT NULL AND {hit("x.close", "<", "x.ma_mid")} AS trailed
    FROM sim s JOIN ann x ON x.symbol = s.symbol AND x.bar = s.bar + 1 WHERE s.outcome = '' AND s.bar < least(n, fb + 120)) s
  JOIN bars b ON b.symbol = s.symbol AND b.bar = s.nb),
done AS (SELECT * FROM sim WHERE outcome <> '' OR bar = least(n, fb + 120)),
closed AS (
  SELECT e.symbol, sig, CASE WHEN outcome = '' THEN 'max_hold' ELSE outcome END AS outcome, f.date AS fill_date, round(fill, 9) AS fill, round(stop, 9) AS sim_stop,
         round(round(r + left_ * {d} * (x.close - fill) / risk, 9), 3) AS r_multiple, round(round(mfe, 9), 2) AS mfe_r, round(round(mae, 9), 2) AS mae_r,
         (e.bar - fb)::INTEGER AS days_held, x.date AS exit_date, x.close AS exit_price
  FROM done e JOIN bars x ON x.symbol = e.symbol AND x.bar = e.bar JOIN bars f ON f.symbol = e.symbol AND f.bar = e.fb),
trades AS (
  SELECT k.*, coalesce(c.outcome, CASE WHEN t.fb IS NULL THEN 'no_trigger' ELSE 'bad_risk' END) AS outcome, fill_date, c.fill, sim_stop, r_multiple, mfe_r, mae_r, coalesce(days_held, 0)::INTEGER AS days_held, exit_date, exit_price
  FROM kept k LEFT JOIN trade0 t ON t.symbol = k.symbol AND t.sig = k.bar LEFT JOIN closed c ON c.symbol = k.symbol AND c.sig = k.bar)"""


def hits(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return D.SETUPS[name].scan(bars(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return O.dedupe_signals(hits(spark, sf_dir, name), D.SETUPS[name].cooldown)


def trades(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return O.simulate_trades(kept(spark, sf_dir, name), annotated(spark, sf_dir, only=("ma_fast", "ma_mid")))


DATES = ("date", "fill_date", "exit_date", "on", "first_date", "latest_date", "start", "end")


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: tuple[str, ...] = ("date",)) -> None:
    """Dates go out as text, which both engines write alike; dates: those that the SQL returns."""

    def told(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c in DATES})

    QUERIES[name] = told
    if sql:
        shown = ", ".join(f'"{c}"::VARCHAR AS "{c}"' for c in dates)
        ORACLE_SQL[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if dates else sql


KEY = "symbol, date, bar"
K = ("symbol", "date", "bar")


def _simple() -> None:
    ann = lambda *c: lambda s, d: annotated(s, d).select(*K, *c)
    sql = lambda c: f"WITH {ANN_SQL} SELECT {KEY}, {c} FROM ann"
    register("bars_derived", lambda s, d: bars(s, d), f"WITH {BARS_SQL} SELECT symbol, date, open, high, low, close, volume FROM bars")
    for name, cols in {"sma_stack": "ma_fast, ma_mid, ma_slow", "adr20": "adr20, range_pct", "dollar_volume": "dollar_vol20", "volume_avg": "vol_avg20", "returns_1m_3m_6m": "ret_1m, ret_3m, ret_6m", "ma_slope": "ma_mid_slope, ma_slow_slope"}.items():
        register(name, ann(*cols.split(", ")), sql(cols))
    register("true_range", lambda s, d: with_bar(bars(s, d)).select(*K, measure(true_range()).alias("true_range")), f"WITH {BARS_SQL} SELECT {KEY}, round(greatest(high - low, abs(high - {_lag('close', 1)}), abs(low - {_lag('close', 1)})), 9) AS true_range FROM bars")
    register("rs_horizon_rank", lambda s, d: ranked(s, d).select(*K, "rank_1m", "rank_3m", "rank_6m"), f"WITH {ANN_SQL}, {_ranks('ann', 'date')} SELECT {KEY}, round(rank_1m, 9) AS rank_1m, round(rank_3m, 9) AS rank_3m, round(rank_6m, 9) AS rank_6m FROM ranked")
    register("rs_composite", lambda s, d: ranked(s, d).select(*K, "rs_rank"), f"WITH {ANN_SQL}, {_ranks('ann', 'date')} SELECT {KEY}, round(rs_rank, 9) AS rs_rank FROM ranked")
    register("rs_latest", lambda s, d: latest_ranks(annotated(s, d, newest=True, only=RETURNS), common_date=False).select(*K, "rs_rank"), f"WITH {ANN_SQL}, newest AS (SELECT *, 0 AS one FROM ann QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), {_ranks('newest', 'one')} SELECT {KEY}, round(rs_rank, 9) AS rs_rank FROM ranked")
    register("rs_latest_common_date", lambda s, d: latest_ranks(annotated(s, d, newest=True, only=RETURNS)).select(*K, "rs_rank"), f"WITH {ANN_SQL}, newest AS (SELECT *, 0 AS one FROM ann WHERE date = (SELECT max(date) FROM ann)), {_ranks('newest', 'one')} SELECT {KEY}, round(rs_rank, 9) AS rs_rank FROM ranked")
    register("tradable_filter", lambda s, d: annotated(s, d).withColumn("reject", D.first_reason(*D.tradable(CFG))).groupBy("reject").agg(F.count(F.lit(1)).alias("n")), f"WITH {ANN_SQL} SELECT CASE {_tradable(CFG)} ELSE '' END AS reject, count(*) AS n FROM ann GROUP BY 1", dates=())
    register(
        "prior_move",
        lambda s, d: annotated(s, d, more=D.breakout_measures(CFG)).where(D.first_reason(*D.tradable(CFG)) == "").where("move_ratio >= 1").select(*K, "close", "adr20", "move_ratio").orderBy(F.col("move_ratio").desc(), "symbol", "bar"),
        f"WITH {SETUP_SQL['breakout']} SELECT {KEY}, close, adr20, move_ratio FROM top WHERE CASE {_tradable(CFG)} ELSE '' END = '' AND move_ratio >= 1",
    )
    register("green_streak", lambda s, d: D.with_streak(with_bar(bars(s, d))).select(*K, "green_streak"), f"WITH {BARS_SQL}, {STREAK_SQL.format('bars')} SELECT {KEY}, green_streak FROM streaks")
    register("forward_returns", lambda s, d: O.forward_returns(with_bar(bars(s, d))).select(*K, "fwd_5d", "fwd_10d", "fwd_20d", "fwd_60d"), f"WITH {BARS_SQL} SELECT {KEY}, {', '.join(f'round(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY bar) / close - 1, 9) AS fwd_{h}d' for h in (5, 10, 20, 60))} FROM bars")
    ahead = "OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
    register("mfe_mae", lambda s, d: O.forward_returns(with_bar(bars(s, d)), -1).select(*K, "mfe_20d", "mae_20d"), f"WITH {BARS_SQL} SELECT {KEY}, round(-(min(low) {ahead} / close - 1), 9) + 0 AS mfe_20d, round(-(max(high) {ahead} / close - 1), 9) + 0 AS mae_20d FROM bars")
    register("minimum_history", lambda s, d: B.with_history(bars(s, d), 520).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")), f"WITH {BARS_SQL} SELECT symbol, count(*) AS n_bars FROM bars GROUP BY 1 HAVING count(*) >= 520", dates=())
    register("last_bar", lambda s, d: B.last_bars(bars(s, d)).select("symbol", "date", "close"), f"WITH {BARS_SQL} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
    register("coverage", lambda s, d: bars(s, d).agg(F.countDistinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("first_date"), F.max("date").alias("latest_date")), f"WITH {BARS_SQL} SELECT count(DISTINCT symbol) AS symbols, count(*) AS total_rows, min(date) AS first_date, max(date) AS latest_date FROM bars", dates=("first_date", "latest_date"))


def _merging() -> None:
    fresh = lambda s, d: bars(s, d).where("date >= date '1998-01-01'").withColumns({c: F.col(c) * F.when(F.col("symbol").cast("int") % 3 == 0, 0.5).otherwise(1.0001) for c in B.OHLC})
    stored = lambda s, d: bars(s, d).where("date < date '1998-06-01'")
    two = f"""{BARS_SQL}, stored AS (SELECT * FROM bars WHERE date < DATE '1998-06-01'),
fresh AS (SELECT symbol, date, {', '.join(f'{c} * CASE WHEN symbol::INT % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0001::DOUBLE END AS {c}' for c in B.OHLC)}, volume FROM bars WHERE date >= DATE '1998-01-01')"""
    register("upsert_merge", lambda s, d: B.upsert(stored(s, d), fresh(s, d)), f"WITH {two} SELECT symbol, date, open, high, low, close, volume FROM fresh UNION ALL SELECT symbol, date, open, high, low, close, volume FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.symbol = s.symbol AND f.date = s.date)")
    register("split_drift", lambda s, d: B.drift(stored(s, d), fresh(s, d)), f"WITH {two}, j AS (SELECT s.symbol, abs(f.close - s.close) / s.close AS x FROM stored s JOIN fresh f USING (symbol, date)) SELECT symbol, count(*) AS shared, round(median(x), 9) AS drift, count(*) >= 3 AND round(median(x), 9) > 0.002 AS readjusted FROM j GROUP BY 1", dates=())
    messy = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").cast("string").alias(" Date "), F.col("l_extendedprice").alias("OPEN"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("High"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("low"), F.when(F.col("l_quantity") > 2, F.col("l_extendedprice") * 1.01).alias("Close"), F.col("l_quantity").alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"))
    raw = "raw AS (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::DATE AS date, l_extendedprice AS open, l_extendedprice * (1 - l_discount) AS high, l_extendedprice * (1 + l_tax) AS low, CASE WHEN l_quantity > 2 THEN l_extendedprice * 1.01::DOUBLE END AS close, l_quantity AS volume, l_orderkey, l_linenumber, l_partkey FROM lineitem), one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1)"
    register("bars_normalized", lambda s, d: B.normalized(messy(s, d), "ord").withColumns({c: F.round(c, 6) for c in B.OHLC}), f"WITH {raw} SELECT symbol, date, round(open, 6) AS open, round(greatest(high, open, close), 6) AS high, round(least(low, open, close), 6) AS low, round(close, 6) AS close, volume FROM one WHERE close > 0 AND open > 0 AND high > 0 AND low > 0")
    register("bars_dedupe_keep_last", lambda s, d: B.keep_last(B.tidy_names(messy(s, d)).withColumn("date", F.to_date("date")), "ord").select(F.col("symbol").cast("string").alias("symbol"), "date", "open", "volume"), f"WITH {raw} SELECT symbol, date, open, volume FROM one")
    adj = lambda s, d: B.adjusted(bars(s, d).withColumn("adj close", F.when(F.col("date") < "1998-01-01", F.col("close") / 2).when(F.col("date") < "1999-01-01", F.lit(0.0)).otherwise(F.col("close"))))
    f = "CASE WHEN date < DATE '1998-01-01' THEN 0.5::DOUBLE ELSE 1::DOUBLE END"
    register("bars_adjusted_close", lambda s, d: adj(s, d).select("symbol", "date", *[F.round(c, 6).alias(c) for c in B.OHLC], "volume"), f"WITH {BARS_SQL} SELECT symbol, date, {', '.join(f'round({c} * {f}, 6) AS {c}' for c in B.OHLC)}, volume FROM bars")
    want = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("symbol"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") * 37 % 3000).cast("int")).alias("on"))
    register("asof_next_bar", lambda s, d: B.next_bar(want(s, d), bars(s, d)).select("symbol", "on", "bar", "date"), f"WITH {BARS_SQL}, want AS (SELECT s_suppkey::VARCHAR AS symbol, (DATE '1997-01-01' + (s_suppkey * 37 % 3000)::INT)::DATE AS \"on\" FROM supplier), newest AS (SELECT symbol, max(bar) AS bar, max(date) AS date FROM bars GROUP BY symbol) SELECT w.symbol, w.\"on\", coalesce(b.bar, n.bar) AS bar, coalesce(b.date, n.date) AS date FROM want w JOIN newest n ON n.symbol = w.symbol ASOF LEFT JOIN bars b ON b.symbol = w.symbol AND b.date >= w.\"on\"", dates=("date", "on"))
    wanted = lambda s, d: s.read.parquet(f"{d}/supplier.parquet").where("s_nationkey < 5").select(F.col("s_suppkey").cast("string").alias("symbol"))
    register("semi_join_universe", lambda s, d: bars(s, d).join(wanted(s, d), "symbol", "left_semi"), f"WITH {BARS_SQL} SELECT symbol, date, open, high, low, close, volume FROM bars WHERE symbol IN (SELECT s_suppkey::VARCHAR FROM supplier WHERE s_nationkey < 5)")
    register("anti_join_missing", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("symbol")).join(bars(s, d).select("symbol").distinct(), "symbol", "left_anti"), f"WITH {BARS_SQL} SELECT c_custkey::VARCHAR AS symbol FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT symbol FROM bars)", dates=())
    spans = lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 40 - 5).cast("int")).alias("b"))
    register("business_days", lambda s, d: spans(s, d).select("o_orderkey", P.business_days("a", "b").cast("int").alias("days")), "WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + (o_custkey % 40 - 5)::INT)::DATE AS b FROM orders) SELECT o_orderkey, len(list_filter(generate_series(a::TIMESTAMP, b::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::INTEGER AS days FROM s", dates=())


def _detecting() -> None:
    scan = lambda name: lambda s, d: D.SETUPS[name].scan(bars(s, d), keep_rejects=True)
    plan = ("state", "entry", "raw_stop", "stop", "risk_pct", "shares", "target_2r", "target_3r")
    for name, cols in {
        "breakout": ("move_ratio", "pivot", "base_len", "base_low", "base_depth", "contraction", "low_slope", "impulse_gain", "vol_dryup", "surf_dist", "surf_ma", "dist_from_pivot", "vol_mult"),
        "ep": ("gap", "vol_mult", "prior_gain", "dormant_band", "base_high", "close_position", "stop_adr_ref"),
        "parabolic": ("run_gain", "run_bars", "extension", "vol_mult", "close_position", "reversal_bar", "broke_prior_low", "red_after_green", "days_off_high"),
    }.items():
        all_cols = (*K, *cols, *plan, "score")
        register(f"{name}_scan", lambda s, d, n=name, c=all_cols: hits(s, d, n).select(*c), f"WITH {SETUP_SQL[name]} SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in all_cols)} FROM hits")
        register(f"{name}_reject_histogram", lambda s, d, n=name: scan(n)(s, d).groupBy("reject").agg(F.count(F.lit(1)).alias("n")), f"WITH {SETUP_SQL[name]} SELECT reject, count(*) AS n FROM gated GROUP BY 1", dates=())
    b = SETUP_SQL["breakout"]
    for name, cols in {"pivot_location": "pivot, pivot_bar, base_len", "impulse_leg": "impulse_low, impulse_bar, impulse_gain"}.items():
        register(name, lambda s, d, c=cols: D.pivots(annotated(s, d, more=D.breakout_measures(CFG)), CFG).where("bar >= 126").select(*K, *c.split(", ")), f"WITH {b} SELECT {KEY}, {cols.replace('pivot,', chr(34) + 'pivot' + chr(34) + ',')} FROM loc WHERE bar >= 126")
    for name, cols in {"base_depth": "base_low, base_depth", "base_contraction": "contraction", "base_low_slope": "low_slope", "volume_dryup": "vol_dryup", "surf_distance": "surf_ma_fast, surf_ma_mid, surf_ma_slow, surf_dist, surf_ma"}.items():
        register(name, lambda s, d, c=cols: scan("breakout")(s, d).where("base_low IS NOT NULL").select(*K, *c.split(", ")), f"WITH {b} SELECT {KEY}, {cols} FROM stated WHERE base_low IS NOT NULL")
    register("breakout_trade_plan", lambda s, d: hits(s, d, "breakout").select(*K, *plan), f"WITH {b} SELECT {KEY}, {', '.join(plan)} FROM hits")
    register("breakout_score", lambda s, d: hits(s, d, "breakout").select(*K, "score"), f"WITH {b} SELECT {KEY}, score FROM hits")
    register("state_counts", lambda s, d: hits(s, d, "breakout").groupBy("state").agg(F.count(F.lit(1)).alias("n")), f"WITH {b} SELECT state, count(*) AS n FROM hits GROUP BY 1", dates=())
    register("top_k_by_score", lambda s, d: hits(s, d, "breakout").orderBy(F.col("score").desc(), "symbol", "bar").limit(25).select(*K, "score"), f"WITH {b} SELECT {KEY}, score FROM hits ORDER BY score DESC, symbol, bar LIMIT 25")


def _trading() -> None:
    result = ("outcome", "fill_date", "fill", "sim_stop", "r_multiple", "mfe_r", "mae_r", "days_held", "exit_date", "exit_price")
    stats = """count(*) AS signals, count(r) AS trades, count(*) FILTER (WHERE outcome = 'no_trigger') AS no_trigger, round(count(r) FILTER (WHERE r > 0) / nullif(count(r), 0), 3) AS win_rate,
  round(round(avg(r), 9), 3) AS avg_r, round(round(median(r), 9), 3) AS median_r, round(round(sum(r), 9), 1) AS total_r, coalesce(round(round(avg(r) FILTER (WHERE r > 0), 9), 2), 0) AS avg_win_r,
  coalesce(round(round(avg(r) FILTER (WHERE r <= 0), 9), 2), 0) AS avg_loss_r, round(max(r), 2) AS best_r, round(min(r), 2) AS worst_r, round(round(avg(r), 9), 3) AS expectancy_r"""
    for name in D.SETUPS:
        register(f"dedupe_signals_{name}", lambda s, d, n=name: kept(s, d, n).select(*K), f"WITH {SETUP_SQL[name]}, {_dedupe(D.SETUPS[name].cooldown)} SELECT {KEY} FROM kept")
        register(f"simulate_trades_{name}", lambda s, d, n=name: trades(s, d, n).select(*K, *result), f"WITH RECURSIVE {_trades_sql(name)} SELECT {KEY}, {', '.join(result)} FROM trades", dates=("date", "fill_date", "exit_date"))
        register(f"trade_summary_{name}", lambda s, d, n=name: O.summarise(trades(s, d, n)), f"WITH RECURSIVE {_trades_sql(name)}, rs AS (SELECT outcome, CASE WHEN outcome <> 'no_trigger' THEN r_multiple END AS r FROM trades) SELECT {stats} FROM rs", dates=())
    b = _trades_sql("breakout")
    register("best_worst_trades", lambda s, d: O.best_and_worst(trades(s, d, "breakout"), 10).select(*K, "r_multiple"), f"WITH RECURSIVE {b}, t AS (SELECT *, row_number() OVER (ORDER BY r_multiple DESC, symbol, bar) AS a, row_number() OVER (ORDER BY r_multiple, symbol, bar) AS z FROM trades WHERE r_multiple IS NOT NULL) SELECT {KEY}, r_multiple FROM t WHERE a <= 10 OR z <= 10")
    book = lambda s, d: P.replay(trades(s, d, "breakout").withColumn("sleeve", F.col("symbol").cast("int") % 4), account="sleeve")
    ledger = _ledger_sql()
    register("portfolio_replay", lambda s, d: book(s, d).where("kind = 'trade'").drop("kind", "seq", "open_positions", "exposure"), f"WITH RECURSIVE {ledger} SELECT account, symbol, setup, direction, exit_date AS date, fill_date, exit_date, days_held, shares, fill, risk_dollars, r_multiple, pnl, equity, score FROM ended", dates=("date", "fill_date", "exit_date"))
    register("equity_drawdown", lambda s, d: P.equity_curve(book(s, d)), f"WITH RECURSIVE {ledger} SELECT * FROM curve")
    register("portfolio_stats", lambda s, d: P.account_stats(book(s, d)), f"WITH RECURSIVE {ledger} {_STATS_SQL}", dates=("start", "end"))


def _ledger_sql() -> str:
    """CTEs ended (trades of the accounts), skipped and curve: events in order, one a step of a recursive query, with the open positions in a list."""
    a = P.AccountConfig()
    return f"""{_trades_sql("breakout")},
fill_rows AS (
  SELECT (symbol::INT % 4)::VARCHAR AS account, fill_date AS day, 1 AS turn, symbol, score, fill, coalesce(stop, 0) AS stop, r_multiple, direction, greatest(exit_date, fill_date) AS exit_date
  FROM trades WHERE fill_date IS NOT NULL AND exit_date IS NOT NULL AND fill IS NOT NULL AND r_multiple IS NOT NULL),
day_rows AS (SELECT account, fill_date AS day FROM (SELECT account, day AS fill_date FROM fill_rows UNION SELECT account, exit_date FROM fill_rows)),
event AS (
  SELECT *, row_number() OVER (PARTITION BY account ORDER BY day, turn, score DESC, symbol) AS k FROM (
    SELECT account, day, turn, symbol, score, fill, stop, r_multiple, direction, exit_date FROM fill_rows
    UNION ALL SELECT account, day, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM day_rows
    UNION ALL SELECT account, day, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM day_rows
    UNION ALL SELECT DISTINCT account, DATE '9999-12-31', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM day_rows)),
book AS (
  SELECT DISTINCT account, 0::BIGINT AS k, {a.starting_equity}::DOUBLE AS equity, {a.starting_equity}::DOUBLE AS before,
         []::STRUCT(symbol VARCHAR, fill_date DATE, exit_date DATE, fill DOUBLE, r_multiple DOUBLE, score DOUBLE, direction INTEGER, shares DOUBLE, risk DOUBLE)[] AS held,
         []::STRUCT(symbol VARCHAR, fill_date DATE, exit_date DATE, fill DOUBLE, r_multiple DOUBLE, score DOUBLE, direction INTEGER, shares DOUBLE, risk DOUBLE)[] AS over, ''::VARCHAR AS what
  FROM event
  UNION ALL
  SELECT account, k, equity + coalesce(list_sum(list_transform(over, lambda p: p.risk * p.r_multiple)), 0), equity,
         CASE WHEN turn = 0 THEN staying WHEN what = 'taken' THEN list_append(held, {{'symbol': symbol, 'fill_date': day, 'exit_date': exit_date, 'fill': fill, 'r_multiple': r_multiple, 'score': score, 'direction': direction, 'shares': shares, 'risk': shares * each}}) ELSE held END,
         over, what
  FROM (
    SELECT *, CASE WHEN turn <> 1 THEN '' WHEN len(held) >= {a.max_positions} THEN 'no_slot' WHEN shares <= 0 THEN 'no_capital' ELSE 'taken' END AS what
    FROM (
      SELECT *, trunc(greatest(0, least({a.risk_pct} * equity / each, {a.max_position_pct} * equity / fill, ({a.max_exposure_pct} * equity - invested) / fill))) AS shares
      FROM (
        SELECT e.*, b.equity, b.held, coalesce(list_sum(list_transform(b.held, lambda p: p.shares * p.fill)), 0) AS invested,
               CASE WHEN abs(e.fill - e.stop) > 0 THEN abs(e.fill - e.stop) ELSE 0.05 * e.fill END AS each,
               CASE WHEN e.turn = 0 THEN list_filter(b.held, lambda p: p.exit_date <= e.day) ELSE [] END AS over, list_filter(b.held, lambda p: p.exit_date > e.day) AS staying
        FROM book b JOIN event e ON e.account = b.account AND e.k = b.k + 1)))),
ended AS (
  SELECT account, p.symbol AS symbol, 'breakout' AS setup, p.direction AS direction, p.fill_date AS fill_date, p.exit_date AS exit_date,
         len(list_filter(generate_series(p.fill_date::TIMESTAMP, p.exit_date::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6))::INTEGER AS days_held,
         p.shares AS shares, p.fill AS fill, round(p.risk, 2) AS risk_dollars, p.r_multiple AS r_multiple, round(p.risk * p.r_multiple, 2) AS pnl,
         round(before + list_sum(list_transform(over[1:i], lambda q: q.risk * q.r_multiple)), 2) AS equity, p.score AS score, k, i
  FROM (SELECT account, k, before, over, unnest(range(1, len(over) + 1)) AS i, unnest(over) AS p FROM book)),
curve AS (
  SELECT *, round(equity / max(equity) OVER (PARTITION BY account ORDER BY date) - 1, 5) AS drawdown
  FROM (
    SELECT account, day AS date, round(b.equity, 2) AS equity, len(held)::INTEGER AS open_positions, round(coalesce(list_sum(list_transform(held, lambda p: p.shares * p.fill)), 0), 2) AS exposure
    FROM book b JOIN event e USING (account, k) WHERE e.turn = 2))"""


_STATS_SQL = f"""SELECT account, trades_taken, final_equity, win_rate, avg_r, avg_win_r, avg_loss_r, profit_factor, best_trade, worst_trade, avg_days_held, start, "end", max_drawdown, avg_open_positions, max_open_positions,
  skipped_no_slot, skipped_no_capital, {P.AccountConfig().starting_equity}::DOUBLE AS starting_equity, round(final_equity / {P.AccountConfig().starting_equity} - 1, 4) AS total_return, round(span, 2) AS years,
  round(CASE WHEN final_equity > 0 THEN pow(final_equity / {P.AccountConfig().starting_equity}, 1 / span) - 1 ELSE -1 END, 4) AS cagr
FROM (
  SELECT account, count(*) AS trades_taken, arg_max(equity, k * 1000 + i) AS final_equity, round(avg((r_multiple > 0)::INT), 3) AS win_rate, round(avg(r_multiple), 3) AS avg_r,
    coalesce(round(avg(r_multiple) FILTER (WHERE r_multiple > 0), 2), 0) AS avg_win_r, coalesce(round(avg(r_multiple) FILTER (WHERE r_multiple <= 0), 2), 0) AS avg_loss_r,
    round(sum(pnl) FILTER (WHERE r_multiple > 0) / nullif(abs(sum(pnl) FILTER (WHERE r_multiple <= 0)), 0), 2) AS profit_factor, max(pnl) AS best_trade, min(pnl) AS worst_trade, round(avg(days_held), 1) AS avg_days_held
  FROM ended GROUP BY account) JOIN (
  SELECT account, min(date) AS start, max(date) AS "end", round(min(drawdown), 4) AS max_drawdown, round(avg(open_positions), 2) AS avg_open_positions, max(open_positions) AS max_open_positions,
    greatest((max(date) - min(date)) / 365.25, 1e-9) AS span FROM curve GROUP BY account) USING (account) JOIN (
  SELECT account, count(*) FILTER (WHERE what = 'no_slot') AS skipped_no_slot, count(*) FILTER (WHERE what = 'no_capital') AS skipped_no_capital FROM book GROUP BY account) USING (account)"""


def _smoothing() -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = smoothed(with_bar(bars(s, d)).withColumn("tr", true_range()), {"ema10": ("close", 2 / 11, 10), "atr14": ("tr", 1 / 14, 14)})
        return df.select(*K, measure(F.col("ema10")).alias("ema10"), measure(F.col("atr14")).alias("atr14"))

    step = lambda x, a: f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), lambda p, q: p * {1 - a}::DOUBLE + q * {a}::DOUBLE)"
    register("ema_atr", run, f"WITH {BARS_SQL}, t AS (SELECT *, greatest(high - low, abs(high - {_lag('close', 1)}), abs(low - {_lag('close', 1)})) AS tr FROM bars) SELECT {KEY}, round(CASE WHEN bar >= 9 THEN {step('close', 2 / 11)} END, 9) AS ema10, round(CASE WHEN bar >= 13 THEN {step('tr', 1 / 14)} END, 9) AS atr14 FROM t")


for _add in (_simple, _merging, _detecting, _trading, _smoothing):
    _add()
