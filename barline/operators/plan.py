"""Entry, stop, size and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import measure, ratio
from ..plans.config import SetupConfig


def trade_plan(df: DataFrame, entry: Column, raw_stop: Column, adr: Column, direction: int, cfg: SetupConfig) -> DataFrame:
    """df with the plan; the stop is never further off than max_stop_adr_mult average ranges. No risk: no shares, no targets."""
    reach = adr / 100.0 * cfg.max_stop_adr_mult
    df = df.withColumns({"entry": measure(entry), "raw_stop": measure(raw_stop)})
    limit = F.col("entry") * (1.0 - direction * reach)
    df = df.withColumn("stop", measure(F.greatest("raw_stop", limit) if direction > 0 else F.least("raw_stop", limit)))
    df = df.withColumn("_risk", measure((F.col("entry") - F.col("stop")) * direction))
    some = lambda c: F.when(F.col("_risk") > 0, c)
    shares = F.floor(F.least(ratio(F.lit(cfg.account_size * cfg.risk_pct), F.col("_risk")), ratio(F.lit(cfg.account_size * cfg.max_position_pct), F.col("entry"))))
    df = df.withColumns({
        "direction": F.lit(direction),
        "stop_capped_by_adr": some(F.col("stop") != F.col("raw_stop")),
        "risk_pct": some(measure(ratio(F.col("_risk"), F.col("entry")))),
        "risk_in_adr": some(measure(ratio(ratio(F.col("_risk"), F.col("entry")), adr / 100.0))),
        "shares": F.coalesce(some(shares), F.lit(0)).cast("long"),
        "target_2r": some(measure(F.col("entry") + 2 * direction * F.col("_risk"))),
        "target_3r": some(measure(F.col("entry") + 3 * direction * F.col("_risk"))),
    })
    return df.withColumn("position_value", some(measure(F.col("shares") * F.col("entry")))).drop("_risk")
