"""Cross-sectional relative strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import measure, ratio
from .bars import last_bars

RETURNS, RANKS = ("ret_1m", "ret_3m", "ret_6m"), ("rank_1m", "rank_3m", "rank_6m")
#: Cells a radian, into which the ranks of a whole universe are counted.
CELLS = 2000


def percent_rank_of(c: str, *by: str) -> Column:
    """Percentile (0-100] of c among the rows with a value, ties at their average."""
    order = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
    ties, group = Window.partitionBy(*by, c), Window.partitionBy(*by)
    rank = F.rank().over(order) + (F.count(c).over(ties) - 1) / 2
    return F.when(F.col(c).isNotNull(), rank * 100.0 / F.count(c).over(group))


def percent_ranks_of_all(df: DataFrame, ranks: dict[str, tuple[str, float]]) -> DataFrame:
    """df (a row per symbol) with percent_rank_of several columns among all its rows, without bringing them together.

    ranks: name -> (column, scale). Values of all columns stand in one long table and fall into
    at most 3.2 * CELLS cells a column, in their order; a row's rank is the count of the cells
    before its own (one table of that bounded size for all columns) and its rank inside the
    cell. df is used twice, however many columns are ranked. The row itself travels once,
    beside its values, and comes back in the group by symbol.
    """
    items = [F.struct(F.lit(k).alias("_of"), F.col(c).cast("double").alias("_v"), F.floor(F.atan(F.col(c) / scale) * CELLS).alias("_cell")) for k, (c, scale) in ranks.items()]
    values = F.filter(F.array(*items), lambda x: x["_v"].isNotNull())
    key, total = Window.partitionBy("_of", "_cell"), Window.partitionBy("_of")
    cells = df.select(F.inline(values)).groupBy("_of", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(total.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.select("_of", "_cell", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(total).alias("_total"))
    own = F.struct(F.lit("").alias("_of"), F.lit(None).cast("double").alias("_v"), F.pmod(F.xxhash64("symbol"), F.lit(1000)).alias("_cell"))
    whole = F.struct(*df.columns)
    long = df.select("symbol", whole.alias("_row"), F.inline(F.concat(F.array(own), values)))
    long = long.withColumn("_row", F.when(F.col("_of") == "", F.col("_row")))
    inside = F.rank().over(key.orderBy("_v")) + (F.count("_v").over(Window.partitionBy("_of", "_cell", "_v")) - 1) / 2
    long = long.join(F.broadcast(cells), ["_of", "_cell"], "left").withColumn("_rank", (F.col("_before") + inside) * 100.0 / F.col("_total"))
    out = long.groupBy("symbol").agg(F.first("_row", ignorenulls=True).alias("_row"), *[F.max(F.when(F.col("_of") == k, F.col("_rank"))).alias(k) for k in ranks])
    return out.select("_row.*", *ranks)


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, where a checkpoint folder is set: a row per symbol that several ranks start from."""
    has = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if has else df


def _blended(df: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """df with _blend of its ranks; a missing horizon's weight goes to the others."""
    some = total = F.lit(0.0)
    for r, w in zip(RANKS, weights, strict=True):
        some = some + F.coalesce(F.col(r), F.lit(0.0)) * w
        total = total + F.when(F.col(r).isNotNull(), w).otherwise(0.0)
    return df.withColumn("_blend", measure(ratio(some, total)))


def composite_rank(df: DataFrame, weights: tuple[float, ...] = (0.4, 0.3, 0.3), by: str = "date", parts: int | None = None) -> DataFrame:
    """df with rank_1m, rank_3m, rank_6m and rs_rank among the rows of a date; parts: the tasks to which dates are dealt (by default the session's)."""
    df = df if parts is None else df.repartition(parts, by)
    df = _blended(df.withColumns({r: percent_rank_of(c, by) for r, c in zip(RANKS, RETURNS, strict=True)}), weights)
    shown = {r: measure(F.col(r)) for r in RANKS}
    return df.withColumns({**shown, "rs_rank": measure(percent_rank_of("_blend", by))}).drop("_blend")


def latest_ranks(annotated: DataFrame, weights: tuple[float, ...] = (0.4, 0.3, 0.3), common_date: bool = True) -> DataFrame:
    """Ranks on each symbol's newest bar; with common_date only symbols that have the universe's newest date."""
    df = settled(last_bars(annotated))
    if common_date:
        df = df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date")
    df = percent_ranks_of_all(df, {r: (c, 1.0) for r, c in zip(RANKS, RETURNS, strict=True)})
    df = percent_ranks_of_all(settled(_blended(df, weights)), {"rs_rank": ("_blend", 100.0)})
    return df.withColumns({r: measure(F.col(r)) for r in (*RANKS, "rs_rank")}).drop("_blend")
