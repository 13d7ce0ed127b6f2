"""Made-up markets of any size, for trying out and for load: expressions over a range, no shuffle.

A bar depends on its symbol, its position and the seed only, so the rows are the same however
they are partitioned, and again in every run.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leg:
    """Bars of a course: their number, the gain from first to last (log), what is added to the
    first bar's open (log), the day's range at the leg's begin and end, volume, waves that die
    down (depth under the course) and noise (log)."""

    bars: int
    gain: float = 0.0
    gap: float = 0.0
    ranges: tuple[float, float] = (0.04, 0.04)
    volume: float = 1e6
    waves: float = 0.0
    noise: float = 0.0


#: Courses that the setups look for, and three that they should leave alone.
SHAPES: dict[str, tuple[Leg, ...]] = {
    "COIL": (Leg(150, noise=0.005), Leg(15, 0.49, ranges=(0.06, 0.06), volume=3e6), Leg(26, 0.009, ranges=(0.05, 0.027), volume=8e5, waves=0.048)),
    "GAP": (Leg(200, ranges=(0.045, 0.045), volume=5e5, noise=0.02), Leg(1, 0.04, 0.19, (0.015, 0.015), 4e6)),
    "CLIMAX": (Leg(160, ranges=(0.1, 0.1)), Leg(15, 1.43, ranges=(0.1, 0.1), volume=4e6), Leg(1, -0.06, ranges=(0.1, 0.1), volume=4e6)),
    "FLAT": (Leg(200, noise=0.01),),
    "FALL": (Leg(200, -1.0, noise=0.01),),
    "THIN": (Leg(200, 0.5, volume=1e3, noise=0.01),),
}


def _on_leg(legs: tuple[Leg, ...], k: Column, value) -> Column:
    """value(leg, bars into it, log price before it) of the leg that bar k is on."""
    out, begin, level = F.lit(None).cast("double"), 0, 0.0
    cases = []
    for leg in legs:
        cases.append((k < begin + leg.bars, value(leg, k - begin, level)))
        begin, level = begin + leg.bars, level + leg.gap + leg.gain
    for test, c in reversed(cases):
        out = F.when(test, c).otherwise(out)
    return out


def market(spark: SparkSession, symbols: int, shapes: dict[str, tuple[Leg, ...]] | None = None, start: date = date(2021, 1, 4), price: float = 20.0, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Canonical bars of so many symbols, which take the shapes in turn; a course that is shorter than the longest begins later.

    start must be a weekday. No symbols give no rows.
    """
    if start.weekday() > 4:
        raise ValueError(f"{start} is not a weekday")
    shapes = shapes or SHAPES
    longest = max(sum(leg.bars for leg in legs) for legs in shapes.values())
    rows = spark.range(0, symbols * longest, 1, partitions) if partitions else spark.range(symbols * longest)
    number, day = F.floor(F.col("id") / longest), F.pmod(F.col("id"), F.lit(longest))
    df = rows.select(number.alias("n"), F.pmod(number, F.lit(len(shapes))).alias("shape"), day.alias("day"))
    short = F.array(*[F.lit(longest - sum(leg.bars for leg in legs)) for legs in shapes.values()])
    df = df.withColumn("k", F.col("day") - F.element_at(short, (F.col("shape") + 1).cast("int"))).where("k >= 0")
    jitter = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("n"), k), F.lit(2_000_001)) / 1e6 - 1.0

    def course(leg: Leg, i: Column, level: float, k: Column) -> Column:
        way = level + leg.gap + leg.gain * (i + 1) / leg.bars + jitter(k) * leg.noise
        return F.lit(price) * F.exp(way) * (1.0 - leg.waves * F.exp(-i / 9.0) * F.abs(F.sin(i / 2.2)))

    def of_shape(value) -> Column:
        out = F.lit(None).cast("double")
        for j, legs in enumerate(shapes.values()):
            out = F.when(F.col("shape") == j, value(legs)).otherwise(out)
        return out

    at = lambda legs, k: _on_leg(legs, k, lambda leg, i, level: course(leg, i, level, k))
    gap = lambda legs: _on_leg(legs, F.col("k"), lambda leg, i, _: F.when(i == 0, leg.gap).otherwise(0.0))
    span = lambda leg, i, _: leg.ranges[0] + (leg.ranges[1] - leg.ranges[0]) * i / max(1, leg.bars - 1)
    before = F.when(F.col("k") == 0, price).otherwise(of_shape(lambda legs: at(legs, F.col("k") - 1)))
    df = df.withColumns({"close": of_shape(lambda legs: at(legs, F.col("k"))), "open": before * F.exp(of_shape(gap)), "span": of_shape(lambda legs: _on_leg(legs, F.col("k"), span)), "volume": of_shape(lambda legs: _on_leg(legs, F.col("k"), lambda leg, *_: F.lit(leg.volume)))})
    name = F.concat(F.element_at(F.array(*map(F.lit, shapes)), (F.col("shape") + 1).cast("int")), F.col("n").cast("string"))
    weekends = F.floor((F.col("day") + start.weekday()) / 5) * 2
    return df.select(
        name.alias("symbol"), F.date_add(F.lit(start), (F.col("day") + weekends).cast("int")).alias("date"), "open",
        (F.greatest("open", "close") * (1 + F.col("span") / 2)).alias("high"), (F.least("open", "close") * (1 - F.col("span") / 2)).alias("low"), "close", "volume",
    )
