"""Continuous refresh: bars that arrive as files go into the store; signals are thinned as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import CANONICAL, keep_last
from ..operators.store import BARS, PriceStore, benched


def bar_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet bars that are dropped into folder, with `arrived`: when and in which file."""
    files = spark.readStream.schema(BARS).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return files.select("*", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("arrived"))


def refresh(stream: DataFrame, store: PriceStore, today: str, checkpoint: str, history: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge each micro-batch; of two bars of a day that of the later file stays, so a batch that is run again writes the same rows.

    Bars of benched symbols are passed over until their time is up. A symbol whose prices a
    batch has rewritten gets its whole history from `history` (symbols -> bars), if given.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        order = [F.col("arrived"), F.monotonically_increasing_id()] if "arrived" in batch.columns else [F.monotonically_increasing_id()]
        resting = store.manifest().where(benched(today)).select("symbol")
        with store.staging() as stage:
            rows = stage(keep_last(batch.withColumn("ord", F.struct(*order)), "ord").join(resting, "symbol", "left_anti").select(*CANONICAL))
            moved = store.actions(rows).where("action = 'readjusted'").select("symbol") if history else None
            full = stage(history(moved).select(*CANONICAL)) if moved is not None and not moved.isEmpty() else None
            store.update(rows, today, full=full)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def thin(signals: DataFrame, cooldown: int) -> DataFrame:
    """Streaming twin of dedupe_signals: the state of a symbol is the bar of its last hit."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for bar, date in sorted((r.bar, r.date) for b in batches for r in b.itertuples()):
            if last is None or bar - last > cooldown:
                out.append((key[0], bar, date))
            last = bar if last is None else max(last, bar)
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["symbol", "bar", "date"])

    rows = signals.select("symbol", F.col("bar").cast("long").alias("bar"), "date")
    return rows.groupBy("symbol").applyInPandasWithState(run, "symbol string, bar long, date date", "last long", "append", GroupStateTimeout.NoTimeout)


def weekly(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """Weekly highs, lows and volume per symbol; bars later than `late` are ignored."""
    at = F.col("date").cast("timestamp")
    return stream.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", "7 days"), "symbol").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
