"""Keyed state for streams: sessions need the RocksDB store for it, and a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The session, whose queries from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else the context's checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = own.get()
    return at.rstrip("/")
