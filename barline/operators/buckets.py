"""Bars as a table by symbol buckets: windows and joins by symbol find their rows in place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bars as B
from .store import PriceStore

#: Table property that says which folder of the database each year was copied from.
SOURCE = "barline.years"


class BucketedBars:
    """A copy of a price database for scans and sweeps: a catalog table by year, hashed into symbol buckets.

    All years of a symbol are in the same bucket, so a plan that groups, joins or orders bars by
    symbol reads them without an exchange, whatever it does afterwards by symbol; two tables
    with as many buckets are joined in place. ``buckets`` is fixed when the table is made: a
    bucket should fit a task (at 100 TB some ten thousands).

    sync copies the years whose folder in the database has changed since, each by one dynamic
    overwrite, so a daily update costs the current year. A sync that is cut off is repeated: the
    property is set last. Years that left the database are no longer read. An empty database
    gives an empty table. Readers should begin after a sync, not during one.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 200) -> None:
        self.spark, self.table = spark, table
        kinds = ", ".join(f"`{c}` {'string' if c == 'symbol' else 'date' if c == 'date' else 'double'}" for c in B.CANONICAL)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({kinds}, year int) USING parquet PARTITIONED BY (year) CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {int(buckets)} BUCKETS")
        self.buckets = self._described("Num Buckets", int(buckets))

    def _described(self, name: str, default: int) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where(F.col("col_name") == name).collect()
        return int(rows[0]["data_type"]) if rows else default

    def copied(self) -> dict[int, str]:
        """Year -> the database's folder that the table's rows come from."""
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.table}").where(F.col("key") == SOURCE).collect()
        return {int(y): f for y, f in json.loads(rows[0]["value"]).items()} if rows else {}

    def sync(self, store: PriceStore) -> list[int]:
        """Copy what has changed; the years written."""
        at, have = store.version(), self.copied()
        stale = sorted(y for y, f in at.years.items() if have.get(y) != f)
        if stale:
            rows = store._prices(stale, at).select(*B.CANONICAL, "year")
            rows.repartition(self.buckets, "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.table)
        if have != at.years:
            self.spark.sql(f"ALTER TABLE {self.table} SET TBLPROPERTIES ('{SOURCE}' = '{json.dumps(at.years)}')")
        return stale

    def load(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars; a date range prunes to its years."""
        years = [y for y in self.copied() if (not start or y >= int(start[:4])) and (not end or y <= int(end[:4]))]
        df = self.spark.table(self.table).where(F.col("year").isin(years))
        if start:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end:
            df = df.where(F.col("date") <= F.lit(end).cast("date"))
        return df.select(*B.CANONICAL)
