"""Bars and symbol lists from files."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import CANONICAL, day_of, normalized

# The column that each vendor's spelling means, compared trimmed and in lower case.
SPELLINGS = {
    "date": "date", "datetime": "date", "timestamp": "date", "time": "date", "trade date": "date", "tradedate": "date", "day": "date", "dt": "date", "<date>": "date",
    "open": "open", "o": "open", "opening price": "open", "open price": "open", "<open>": "open",
    "high": "high", "h": "high", "high price": "high", "<high>": "high",
    "low": "low", "l": "low", "low price": "low", "<low>": "low",
    "close": "close", "c": "close", "closing price": "close", "close price": "close", "last": "close", "<close>": "close",
    "adj close": "adj close", "adj_close": "adj close", "adjclose": "adj close", "adjusted close": "adj close", "adj. close": "adj close",
    "volume": "volume", "v": "volume", "vol": "volume", "total volume": "volume", "<vol>": "volume",
    "symbol": "symbol", "ticker": "symbol", "sym": "symbol", "name": "symbol", "<ticker>": "symbol",
}
REQUIRED = ("date", "open", "high", "low", "close", "volume")
TABULAR = (".csv", ".txt", ".tsv")
SYMBOL = r"^[A-Z0-9.\-]{1,10}$"


def canonical(header: list[str]) -> dict[str, int]:
    """Canonical name -> position; the first column that fits wins."""
    out: dict[str, int] = {}
    for i, h in enumerate(header):
        if k := SPELLINGS.get(h.strip().lower()):
            out.setdefault(k, i)
    return out


def csv_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Canonical bars of a folder of TICKER.csv files, and the files left out (file, problem).

    Every file has its own header: names are trimmed, any order and further columns will do.
    The date is the first column called date, datetime or timestamp, else the first one. A file
    that lacks a column is left out, as is one without any usable date or price.
    """
    text = spark.read.text(path, pathGlobFilter="*.[cC][sS][vV]")
    lines = text.select(F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line")).where(F.trim("line") != "")
    cells = lambda c: F.transform(F.split(c, r''',(?=(?:[^"]*"[^"]*")*[^"]*$)''', -1), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("_head"), F.min("at").alias("_first"))
    heads = heads.withColumn("_names", F.transform(cells("_head"), F.lower))
    place = lambda *names: F.coalesce(*[F.when(F.array_contains("_names", n), F.array_position("_names", n).cast("int")) for n in names])
    wanted = {c: place(c) for c in ("open", "high", "low", "volume")} | {"adj close": place("adj close", "adj_close", "adjclose")}
    wanted |= {"date": F.coalesce(place("date", "datetime", "timestamp"), F.lit(1)), "close": F.coalesce(place("close"), wanted["adj close"])}
    heads = heads.select("file", "_first", F.struct(*[v.alias(k) for k, v in wanted.items()]).alias("_place"))
    lacking = F.filter(F.array(*[F.when(F.col(f"_place.{c}").isNull(), c) for c in REQUIRED]), lambda x: x.isNotNull())
    heads = heads.withColumn("problem", F.when(F.size(lacking) > 0, F.concat(F.lit("missing columns "), F.array_join(lacking, ", "))))
    rows = lines.join(heads.where("problem IS NULL"), "file").where(F.col("at") != F.col("_first")).withColumn("_cells", cells("line"))
    cell = lambda c: F.when(F.col(f"_place.`{c}`").isNotNull(), F.nullif(F.get("_cells", F.col(f"_place.`{c}`") - 1), F.lit(""))).alias(c)
    symbol = F.upper(F.regexp_replace("file", r"(?i)\.csv$", ""))
    bars = normalized(rows.select(symbol.alias("symbol"), *[cell(c) for c in (*REQUIRED, "adj close")], F.col("at").alias("ord")), "ord")
    empty = heads.where("problem IS NULL").select("file", symbol.alias("symbol")).join(bars.select("symbol").distinct(), "symbol", "left_anti").select("file", F.lit("no usable rows").alias("problem"))
    return bars, heads.where("problem IS NOT NULL").select("file", "problem").unionByName(empty)


def csv_directory(spark: SparkSession, path: str) -> DataFrame:
    """The bars of csv_folder."""
    return csv_folder(spark, path)[0]


VENDOR = "member string, line long, problem string, symbol string, date string, open string, high string, low string, close string, `adj close` string, volume string"
_VENDOR_NAMES = ["member", "line", "problem", "symbol", "date", "open", "high", "low", "close", "adj close", "volume"]
_VENDOR_TYPES = [pa.int64() if n == "line" else pa.string() for n in _VENDOR_NAMES]


def vendor_lines(member: str, f: io.TextIOBase) -> Iterator[tuple]:
    """Rows of VENDOR of an open vendor file of any separator; one row with `problem` if it lacks a column."""
    head = f.readline()
    mark = "\t" if member.lower().endswith(".tsv") else max(",;|\t", key=head.count)
    at = canonical(next(csv.reader([head], delimiter=mark), []))
    if missing := [c for c in REQUIRED if c not in at]:
        yield (member, 0, f"missing columns {missing}", *[None] * 8)
        return
    stem = re.sub(r"\.[^.]*$", "", member.rsplit("/", 1)[-1]).upper().split(".")[0].strip()
    for i, cells in enumerate(csv.reader(f, delimiter=mark)):
        get = lambda k, cells=cells: cells[at[k]].strip() or None if k in at and at[k] < len(cells) else None
        symbol = (get("symbol") or "").upper() if "symbol" in at else stem
        yield (member, i + 1, None, symbol or None, *(get(k) for k in _VENDOR_NAMES[4:]))


def in_batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _VENDOR_TYPES, strict=True)], names=_VENDOR_NAMES)


def vendor_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of vendor files (zip archives, folders or single files) under canonical names, as text.

    Every member of an archive is read by a range of its own, so tasks share an archive and hold
    none of it. A member that lacks a column or is damaged is one row with `problem` set. Files
    that are not archives can be of any separator.
    """
    from .archives import VendorFiles  # it is built on this module

    spark.dataSource.register(VendorFiles)
    return spark.read.format("vendor_files").option("paths", json.dumps([str(p) for p in paths])).load()


def ingest(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Canonical bars of vendor files, and what was left out (member, problem)."""
    return usable_rows(vendor_rows(spark, *paths))


def usable_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rows of VENDOR."""
    good = rows.where("problem IS NULL AND symbol IS NOT NULL").withColumn("ord", F.struct("member", "line"))
    bars = normalized(good.drop("member", "line", "problem"), "ord")
    dated = good.groupBy("member").agg(F.count(day_of("date")).alias("n")).where("n = 0").select("member", F.lit("no parseable dates").alias("problem"))
    return bars, rows.where("problem IS NOT NULL").select("member", "problem").unionByName(dated)


def universe(spark: SparkSession, given: str | list[str]) -> DataFrame:
    """symbol, ord: distinct valid symbols in their first order, from a list, text ('A, B # note'), a file (.txt or .csv) or a list that comes along ('sample')."""
    if isinstance(given, str) and (own := Path(__file__).with_name(f"{given.lower()}.symbols")).is_file():
        given = own.read_text().splitlines()
    if isinstance(given, str) and given.lower().endswith(".csv"):
        raw = spark.read.option("header", True).csv(given)
        names = {c.strip().lower(): c for c in raw.columns}
        column = next((names[n] for n in ("symbol", "ticker", "act symbol") if n in names), raw.columns[0])
        lines = raw.select(F.col(f"`{column}`").alias("value"))
    elif isinstance(given, str) and given.lower().endswith(".txt"):
        lines = spark.read.text(given)
    else:
        lines = spark.createDataFrame([(x,) for x in ([given] if isinstance(given, str) else given)], "value string")
    words = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(F.regexp_replace("value", "#.*", ""), r"[\s,;]+")).alias("pos", "word"))
    found = words.select(F.upper(F.trim("word")).alias("symbol"), F.struct("line", "pos").alias("at")).where(F.col("symbol").rlike(SYMBOL))
    first = found.groupBy("symbol").agg(F.min("at").alias("at"))
    return first.select("symbol", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))


def listings(spark: SparkSession, path: str, include_etfs: bool = False) -> DataFrame:
    """Symbols of a pipe-separated exchange listing without test issues, funds and other share classes."""
    raw = spark.read.option("header", True).option("sep", "|").csv(path)
    keep = F.col("Symbol").isNotNull() & ~F.col("Symbol").rlike(r"[.$]")
    for c, wanted in (("Test Issue", True), ("ETF", not include_etfs)):
        if c in raw.columns and wanted:
            keep = keep & F.coalesce(F.col(f"`{c}`") != "Y", F.lit(True))
    return raw.where(keep).select(F.upper(F.trim("Symbol")).alias("symbol")).where(F.col("symbol").rlike(SYMBOL)).distinct()


def nasdaq_listings(spark: SparkSession, folder: str, include_etfs: bool = False) -> DataFrame:
    """Symbols of the exchange's current listing, fetched into folder (a path that Spark can write) and then read as `listings` does."""
    from .providers import _get

    names = ("nasdaqlisted.txt", "otherlisted.txt")
    pages = [(n, _get(f"https://www.nasdaqtrader.com/dynamic/SymDir/{n}").replace("ACT Symbol|", "Symbol|")) for n in names]
    spark.createDataFrame(pages, "name string, value string").write.mode("overwrite").partitionBy("name").text(folder)
    found = [listings(spark, f"{folder}/name={n}", include_etfs) for n in names]
    return found[0].union(found[1]).distinct()


def write_csv(df: DataFrame, path: str, first: tuple[str, ...] = ()) -> None:
    """One CSV with header; the columns named first come first, the others after them."""
    order = [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]
    df.select(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Small results (statistics), a JSON object a line."""
    df.coalesce(1).write.mode("overwrite").json(path)


assert set(CANONICAL) <= set(SPELLINGS.values())
