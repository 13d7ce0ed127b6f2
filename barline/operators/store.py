"""The price database: Parquet by year, a manifest, incremental updates, commits by optimistic concurrency."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import bars as B

OVERLAP_BARS = 10
MANIFEST = "symbol string, first_date date, last_date date, rows long, failures int, last_failure date, last_error string, last_readjust date, last_check date"
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
FAILURES, BENCH_DAYS = 3, 7
#: Action tables of past updates that are kept, and versions of the data; times that an update begins anew.
UPDATES, VERSIONS, ATTEMPTS = 10, 3, 20


@dataclass(frozen=True)
class Version:
    """A committed state: the manifest's folder, and the folder that holds each year's bars."""

    number: int = -1
    manifest: str | None = None
    years: dict[int, str] = field(default_factory=dict)


class PriceStore:
    """Bars under root/prices (a folder per update, by year), manifests under root/manifest, versions under root/commits.

    An update reads only the years it touches and writes them, and a manifest, to new folders.
    It counts once its version is committed: a file with the next number that is created only
    if nobody has. Whoever comes second drops what they wrote and merges again on the new
    version, so two updates at a time both stay, and a failed write leaves nothing that counts.
    Version files stay for good, folders as long as one of the last VERSIONS needs them.

    progress(step, what) hears of every table that an update writes, in order: what is
    observed while the rows pass by, so nothing is read or run for it. Steps: staged, bars,
    manifest; what: rows, symbols (estimated) and, where there are days, first and last. A step
    that begins anew on a newer version is told again.
    """

    def __init__(self, spark: SparkSession, root: str, progress: Callable[[str, dict], None] | None = None) -> None:
        self.spark, self.root, self.progress = spark, root.rstrip("/"), progress
        self._good: dict[str, object] = {}  # manifests found readable, as they were listed then

    def _files(self, path: str):
        """The path and its file system, for listing and deleting."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listing(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, changed at) of what is in a folder."""
        p, fs = self._files(path)
        return sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _names(self, path: str) -> list[str]:
        return [x[0] for x in self._listing(path)]

    def _remove(self, path: str) -> None:
        p, fs = self._files(path)
        fs.delete(p, True)

    def _claim(self, number: int, text: str) -> bool:
        """Create the version file whole, unless it is there: a hard link on local disks, a rename that does not replace elsewhere."""
        new, final = f"{self.root}/commits/.{uuid.uuid4().hex}", f"{self.root}/commits/{number:09d}.json"
        p, fs = self._files(new)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                plain = lambda x: self._files(x)[0].toUri().getPath()
                try:
                    os.link(plain(new), plain(final))
                    return True
                except FileExistsError:
                    return False
            jvm, options = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(p, self._files(final)[0], options)
                return True
            except Exception:
                if fs.exists(self._files(final)[0]):
                    return False
                raise
        finally:
            fs.delete(p, False)

    def version(self, number: int | None = None) -> Version:
        """A committed version, by default the newest one."""
        names = [n for n in self._names(f"{self.root}/commits") if n.endswith(".json") and not n.startswith(".")]
        name = f"{number:09d}.json" if number is not None else names[-1] if names else None
        if name not in names:
            return Version()
        p, fs = self._files(f"{self.root}/commits/{name}")
        stream = fs.open(p)
        try:
            got = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(int(name[:-5]), got["manifest"], {int(y): f for y, f in got["years"].items()})

    def _committed(self, change: Callable[[Version], tuple[DataFrame, str, dict[int, str], list[str]]]) -> DataFrame:
        """Run change on the newest version until its version can be committed; change returns a result, the manifest, the years and the folders it has written."""
        for k in range(ATTEMPTS):
            base, made = self.version(), []
            try:
                result, manifest, years, made = change(base)
            except Exception:
                if self.version().number != base.number:  # what it read may have been replaced meanwhile
                    continue
                raise
            if self._claim(base.number + 1, json.dumps({"manifest": manifest, "years": years})):
                self._tidy(base.number + 1)
                return result
            for path in made:
                self._remove(path)
            time.sleep(random.random() * 0.2 * k)
        raise RuntimeError(f"{ATTEMPTS} other updates came first")

    def _tidy(self, number: int) -> None:
        """Drop the folders that the version VERSIONS before this one was the last to need."""
        old = self.version(number - VERSIONS) if number >= VERSIONS else Version()
        live = [self.version(n) for n in range(max(0, number - VERSIONS + 1), number + 1)]
        for year, folder in old.years.items():
            if all(v.years.get(year) != folder for v in live):
                self._remove(f"{self.root}/prices/{folder}" if all(folder not in v.years.values() for v in live) else f"{self.root}/prices/{folder}/year={year}")
        if old.manifest and all(v.manifest != old.manifest for v in live):
            self._remove(f"{self.root}/manifest/{old.manifest}")

    def _write(self, step: str, df: DataFrame, path: str, *by: str) -> None:
        """Write a new folder, and tell of its rows if anybody listens."""
        seen = Observation() if self.progress else None
        if seen is not None:
            days = [F.min("date").alias("first"), F.max("date").alias("last")] if "date" in df.columns else []
            names = [F.approx_count_distinct("symbol").alias("symbols")] if "symbol" in df.columns else []
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *names, *days)
        df.write.partitionBy(*by).parquet(path)
        if seen is not None:
            self.progress(step, seen.get)

    @contextmanager
    def staging(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a table and reads it back; the tables go when the block ends."""
        folder = f"{self.root}/staging/{uuid.uuid4().hex}"

        def stage(df: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            self._write("staged", df, path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            self._remove(folder)

    def load(self, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
        """Bars; a date range prunes to its years and is pushed to the files."""
        at = self.version(version)
        years = [y for y in at.years if (not start or y >= int(start[:4])) and (not end or y <= int(end[:4]))]
        df = self._prices(years, at)
        for bound, side in ((start, "ge"), (end, "le")):
            if bound:
                day = F.lit(bound).cast("date")
                df = df.where(F.col("date") >= day if side == "ge" else F.col("date") <= day)
        return df.select(*B.CANONICAL)

    def _prices(self, years: list[int] | None = None, at: Version | None = None) -> DataFrame:
        """Bars with year; of some years, which reads their folders only."""
        at = at or self.version()
        paths = [f"{self.root}/prices/{f}/year={y}" for y, f in sorted(at.years.items()) if years is None or y in years]
        df = self.spark.read.schema(BARS).parquet(*paths) if paths else self.spark.createDataFrame([], BARS)
        return df.withColumn("year", F.year("date"))

    def manifest(self, at: Version | None = None) -> DataFrame:
        """The manifest of a version; if it cannot be read, that of the version before it."""
        at = at or self.version()
        while at.number >= 0:
            path = f"{self.root}/manifest/{at.manifest}"
            listing = self._listing(path)
            if any(x[0] == "_SUCCESS" for x in listing):
                df = self.spark.read.schema(MANIFEST).parquet(path)
                try:
                    if self._good.get(path) != listing:
                        df.write.format("noop").mode("overwrite").save()
                        self._good[path] = listing
                    return df
                except Exception:  # damaged
                    pass
            at = self.version(at.number - 1) if at.number else Version()
        return self.spark.createDataFrame([], MANIFEST)

    def _written(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A new folder with rows by year, a year's symbols spread over files by ranges, and its years."""
        folder = uuid.uuid4().hex
        out = rows.select(*B.CANONICAL).withColumns({c: F.round(c, 6) for c in B.OHLC}).withColumn("year", F.year("date"))
        ranged = out.repartitionByRange("year", "symbol").sortWithinPartitions("year", "symbol", "date")
        self._write("bars", ranged, f"{self.root}/prices/{folder}", "year")
        return folder, [int(n[5:]) for n in self._names(f"{self.root}/prices/{folder}") if n.startswith("year=")]

    def wanted(self, symbols: DataFrame, today: str, force: bool = False) -> DataFrame:
        """symbol, start: what to ask a provider for; benched symbols are left out, the last bars asked for again."""
        both = symbols.select("symbol").join(self.manifest(), "symbol", "left")
        if not force:
            both = both.where(~benched(today))
        from_ = F.date_sub("last_date", OVERLAP_BARS * 7 // 5 + 4)
        return both.where(F.col("last_date").isNull() | (F.col("last_date") < F.lit(today).cast("date"))).select("symbol", from_.alias("start"))

    def actions(self, fresh: DataFrame, at: Version | None = None) -> DataFrame:
        """symbol, action (created, appended, readjusted, unchanged), new_rows for fresh bars; reads the years of fresh."""
        at = at or self.version()
        old = self._prices(_years(fresh), at)
        known = self.manifest(at).where("rows IS NOT NULL").select("symbol").union(old.select("symbol")).distinct().withColumn("had", F.lit(True))
        new = fresh.join(old.select("symbol", "date"), ["symbol", "date"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("new_rows"))
        moved = B.drift(old, fresh).select("symbol", "readjusted")
        df = fresh.select("symbol").distinct().join(known, "symbol", "left").join(new, "symbol", "left").join(moved, "symbol", "left")
        n = F.coalesce("new_rows", F.lit(0))
        action = F.when(F.col("had").isNull(), "created").when(F.col("readjusted"), "readjusted").when(n > 0, "appended").otherwise("unchanged")
        return df.select("symbol", action.alias("action"), n.alias("new_rows"))

    def update(self, fresh: DataFrame, today: str, failed: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
        """Merge fresh bars; failed: symbol, error; full: whole histories for symbols whose history was rewritten.

        Returns symbol, action, new_rows, with action `failed` for the failed ones.
        """
        with self.staging() as stage:
            fresh = stage(fresh.select(*B.CANONICAL))

            def change(base: Version):
                done = stage(self.actions(fresh, base))
                rewritten = done.where("action = 'readjusted'").select("symbol")
                news = fresh.join(done.where("action IN ('created', 'appended')").select("symbol"), "symbol", "left_semi")
                whole = (full if full is not None else fresh).join(rewritten, "symbol", "left_semi").select(*B.CANONICAL)
                return self._merged(base, stage(news.unionByName(whole)), rewritten if full is not None else None, done, today, failed)

            return self._committed(change)

    def ingest(self, fresh: DataFrame, today: str, merge: bool = True) -> DataFrame:
        """Take bars as they are: over the stored ones of their days (merge), or in place of all that is stored of their symbols.

        Returns symbol, action (created, merged, replaced), new_rows.
        """
        with self.staging() as stage:
            fresh = stage(fresh.select(*B.CANONICAL))

            def change(base: Version):
                old = self._prices(_years(fresh), base)
                known = self.manifest(base).where("rows IS NOT NULL").select("symbol", F.lit(True).alias("had"))
                new = fresh.join(old.select("symbol", "date"), ["symbol", "date"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("new_rows"))
                action = F.when(F.col("had").isNull(), "created").otherwise("merged" if merge else "replaced")
                every = fresh.select("symbol").distinct().join(known, "symbol", "left").join(new, "symbol", "left")
                done = stage(every.select("symbol", action.alias("action"), F.coalesce("new_rows", F.lit(0)).alias("new_rows")))
                return self._merged(base, fresh, None if merge else done.where("action = 'replaced'").select("symbol"), done, today, None)

            return self._committed(change)

    def _merged(self, base: Version, incoming: DataFrame, leaving: DataFrame | None, done: DataFrame, today: str, failed: DataFrame | None):
        """incoming over the bars of base, without the stored bars of the symbols that are leaving: what _committed takes."""
        years, made = _years(incoming), []
        if leaving is not None:  # years in which the old history leaves as well
            spans = self.manifest(base).join(leaving, "symbol", "left_semi").select(F.explode(F.sequence(F.year("first_date"), F.year("last_date"))).alias("year"))
            years = sorted({*years, *(r["year"] for r in spans.distinct().collect())})
        where, span = dict(base.years), None
        if years:
            old = self._prices(years, base)
            stays = old if leaving is None else old.join(leaving, "symbol", "left_anti")
            folder, there = self._written(B.upsert(stays, incoming))
            made.append(f"{self.root}/prices/{folder}")
            where = {y: f for y, f in where.items() if y not in years} | dict.fromkeys(there, folder)
            ours = incoming.select("symbol").distinct() if leaving is None else incoming.select("symbol").union(leaving).distinct()
            now = self._prices(there, Version(years=where)).join(ours, "symbol", "left_semi").groupBy("symbol").agg(F.min("date").alias("_first"), F.max("date").alias("_last"), F.count(F.lit(1)).alias("_rows"))
            before = old.join(ours, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("_gone"))
            span = now.join(before, "symbol", "left")
            if leaving is not None:
                span = span.join(leaving.distinct().withColumn("_anew", F.lit(True)), "symbol", "left")
        manifest = self._recorded(base, span, done, today, failed)
        made.append(f"{self.root}/manifest/{manifest}")
        log = f"{self.root}/updates/{base.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        out = done.select("symbol", "action", "new_rows")
        gone = None if failed is None else failed.select("symbol", F.lit("failed").alias("action"), F.lit(0).cast("long").alias("new_rows"))
        (out if gone is None else out.unionByName(gone)).write.parquet(log)
        made.append(log)
        for name in self._names(f"{self.root}/updates")[:-UPDATES]:
            self._remove(f"{self.root}/updates/{name}")
        return self.spark.read.parquet(log), manifest, where, made

    def _recorded(self, base: Version, span: DataFrame | None, done: DataFrame, today: str, failed: DataFrame | None) -> str:
        """The folder of the next manifest: symbols with news are counted from the years touched and what the last manifest says of the others."""
        day = F.lit(today).cast("date")
        span = span if span is not None else self.spark.createDataFrame([], "symbol string, _first date, _last date, _rows long, _gone long")
        anew = F.coalesce(F.col("_anew"), F.lit(False)) if "_anew" in span.columns else F.lit(False)
        bad = failed.groupBy("symbol").agg(F.first("error").alias("error")) if failed is not None else self.spark.createDataFrame([], "symbol string, error string")
        both = self.manifest(base).join(span, "symbol", "full").join(done.select("symbol", "action"), "symbol", "full").join(bad, "symbol", "full")
        failing, seen = F.col("error").isNotNull(), F.col("action").isNotNull()
        keep = lambda test, new, name: F.when(test, new).otherwise(F.col(name)).alias(name)
        rows = F.when(F.col("_rows").isNull(), F.col("rows")).when(anew, F.col("_rows")).otherwise(F.coalesce("rows", F.lit(0)) - F.coalesce("_gone", F.lit(0)) + F.col("_rows"))
        out = both.select(
            "symbol", F.when(anew, F.col("_first")).otherwise(F.least("_first", "first_date")).alias("first_date"), F.when(anew, F.col("_last")).otherwise(F.greatest("_last", "last_date")).alias("last_date"), rows.alias("rows"),
            F.when(failing, F.coalesce("failures", F.lit(0)) + 1).when(seen, 0).otherwise(F.coalesce("failures", F.lit(0))).cast("int").alias("failures"),
            keep(failing, day, "last_failure"), keep(failing, F.col("error"), "last_error"), keep(F.col("action") == "readjusted", day, "last_readjust"), keep(seen | failing, day, "last_check"),
        )
        folder = f"{base.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        self._write("manifest", out.coalesce(1), f"{self.root}/manifest/{folder}")
        return folder

    def coverage(self) -> DataFrame:
        m = self.manifest()
        return m.agg(F.count("rows").alias("symbols_on_disk"), F.count(F.lit(1)).alias("symbols_tracked"), F.count_if((F.col("failures") < FAILURES) & F.col("rows").isNotNull()).alias("symbols_healthy"), F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.max("last_date").alias("latest_date"))


def benched(today: str):
    """Whether a symbol of the manifest has failed so often of late that it is left alone for some days."""
    return F.coalesce((F.col("failures") >= FAILURES) & (F.datediff(F.lit(today), "last_failure") < BENCH_DAYS), F.lit(False))


def _years(df: DataFrame) -> list[int]:
    """The calendar years of some bars: a short list."""
    return sorted(r["year"] for r in df.select(F.year("date").alias("year")).where("year IS NOT NULL").distinct().collect())


def counters(actions: DataFrame) -> DataFrame:
    """action, symbols, new_rows."""
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("symbols"), F.sum("new_rows").alias("new_rows"))


def health(coverage: dict, actions: dict[str, int], today, max_failure_ratio: float = 0.5, max_stale_days: int = 5) -> list[str]:
    """What is wrong with the database, in words: checks of a measured value against the most that is allowed."""
    asked, latest = sum(actions.values()), coverage.get("latest_date")
    share = actions.get("failed", 0) / asked if asked else 0.0
    age = (today - latest).days if latest else 0
    checks = (
        (not latest, True, "no bars are stored"),
        (share, max_failure_ratio, f"{actions.get('failed', 0)} of {asked} fetches failed, more than {max_failure_ratio:.0%}"),
        (age, max_stale_days, f"the last bar, of {latest}, is {age} days old, more than {max_stale_days}"),
    )
    return [words for value, most, words in checks if (value is most if isinstance(most, bool) else value > most)]
