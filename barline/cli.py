"""python -m barline VERB: scan, history, backtest, update, daily, ingest, explain.

Exit codes: 0 done, 1 done with problems or nothing found, 2 unusable data or arguments.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import fields, replace
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .errors import DataError
from .operators import outcomes as O
from .operators.detectors import SETUPS
from .operators.store import PriceStore, counters, health
from .plans import scans
from .plans.config import AccountConfig, SetupConfig, TradeRules, settings
from .sources import files, providers
from .sources.cache import CachedBars

_STATES = sorted({x for s in SETUPS.values() for x in s.states})
_ON = {"action": "store_true"}


def _number(kind, default=None) -> dict:
    return {"type": kind, "default": default}


#: Options by what they are about; a verb takes whole groups.
OPTIONS: dict[str, dict[str, dict]] = {
    "setup": {"--setup": {"choices": list(SETUPS), "default": "breakout"}, "--preset": {"choices": ["default", "relaxed", "strict"], "default": "default"}, "--set": {"action": "append", "default": [], "metavar": "NAME=JSON", "help": "any setting"}}
    | {f"--{k.replace('_', '-')}": _number(t) for k, t in (("account_size", float), ("max_base_depth", float), ("max_base_len", int), ("max_dist_from_pivot", float), ("max_position_pct", float), ("min_adr_pct", float), ("min_base_len", int), ("min_dollar_volume", float), ("min_price", float), ("min_rs_rank", float), ("risk_pct", float))},
    "bars": {"--repo": {"help": "the price database"}, "--csv-dir": {"help": "a folder of TICKER.csv"}, "--provider": {"choices": list(providers.PROVIDERS), "default": "stooq"}, "--cache": {"default": "cache", "help": "where fetched bars are kept"}, "--offline": _ON, "--refresh": _ON, "--universe": {"help": "symbols, a .txt or .csv of them, or 'listed'"}, "--verbose": _ON},
    "shown": {"--out": {"default": "out"}, "--limit": _number(int, 25)},
    "picked": {"--state": {"choices": _STATES}, "--min-score": _number(float, 0.0)},
    "charts": {"--charts": _number(int, 0), "--contact-sheet": _ON},
    "past": {"--start": {}, "--end": {}, "--years": _number(int, 5), "--cooldown": _number(int), "--trail-ma": {"type": int, "choices": [10, 20], "default": 20}, "--partial-days": _number(int, 4)},
    "account": {"--starting-equity": _number(float, 100_000.0), "--max-positions": _number(int, 10), "--max-exposure-pct": _number(float, 1.0)},
    "fetch": {"--workers": _number(int, 8), "--pause": _number(float, 0.0), "--history-years": _number(int, 12), "--force": _ON},
    "checks": {"--skip-update": _ON, "--max-failure-ratio": _number(float, 0.5), "--max-stale-days": _number(int, 5)},
    "asof": {"--asof": {}},
    "archives": {"sources": {"nargs": "+"}, "--no-merge": _ON},
    "one": {"--symbol": {"required": True}, "--date": {}, "--years": _number(int, 3), "--chart": _ON},
}
VERBS = {
    "scan": ("candidates on the newest bar", "setup bars shown picked charts asof"),
    "history": ("past signals and what followed", "setup bars shown past charts"),
    "backtest": ("past signals as one account", "setup bars shown past charts account"),
    "update": ("refresh the price database", "setup bars shown fetch"),
    "daily": ("refresh, scan and report", "setup bars shown picked charts fetch checks"),
    "ingest": ("load vendor files into the price database", "setup bars shown archives"),
    "explain": ("every measure of one symbol on one bar", "setup bars shown one"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barline", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, (about, groups) in VERBS.items():
        p = verbs.add_parser(name, help=about)
        for group in groups.split():
            for flag, how in OPTIONS[group].items():
                p.add_argument(flag, **how)
    return top


def chosen(a: argparse.Namespace) -> SetupConfig:
    """The preset with the options that name a setting of the setup, and --set."""
    base = SETUPS[a.setup].presets[a.preset]
    given = {f.name: getattr(a, f.name) for f in fields(base) if getattr(a, f.name, None) is not None}
    for item in a.set:
        name, _, value = item.partition("=")
        given[name] = json.loads(value)
    return settings(base, given)


def symbols(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    if a.universe == "listed":
        return files.nasdaq_listings(spark, f"{a.cache}/listings").select("symbol")
    return files.universe(spark, a.universe).select("symbol") if a.universe else None


def load(spark: SparkSession, a: argparse.Namespace, start: str | None = None, end: str | None = None) -> DataFrame:
    """The bars asked for, from the database, a folder or a provider (through its cache)."""
    names = symbols(spark, a)
    if a.repo:
        bars = PriceStore(spark, a.repo).load(start, end)
    elif a.csv_dir:
        bars, left_out = files.csv_folder(spark, a.csv_dir)
        tell(a, left_out)
    elif names is not None:
        first, last = providers.default_window(getattr(a, "years", 3))
        bars, failed = CachedBars(spark, a.cache, a.provider, offline=a.offline).get([r["symbol"] for r in names.toLocalIterator()], date.fromisoformat(start) if start else first, last, a.refresh)
        tell(a, failed)
    else:
        raise DataError("name a price database (--repo), a folder (--csv-dir) or symbols (--universe)")
    if names is not None:
        bars = bars.join(names, "symbol", "left_semi")
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if bars.isEmpty():
        raise DataError("no bars of these symbols")
    return bars


def tell(a: argparse.Namespace, left_out: DataFrame) -> None:
    if a.verbose:
        for r in left_out.limit(a.limit).toLocalIterator():
            print(*r, file=sys.stderr)


def database(spark: SparkSession, a: argparse.Namespace) -> PriceStore:
    """The price database; with --verbose its updates say how far they are."""
    heard = lambda step, what: print(step, *(f"{k}={v}" for k, v in what.items()), file=sys.stderr)
    return PriceStore(spark, a.repo, heard if a.verbose else None)


def years_before(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year - years)
    except ValueError:  # 29 February
        return day.replace(year=day.year - years, day=28)


def refresh(spark: SparkSession, a: argparse.Namespace, store: PriceStore) -> dict[str, int]:
    """Ask for what the database lacks and merge it; how many symbols were created, appended and so on."""
    today = date.today()
    names = symbols(spark, a)
    ask = {r["symbol"]: r["start"] for r in store.wanted(names if names is not None else store.manifest().select("symbol"), str(today), a.force).collect()}  # the list of requests
    first = today - timedelta(days=int(365.25 * a.history_years))

    def get(some: list[str], start: date) -> tuple[DataFrame, DataFrame]:
        if not a.csv_dir:
            return providers.fetch(spark, a.provider, some, start, today + timedelta(days=1), pause=a.pause, per_partition=max(1, -(-len(some) // a.workers)))
        wanted = spark.createDataFrame([(s,) for s in some], "symbol string")
        bars, left_out = files.csv_folder(spark, a.csv_dir)
        bars = bars.join(wanted, "symbol", "left_semi").where(F.col("date") >= F.lit(start))
        problems = left_out.select(F.upper(F.regexp_replace("file", r"(?i)\.csv$", "")).alias("symbol"), "problem")
        lacking = wanted.join(bars.select("symbol").distinct(), "symbol", "left_anti").join(problems, "symbol", "left")
        return bars, lacking.select("symbol", F.coalesce("problem", F.lit("no CSV")).alias("error"))

    seed, old = [s for s, d in ask.items() if d is None], {s: d for s, d in ask.items() if d}
    parts = ([get(seed, first)] if seed else []) + ([get(list(old), min(old.values()))] if old else [])
    if not parts:
        return {}
    with store.staging() as stage:
        bars, failed = (stage(parts[0][i] if len(parts) == 1 else parts[0][i].unionByName(parts[1][i])) for i in (0, 1))
        moved = [r["symbol"] for r in store.actions(bars).where("action = 'readjusted'").collect()]
        done = store.update(bars, str(today), failed, stage(get(moved, first)[0]) if moved else None)
    return {r["action"]: r["symbols"] for r in counters(done).collect()}


def drawn(bars: DataFrame, a: argparse.Namespace, cfg: SetupConfig, signals: DataFrame, folder: Path) -> dict[str, str]:
    """Pictures of the first --charts signals: symbol -> file (the newest of a symbol), and a contact sheet if asked for."""
    some = [r.asDict() for r in signals.limit(a.charts).collect()] if a.charts else []
    made, paths = {}, []
    if some:
        spark = bars.sparkSession
        want = spark.createDataFrame([(s["symbol"], s["bar"]) for s in some], "symbol string, bar int")
        ann = scans.annotate(bars.join(F.broadcast(want.select("symbol").distinct()), "symbol", "left_semi"), cfg)
        near: dict[tuple, list] = {}
        for r in scans.around(ann, want).toLocalIterator():
            near.setdefault((r["symbol"], r["at"]), []).append(r)
        for s in some:
            if rows := near.get((s["symbol"], s["bar"])):
                paths.append(report.chart(rows, s, folder / f"{s['symbol']}_{s['date']}.svg"))
                made[s["symbol"]] = str(paths[-1])
        if a.contact_sheet:
            report.contact_sheet(paths, folder / "contact_sheet.svg")
    return made


def say(**what) -> None:
    print(json.dumps(what, default=str))


def ingest(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    store = database(spark, a)
    with store.staging() as stage:
        rows = stage(files.vendor_rows(spark, *a.sources))  # archives are read once
        bars, left_out = files.usable_rows(rows)
        bars, left_out = stage(bars), stage(left_out)
        done = store.ingest(bars, str(date.today()), merge=not a.no_merge)
        names = bars.select("symbol").distinct()
        names.orderBy("symbol").coalesce(1).write.mode("overwrite").text(str(out / "universe"))
        count, read = names.count(), rows.where("problem IS NULL").select("member").distinct().count()
        say(symbols=count, rows=bars.count(), files_read=read, actions={r["action"]: r["symbols"] for r in counters(done).collect()}, skipped=left_out.count(), skipped_sample=[tuple(r) for r in left_out.orderBy("member").limit(min(a.limit, 8)).collect()])
    return int(count == 0)


def explain(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    a.universe = a.universe or a.symbol
    bars = load(spark, a)
    found = scans.explain(bars, a.setup, a.symbol.upper(), a.date, cfg)
    rows = found.toJSON().take(1)
    if not rows:
        raise DataError(f"{a.symbol} has no bars")
    print(rows[0])
    if a.chart:
        a.charts, a.contact_sheet = 1, False
        drawn(bars, a, cfg, found, out / "charts")
    return 0


def scan(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    bars = load(spark, a)
    if a.asof:
        bars = bars.where(F.col("date") <= F.lit(a.asof).cast("date"))
    hits = scans.scan(bars, a.setup, cfg, None, (a.state,) if a.state else (), a.min_score).cache()
    path = out / f"scan_{date.today()}.csv"
    files.write_csv(hits, str(path), scans.FIRST)
    hits.select(*[c for c in scans.FIRST if c in hits.columns][:16]).show(a.limit, truncate=False)
    say(candidates=hits.count(), csv=path, charts=len(drawn(bars, a, cfg, hits, out / "charts")))
    return 0


def past(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    end = a.end or str(date.today())
    start = a.start or str(years_before(date.fromisoformat(end), a.years))
    bars = load(spark, a, str(date.fromisoformat(start) - timedelta(days=400)), end)
    signals = scans.sweep(bars, a.setup, cfg, replace(TradeRules(), trail_ma=a.trail_ma, partial_days=a.partial_days), start, a.cooldown).cache()
    span = f"{start}_{end}"
    files.write_csv(signals.orderBy("date", "symbol"), str(out / f"{a.verb}_{span}.csv"), scans.FIRST)
    files.write_json(O.summarise(signals), str(out / f"{a.verb}_summary_{span}"))
    best = signals.orderBy(F.col("score").desc(), "symbol", "bar")
    if a.verb == "backtest":
        account = AccountConfig(starting_equity=a.starting_equity, max_positions=a.max_positions, max_exposure_pct=a.max_exposure_pct, risk_pct=cfg.risk_pct, max_position_pct=cfg.max_position_pct)
        trades, curve, stats = scans.backtest(signals, account)
        for name, df in (("trades", trades), ("equity", curve)):
            files.write_csv(df, str(out / f"backtest_{name}_{span}.csv"))
        files.write_json(stats, str(out / f"backtest_stats_{span}"))
        report.equity_chart(curve.collect(), out / f"equity_{span}.svg")
        stats.show(truncate=False)
        best = best.join(trades.select("symbol", "fill_date").distinct(), ["symbol", "fill_date"], "left_semi").orderBy(F.col("score").desc(), "symbol", "bar")  # only trades that the account took
    O.summarise(signals).show(truncate=False)
    say(signals=signals.count(), charts=len(drawn(bars, a, cfg, best, out / "charts")))
    return 0


def update(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    store = database(spark, a)
    actions = refresh(spark, a, store)
    coverage = store.coverage().first().asDict()
    say(actions=actions, **coverage)
    return int(not coverage["total_rows"])


def daily(spark: SparkSession, a: argparse.Namespace, out: Path, cfg: SetupConfig) -> int:
    began, today = time.time(), date.today()
    store = database(spark, a)
    actions = {} if a.skip_update else refresh(spark, a, store)
    coverage = store.coverage().first().asDict()
    problems = health(coverage, actions, today, a.max_failure_ratio, a.max_stale_days)
    names = symbols(spark, a)
    bars = store.load() if names is None else store.load().join(names, "symbol", "left_semi")
    hits = scans.scan(bars, a.setup, cfg, None, (a.state,) if a.state else (), a.min_score).cache()
    csv, page, latest = out / f"scan_{today}.csv", out / f"report_{today}.html", out / "latest.html"
    files.write_csv(hits, str(csv), scans.FIRST)
    charts = drawn(bars, a, cfg, hits, out / "charts" / str(today))
    page.write_text(report.page(hits, list(scans.FIRST[:20]), f"{SETUPS[a.setup].label} scan", coverage=coverage, actions=actions, problems=problems, charts=charts))
    latest.write_text(page.read_text())
    states = {r["state"]: r["count"] for r in hits.groupBy("state").count().collect()}
    say(date=today, universe=coverage["symbols_on_disk"] if names is None else names.count(), candidates=sum(states.values()), states=states, charts=len(charts), report=page, latest=latest, csv=csv, data_as_of=coverage["latest_date"], elapsed_sec=round(time.time() - began, 1), actions=actions, problems=problems)
    return int(bool(problems))


RUN = {"scan": scan, "history": past, "backtest": past, "update": update, "daily": daily, "ingest": ingest, "explain": explain}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.verb in ("update", "daily", "ingest") and not a.repo:
            raise DataError("name the price database (--repo)")
        cfg = chosen(a)
        out = Path(a.out)
        out.mkdir(parents=True, exist_ok=True)
        return RUN[a.verb](SparkSession.builder.appName(f"barline-{a.verb}").getOrCreate(), a, out, cfg)
    except ValueError as e:  # DataError and unknown settings
        print(f"data error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
