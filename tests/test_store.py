"""Commits of the price database, and ingest."""

import threading
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from barline.functions.indicators import annotate
from barline.operators import store as S
from barline.operators.buckets import BucketedBars
from barline.operators.detectors import breakout
from barline.operators.store import PriceStore
from barline.plans.config import BreakoutConfig

from .test_bars import frame, line, run_cli, series


@pytest.mark.parametrize("years", ["the same", "other"])
def test_two_updates_at_a_time_both_stay(spark, tmp_path, monkeypatch, years):
    a, b = series("A", line(10, 20, 40)), series("B", line(30, 20, 40), start=date(2021 if years == "the same" else 2023, 1, 4))
    one, two = (PriceStore(spark, str(tmp_path / "db")) for _ in range(2))
    one.update(frame(spark, a[:20]), "2021-06-01")
    claim, tries = one._claim, []

    def second_first(number, text):
        tries.append(number)
        if len(tries) == 1:  # the other update is committed between this one's reading and its commit
            two.update(frame(spark, b), "2021-06-01", spark.createDataFrame([("Z", "boom")], "symbol string, error string"))
        return claim(number, text)

    monkeypatch.setattr(one, "_claim", second_first)
    done = one.update(frame(spark, a[10:40]), "2021-06-02")
    assert tries == [1, 2] and {r["symbol"]: r["action"] for r in done.collect()} == {"A": "appended"}
    assert {r["symbol"]: r["count"] for r in one.load().groupBy("symbol").count().collect()} == {"A": 40, "B": 40}
    assert {r["symbol"]: (r["rows"], r["failures"]) for r in two.manifest().collect()} == {"A": (40, 0), "B": (40, 0), "Z": (None, 1)}
    kept = {f for v in range(3) for f in one.version(v).years.values()}
    assert {p.name for p in (tmp_path / "db" / "prices").iterdir()} == kept  # the loser's folder is gone
    assert one.load(version=0).count() == 20 and not list((tmp_path / "db" / "staging").iterdir())


def test_a_number_is_given_once(spark, tmp_path):
    store, won = PriceStore(spark, str(tmp_path / "db")), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if store._claim(0, f'{{"manifest": "m{i}", "years": {{}}}}') else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.version().manifest == f"m{won[0]}" and [p.name for p in (tmp_path / "db" / "commits").iterdir() if p.suffix == ".json"] == ["000000000.json"]


def test_old_versions_go_and_unread_years_stay(spark, tmp_path):
    store, a = PriceStore(spark, str(tmp_path / "db")), series("A", line(10, 20, 300))
    for k, end in enumerate((200, 265, 270, 280, 290, 300)):
        store.update(frame(spark, a[max(0, end - 75) : end] if k else a[:end]), f"2022-01-{k + 10}")
    assert store.load().count() == 300 and store.manifest().first()["rows"] == 300
    live = [store.version(n) for n in (3, 4, 5)]
    assert {(p.parent.name, p.name) for p in (tmp_path / "db" / "prices").glob("*/year=*")} == {(f, f"year={y}") for v in live for y, f in v.years.items()}
    assert len(list((tmp_path / "db" / "manifest").iterdir())) == S.VERSIONS
    assert store.load("2022-01-03", "2022-01-10").inputFiles() and all("year=2022" in f for f in store.load("2022-01-03", "2022-01-10").inputFiles())


def test_ingest_keeps_the_last_row_or_replaces(spark, tmp_path, capsys):
    def vendor(name, rows):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("AAA.csv", "date,open,high,low,close,volume\n" + "".join(f"2021-01-{d:02d},10,12,9,{c},{v}\n" for d, c, v in rows))
            z.writestr("bad.csv", "date,what\n2021-01-01,1\n")
        return str(tmp_path / name)

    base = ["--repo", str(tmp_path / "db"), "--out", str(tmp_path / "out")]
    store = PriceStore(spark, str(tmp_path / "db"))
    bars = lambda: {r["date"].day: (r["close"], r["volume"]) for r in store.load().collect()}
    code, told, _ = run_cli(capsys, "ingest", vendor("a.zip", [(d, 11, 100) for d in range(1, 11)]), *base)
    assert (code, told["symbols"], told["rows"], told["files_read"], told["actions"], told["skipped"]) == (0, 1, 10, 1, {"created": 1}, 1) and "missing columns" in told["skipped_sample"][0][1]
    code, told, _ = run_cli(capsys, "ingest", vendor("b.zip", [(3, 11, 777), (11, 11, 5)]), *base)
    assert told["actions"] == {"merged": 1} and bars() == {d: (11.0, 777.0 if d == 3 else 5.0 if d == 11 else 100.0) for d in range(1, 12)}
    assert store.manifest().first()["rows"] == 11
    code, told, _ = run_cli(capsys, "ingest", vendor("c.zip", [(d, 11, 100) for d in range(4, 8)]), *base, "--no-merge")
    m = store.manifest().first()
    assert told["actions"] == {"replaced": 1} and set(bars()) == {4, 5, 6, 7} and (m["rows"], m["first_date"], m["last_date"], m["failures"]) == (4, date(2021, 1, 4), date(2021, 1, 7), 0)


def test_replacement_empties_the_years_it_leaves(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "db"))
    store.update(frame(spark, series("A", line(10, 20, 300))), "2022-06-01")
    store.ingest(frame(spark, series("A", line(10, 20, 5), start=date(2022, 3, 1))), "2022-06-02", merge=False)
    m = store.manifest().first()
    assert store.load().agg(F.min("date")).first()[0] == date(2022, 3, 1) == m["first_date"] and m["rows"] == store.load().count() == 5 and list(store.version().years) == [2022]


def test_progress_is_told_without_a_job_of_its_own(spark, tmp_path):
    def jobs(listen):
        heard, tracker = [], spark.sparkContext.statusTracker()
        store = PriceStore(spark, str(tmp_path / f"db{listen}"), (lambda *x: heard.append(x)) if listen else None)
        spark.sparkContext.setJobGroup(f"progress{listen}", "")
        store.update(frame(spark, series("A", line(10, 20, 300)) + series("B", line(10, 20, 40))), "2022-06-01")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return heard, len(tracker.getJobIdsForGroup(f"progress{listen}"))

    (heard, told), (_, plain) = jobs(True), jobs(False)
    assert told == plain > 0
    assert [step for step, _ in heard] == ["staged", "staged", "staged", "bars", "manifest"]
    bars, manifest = heard[3][1], heard[4][1]
    assert bars == {"rows": 340, "symbols": 2, "first": date(2021, 1, 4), "last": bars["last"]} and bars["last"].year == 2022
    assert manifest == {"rows": 2, "symbols": 2}


def test_buckets_need_no_exchange_and_copy_only_what_changed(spark, tmp_path):
    store, table = PriceStore(spark, str(tmp_path / "db")), BucketedBars(spark, "bars_by_symbol", 4)
    assert table.sync(store) == [] and table.load().count() == 0
    a, b = series("A", line(10, 20, 300)), series("B", line(30, 20, 280))
    store.update(frame(spark, a[:255] + b), "2022-06-01")
    assert table.sync(store) == [2021, 2022] and table.sync(store) == []
    store.update(frame(spark, a[245:]), "2022-06-02")
    changed = [y for y, f in store.version().years.items() if f != store.version(0).years.get(y)]
    assert BucketedBars(spark, "bars_by_symbol", 99).buckets == 4 and table.sync(store) == changed
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(table.load()) == rows(store.load()) and len(rows(store.load())) == 580
    assert rows(table.load("2022-01-03", "2022-01-10")) == rows(store.load("2022-01-03", "2022-01-10"))
    bars = table.load()
    other = bars.select("symbol", "date", F.col("close").alias("c2"))
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (annotate(bars), counts, bars.join(counts, "symbol"), breakout(annotate(bars), BreakoutConfig())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(annotate(bars)) == rows(annotate(store.load())) and bars.join(other, ["symbol", "date"]).count() == 580
    store.ingest(frame(spark, series("A", line(10, 20, 5), start=date(2022, 3, 1))), "2022-06-03", merge=False)
    store.ingest(frame(spark, series("B", line(10, 20, 5), start=date(2022, 3, 1))), "2022-06-03", merge=False)
    assert table.sync(store) == [2022] and rows(table.load()) == rows(store.load()) and set(table.copied()) == {2022}
    spark.sql("DROP TABLE bars_by_symbol")
