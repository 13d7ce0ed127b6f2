"""Account state and benching as streams: typed state, timers, stops and restarts."""

from datetime import date, datetime, timedelta


from barline.operators import portfolio as P
from barline.operators.store import PriceStore, benched
from barline.plans.config import AccountConfig
from barline.streaming.accounts import live_ledger
from barline.streaming.benching import benching, resting

TRADES = "sleeve string, symbol string, setup string, direction int, fill_date date, exit_date date, fill double, stop double, r_multiple double, score double"


def d(n):
    return date(2024, 1, 1) + timedelta(days=n)


def trades(n=60):
    import random

    rng = random.Random(8)
    rows = [(rng.choice("ab"), f"S{i % 17}", "breakout", 1, d(i // 3), d(i // 3 + rng.randint(0, 9)), 100.0 + i % 7, 95.0, rng.choice([-1.0, 0.5, 2.0, 3.5]), float(rng.choice([10, 20, 30]))) for i in range(n)]
    return [*rows, ("a", "OPEN", "ep", 1, d(3), None, 50.0, 48.0, 1.0, 99.0), ("a", "NAN", "ep", 1, d(3), d(5), 50.0, 48.0, float("nan"), 99.0)]


def pieces(spark, rows, schema, folder, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.parquet(f"{folder}/.new")
        import os
        import shutil

        for f in os.listdir(f"{folder}/.new"):
            if f.endswith(".parquet"):
                os.rename(f"{folder}/.new/{f}", f"{folder}/{k:05d}.parquet")
        shutil.rmtree(f"{folder}/.new")


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_stream_in_pieces_gives_the_batch_ledger(spark, tmp_path):
    rows, cfg = trades(), AccountConfig(max_positions=4, max_position_pct=0.4, risk_pct=0.02)
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    stream = lambda: live_ledger(spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(folder), cfg, "sleeve", "2 days")
    late = [rows[i] for i in (*range(0, 20), *range(22, 24), 20, 21, *range(24, 40))]  # two come after trades of the next day
    pieces(spark, late, TRADES, folder, 8)
    run(stream(), out, mark)
    first = spark.read.parquet(out).count()
    pieces(spark, [*[("", *[None] * 9)] * 40, *rows[40:], *[(a, None, None, None, d(400), None, None, None, None, None) for a in "ab"]], TRADES, folder, 7)  # the files of the first run stay as they are, this one adds
    run(stream(), out, mark)
    names = [x.split()[0] for x in P.LEDGER.split(", ")]
    got = spark.read.parquet(out).select(names)
    want = P.replay(spark.createDataFrame(rows, TRADES), cfg, "sleeve").select(names)
    assert 0 < first < got.count() == want.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {"trade", "curve", "no_slot"} <= {r["kind"] for r in got.select("kind").distinct().collect()}


ATTEMPTS = "symbol string, at timestamp, error string"


def at(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def test_the_clock_releases_a_benched_symbol(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    stream = lambda: benching(spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(folder))
    events = lambda: {(r["symbol"], r["event"], r["at"].day, r["failures"]) for r in spark.read.parquet(out).collect()}
    rows = [("X", at(0), "boom"), ("X", at(1), "boom"), ("OK", at(1), None), ("Y", at(1), "a"), ("Y", at(2), None), ("Y", at(2, 1), "a"), ("Y", at(2, 2), "a"), ("X", at(2), "boom"), ("Z", at(0), "z"), ("Z", at(1), "z"), ("Z", at(2), "z")]
    pieces(spark, sorted(rows, key=lambda r: r[1]), ATTEMPTS, folder, 4)
    run(stream(), out, mark)
    assert events() == {("X", "benched", 3, 3), ("Z", "benched", 3, 3)}
    assert {r["symbol"] for r in resting(spark.read.parquet(out), at(4)).collect()} == {"X", "Z"}
    pieces(spark, [*[(None, None, None)] * 12, ("Z", at(5), "forced"), ("OK", at(9, 1), None)], ATTEMPTS, folder, 12)  # the clock moves past X's seven days
    run(stream(), out, mark)
    assert events() >= {("X", "released", 10, 3), ("Z", "rests longer", 6, 4)} and ("Z", "released", 13, 4) not in events()
    assert {r["symbol"] for r in resting(spark.read.parquet(out), at(9, 3)).collect()} == {"Z"}
    pieces(spark, [*[(None, None, None)] * 24, ("X", at(10), "again"), ("Z", at(10), None), ("OK", at(30), None)], ATTEMPTS, folder, 24)
    run(stream(), out, mark)
    assert events() >= {("X", "benched", 11, 4), ("Z", "released", 11, 0), ("X", "released", 18, 4)} and ("Z", "released", 13, 4) not in events()
    assert resting(spark.read.parquet(out), at(31)).count() == 0


def test_the_bench_agrees_with_the_manifest(spark, tmp_path):
    store, folder, out = PriceStore(spark, str(tmp_path / "db")), str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    none = spark.createDataFrame([], "symbol string, date date, open double, high double, low double, close double, volume double")
    for day in range(3):
        store.update(none, str(at(day).date()), spark.createDataFrame([("X", "boom")] + [("Y", "boom")] * (day > 0), "symbol string, error string"))
    pieces(spark, [("X", at(0), "boom"), ("X", at(1), "boom"), ("Y", at(1), "boom"), ("X", at(2), "boom"), ("Y", at(2), "boom")], ATTEMPTS, folder, 2)
    run(benching(spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(folder)), out, str(tmp_path / "mark"))
    for day in (3, 8, 9, 12):
        by_manifest = {r["symbol"] for r in store.manifest().where(benched(str(at(day).date()))).collect()}
        assert {r["symbol"] for r in resting(spark.read.parquet(out), at(day)).collect()} == by_manifest
