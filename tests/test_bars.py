"""The bar engine: analytic units, named gates, no look-ahead, messy inputs, exact dollars."""

import math
import zipfile
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline import report
from barline.functions.indicators import annotate, smoothed, with_bar
from barline.operators import bars as B
from barline.operators import outcomes as O
from barline.operators import portfolio as P
from barline.operators.detectors import SETUPS, setup
from barline.operators.plan import trade_plan
from barline.operators.store import PriceStore, counters, health
from barline.operators.strength import composite_rank
from barline.plans import scans
from barline.plans.config import AccountConfig, BreakoutConfig, TradeRules
from barline.sources import files, providers
from barline.streaming.refresh import bar_stream, refresh, thin, weekly

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def days(n, start=date(2021, 1, 4)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def series(symbol, closes, ranges=0.05, volumes=1e6, start=date(2021, 1, 4)):
    n = len(closes)
    r = ranges if isinstance(ranges, list) else [ranges] * n
    v = volumes if isinstance(volumes, list) else [volumes] * n
    rows = []
    for i, (d, c) in enumerate(zip(days(n, start), closes, strict=True)):
        o = closes[i - 1] if i else c
        rows.append((symbol, d, float(o), max(o, c) * (1 + r[i] / 2), min(o, c) * (1 - r[i] / 2), float(c), float(v[i])))
    return rows


def line(a, b, n):
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def coiled(symbol="COIL", last=None, volume=1e6):
    """Flat, a strong run, then a base that tightens under its high."""
    base = [33 - 1.6 * math.exp(-i / 9) * abs(math.sin(i / 2.2)) - 0.5 + i * 0.012 for i in range(26)]
    closes = [20.0 + 0.2 * math.sin(i / 5) for i in range(150)] + line(20.4, 33, 15) + base + ([last] if last else [])
    ranges = [0.04] * 150 + [0.06] * 15 + [0.05 - 0.0009 * i for i in range(26)] + ([0.02] if last else [])
    volumes = [volume] * 150 + [volume * 3] * 15 + [volume * 0.8] * 26 + ([volume * 4] if last else [])
    return series(symbol, closes, ranges, volumes)


def gap_up(symbol="GAP", gap=0.2, times=8.0):
    closes = [20 + 0.8 * math.sin(i / 7) for i in range(200)]
    rows = series(symbol, closes, 0.045, 5e5)
    o = closes[-1] * (1 + gap)
    return [*rows, (symbol, days(201)[-1], o, o * 1.05, o * 0.99, o * 1.045, 5e5 * times)]


def climax(symbol="PARA", crack=True):
    closes = [10.0] * 160 + [10 * (1 + 0.10) ** i for i in range(1, 16)]
    rows = series(symbol, closes, 0.10, [1e6] * 160 + [4e6] * 15)
    o = closes[-1]
    d = days(176)[-1]
    return [*rows, (symbol, d, o * 1.05, o * 1.12, o * 0.93, o * (0.94 if crack else 1.115), 5e6)]


@pytest.fixture(scope="module")
def market(spark):
    rows = coiled() + coiled("BRK", 34.3) + gap_up() + climax() + climax("RUN", False) + series("DOWN", line(60, 22, 200)) + coiled("THIN", 34.3, 1e3)
    return spark.createDataFrame(rows, BAR).cache()


def last(df, symbol):
    return B.last_bars(df.where(F.col("symbol") == symbol)).first()


def test_constant_range_and_moving_average(spark):
    df = annotate(spark.createDataFrame(series("A", [10.0] * 60, 0.05), BAR))
    row = last(df, "A")
    assert row["adr20"] == pytest.approx((1.025 / 0.975 - 1) * 100) and row["ma_slow"] == 10.0 and row["ma_mid_slope"] == 0.0
    assert df.where("ma_slow IS NULL").count() == 49 and df.where("adr20 IS NULL").count() == 9


def test_slope_is_percent_of_the_mean_per_bar(spark):
    row = last(annotate(spark.createDataFrame(series("A", line(100, 199, 100)), BAR)), "A")
    assert row["ma_mid_slope"] == pytest.approx(1.0 / (199 - 9.5 - 9.5) * 100)


def test_smoothing_equals_pandas(spark):
    closes = [20 + math.sin(i) for i in range(80)]
    got = smoothed(with_bar(spark.createDataFrame(series("A", closes), BAR)), {"e": ("close", 2 / 11, 10)}).orderBy("bar").toPandas()["e"]
    want = pd.Series(closes).ewm(span=10, adjust=False, min_periods=10).mean()
    assert got.isna().sum() == 9 and abs(got - want).max() < 1e-9


def test_ranks_average_ties_and_skip_missing(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 0.1, None), ("b", 1, 0.2, 0.3, None), ("c", 1, 0.2, None, None), ("d", 1, None, None, None)], "symbol string, date int, ret_1m double, ret_3m double, ret_6m double")
    got = {r["symbol"]: r for r in composite_rank(df).collect()}
    assert [round(got[s]["rank_1m"], 3) for s in "abc"] == [33.333, 83.333, 83.333] and got["d"]["rank_1m"] is None
    assert got["d"]["rs_rank"] is None and got["b"]["rs_rank"] == 100.0 and got["a"]["rs_rank"] == pytest.approx(100 / 3)


def test_setups_find_their_own_pattern(market):
    assert last(SETUPS["breakout"].scan(market, keep_rejects=True), "COIL")["state"] == "setup"
    brk = last(SETUPS["breakout"].scan(market, keep_rejects=True), "BRK")
    assert (brk["reject"], brk["state"]) == ("", "breakout") and brk["stop"] < brk["entry"] and brk["shares"] > 0 and 0 < brk["score"] <= 100
    assert last(SETUPS["ep"].scan(market, keep_rejects=True), "GAP")["reject"] == ""
    para = last(SETUPS["parabolic"].scan(market, keep_rejects=True), "PARA")
    assert para["reject"] == "" and para["stop"] > para["entry"] and para["target_2r"] < para["entry"]


@pytest.mark.parametrize(("name", "symbol", "reason"), [("breakout", "DOWN", "no_prior_move"), ("breakout", "THIN", "liquidity"), ("parabolic", "RUN", "no_weakness_yet"), ("ep", "COIL", "gap_too_small"), ("parabolic", "DOWN", "adr")])
def test_rejections_name_their_gate(market, name, symbol, reason):
    got = last(SETUPS[name].scan(market, keep_rejects=True), symbol)["reject"]
    assert got == reason or (reason == "adr" and got == "not_parabolic")


def test_strength_gate(market):
    cfg = SETUPS["breakout"].config("default", min_rs_rank=101.0)
    assert last(SETUPS["breakout"].scan(market, cfg, keep_rejects=True), "BRK")["reject"] == "weak_rs"
    assert SETUPS["breakout"].detect(annotate(market), cfg).where("reject = 'no_rs_data'").count() > 0


@pytest.mark.parametrize("name", list(SETUPS))
def test_no_look_ahead(market, name):
    whole = SETUPS[name].scan(market, keep_rejects=True)
    cut = market.where("date <= date '2021-09-10'")
    part = SETUPS[name].scan(cut, keep_rejects=True)
    key = lambda r: (r["symbol"], r["date"])
    a = sorted(whole.where("date <= date '2021-09-10'").collect(), key=key)
    assert [r.asDict() for r in a] == [r.asDict() for r in sorted(part.collect(), key=key)]


def test_scan_with_pruned_history_equals_the_full_one(market):
    full = {r["symbol"]: r for r in B.last_bars(SETUPS["breakout"].scan(market, keep_rejects=True)).where("passed").collect()}
    got = {r["symbol"]: r for r in scans.scan(market, "breakout").collect()}
    assert set(got) == set(full) and all(got[s]["score"] == full[s]["score"] and got[s]["bar"] == full[s]["bar"] for s in got)


@pytest.mark.parametrize(("entry", "raw", "adr", "direction", "stop", "two_r"), [(100, 97, 5, 1, 97, 106), (100, 80, 5, 1, 95, 110), (100, 130, 6, -1, 106, 88)])
def test_trade_plans(spark, entry, raw, adr, direction, stop, two_r):
    row = trade_plan(spark.range(1), F.lit(float(entry)), F.lit(float(raw)), F.lit(float(adr)), direction, BreakoutConfig()).first()
    assert (row["stop"], row["target_2r"]) == (stop, two_r) and row["stop_capped_by_adr"] == (stop != raw)


def test_no_risk_no_shares(spark):
    row = trade_plan(spark.range(1), F.lit(100.0), F.lit(101.0), F.lit(5.0), 1, BreakoutConfig()).first()
    assert row["shares"] == 0 and row["risk_pct"] is None


def test_cooldown(spark):
    df = spark.createDataFrame([("A", b) for b in (100, 101, 102, 130, 131)], "symbol string, bar int")
    assert sorted(r["bar"] for r in O.dedupe_signals(df, 10).collect()) == [100, 130]


def simulate(spark, path, state="breakout", direction=1, rules=None):
    rows = [("A", i, date(2024, 1, 1) + timedelta(days=i), *map(float, x), 0.0, 90.0) for i, x in enumerate(path)]
    bars = spark.createDataFrame(rows, "symbol string, bar int, date date, open double, high double, low double, close double, ma_fast double, ma_mid double")
    signal = spark.createDataFrame([("A", 0, state, direction, 100.0, 5.0)], "symbol string, bar int, state string, direction int, entry double, adr20 double")
    return O.simulate_trades(signal, bars, rules).first()


def test_stopped_at_the_open_of_a_gap(spark):
    r = simulate(spark, [(100, 101, 95, 100), (92, 93, 91, 92), (90, 90, 90, 90)])
    assert (r["outcome"], r["r_multiple"], r["days_held"]) == ("stopped", -1.6, 1)


def test_partial_then_breakeven(spark):
    r = simulate(spark, [(100, 101, 95, 100), (105, 116, 104, 114), (110, 111, 99, 100), (100, 100, 100, 100)])
    assert (r["outcome"], r["r_multiple"], r["sim_stop"]) == ("trail_stop", 1.5, 100.0)


def test_trail_on_the_average_and_no_trigger(spark):
    r = simulate(spark, [(100, 101, 99, 100), *[(101, 102, 100.5, 101.5)] * 4, (101, 101, 100.2, 89)])
    assert r["outcome"] == "ma_trail" and r["days_held"] == 5
    assert simulate(spark, [(98, 99, 97, 98)] * 5, "setup")["outcome"] == "no_trigger"
    short = simulate(spark, [(100, 105, 99, 100), (99, 100, 80, 82), (82, 83, 81, 82)], "short", -1)
    assert short["r_multiple"] > 2


def test_summary(spark):
    df = spark.createDataFrame([("ma_trail", 4.0), ("stopped", -1.0), ("stopped", -1.0), ("no_trigger", None)], "outcome string, r_multiple double")
    r = O.summarise(df).first()
    assert (r["signals"], r["trades"], r["total_r"], r["no_trigger"], r["median_r"]) == (4, 3, 2.0, 1, -1.0)
    assert O.summarise(df.where("false")).first()["trades"] == 0


SIGNAL = "symbol string, fill_date date, exit_date date, fill double, stop double, r_multiple double, score double"


def book(spark, rows, **cfg):
    cfg = AccountConfig(**{"risk_pct": 0.01, "max_position_pct": 1.0, **cfg})
    return P.replay(spark.createDataFrame(rows, SIGNAL), cfg), cfg


def d(n):
    return date(2024, 1, 1) + timedelta(days=n)


def test_exact_dollars(spark):
    ledger, cfg = book(spark, [("A", d(0), d(4), 100.0, 95.0, 2.0, 50.0)])
    t = ledger.where("kind = 'trade'").first()
    assert (t["shares"], t["pnl"], t["equity"], t["days_held"]) == (200.0, 2000.0, 102_000.0, 4)
    s = P.account_stats(ledger, cfg).first()
    assert (s["final_equity"], s["total_return"], s["profit_factor"]) == (102_000.0, 0.02, None)


def test_slots_capital_and_order(spark):
    rows = [("A", d(0), d(5), 100.0, 95.0, 1.0, 10.0), ("B", d(0), d(5), 100.0, 95.0, -1.0, 90.0), ("C", d(0), d(3), 100.0, 95.0, 1.0, 50.0), ("D", d(1), None, 100.0, 95.0, 1.0, 1.0)]
    ledger, _ = book(spark, rows, max_positions=2)
    assert {r["symbol"] for r in ledger.where("kind = 'trade'").collect()} == {"B", "C"} and ledger.where("kind = 'no_slot'").count() == 1
    tight, _ = book(spark, rows, max_exposure_pct=0.2)
    assert tight.where("kind = 'no_capital'").count() == 2
    curve = P.equity_curve(ledger).orderBy("date").collect()
    assert curve[-1]["drawdown"] < 0 and curve[-1]["open_positions"] == 0


def test_messy_bars(spark):
    rows = [("A", "2024-01-02", 10.0, 9.0, 11.0, 10.5, 5.0, 1), ("A", "2024-01-02", 20.0, 21.0, 19.0, 20.0, 5.0, 2), ("A", "2024-01-03", 10.0, 11.0, 9.0, float("nan"), 5.0, 3), ("A", "bad", 1.0, 1.0, 1.0, 1.0, 1.0, 4), ("A", "20240104", 10.0, 9.0, 9.5, 10.5, 0.0, 5), ("A", "2024-01-05", -1.0, 1.0, 1.0, 1.0, 1.0, 6)]
    df = spark.createDataFrame(rows, "symbol string, ` Date ` string, OPEN double, High double, low double, Close double, volume double, ord int").withColumn("dividends", F.lit(1))
    got = {str(r["date"]): r for r in B.normalized(df, "ord").collect()}
    assert set(got) == {"2024-01-02", "2024-01-04"} and got["2024-01-02"]["close"] == 20.0
    assert (got["2024-01-04"]["high"], got["2024-01-04"]["low"], got["2024-01-04"]["volume"]) == (10.5, 9.5, 0.0)
    with pytest.raises(ValueError, match="volume"):
        B.normalized(df.drop("volume"))


def test_adjusted_close(spark):
    df = spark.createDataFrame([("A", "2024-01-02", 10.0, 12.0, 8.0, 10.0, 100.0, 5.0), ("A", "2024-01-03", 10.0, 12.0, 8.0, 10.0, 100.0, 0.0)], "symbol string, date string, open double, high double, low double, close double, volume double, `Adj Close` double")
    a, b = B.normalized(df).orderBy("date").collect()
    assert (a["open"], a["high"], a["close"], a["volume"]) == (5.0, 6.0, 5.0, 100.0) and b["close"] == 10.0
    only = spark.createDataFrame([("A", "2024-01-02", 5.0, 6.0, 4.0, 100.0, 5.5)], "symbol string, date string, open double, high double, low double, volume double, adjclose double")
    assert B.normalized(only).first()["close"] == 5.5


def test_vendor_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "aaa.us.txt").write_text("<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n20240102,1,2,0.5,1.5,10\n")
    (tmp_path / "in" / "long.csv").write_text("Ticker;Trade Date;O;H;L;Last;Volume\nbbb;2024-01-02;1;2;0.5;1.5;10\nccc;2024-01-02;1;2;0.5;1.5;10\n")
    (tmp_path / "in" / "broken.csv").write_text("date,foo,bar\n2024-01-02,1,2\n")
    with zipfile.ZipFile(tmp_path / "in" / "some.zip", "w") as z:
        z.writestr("x/DDD.csv", "date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n")
    bars, left_out = files.ingest(spark, str(tmp_path / "in"))
    assert {r["symbol"] for r in bars.collect()} == {"AAA", "BBB", "CCC", "DDD"}
    assert "missing columns" in left_out.first()["problem"] and left_out.count() == 1


def test_csv_directory_and_universe(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "Abc.csv").write_text("When,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nx,1,1,1,1,1\n")
    assert [r["symbol"] for r in files.csv_directory(spark, str(tmp_path / "csv")).collect()] == ["ABC"]
    got = files.universe(spark, ["aapl, MSFT # note", "aapl brk.b TOO_LONG_NAME_X"]).orderBy("ord").collect()
    assert [r["symbol"] for r in got] == ["AAPL", "MSFT", "BRK.B"]
    (tmp_path / "list.txt").write_text("Symbol|Test Issue|ETF\nAAA|N|N\nBBB|Y|N\nCCC|N|Y\nDD.A|N|N\n")
    assert [r["symbol"] for r in files.listings(spark, str(tmp_path / "list.txt")).collect()] == ["AAA"]


def test_providers(spark, monkeypatch):
    assert list(providers.parse_csv("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n"))[0][1:] == (1, 2, 0.5, 1.5, 10)
    with pytest.raises(providers.ProviderError):
        list(providers.parse_csv("<html>"))
    tries = []
    assert providers.with_retry(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else [7]), sleep=lambda _: None) == [7]
    bars, failed = providers.fetch(spark, "tiingo", ["A", "B"], date(2024, 1, 1), date(2024, 2, 1), retry_pause=0)
    assert bars.count() == 0 and {r["symbol"] for r in failed.collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        providers.fetch(spark, "nobody", [], date(2024, 1, 1), date(2024, 2, 1))


def frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def actions(df):
    return {r["symbol"]: r["action"] for r in df.collect()}


def test_store_updates(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "db"))
    a = series("A", line(10, 20, 300))
    assert actions(store.update(frame(spark, a[:200]), "2021-12-01")) == {"A": "created"}
    assert actions(store.update(frame(spark, a[190:210]), "2021-12-02")) == {"A": "appended"}
    assert actions(store.update(frame(spark, a[195:210]), "2021-12-03")) == {"A": "unchanged"}
    assert store.load().count() == 210
    half = [(s, d, o / 2, h / 2, lo / 2, c / 2, v) for s, d, o, h, lo, c, v in a[:215]]
    failed = spark.createDataFrame([("Z", "boom")], "symbol string, error string")
    done = store.update(frame(spark, half[200:]), "2021-12-06", failed, frame(spark, half))
    assert actions(done) == {"A": "readjusted", "Z": "failed"} and {r["action"]: r["symbols"] for r in counters(done).collect()} == {"readjusted": 1, "failed": 1}
    assert store.load().count() == 215 and store.load().agg(F.max("close")).first()[0] < 10
    for day in ("2021-12-07", "2021-12-08"):
        store.update(frame(spark, half[205:]), day, failed)
    z = store.manifest().where("symbol = 'Z'").first()
    assert z["failures"] == 3 and z["rows"] is None
    names = spark.createDataFrame([("A",), ("Z",), ("N",)], "symbol string")
    assert {r["symbol"] for r in store.wanted(names, "2021-12-09").collect()} == {"A", "N"}
    assert {r["symbol"] for r in store.wanted(names, "2021-12-09", force=True).collect()} == {"A", "N", "Z"}
    c = store.coverage().first()
    assert (c["symbols_on_disk"], c["symbols_tracked"], c["symbols_healthy"], c["total_rows"]) == (1, 2, 1, 215)
    assert store.load("2021-03-01", "2021-03-05").count() == 5


def test_drift_tolerates_noise(spark):
    a = series("A", line(10, 20, 20))
    noisy = [(s, d, o, h, lo, c * 1.0001, v) for s, d, o, h, lo, c, v in a]
    assert not B.drift(frame(spark, a), frame(spark, noisy)).first()["readjusted"]


def test_health():
    assert health({"latest_date": None}, {}, date(2024, 1, 9)) == ["no bars are stored"]
    assert len(health({"latest_date": date(2024, 1, 1)}, {"failed": 6, "appended": 4}, date(2024, 1, 9))) == 2
    assert health({"latest_date": date(2024, 1, 8)}, {"failed": 1, "appended": 9}, date(2024, 1, 9)) == []


def test_store_leaves_no_staging_and_survives_a_damaged_manifest(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "db"))
    a = series("A", line(10, 20, 300))
    store.update(frame(spark, a[:200]), "2021-12-01")
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "db" / "prices").glob("*/year=2021/*.parquet")}
    store.update(frame(spark, a[270:]), "2022-03-01")  # bars of 2022 only
    assert untouched and untouched == {p: p.stat().st_mtime_ns for p in (tmp_path / "db" / "prices").glob("*/year=2021/*.parquet")}
    assert not list((tmp_path / "db" / "staging").iterdir()) and store.load().count() == 230
    versions = sorted((tmp_path / "db" / "manifest").iterdir())
    assert len(versions) == 2 and store.manifest().first()["rows"] == 230
    for f in versions[-1].glob("*.parquet"):
        f.write_bytes(b"broken")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert store.manifest().first()["rows"] == 200
    (versions[0] / "_SUCCESS").unlink()
    assert store.manifest().count() == 0


def test_streaming_refresh_and_cooldown(spark, tmp_path):
    a = series("A", line(10, 20, 60))
    for i in range(3):
        frame(spark, a[20 * i : 20 * i + 20]).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    store = PriceStore(spark, str(tmp_path / "db"))
    stream = bar_stream(spark, str(tmp_path / "in" / "*"), 1)
    refresh(stream, store, "2021-06-01", str(tmp_path / "cp")).awaitTermination()
    assert store.load().count() == 60
    spark.createDataFrame([("A", b, date(2024, 1, 1)) for b in (100, 101, 102, 130, 131)], "symbol string, bar long, date date").coalesce(1).write.parquet(str(tmp_path / "hits"))
    hits = spark.readStream.schema("symbol string, bar long, date date").parquet(str(tmp_path / "hits"))
    q = thin(hits, 10).writeStream.format("memory").queryName("thinned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert sorted(r["bar"] for r in spark.table("thinned").collect()) == [100, 130]
    assert weekly(stream).isStreaming


def test_streaming_refetches_rewritten_histories_and_rests_benched_symbols(spark, tmp_path):
    a = series("A", line(10, 20, 60))
    half = [(s, d, o / 2, h / 2, lo / 2, c / 2, v) for s, d, o, h, lo, c, v in a]
    store = PriceStore(spark, str(tmp_path / "db"))
    store.update(frame(spark, a[:50]), "2021-06-01")
    failed = spark.createDataFrame([("Z", "boom")], "symbol string, error string")
    for day in ("2021-06-02", "2021-06-03", "2021-06-04"):
        store.update(frame(spark, a[40:50]), day, failed)
    frame(spark, half[45:] + series("Z", line(1, 2, 20))).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    asked = []

    def history(symbols):
        asked.extend(r["symbol"] for r in symbols.collect())
        return frame(spark, half)

    refresh(bar_stream(spark, str(tmp_path / "in" / "*")), store, "2021-06-05", str(tmp_path / "cp"), history).awaitTermination()
    assert asked == ["A"] and store.load().count() == 60 and store.load().agg(F.max("close")).first()[0] <= 10


def test_the_later_file_wins_in_a_stream(spark, tmp_path):
    import os

    a = series("A", line(10, 20, 5))
    later = [(s, d, o * 1.0001, h * 1.0001, lo * 1.0001, c * 1.0001, 7.0) for s, d, o, h, lo, c, v in a]
    for name, rows, age in (("p0", later, 0), ("p1", a, 1000)):  # the file listed last is the older one
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        for f in (tmp_path / "in" / name).glob("*.parquet"):
            os.utime(f, (f.stat().st_mtime - age, f.stat().st_mtime - age))
    store = PriceStore(spark, str(tmp_path / "db"))
    refresh(bar_stream(spark, str(tmp_path / "in" / "*")), store, "2021-06-01", str(tmp_path / "cp")).awaitTermination()
    assert {r["volume"] for r in store.load().collect()} == {7.0}


def test_page_is_self_contained_and_escaped(spark):
    df = spark.createDataFrame([("<A&B>", "setup", 71.25, 0.051), ("C", "breakout", None, None)], "symbol string, state string, score double, risk_pct double")
    html = report.page(df, ["symbol", "state", "score", "risk_pct", "absent"], "T <x>", coverage={"symbols_healthy": 3, "total_rows": 1000}, problems=["bad & old"])
    assert "&lt;A&amp;B&gt;" in html and "5.1%" in html and "bad &amp; old" in html and "–" in html and "http" not in html and "<A&B>" not in html
    assert "Best score<b>71.25</b>" in html and "Bars of" not in html
    dated = report.page(df.withColumn("date", F.expr("if(state = 'setup', DATE'2024-01-02', DATE'2024-01-05')")), ["symbol"])
    assert "Bars of<b>2024-01-05</b>from 2024-01-02" in dated and "Best score" not in report.page(df.where("score IS NULL"), ["symbol"])


def test_settings():
    from barline.cli import chosen, parser, years_before
    from barline.plans.config import settings

    assert settings(TradeRules, {"max_hold": 5, "other": 1}, lenient=True).max_hold == 5
    for bad in ({"nope": 1}, {"min_price": "five"}, {"require_ma_stack": 1}, {"move_lookbacks": 3}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            settings(BreakoutConfig(), bad)
    assert settings(BreakoutConfig(), {"move_lookbacks": [[21, 0.5]], "min_rs_rank": 90}).move_lookbacks == ((21, 0.5),)
    with pytest.raises(ValueError):
        setup("nope")
    a = parser().parse_args(["scan", "--setup", "ep", "--min-price", "7", "--max-base-len", "9", "--set", "min_gap=0.3"])
    assert (chosen(a).min_price, chosen(a).min_gap) == (7.0, 0.3) and years_before(date(2024, 2, 29), 1) == date(2023, 2, 28)


def csvs(folder, rows, end=None):
    """A TICKER.csv for each symbol of rows, moved so that the last bar is at `end`."""
    folder.mkdir(parents=True, exist_ok=True)
    for symbol in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == symbol]
        shift = (end or date.today()) - own[-1][1]
        lines = ["Date,Open,High,Low,Close,Volume", *(f"{r[1] + shift},{','.join(f'{x:.4f}' for x in r[2:])}" for r in own)]
        (folder / f"{symbol}.csv").write_text("\n".join(lines))


def run_cli(capsys, *args):
    import json

    from barline.cli import main

    capsys.readouterr()
    code = main(list(args))
    said = capsys.readouterr()
    told = [x for x in said.out.splitlines() if x.startswith("{")]
    return code, json.loads(told[-1]) if told else {}, said.err


def test_daily_refreshes_scans_draws_and_reports(spark, tmp_path, capsys):
    rows = coiled() + coiled("BRK", 34.3) + series("DOWN", line(60, 22, 200))
    csvs(tmp_path / "csv", rows)
    base = ["daily", "--csv-dir", str(tmp_path / "csv"), "--repo", str(tmp_path / "db"), "--out", str(tmp_path / "out"), "--universe", "COIL,BRK,DOWN"]
    code, told, _ = run_cli(capsys, *base, "--charts", "3", "--contact-sheet")
    assert code == 0 and told["problems"] == [] and told["universe"] == 3 and told["actions"] == {"created": 3} and told["elapsed_sec"] > 0
    pictures = list((tmp_path / "out" / "charts").rglob("*_*-*.svg"))
    assert told["charts"] == len(pictures) == told["candidates"] >= 1 and (pictures[0].parent / "contact_sheet.svg").is_file()
    page = open(told["report"]).read()
    assert "data:image/svg+xml;base64," in page and page == open(told["latest"]).read()
    found = {r["symbol"] for r in spark.read.option("header", True).csv(told["csv"]).collect()}
    assert "DOWN" not in found and found <= {"COIL", "BRK"}
    code, told, _ = run_cli(capsys, *base, "--skip-update", "--min-score", "99.9")
    assert (code, told["candidates"]) == (0, 0) and "No candidates passed the filters" in open(told["report"]).read()
    csvs(tmp_path / "old", rows, date.today() - timedelta(days=30))
    stale = ["daily", "--csv-dir", str(tmp_path / "old"), "--repo", str(tmp_path / "db2"), "--out", str(tmp_path / "out2"), "--universe", "COIL,BRK,NONE1,NONE2,NONE3"]
    code, told, _ = run_cli(capsys, *stale)
    assert code == 1 and len(told["problems"]) == 2 and any("days old" in p for p in told["problems"]) and any("fetches failed" in p for p in told["problems"])


def test_commands_and_their_exit_codes(spark, tmp_path, capsys):
    csvs(tmp_path / "csv", coiled() + coiled("BRK", 34.3))
    folder = ["--csv-dir", str(tmp_path / "csv"), "--out", str(tmp_path / "out")]
    code, told, _ = run_cli(capsys, "scan", *folder, "--charts", "1", "--preset", "relaxed")
    assert code == 0 and told["charts"] == 1 and date.today().isoformat() in told["csv"]
    code, told, _ = run_cli(capsys, "scan", *folder, "--universe", "BRK", "--preset", "strict")  # one symbol: no strength to rank
    assert code == 0
    code, told, _ = run_cli(capsys, "backtest", *folder, "--charts", "2", "--years", "1", "--set", "max_base_len=59")
    assert code == 0 and list((tmp_path / "out").glob("equity_*.svg")) or told["signals"] == 0
    code, told, _ = run_cli(capsys, "explain", *folder, "--symbol", "brk", "--chart")
    assert code == 0 and told["symbol"] == "BRK" and list((tmp_path / "out" / "charts").glob("BRK_*.svg"))
    for bad in (["explain", *folder, "--symbol", "NONE"], ["scan", "--out", str(tmp_path)], ["scan", *folder, "--set", "nope=1"], ["daily", *folder]):
        code, _, err = run_cli(capsys, *bad)
        assert code == 2 and err.strip().splitlines()[-1].startswith("data error: ")


def test_headers_of_their_own(spark, tmp_path):
    at = tmp_path / "csv"
    at.mkdir()
    (at / "0BROKEN.csv").write_text("date,foo,bar\n2024-01-02,1,2\n")
    (at / "PLAIN.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,50,52,49,51,10\n")
    (at / "OTHER.csv").write_text("\ufeff\"Date\",Close,Open,High,Low,Volume,Dividends\r\n2024-01-02,50,51,52,49,7,0\r\n2024-01-02,50.5,51,52,49,8,0\r\n")
    (at / "ADJ.csv").write_text(" Volume , Adj Close ,LOW,HIGH,OPEN,CLOSE,timestamp\n100,5,8,12,10,10,2024-01-02\n")
    (at / "ONLYADJ.csv").write_text("When,open,high,low,adj_close,volume\n2024-01-02,5,6,4,5.5,100\n")
    (at / "EMPTY.csv").write_text("date,open,high,low,close,volume\n")
    (at / "NOTHING.csv").write_text("")
    bars, left_out = files.csv_folder(spark, str(at))
    got = {r["symbol"]: tuple(r)[2:] for r in bars.collect()}
    assert got == {"PLAIN": (50, 52, 49, 51, 10), "OTHER": (51, 52, 49, 50.5, 8), "ADJ": (5, 6, 4, 5, 100), "ONLYADJ": (5, 6, 4, 5.5, 100)}
    told = {r["file"]: r["problem"] for r in left_out.collect()}
    assert set(told) == {"0BROKEN.csv", "EMPTY.csv"} and "volume" in told["0BROKEN.csv"]


def test_cache_keeps_fresh_bars_and_falls_back_on_stale_ones(spark, tmp_path, monkeypatch):
    from datetime import datetime, timezone

    from barline.sources import cache

    calls, bad = [], set()

    def fetch(spark, provider, symbols, start, end, **how):
        calls.append(sorted(symbols))
        rows = [r for s in symbols if s not in bad for r in series(s, line(10, 20, 30))]
        return frame(spark, rows), spark.createDataFrame([(s, "down") for s in symbols if s in bad], "symbol string, error string")

    monkeypatch.setattr(cache.providers, "fetch", fetch)
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    store = cache.CachedBars(spark, str(tmp_path), "stooq")
    window = (date(2021, 1, 1), date(2021, 1, 15))
    bars, failed = store.get(["A", "b"], *window, now=at)
    assert bars.groupBy("symbol").count().count() == 2 and bars.count() == 20 and failed.isEmpty() and calls == [["A", "B"]]
    store.get(["A", "C"], *window, now=at + timedelta(hours=1))
    assert calls[1:] == [["C"]]
    bad |= {"A", "D"}
    heard = []
    bars, failed = store.get(["A", "B", "D"], *window, now=at + timedelta(hours=13), on_error=lambda s, e: heard.append((s, e)))
    assert calls[2] == ["A", "B", "D"] and sorted(heard) == [("A", "down"), ("D", "down")]
    assert {r["symbol"] for r in bars.collect()} == {"A", "B"} and [tuple(r) for r in failed.collect()] == [("D", "down")]
    store.get(["B"], *window, now=at + timedelta(hours=13), refresh=True)
    assert calls[3] == ["B"]
    offline = cache.CachedBars(spark, str(tmp_path), "stooq", offline=True)
    bars, failed = offline.get(["A", "E"], *window, now=at + timedelta(days=9))
    assert bars.count() == 10 and failed.first()["symbol"] == "E" and len(calls) == 4
    with pytest.raises(ValueError, match="nobody"):
        cache.CachedBars(spark, str(tmp_path), "nobody")


def test_ranks_of_a_whole_universe_equal_those_of_one_window(spark):
    from barline.operators.strength import percent_rank_of, percent_ranks_of_all

    v = [None, None, 0.1, 0.1, -0.9, 3.5, 0.1000001, 80.0, -0.2, 0.0, 0.0, 0.0]
    w = [7.0, None, 7.0, 55.0, None, 55.0, 99.9, 0.0, 12.5, 12.5, 12.5, 100.0]
    df = spark.createDataFrame([(str(i), *x, None) for i, x in enumerate(zip(v, w, strict=True))], "symbol string, v double, w double, gone double")
    kept = lambda d: sorted(map(tuple, d.select("symbol", "v", "w", "gone", "p", "q", "r").collect()))
    one = df.withColumn("_all", F.lit(0)).withColumns({"p": percent_rank_of("v", "_all"), "q": percent_rank_of("w", "_all"), "r": percent_rank_of("gone", "_all")})
    ranked = percent_ranks_of_all(df, {"p": ("v", 1.0), "q": ("w", 100.0), "r": ("gone", 1.0)})
    assert kept(ranked) == kept(one) and ranked.columns == [*df.columns, "p", "q", "r"]
    assert percent_ranks_of_all(df.where("false"), {"p": ("v", 1.0)}).count() == 0


def test_plans_end_to_end(market):
    signals = scans.sweep(B.with_history(market, 150).unionByName(market.where("false")), "breakout", cooldown=3)
    assert {"fwd_5d", "outcome", "rs_rank", "r_multiple"} <= set(signals.columns)
    row = scans.explain(market, "breakout", "BRK").first()
    assert row["reject"] == "" and scans.explain(market, "breakout", "BRK", "2021-03-01").first()["reject"] == "warmup"
    assert scans.around(market, B.last_bars(with_bar(market)).select("symbol", "bar"), 5, 5).groupBy("symbol").count().first()["count"] == 6


def test_least_of_bars_back(spark):
    """Two-level minima are those of one frame, whatever its length."""
    from barline.operators.detectors import _least_back

    rows = [("A", i, float((i * 37) % 29)) for i in range(70)]
    df = spark.createDataFrame(rows, "symbol string, bar int, x double")
    for first, last in ((0, 90), (1, 60), (1, 4), (1, 1), (0, 12)):
        for r in _least_back(df, "m", F.struct("x", "bar"), first, last).collect():
            seen = [(x, b) for _, b, x in rows if r.bar - last <= b <= r.bar - first]
            assert (tuple(r.m) if r.m else None) == (min(seen) if seen else None)


def test_rounding_of_arrays_is_that_of_columns(spark):
    """Half up by decimal digits, ties and large values included."""
    import numpy as np

    from barline.functions.columns import measure
    from barline.functions.series import rounded

    x = [0.5e-9, 1.5e-9, 2.5e-9, -2.5e-9, -0.5e-9, 1.0000000005, 0.1 + 0.2, 1234.5678901235, 1e15 + 0.3, 4503599627370497.5, -0.0, -1e-12, 0.1234567895, 98765.43215]
    for places in (4, 9):
        want = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", measure(F.col("x"), places).alias("y")).orderBy("i").collect()]
        assert rounded(np.array(x), places).tolist() == want


def test_one_pass_takes_rows_as_they_come(spark):
    """Rows in any order, missing values, columns of any name."""
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), None if i == 30 else 10.0 + i, s + str(i)) for s in ("A", "B") for i in range(70)]
    df = spark.createDataFrame([(s, d, c, c, c, c, 100.0, n) for s, d, c, n in rows[::-1]], "symbol string, date date, open double, high double, low double, close double, volume double, `a b` string")
    got = {(r.symbol, r.bar): r for r in annotate(df).collect()}
    assert len(got) == 140 and all(r["a b"] == s + str(b) and r.date == date(2020, 1, 1) + timedelta(days=b) for (s, b), r in got.items())
    assert got["A", 29].ma_fast == 34.5 and got["A", 30].ma_fast is None and got["B", 40].ma_fast == 45.5 and got["B", 51].ret_1m is None
    assert got["A", 39].vol_avg20 == 100.0 and got["A", 8].vol_avg20 is None and got["A", 50].ma_mid_slope is None and got["A", 69].ma_mid_slope == round(100 / 60, 9)  # the mean of 20 averages


def test_signals_are_found_once(spark):
    """One pass over a symbol's bars finds the signals, one gives the bars of their trades; no window runs over measures of all bars."""
    from barline import queries as Q

    plan = Q.QUERIES["simulate_trades_breakout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _m#") == 2 and "collect_list" not in plan


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Bars and ranks are dealt to as many tasks as the rows ask for, not to a fixed number."""
    import re

    from barline import queries as Q

    monkeypatch.setattr(B, "ROWS", 500)
    where = "/root/testdata/sf0.001"
    parts = B.parts_for(spark.read.parquet(f"{where}/lineitem.parquet"))
    assert parts >= 12
    for name, least in (("rs_composite", 2), ("rs_horizon_rank", 2), ("returns_1m_3m_6m", 1)):
        plan = Q.QUERIES[name](spark, where)._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"hashpartitioning\((?:date|l_suppkey)#\d+, (\d+)\)", plan)
        assert len(found) >= least and set(found) == {str(parts)}, name
    assert Q.annotated(spark, where, newest=True, only=("ret_1m",)).count() == Q.bars(spark, where).select("symbol").distinct().count()
