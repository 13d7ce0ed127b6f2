"""Archives by member, and a provider as a stream with an offset per symbol."""

import threading
import zipfile
from collections import Counter
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from barline.functions.indicators import annotate
from barline.operators import bars as B
from barline.operators.detectors import SETUPS
from barline.operators.store import PriceStore
from barline.plans.config import settings
from barline.sources import archives, files, providers, synthetic

HEAD = "Date,Open,High,Low,Close,Volume\n"


def lines(n, start=date(2020, 1, 1)):
    return "".join(f"{start + timedelta(days=i)},{10 + i % 7},{12 + i % 7},9,{11 + i % 7},{1000 + i}\n" for i in range(n))


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "all.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(8):
            z.writestr(f"x/S{i}.csv", HEAD + lines(3000))
        z.writestr("stored.txt", HEAD + lines(5), zipfile.ZIP_STORED)
        z.writestr("odd.csv", HEAD + lines(5), zipfile.ZIP_LZMA)
        z.writestr("notes.md", "no table")
    spark.dataSource.register(archives.VendorFiles)
    rows = spark.read.format("vendor_files").option("paths", f'["{tmp_path}"]').option("partition_bytes", 40_000).load()
    assert rows.rdd.getNumPartitions() >= 4
    got = Counter(r["member"] for r in rows.where("problem IS NULL").collect())
    assert got == Counter({f"x/S{i}.csv": 3000 for i in range(8)} | {"stored.txt": 5})
    assert [(r["member"], r["problem"]) for r in rows.where("problem IS NOT NULL").collect()] == [("odd.csv", "damaged: compressed by method 14")]
    bars, left_out = files.ingest(spark, f"file://{path}")
    assert bars.count() == 8 * 3000 + 5 and left_out.count() == 1
    assert files.vendor_rows(spark, f"{tmp_path}/a*.zip").count() == bars.count() + 1


def test_damaged_archives_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("GOOD.csv", HEAD + lines(3))
        z.writestr("BAD.csv", HEAD + lines(300))
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"1299\n", raw.index(b"BAD.csv"))
    raw[at] = ord("9")
    (tmp_path / "a.zip").write_bytes(raw)
    (tmp_path / "b.zip").write_bytes(b"not an archive")
    (tmp_path / "empty.csv").write_text("")
    told = {r["member"]: r["problem"] for r in files.vendor_rows(spark, str(tmp_path)).where("problem IS NOT NULL").collect()}
    assert told["BAD.csv"] == "damaged: bad checksum" and told["b.zip"] == "damaged: not an archive" and "missing columns" in told["empty.csv"] and "GOOD.csv" not in told


def test_members_share_partitions_up_to_a_size():
    each = [archives.Member("p", str(i), s) for i, s in enumerate([5, 5, 30, 1, 1, 9])]
    assert [[m.name for m in x] for x in archives.dealt(iter(each), 10)] == [["0", "1"], ["2"], ["3", "4"], ["5"]]


@pytest.fixture
def exchange():
    """An HTTP provider that keeps count of the days it is asked for; `broken` symbols fail."""
    asked, broken = Counter(), set()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            q, symbol = {k: v[0] for k, v in parse_qs(at.query).items()}, at.path.strip("/")
            if symbol in broken:
                self.send_error(500)
                return
            start, end = date.fromisoformat(q["start"]), date.fromisoformat(q["end"])
            n = (end - start).days + 1
            asked.update((symbol, start + timedelta(days=i)) for i in range(n))
            body = (HEAD + lines(n, start)).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{symbol}}?start={{start}}&end={{end}}", asked, broken
    server.shutdown()


def test_a_provider_stream_asks_for_each_day_once(spark, tmp_path, exchange):
    url, asked, broken = exchange
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(symbols, today, sink="parquet", **options):
        stream = providers.bars_stream(spark, "url", symbols, date(2024, 1, 1), url=url, today=today, per_partition=1, retry_pause=0, **options)
        q = stream.writeStream.format(sink).option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()

    run(["A", "B"], "2024-01-05")
    assert asked == Counter((s, date(2024, 1, 1) + timedelta(days=i)) for s in "AB" for i in range(5))
    run(["A", "B", "C"], "2024-01-08")  # a symbol more, three days later
    run(["A", "B", "C"], "2024-01-08")  # nothing new
    days = {"A": 8, "B": 8, "C": 8}
    want = Counter((s, date(2024, 1, 1) + timedelta(days=i)) for s, n in days.items() for i in range(n))
    assert asked == want
    broken.add("B")
    with pytest.raises(Exception, match="HTTP Error 500"):
        run(["A", "B", "C"], "2024-01-09", failures="raise")
    broken.clear()
    run(["A", "B", "C"], "2024-01-09", failures="raise")  # the days of the failed batch are asked for again
    broken.add("C")
    run(["A", "B", "C"], "2024-01-10")
    rows = spark.read.parquet(out).collect()
    good = Counter((r["symbol"], r["date"]) for r in rows if r["error"] is None)
    days = {"A": 10, "B": 10, "C": 9}
    assert good == Counter((s, date(2024, 1, 1) + timedelta(days=i)) for s, n in days.items() for i in range(n))
    assert [(r["symbol"], r["date"]) for r in rows if r["error"]] == [("C", date(2024, 1, 10))]


def test_providers_by_address(spark, exchange):
    url, _, broken = exchange
    broken.add("X")
    bars, failed = providers.fetch(spark, "url", ["A", "X"], date(2024, 1, 1), date(2024, 1, 3), url=url, retry_pause=0)
    assert bars.count() == 3 and [r["symbol"] for r in failed.collect()] == ["X"]


def test_update_reads_every_file_under_its_own_header(spark, tmp_path, capsys):
    from .test_bars import run_cli

    (tmp_path / "csv").mkdir()
    day = date.today() - timedelta(days=1)
    (tmp_path / "csv" / "AAA.csv").write_text(f"Date,Open,High,Low,Close,Volume\n{day},10,12,9,11,100\n")
    (tmp_path / "csv" / "BBB.csv").write_text(f"volume,close,low,high,open,Datetime\n100,11,9,12,10,{day}\n")
    (tmp_path / "csv" / "CCC.csv").write_text(f"Date,Open,High,Low,Close,Adj Close,Volume\n{day},10,12,9,11,5.5,100\n")
    (tmp_path / "csv" / "DDD.csv").write_text(f"Date,Open,High,Low\n{day},10,12,9\n")
    code, told, _ = run_cli(capsys, "update", "--csv-dir", str(tmp_path / "csv"), "--repo", str(tmp_path / "db"), "--out", str(tmp_path / "out"), "--universe", "AAA,BBB,CCC,DDD,EEE")
    assert code == 0 and told["actions"] == {"created": 3, "failed": 2}
    store = PriceStore(spark, str(tmp_path / "db"))
    got = {r["symbol"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in store.load().collect()}
    assert got == {"AAA": (10, 12, 9, 11, 100), "BBB": (10, 12, 9, 11, 100), "CCC": (5, 6, 4.5, 5.5, 100)}
    assert {r["symbol"]: r["last_error"] for r in store.manifest().where("failures > 0").collect()} == {"DDD": "missing columns close, volume", "EEE": "no CSV"}


def test_made_up_markets_are_found_by_the_setups(spark):
    bars = synthetic.market(spark, 12)
    assert "Exchange" not in bars._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bars) == rows(synthetic.market(spark, 12, partitions=5)) != rows(synthetic.market(spark, 12, seed=1))
    assert rows(B.normalized(bars)) == rows(bars) and bars.where("weekday(date) > 4 OR NOT (low <= least(open, close) AND high >= greatest(open, close))").isEmpty()
    days = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"))
    assert {(r["n"], r["d"], r["b"]) for r in days.collect()} == {(n, n, days.first()["b"]) for n in (191, 201, 176, 200)}
    found = {}
    for name, s in SETUPS.items():
        cfg = settings(s.presets["default"], {"min_rs_rank": None}) if hasattr(s.presets["default"], "min_rs_rank") else s.presets["default"]
        found[name] = {r["symbol"] for r in B.last_bars(s.detect(annotate(bars, cfg), cfg)).where("passed").collect()}
    assert list(found.values()) == [{"COIL0", "COIL6"}, {"GAP1", "GAP7"}, {"CLIMAX2", "CLIMAX8"}]
    assert synthetic.market(spark, 0).count() == 0
    with pytest.raises(ValueError, match="weekday"):
        synthetic.market(spark, 1, start=date(2021, 1, 3))


def test_a_list_of_symbols_comes_along(spark):
    names = [r["symbol"] for r in files.universe(spark, "sample").orderBy("ord").collect()]
    assert names[:3] == ["AAPL", "MSFT", "NVDA"] and len(names) == len(set(names)) > 40 and "TECHNOLOGY" not in names
