"""Legacy files, archives, provider merges and backfills over temporary folders."""

import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeloom import Archive, build_archive, load_daily_prices
from tapeloom.plans import archive as archives
from tapeloom.plans import backfill, merge
from tapeloom.sources.legacy import inspect_legacy_archive, ticker_of
from tapeloom.sources.provider import MarketDataClient

HEADER = "Ticker,DateTime,Open,High,Low,Close,Adj Close,Volume\n"


def lines(ticker, rows=70, bad=None):
    out = [HEADER]
    for i in range(rows):
        day = datetime(2024, 1, 2, 15) + timedelta(days=i)
        low = 0 if i == bad else 99 + i
        out.append(f"{ticker},{day:%Y-%m-%d %H:%M:%S},{100 + i},{101 + i},{low},{100.5 + i},{100.4 + i},{1000 + i}\n")
    return "".join(out)


def test_file_names():
    assert ticker_of("StockTests\\Data\\CurrentData(BRK-B).csv") == "BRK-B"
    assert ticker_of("CurrentData(abc).csv") is None and ticker_of("Other.csv") is None


def test_folder_build(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "CurrentData(AAA).csv").write_text(lines("AAA"))
    (src / "deep" / "CurrentData(ZERO).csv").write_text(lines("ZERO", bad=3))
    (src / "CurrentData(BAD).csv").write_text("DateTime,Open\n2024-01-02,1\n")
    (src / "notes.csv").write_text("x\n")
    (src / "CurrentData(LATIN).csv").write_bytes(HEADER.encode() + b"caf\xe9,2024-01-02,1,1,1,1,1,1\n")
    assert inspect_legacy_archive(src).price_file_count == 4
    db, told = tmp_path / "db", []
    r = build_archive(src, db, progress=lambda k, n, ticker: told.append((k, n, ticker)))
    assert told == [(1, 4, "AAA"), (2, 4, "BAD"), (3, 4, "LATIN"), (4, 4, "ZERO")]
    assert (r.files_imported, r.rows_imported, r.rows_rejected, r.symbols, r.daily_rows) == (2, 139, 1, 2, 139)
    assert not (tmp_path / "db.building").exists()
    with pytest.raises(FileExistsError):
        build_archive(src, db)
    assert build_archive(src, db, replace=True).daily_rows == 139
    a = Archive(db)
    assert [(x.reason, x.rejected_rows) for x in a.read("import_rejections").collect()] == [("non_positive_price", 1)]
    assert {r.ticker: r.error.split(":")[0] for r in a.read("import_log").where("error is not null").collect()} == {"BAD": "ValueError", "LATIN": "UnicodeDecodeError"}
    s = archives.archive_statistics(a)
    assert s["symbols"] == 2 and s["raw_rows"] == 139
    got = load_daily_prices(a, " aaa ", start="2024-01-03", end="2024-01-05").collect()
    assert len(got) == 3 and got[0].Open == 101.0
    with pytest.raises(ValueError):
        load_daily_prices(a, "NONE")
    with pytest.raises(ValueError, match="unsupported"):
        load_daily_prices(a, "A B")
    with pytest.raises(FileNotFoundError):
        archives.archive_statistics(Archive(tmp_path / "no"))


def test_zip_build(spark, tmp_path):
    path = tmp_path / "old.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("StockTests/Data/CurrentData(ZIP).csv", lines("ZIP"))
        z.writestr("StockTests/Data/CurrentData(SAFE).csv", lines("SAFE"))
    r = build_archive(path, tmp_path / "db")
    assert r.symbols == 2 and r.daily_rows == 140
    assert sorted(p.name for p in tmp_path.iterdir()) == ["db", "old.zip"]


def contents(db):
    a = Archive(db)
    strip = lambda df: df.withColumn("source_file", F.regexp_extract("source_file", "[^/]+$", 0))
    return [sorted(map(str, strip(a.read(t)).collect() if t != "daily_prices" else a.read(t).collect())) for t in ("prices", "daily_prices", "import_log", "import_rejections")]


def test_all_rows_of_one_instant_can_be_kept(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "CurrentData(AAA).csv").write_text(lines("AAA") + "".join(lines("AAA", 5).splitlines(True)[1:]))
    r = build_archive(src, tmp_path / "first")
    assert (r.rows_imported, Archive(tmp_path / "first").read("daily_prices").agg(F.sum("source_rows")).first()[0]) == (70, 70)
    r = build_archive(src, tmp_path / "all", one_per_instant=False)
    assert (r.rows_imported, Archive(tmp_path / "all").read("daily_prices").agg(F.sum("source_rows")).first()[0]) == (75, 75)
    assert Archive(tmp_path / "all").read("prices").groupBy("ticker", "timestamp").count().where("count = 2").count() == 5


def test_zip_and_folder_builds_are_equal_and_broken_files_keep_their_rows(spark, tmp_path, monkeypatch):
    from tapeloom.sources import legacy

    whole = lines("GOOD", 3000, bad=17).splitlines(True)
    texts = {
        "GOOD": "".join(whole), "EMPTY": "", "HEAD": HEADER, "BOM": "\ufeff" + lines("BOM", 5),
        "WIDE": "".join(lines("WIDE", 1500).splitlines(True)[:1000]) + "WIDE,2030-01-01,1,1,1,1,1,1,one,two\n" + "WIDE,2030-01-02,1,1,1,1,1,1\n",  # broken at row 1,000
        "SHORT": lines("SHORT", 40) + "SHORT,2030-01-01,1,1\n\n" + "SHORT,2030-01-02,2,3,1,2,2,5\n",
        "QUOTE": HEADER + '"QUOTE","2024-01-02","1","2","0.5","1","1","3"\nQUOTE,"2024-01\n-03",1,1,1,1,1,1\nQUOTE,2024-01-04,1,1,1,1,1,1\n',
        "NOADJ": "DateTime,Close,Open,High,Low,Volume,Extra\n2024-01-02,1,1,1,1,1,x\n",
    }
    raw = {t: x.encode() for t, x in texts.items()} | {"LATIN": lines("LATIN", 900).encode() + b"caf\xe9,2030-01-02,1,1,1,1,1,1\n" + b"LATIN,2030-01-03,1,1,1,1,1,1\n"}
    src = tmp_path / "src"
    src.mkdir()
    with zipfile.ZipFile(tmp_path / "old.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for t, x in raw.items():
            (src / f"CurrentData({t}).csv").write_bytes(x)
            z.writestr(f"StockTests/Data/CurrentData({t}).csv", x)
    monkeypatch.setattr(legacy, "TASK_BYTES", 100_000)
    assert len(legacy.grouped(legacy.price_files(src), 100_000)) >= 2
    a = build_archive(src, tmp_path / "a")
    before = set(tmp_path.rglob("*"))
    b = build_archive(tmp_path / "old.zip", tmp_path / "b")
    assert {p.relative_to(tmp_path).parts[0] for p in set(tmp_path.rglob("*")) - before} == {"b"}  # nothing was unpacked
    assert (a.rows_imported, a.rows_rejected, a.files_imported, a.daily_rows) == (b.rows_imported, b.rows_rejected, b.files_imported, b.daily_rows) and contents(tmp_path / "a") == contents(tmp_path / "b")
    log = {r.ticker: r for r in Archive(tmp_path / "a").read("import_log").collect()}
    assert {t: (r.imported_rows, r.rejected_rows) for t, r in log.items()} == {
        "GOOD": (2999, 1), "EMPTY": (0, 0), "HEAD": (0, 0), "BOM": (5, 0), "WIDE": (999, 0), "SHORT": (41, 1), "QUOTE": (2, 1), "NOADJ": (1, 0), "LATIN": (900, 0),
    }
    assert {t: r.error.split(":")[0] for t, r in log.items() if r.error} == {"EMPTY": "ValueError", "WIDE": "ParserError", "LATIN": "UnicodeDecodeError"}
    assert a.files_imported == 6 and Archive(tmp_path / "a").read("prices").where("ticker = 'NOADJ'").first().adjusted_close == 1.0


def provider(spark, *rows):
    return spark.createDataFrame(rows, "ticker string, timestamp string, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string")


def test_provider_merge(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for t in ("AAA", "BBB"):
        (src / f"CurrentData({t}).csv").write_text(lines(t))
    build_archive(src, tmp_path / "db")
    a = Archive(tmp_path / "db")
    bar = ("aaa", "2026-01-02T05:00:00Z", 150.0, 155.0, 149.0, 154.0, 1000.0, 100.0, 152.0, "iex")
    for _ in range(2):
        assert merge.merge_provider_daily_bars(a, provider(spark, bar)) == {"rows_merged": 1, "symbols_updated": 1}
    assert a.read("provider_daily_bars").count() == 1 and a.read("provider_update_log").count() == 2
    day = a.read("daily_prices").where("ticker = 'AAA' and trading_date = DATE'2026-01-02'").collect()
    assert len(day) == 1 and day[0].close == 154.0 and day[0].source_rows == 1
    assert archives.next_update_start(a, ["AAA", "bbb"]) == "2024-03-12"
    with pytest.raises(ValueError, match="Provide --start"):
        archives.next_update_start(a, ["NEW"])
    assert merge.merge_provider_daily_bars(a, provider(spark, bar).where("false")) == {"rows_merged": 0, "symbols_updated": 0}
    for spoiled, message in ((dict(open=None), "missing"), (dict(low=-1.0), "non-positive"), (dict(volume=-1.0), "negative volume"), (dict(high=100.0), "inconsistent high"), (dict(low=151.0), "inconsistent low")):
        with pytest.raises(ValueError, match=message):
            merge.merge_provider_daily_bars(a, provider(spark, bar).withColumns({k: F.lit(v).cast("double") for k, v in spoiled.items()}))


class FakeClient:
    def __init__(self, spark, empty=False):
        self.spark, self.empty, self.calls = spark, empty, []

    def fetch_minute_bars(self, symbols, *, start, end, feed, batch_size):
        self.calls.append((tuple(symbols), start))
        return provider(self.spark, *[(s, f"{start[:10]}T14:30:00Z", 100.0, 102.0, 99.0, 101.0, 1000.0, 20.0, 100.5, feed) for s in symbols]).where(F.lit(not self.empty))


def test_resumable_backfill(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "CurrentData(AAA).csv").write_text(lines("AAA"))
    build_archive(src, tmp_path / "db")
    a, client = Archive(tmp_path / "db"), FakeClient(spark)
    args = dict(start="2026-01-01", end="2026-01-10", batch_size=1, chunk_days=7)
    r = backfill.backfill_minute_bars(a, ["bbb", "AAA"], client, **args)
    assert (r.jobs_completed, r.jobs_skipped, r.rows_merged, r.symbols_updated) == (4, 0, 4, 2)
    r = backfill.backfill_minute_bars(a, ["AAA", "BBB"], client, **args)
    assert (r.jobs_completed, r.jobs_skipped) == (0, 4) and len(client.calls) == 4
    s = backfill.minute_archive_statistics(a)
    assert s["rows"] == 4 and s["coverage_records"] == 4
    r = backfill.backfill_minute_bars(a, ["CCC"], FakeClient(spark, empty=True), **args)
    assert (r.jobs_completed, r.rows_merged) == (2, 0)
    assert a.read("provider_minute_coverage").where("ticker = 'CCC' and row_count = 0").count() == 2
    with pytest.raises(ValueError, match="after end"):
        backfill.backfill_minute_bars(a, ["AAA"], client, start="2026-02-01", end="2026-01-01")


def parts(archive, table):
    found = {}
    for e in archive.snapshot().entries(table):
        found.setdefault(e.part, set()).add(e.path)
    return found


def test_a_backfill_can_keep_all_bars_of_one_instant(spark, tmp_path):
    class Twice(FakeClient):
        def fetch_minute_bars(self, *args, **options):
            bars = super().fetch_minute_bars(*args, **options)
            return bars.unionByName(bars)

    for name, keep_one, n in (("one", True, 1), ("all", False, 2)):
        a = Archive(tmp_path / name)
        a.commit({"import_log": spark.createDataFrame([], "source_file string, ticker string, imported_rows long, rejected_rows long, error string")})
        r = backfill.backfill_minute_bars(a, ["AAA"], Twice(spark), start="2026-01-05", end="2026-01-05", one_per_instant=keep_one)
        assert (r.rows_merged, a.read("provider_minute_bars").count(), backfill.minute_archive_statistics(a)["rows"]) == (n, n, n)
        assert [x.row_count for x in a.read("provider_minute_coverage").collect()] == [n]


def test_merges_write_only_the_parts_they_touch(spark, tmp_path):
    a = Archive(tmp_path / "db")
    a.commit({"import_log": spark.createDataFrame([], "source_file string, ticker string, imported_rows long, rejected_rows long, error string")})
    bar = lambda day, close=1.5: ("AAA", f"{day}T15:00:00Z", 1.0, 2.0, 0.5, close, 10.0, 1.0, 1.0, "iex")
    merge.merge_provider_daily_bars(a, provider(spark, bar("2024-03-04"), bar("2025-03-04")))
    daily, own = parts(a, "daily_prices"), parts(a, "provider_daily_bars")
    merge.merge_provider_daily_bars(a, provider(spark, bar("2025-03-04", 1.75), bar("2026-03-04")))
    for table, before in (("daily_prices", daily), ("provider_daily_bars", own)):
        after = parts(a, table)
        assert set(after) == {"2024", "2025", "2026"} and after["2024"] == before["2024"] and after["2025"] != before["2025"]
    assert [(r.trading_date.year, r.close) for r in a.read("daily_prices").orderBy("trading_date").collect()] == [(2024, 1.5), (2025, 1.75), (2026, 1.5)]
    assert a.read("symbol_summary").first().trading_days == 3 and not list(Path(a.root, "landing").iterdir())
    backfill.backfill_minute_bars(a, ["AAA"], FakeClient(spark), start="2026-01-01", end="2026-03-05", chunk_days=31)
    before = parts(a, "provider_minute_bars")
    assert set(before) == {"iex-2026-01", "iex-2026-02", "iex-2026-03"}
    backfill.backfill_minute_bars(a, ["BBB"], FakeClient(spark), start="2026-03-04", end="2026-03-05")
    after = parts(a, "provider_minute_bars")
    assert {p: after[p] for p in ("iex-2026-01", "iex-2026-02")} == {p: before[p] for p in ("iex-2026-01", "iex-2026-02")} and after["iex-2026-03"] != before["iex-2026-03"]


def test_each_page_is_downloaded_once(spark, tmp_path):
    a = Archive(tmp_path / "db")
    a.commit({"import_log": spark.createDataFrame([], "source_file string, ticker string, imported_rows long, rejected_rows long, error string")})
    calls = tmp_path / "calls"

    def get(parameters):
        with calls.open("a") as f:
            f.write("x")
        day = parameters["start"][:10]
        return {"bars": {s: [{"t": f"{day}T15:00:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10}] for s in parameters["symbols"].split(",")}, "next_page_token": None if parameters.get("page_token") else "more"}

    client = MarketDataClient(get=get, spark=spark)
    merge.merge_provider_daily_bars(a, client.fetch_daily_bars(["AAA"], start="2026-01-02", end="2026-01-03"))
    assert calls.read_text() == "xx"
    backfill.backfill_minute_bars(a, ["AAA", "BBB"], client, start="2026-01-05", end="2026-01-06")
    assert calls.read_text() == "xxxx" and a.read("provider_minute_bars").count() == 2
