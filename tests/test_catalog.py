"""The log-structured archive: deltas, conflicts, snapshots, ranges and summaries."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeloom import Archive
from tapeloom.plans import archive as archives
from tapeloom.plans import backfill, catalog
from tapeloom.plans.catalog import SCHEMAS, Append, ConflictError, Upsert

DAILY = SCHEMAS["daily_prices"]


def days(spark, *rows):
    """Daily rows from (ticker, day of 2024, close)."""
    return spark.createDataFrame([(t, date(2024, 1, 1) + timedelta(days=d), 1.0, 1.0, 1.0, float(c), float(c), 1.0, 2) for t, d, c in rows], DAILY)


def minutes(spark, tickers, day, n=50, mark=1.0):
    at = F.timestamp_seconds(F.lit(int(datetime(2026, 1, day, 15, tzinfo=timezone.utc).timestamp())) + F.col("id") * 60)
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    one = F.lit(1.0)
    return spark.range(n).crossJoin(names).select("ticker", at.alias("timestamp"), one.alias("open"), one.alias("high"), one.alias("low"), one.alias("close"), F.rand(3).alias("volume"), F.lit(mark).alias("trade_count"), one.alias("vwap"), F.lit("iex").alias("feed"), F.current_timestamp().alias("fetched_at"))


def held(archive):
    return sorted((r.ticker, (r.trading_date - date(2024, 1, 1)).days, r.close) for r in archive.read("daily_prices").collect())


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_rows_of_the_newest_run_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_RUNS", 3)
    a, g, model = Archive(tmp_path / "db", spark), random.Random(1), {}
    for k in range(6):
        rows = [(g.choice("ABCD"), g.choice([0, 1, 2, 3, 300, 370]), k) for _ in range(5)]
        a.commit({"daily_prices": Upsert(days(spark, *rows))})
        for key in {r[:2] for r in rows}:
            model[key] = [r for r in rows if r[:2] == key]  # equal keys of one batch all stay
        assert held(a) == sorted(r for own in model.values() for r in own)
    summary = {r.ticker: (r.trading_days, r.source_rows) for r in a.read("symbol_summary").collect()}
    rows = [r for own in model.values() for r in own]
    assert summary == {t: (n := sum(r[0] == t for r in rows), 2 * n) for t in {r[0] for r in rows}}
    assert max(len({e.seq for e in a.snapshot().entries("daily_prices") if e.part == p}) for p in ("2024", "2025")) < 6
    before = held(a)
    a.compact("daily_prices")
    assert held(a) == before and all(len({e.seq for e in a.snapshot().entries("daily_prices") if e.part == p}) == 1 for p in ("2024", "2025"))


def test_jobs_write_their_own_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_RUNS", 100)
    a, grown = Archive(tmp_path / "db", spark), []
    for k in range(5):
        before = size(tmp_path)
        a.commit({"provider_minute_bars": Upsert(minutes(spark, [f"T{k}{x}" for x in "ABC"], 5, n=400))})
        grown.append(size(tmp_path) - before)
    assert max(grown) < 1.3 * min(grown), grown  # a month that is rewritten would grow with each job
    assert a.read("provider_minute_bars").count() == 5 * 3 * 400
    assert not any("Window" in line for line in a.read("provider_minute_bars")._jdf.queryExecution().toString().splitlines())  # ranges that do not meet are scanned as they are


def test_folding_keeps_bytes_near_linear(spark, tmp_path):
    a, g = Archive(tmp_path / "db", spark), random.Random(4)
    n = 20
    for k in range(n):
        a.commit({"daily_prices": Upsert(days(spark, *[(f"T{g.randint(0, 99)}", d, k) for d in range(40)]))})
    written = sum(e for e in (a.snapshot().state.version,))
    assert n <= written <= n + n // 4  # folds are rare
    assert len({e.seq for e in a.snapshot().entries("daily_prices")}) < 2 * catalog.MOST_RUNS
    assert len(held(a)) == a.read("daily_prices").select("ticker", "trading_date").distinct().count()


def test_a_crash_between_writing_and_the_log_changes_nothing(spark, tmp_path, monkeypatch):
    a = Archive(tmp_path / "db", spark)
    a.commit({"daily_prices": Upsert(days(spark, ("A", 1, 1)))})
    before, files = held(a), {f for f in (tmp_path / "db" / "data").iterdir()}

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(Archive, "_claim", crash)
        with pytest.raises(RuntimeError, match="crash"):
            a.commit({"daily_prices": Upsert(days(spark, ("A", 1, 2))), "provider_update_log": Append(spark.createDataFrame([], SCHEMAS["provider_update_log"]))})
        assert held(a) == before and {f for f in (tmp_path / "db" / "data").iterdir()} == files
        m.setattr(Archive, "_discard", lambda *_: None)  # the process dies before it can clear up
        with pytest.raises(RuntimeError, match="crash"):
            a.commit({"daily_prices": Upsert(days(spark, ("A", 1, 3)))})
    assert held(Archive(tmp_path / "db", spark)) == before
    assert {f for f in (tmp_path / "db" / "data").iterdir()} > files and a.vacuum(3600) == 0
    assert a.vacuum(0) > 0 and {f for f in (tmp_path / "db" / "data").iterdir()} == files and held(a) == before


def test_writers_at_the_same_time_all_survive(spark, tmp_path):
    a = Archive(tmp_path / "db", spark)
    a.commit({"daily_prices": Upsert(days(spark, ("A", 0, 0)))})
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: Archive(tmp_path / "db", spark).commit({"daily_prices": Upsert(days(spark, (f"W{k}", k, k), ("A", 0, k + 1)))}), range(6)))
    got = held(a)
    assert [r[0] for r in got] == ["A", *[f"W{k}" for k in range(6)]] and got[0][2] >= 1 and a.version() >= 7


def test_a_replacement_of_what_has_changed_is_refused(spark, tmp_path):
    a, b = Archive(tmp_path / "db", spark), Archive(tmp_path / "db", spark)
    a.commit({"daily_prices": days(spark, ("A", 1, 1)), "prices": spark.createDataFrame([], SCHEMAS["prices"])})
    base = a.snapshot()
    b.commit({"daily_prices": Upsert(days(spark, ("B", 1, 1)))})
    with pytest.raises(ConflictError):
        a.commit({"daily_prices": base.read("daily_prices").where("false")}, base=base)
    a.commit({"prices": spark.createDataFrame([], SCHEMAS["prices"])}, base=base)  # another table
    assert [r[0] for r in held(a)] == ["A", "B"]
    with pytest.raises(ValueError, match="no key"):
        a.commit({"import_log": Upsert(spark.createDataFrame([], SCHEMAS["import_log"]))})


def test_a_reader_finishes_after_later_commits(spark, tmp_path):
    a = Archive(tmp_path / "db", spark)
    a.commit({"daily_prices": Upsert(days(spark, *[("A", d, 1) for d in range(5)]))})
    opened, at = a.read("daily_prices"), a.version()
    a.commit({"daily_prices": Upsert(days(spark, *[("A", d, 2) for d in range(9)]))})
    a.compact("daily_prices")
    a.commit({"daily_prices": days(spark, ("Z", 1, 1))})
    assert opened.count() == 5 and opened.agg(F.max("close")).first()[0] == 1.0
    assert a.snapshot(at).read("daily_prices").count() == 5 and held(a) == [("Z", 1, 1.0)]
    assert a.vacuum() == 0 and a.vacuum(0) > 0 and held(a) == [("Z", 1, 1.0)]
    a.forget(["daily_prices"])
    assert a.read("daily_prices").count() == 0 and a.tables() == []


def test_a_read_opens_only_files_of_its_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 200)
    a = Archive(tmp_path / "db", spark)
    a.commit({"provider_minute_bars": Upsert(minutes(spark, ["HOT"], 5, n=3000).unionByName(minutes(spark, ["AAA", "ZZZ"], 5, n=20)))})
    a.commit({"provider_minute_bars": Upsert(minutes(spark, ["HOT", "AAA"], 20, n=100))})
    everything = a.read("provider_minute_bars")
    hot = [e for e in a.snapshot().entries("provider_minute_bars") if e.low == e.high == "HOT"]
    assert len(hot) >= 14 and max(e.rows for e in hot) <= 200  # a hot ticker is many files
    some = a.read("provider_minute_bars", ["ZZZ"])
    assert some.count() == 20 and len(some.inputFiles()) <= 2 < len(everything.inputFiles())
    low = datetime(2026, 1, 5, 16, tzinfo=timezone.utc)
    hour = a.read("provider_minute_bars", ["HOT"], low, low + timedelta(minutes=29))
    assert hour.count() == 30 and len(hour.inputFiles()) <= 3
    late = a.read("provider_minute_bars", since=datetime(2026, 1, 19, tzinfo=timezone.utc))
    assert late.count() == 200 and len(late.inputFiles()) <= 8
    assert a.read("provider_minute_bars", ["NONE"]).count() == 0
    a.commit({"daily_prices": Upsert(days(spark, *[(t, d, 1) for t in "ABCDEFGH" for d in (0, 400)]))})
    opened = archives.load_daily_prices(a, "A", start="2024-01-01", end="2024-02-01")
    assert opened.count() == 1 and all("part=2024" in f for f in opened.inputFiles())


def test_statistics_read_no_bars_where_runs_do_not_meet(spark, tmp_path):
    a = Archive(tmp_path / "db", spark)
    a.commit({"import_log": spark.createDataFrame([], SCHEMAS["import_log"])})
    a.commit({"daily_prices": Upsert(days(spark, ("A", 0, 1), ("A", 400, 1), ("B", 5, 1))), "provider_minute_bars": Upsert(minutes(spark, ["A", "B"], 5, 10))})
    a.commit({"daily_prices": Upsert(days(spark, ("C", 7, 1))), "provider_minute_bars": Upsert(minutes(spark, ["A", "B"], 6, 10))})
    want = archives.archive_statistics(a), backfill.minute_archive_statistics(a), sorted(a.read("symbol_summary").collect())
    for f in (tmp_path / "db" / "data").rglob("part=*/*.parquet"):
        f.unlink()
    for got in (archives.archive_statistics(a), backfill.minute_archive_statistics(a)):
        got.pop("database_bytes")
    assert sorted(a.read("symbol_summary").collect()) == want[2]
    assert want[0]["daily_rows"] == 4 and want[0]["symbols"] == 3 and want[0]["last_date"] == date(2025, 2, 4)
    assert want[1]["rows"] == 40 and want[1]["symbols"] == 2 and want[1]["last_timestamp"].day == 6


def test_the_log_is_read_from_its_last_full_state(spark, tmp_path, monkeypatch):
    a = Archive(tmp_path / "db", spark)
    for _ in range(40):
        a._recorded(lambda now: {"add": {"t": [{"path": f"data/x{now.version}", "run": "x"}]}})
    assert list((tmp_path / "db" / "log").glob("*.full"))
    fresh = Archive(tmp_path / "db", spark)
    loaded = []
    monkeypatch.setattr(Archive, "_load", lambda self, name, f=Archive._load: (loaded.append(name), f(self, name))[1])
    assert len(fresh.snapshot().entries("t")) == 40 and len(loaded) < 30
    assert len(a.snapshot(5).entries("t")) == 5
