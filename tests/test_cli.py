"""Every command of the command line over small folders, with what it prints, writes and refuses."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import Archive
from tapeloom.cli import main
from tapeloom.sources import provider

HEADER = "Ticker,DateTime,Open,High,Low,Close,Adj Close,Volume\n"
BARS = "ticker string, timestamp string, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string"


def price_file(ticker, rows=70):
    days = [datetime(2024, 1, 2, 15) + timedelta(days=i) for i in range(rows)]
    return HEADER + "".join(f"{ticker},{d:%Y-%m-%d %H:%M:%S},{100 + i},{101 + i},{99 + i},{100.5 + i},{100.4 + i},{1000 + i}\n" for i, d in enumerate(days))


class Client:
    """Stands for the provider: one bar a symbol at the asked start. asked keeps each call's start, end and feed."""

    asked: list = []

    def __init__(self, spark):
        self.spark = spark

    def _bars(self, symbols, start, end, feed, hour):
        self.asked.append((start[:10], end[:10], feed))
        return self.spark.createDataFrame([(s, f"{start[:10]}T{hour}:00Z", 150.0, 155.0, 149.0, 154.0, 1000.0, 100.0, 152.0, feed) for s in symbols], BARS)

    def fetch_daily_bars(self, symbols, *, start, end, feed, batch_size):
        return self._bars(symbols, start, end, feed, "05:00")

    def fetch_minute_bars(self, symbols, *, start, end, feed, batch_size):
        return self._bars(symbols, start, end, feed, "14:30")


def told(capsys):
    """What a command printed, as its labels' values; lines without a label are kept under themselves."""
    pairs = (line.partition(":") for line in capsys.readouterr().out.splitlines())
    return {label: value.strip() for label, _, value in pairs}


def test_archive_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(provider, "MarketDataClient", lambda: Client(spark))
    src, db = tmp_path / "src", str(tmp_path / "db")
    src.mkdir()
    for t in ("AAA", "BBB"):
        (src / f"CurrentData({t}).csv").write_text(price_file(t))

    assert main(["archive-inspect", str(src)]) == 0
    assert told(capsys) == {"Price files": "2", "Uncompressed size": "0.00 GiB"}

    assert main(["archive-build", str(src), db]) == 0
    out = told(capsys)
    assert (out["Files read"], out["Rows kept"], out["Rows refused"], out["Symbols"], out["Daily bars"]) == ("2", "140", "0", "2", "140")
    with pytest.raises(SystemExit) as stop:
        main(["archive-build", str(src), db])
    assert stop.value.code == 2
    assert main(["archive-build", str(src), db, "--replace"]) == 0
    capsys.readouterr()

    assert main(["archive-info", db]) == 0
    out = told(capsys)
    assert (out["Symbols"], out["Raw rows"], out["Daily bars"], out["Days"]) == ("2", "140", "140", "2024-01-02 to 2024-03-11")

    # without --start the update goes on after the ticker that is furthest behind
    assert main(["archive-update", db, "--symbols", "AAA,BBB", "--end", "2024-03-20"]) == 0
    out = told(capsys)
    assert (out["Rows merged"], out["Symbols updated"]) == ("2", "2") and Client.asked[-1] == ("2024-03-12", "2024-03-20", "iex")
    assert main(["archive-update", db, "--all-symbols", "--start", "2024-03-13", "--end", "2024-03-20", "--feed", "sip"]) == 0
    assert told(capsys)["Symbols updated"] == "2" and Client.asked[-1] == ("2024-03-13", "2024-03-20", "sip")
    assert Archive(db).read("daily_prices").count() == 144
    with pytest.raises(SystemExit):
        main(["archive-update", db, "--symbols", "AAA", "--all-symbols"])

    assert main(["archive-minute-info", db]) == 0
    assert told(capsys)["Span"] == "not started"
    backfill = ["archive-backfill-minutes", db, "--symbols", "AAA,BBB", "--start", "2026-01-01", "--end", "2026-01-10", "--batch-size", "1"]
    assert main(backfill) == 0
    out = told(capsys)
    assert (out["Jobs completed"], out["Jobs skipped"], out["Rows merged"]) == ("4", "0", "4")
    assert main(backfill) == 0
    out = told(capsys)
    assert (out["Jobs completed"], out["Jobs skipped"], out["Rows merged"]) == ("0", "4", "0")
    assert main(["archive-minute-info", db]) == 0
    out = told(capsys)
    assert (out["Minute rows"], out["Symbols"], out["Ranges covered"]) == ("4", "2", "4")

    report = tmp_path / "aaa.csv"
    assert main(["archive-analyze", db, "aaa", "--end", "2024-03-11", "--output", str(report)]) == 0
    assert {"Signal now", "Final equity", "Trades"} <= set(told(capsys))
    assert len(pd.read_csv(report)) == 70
    with pytest.raises(SystemExit):
        main(["archive-analyze", db, "NONE"])


def test_analyze_command(spark, tmp_path, capsys):
    source, report = tmp_path / "p.csv", tmp_path / "deep" / "r.csv"
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(80)]
    pd.DataFrame({"Date": days, "Open": 100.0, "High": 102.0, "Low": 99.0, "Close": [100 + i % 3 * 0.5 for i in range(80)], "Volume": 10}).to_csv(source, index=False)
    assert main(["analyze", str(source), "--initial-cash", "500", "--output", str(report)]) == 0
    assert told(capsys)["Initial cash"] == "$500.00"
    got = pd.read_csv(report)
    assert len(got) == 80 and got["Date"].is_monotonic_increasing


def test_research_commands(spark, tmp_path, capsys):
    db, r = tmp_path / "db", np.random.default_rng(5)
    rows = []
    for ticker in ("AAA", "BBB"):
        close = 100.0
        for day in [d for k in range(42) if (d := datetime(2026, 1, 5, 14, 30) + timedelta(days=k)).weekday() < 5]:
            for bar in range(26):
                open_, close = close, close * float(np.exp(r.normal(0, 0.004)))
                rows.append((ticker, day + timedelta(minutes=15 * bar), open_, max(open_, close) * 1.001, min(open_, close) * 0.999, close, float(r.integers(100, 900)), 5.0, (open_ + close) / 2, "sip"))
    minutes = spark.createDataFrame(rows, BARS.replace("timestamp string", "timestamp timestamp")).withColumn("fetched_at", F.current_timestamp())
    Archive(db).commit({"provider_minute_bars": minutes})

    with pytest.raises(SystemExit):
        main(["research-evaluate", str(db)])
    assert main(["research-build", str(db)]) == 0
    out = told(capsys)
    assert (out["Interval"], out["Regular-session bars"], out["Symbols"], out["Sessions"]) == ("15 minutes", f"{len(rows):,}", "2", "30")

    report = tmp_path / "folds.csv"
    sizes = ["--train-sessions", "20", "--test-sessions", "3", "--holdout-sessions", "3", "--target-move-bps", "1"]
    for name in ("baseline", "technical"):
        assert main(["research-evaluate", str(db), *sizes, "--feature-set", name, "--output", str(report)]) == 0
        out = told(capsys)
        assert out["Fold report"] == str(report) and (tmp_path / "folds-symbols.csv").is_file()
        folds, symbols, weights = (pd.read_csv(tmp_path / f"folds{x}.csv") for x in ("", "-symbols", "-coefficients"))
        assert len(folds) >= 2 and set(symbols["ticker"]) == {"AAA", "BBB"} and len(weights) > 3
