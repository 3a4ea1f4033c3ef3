"""Command line: python -m tapeloom COMMAND ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date, timedelta
from os.path import splitext
from pathlib import Path

from pyspark.sql import functions as F

from tapeloom.operators.backtest import BacktestResult, run_backtest
from tapeloom.operators.bars import INTERVALS
from tapeloom.operators.features import FEATURE_SETS
from tapeloom.operators.signals import analyze_prices
from tapeloom.plans import archive as archives
from tapeloom.plans import backfill, dataset, merge, walkforward
from tapeloom.plans.catalog import Archive
from tapeloom.session import session
from tapeloom.sources import legacy, prices, provider

NOTICE = "Results describe the past of the given prices. They are no advice to trade."


def show(**lines: object) -> None:
    for label, value in lines.items():
        print(f"{label.replace('_', ' ') + ':':<22}{value}")


def yesterday() -> str:
    return (date.today() - timedelta(days=1)).isoformat()


def gib(n: int) -> str:
    return f"{n / 1024**3:.2f} GiB"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tapeloom", description="Indicators, signals and backtests of price series; archives of prices; walk-forward studies.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, run, *groups) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.set_defaults(run=run)
        for group in groups:
            group(sub)
        return sub

    def money(p):
        p.add_argument("--initial-cash", type=float, default=10_000.0)
        p.add_argument("--transaction-cost-bps", type=float, default=5.0)

    def archive(p):
        p.add_argument("database", type=Path, help="the archive's folder")

    def chosen(p):
        group = p.add_mutually_exclusive_group(required=True)
        group.add_argument("--symbols", help="tickers, with commas between")
        group.add_argument("--all-symbols", action="store_true", help="all tickers the archive has")
        p.add_argument("--feed", choices=provider.FEEDS, default="iex")
        p.add_argument("--batch-size", type=int, default=50)

    def interval(p):
        p.add_argument("--interval", type=int, choices=INTERVALS, default=15)

    p = command("demo", "score and trade a made-up series", run_demo, money)
    p.add_argument("--rows", type=int, default=260)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--output")
    p = command("analyze", "score and trade the series of a price file", run_analyze, money)
    p.add_argument("csv_file")
    p.add_argument("--output", default="reports/analysis.csv")
    command("archive-inspect", "count the price files of a folder or ZIP file", run_inspect).add_argument("source", type=Path)
    p = command("archive-build", "import a folder or ZIP file of price files as a new archive", run_build)
    p.add_argument("source", type=Path)
    archive(p)
    p.add_argument("--replace", action="store_true")
    command("archive-info", "what an archive holds", run_info, archive)
    p = command("archive-update", "fetch daily bars and merge them", run_update, archive, chosen)
    p.add_argument("--start", help="first day (YYYY-MM-DD); else where the ticker that is furthest behind goes on")
    p.add_argument("--end", help="last day (YYYY-MM-DD); else yesterday")
    p = command("archive-backfill-minutes", "fetch minute bars, job by job, leaving out what is there", run_backfill, archive, chosen)
    p.add_argument("--start", required=True)
    p.add_argument("--end")
    p.add_argument("--chunk-days", type=int, default=7)
    command("archive-minute-info", "what an archive holds of minute bars", run_minute_info, archive)
    p = command("research-build", "make the feature table of one bar length", run_research_build, archive, interval)
    p.add_argument("--feed", choices=provider.FEEDS, default="sip")
    p.add_argument("--start")
    p.add_argument("--end")
    p = command("research-evaluate", "fit and test a model fold by fold in time", run_research_evaluate, archive, interval)
    for name, value in (("--train-sessions", 126), ("--test-sessions", 21), ("--holdout-sessions", 21)):
        p.add_argument(name, type=int, default=value)
    p.add_argument("--feature-set", choices=tuple(FEATURE_SETS), default="baseline")
    for name, value in (("--target-move-bps", 5.0), ("--confidence", 0.55), ("--transaction-cost-bps", 5.0)):
        p.add_argument(name, type=float, default=value)
    p.add_argument("--output")
    p = command("archive-analyze", "score and trade one ticker's days", run_archive_analyze, archive, money)
    p.add_argument("ticker")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--output")
    return top


def _analyzed(frame, a) -> None:
    rows = analyze_prices(frame).persist()
    try:
        result: BacktestResult = run_backtest(rows, a.initial_cash, a.transaction_cost_bps)
        if a.output:
            show(Written_to=prices.save_csv(rows.orderBy("Date"), a.output))
        last = rows.agg(F.max_by(F.struct("signal", "signal_score"), "Date").alias("x")).first()["x"]
    finally:
        rows.unpersist()
    m = result.metrics
    show(
        Signal_now=f"{last.signal} (score {last.signal_score:+d})", Initial_cash=f"${m['initial_cash']:,.2f}", Final_equity=f"${m['final_equity']:,.2f}",
        Return=f"{m['total_return_pct']:+.2f}%", **{"Return_if_held": f"{m['buy_and_hold_return_pct']:+.2f}%"}, Trades=m["trade_count"],
    )
    print(NOTICE)


def run_demo(a) -> None:
    _analyzed(prices.generate_demo_prices(a.rows, a.seed), a)


def run_analyze(a) -> None:
    _analyzed(prices.load_prices(a.csv_file), a)


def run_archive_analyze(a) -> None:
    _analyzed(archives.load_daily_prices(Archive(a.database), a.ticker, start=a.start, end=a.end), a)


def run_inspect(a) -> None:
    found = legacy.inspect_legacy_archive(a.source)
    show(Price_files=f"{found.price_file_count:,}", Uncompressed_size=gib(found.uncompressed_bytes))


def run_build(a) -> None:
    r = legacy.build_archive(a.source, a.database, replace=a.replace)
    show(Archive=r.database, Files_read=f"{r.files_imported:,}", Rows_kept=f"{r.rows_imported:,}", Rows_refused=f"{r.rows_rejected:,}", Symbols=f"{r.symbols:,}", Daily_bars=f"{r.daily_rows:,}")


def run_info(a) -> None:
    s = archives.archive_statistics(Archive(a.database))
    show(Symbols=f"{s['symbols']:,}", Raw_rows=f"{s['raw_rows']:,}", Daily_bars=f"{s['daily_rows']:,}", Days=f"{s['first_date']} to {s['last_date']}", Size=gib(s["database_bytes"]))


def _symbols(a, archive: Archive) -> list[str]:
    return archives.list_archive_symbols(archive) if a.all_symbols else a.symbols.split(",")


def run_update(a) -> None:
    client, archive = provider.MarketDataClient(), Archive(a.database)
    symbols = _symbols(a, archive)
    start, end = a.start or archives.next_update_start(archive, symbols), a.end or yesterday()
    print(f"Daily bars of {len(symbols):,} tickers from {start} to {end}")
    merged = merge.merge_provider_daily_bars(archive, client.fetch_daily_bars(symbols, start=start, end=end, feed=a.feed, batch_size=a.batch_size))
    show(Rows_merged=f"{merged['rows_merged']:,}", Symbols_updated=f"{merged['symbols_updated']:,}")


def run_backfill(a) -> None:
    client, archive = provider.MarketDataClient(), Archive(a.database)

    def said(p: backfill.MinuteBackfillProgress) -> None:
        if p.position == 1 or p.position % 10 == 0 or p.position == p.total:
            state = "nothing left to fetch" if p.skipped else f"{p.rows:,} rows"
            print(f"Job {p.position:,}/{p.total:,}: {p.start} to {p.end}; {p.symbol_count:,} symbols; {state}")

    r = backfill.backfill_minute_bars(archive, _symbols(a, archive), client, start=a.start, end=a.end or yesterday(), feed=a.feed, batch_size=a.batch_size, chunk_days=a.chunk_days, progress=said)
    show(Jobs_completed=f"{r.jobs_completed:,}", Jobs_skipped=f"{r.jobs_skipped:,}", Rows_merged=f"{r.rows_merged:,}", Symbols_updated=f"{r.symbols_updated:,}")


def run_minute_info(a) -> None:
    s = backfill.minute_archive_statistics(Archive(a.database))
    span = f"{s['first_timestamp']} to {s['last_timestamp']}" if s["first_timestamp"] else "not started"
    show(Minute_rows=f"{s['rows']:,}", Symbols=f"{s['symbols']:,}", Span=span, Ranges_covered=f"{s['coverage_records']:,}", Size=gib(s["database_bytes"]))


def run_research_build(a) -> None:
    r = dataset.build_research_dataset(Archive(a.database), interval_minutes=a.interval, feed=a.feed, start=a.start, end=a.end)
    show(
        Table=r.table, Interval=f"{r.interval_minutes} minutes", **{"Regular-session_bars": f"{r.bars:,}", "Baseline-ready_rows": f"{r.feature_ready_rows:,}", "Technical-ready_rows": f"{r.technical_ready_rows:,}"},
        Symbols=f"{r.symbols:,}", Sessions=f"{r.sessions:,}", Session_span=f"{r.first_session} to {r.last_session}",
    )


def run_research_evaluate(a) -> None:
    rows = dataset.load_research_dataset(Archive(a.database), interval_minutes=a.interval)
    r = walkforward.evaluate(rows, train_sessions=a.train_sessions, test_sessions=a.test_sessions, holdout_sessions=a.holdout_sessions, feature_set=a.feature_set, target_move_bps=a.target_move_bps, confidence=a.confidence, transaction_cost_bps=a.transaction_cost_bps)
    target = a.output or f"reports/walk-forward-{a.interval}m-{a.feature_set}.csv"
    stem, suffix = splitext(target)
    reports = {"Fold_report": (r.folds, target), "Symbol_report": (r.symbols, f"{stem}-symbols{suffix}"), "Coefficient_report": (r.coefficients, f"{stem}-coefficients{suffix}")}
    for frame, path in reports.values():
        prices.save_csv(frame, path)
    for key, value in r.metrics.items():
        show(**{key: value})
    show(**{k: p for k, (_, p) in reports.items()})
    print("A study of past bars; nothing was traded.")


def main(argv: Sequence[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    session()
    try:
        a.run(a)
    except (FileNotFoundError, FileExistsError, RuntimeError, ValueError) as error:
        top.error(str(error))
    return 0
