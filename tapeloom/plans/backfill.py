"""Backfilling minute bars in jobs of a date range and a symbol batch, each committed with its own coverage records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import clock
from tapeloom.operators import upsert, validate
from tapeloom.plans.catalog import Append, Archive, Upsert
from tapeloom.sources.provider import FEEDS, normalized_symbols


@dataclass(frozen=True)
class MinuteBackfillProgress:
    position: int
    total: int
    start: date
    end: date
    symbol_count: int
    rows: int
    skipped: bool


@dataclass(frozen=True)
class MinuteBackfillResult:
    jobs_completed: int
    jobs_skipped: int
    rows_merged: int
    symbols_updated: int


def job_grid(symbols: DataFrame, start: str | date, end: str | date, chunk_days: int, feed: str) -> DataFrame:
    """Every symbol with every date range: ticker, feed, start_date, end_date. Two small tables are crossed."""
    a, b = clock.as_date(start, "Start date"), clock.as_date(end, "End date")
    starts = symbols.sparkSession.range(0, -(-((b - a).days + 1) // chunk_days)).select(F.date_add(F.lit(a), (F.col("id") * chunk_days).cast("int")).alias("start_date"))
    ranges = starts.withColumn("end_date", F.least(F.date_add("start_date", chunk_days - 1), F.lit(b)))
    return symbols.select("ticker").crossJoin(ranges).select("ticker", F.lit(feed).alias("feed"), "start_date", "end_date")


def coverage_rows(requested: DataFrame, batch: DataFrame) -> DataFrame:
    """Requested tickers with their number of rows; 0 for those that got none."""
    return requested.join(batch.groupBy("ticker").agg(F.count("*").alias("row_count")), "ticker", "left").select("ticker", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def _merge_job(archive: Archive, spark: SparkSession, bars: DataFrame, requested: list[str], feed: str, start: date, end: date, one_per_instant: bool) -> tuple[int, set[str]]:
    """Merge one job's bars. They are read once, and nothing but them is written."""
    with archive.landed(bars) as landed:
        batch = validate.provider_bars(landed, feed, one_per_instant)
        symbols = spark.createDataFrame([(s,) for s in requested], "ticker string")
        counts = {r.ticker: r["count"] for r in batch.groupBy("ticker").count().collect()}  # of one batch of symbols
        job = [F.lit(feed).alias("feed"), F.lit(start).alias("start_date"), F.lit(end).alias("end_date")]
        fresh = coverage_rows(symbols, batch).select("ticker", *job, "row_count", F.current_timestamp().alias("completed_at"))
        row = spark.range(1).select(F.current_timestamp().alias("completed_at"), *job, F.lit(len(requested)).cast("long").alias("symbols_requested"), F.lit(len(counts)).cast("long").alias("symbols_with_bars"), F.lit(sum(counts.values())).cast("long").alias("rows_merged"))
        changes = {
            "provider_minute_coverage": Upsert(fresh), "provider_minute_update_log": Append(row),
        }
        if counts:
            changes["provider_minute_bars"] = Upsert(batch.withColumn("fetched_at", F.current_timestamp()))
        archive.commit(changes)
    return sum(counts.values()), set(counts)


def backfill_minute_bars(archive: Archive, symbols: list[str], client, *, start: str | date, end: str | date, feed: str = "iex", batch_size: int = 50, chunk_days: int = 7, progress: Callable[[MinuteBackfillProgress], None] | None = None, one_per_instant: bool = True) -> MinuteBackfillResult:
    """Fetch and merge what no earlier run covered. A range that gave no bars is covered too. client needs fetch_minute_bars().

    Of a job's bars of one ticker and instant the last is kept, or, without one_per_instant, all.
    """
    archive.require()
    names = normalized_symbols(symbols)
    first, last = clock.as_date(start, "Start date"), clock.as_date(end, "End date")
    if first > last:
        raise ValueError("Start date must not be after end date")
    if feed not in FEEDS:
        raise ValueError("Feed must be iex, sip, or otc")
    if not 1 <= batch_size <= 200:
        raise ValueError("Batch size must be between 1 and 200")
    if not 1 <= chunk_days <= 31:
        raise ValueError("Chunk days must be between 1 and 31")
    spark = archive.spark
    grid = job_grid(spark.createDataFrame([(s,) for s in names], "ticker string"), first, last, chunk_days, feed)
    gaps: dict[date, set[str]] = {}
    for r in upsert.coverage_gaps(grid, archive.read("provider_minute_coverage")).collect():  # symbols times ranges asked for
        gaps.setdefault(r.start_date, set()).add(r.ticker)
    ranges = [(first + timedelta(days=k), min(first + timedelta(days=k + chunk_days - 1), last)) for k in range(0, (last - first).days + 1, chunk_days)]
    batches = [names[i : i + batch_size] for i in range(0, len(names), batch_size)]
    done = skipped = rows = position = 0
    updated: set[str] = set()
    for a, b in ranges:
        for batch in batches:
            position += 1
            missing = [s for s in batch if s in gaps.get(a, ())]
            merged = 0
            if missing:
                low, high = clock.day_bounds(a, b)
                bars = client.fetch_minute_bars(missing, start=low.isoformat(), end=high.isoformat(), feed=feed, batch_size=len(missing))
                merged, tickers = _merge_job(archive, spark, bars, missing, feed, a, b, one_per_instant)
                if hasattr(client, "forget"):
                    client.forget()  # pages saved for this job have been merged
                done, rows = done + 1, rows + merged
                updated |= tickers
            else:
                skipped += 1
            if progress:
                progress(MinuteBackfillProgress(position, len(ranges) * len(batches), a, b, len(missing or batch), merged, not missing))
    return MinuteBackfillResult(done, skipped, rows, len(updated))


def minute_archive_statistics(archive: Archive) -> dict[str, object]:
    """Added up from the runs' summaries; bars are read only where runs meet."""
    now = archive.require().snapshot()
    instant = lambda c: F.timestamp_micros(c)
    row = now.summaries("provider_minute_bars").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.countDistinct("ticker").alias("symbols"), instant(F.min("since")).alias("first_timestamp"), instant(F.max("until")).alias("last_timestamp")).first()
    covered = now.summaries("provider_minute_coverage").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    return {**row.asDict(), "coverage_records": covered, "database_bytes": archive.bytes()}
