"""Replacing and appending rows by key: what is in the batch wins, the rest of the target stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.clock import market_date
from tapeloom.operators.bars import symbol_summary


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], match: Column | None = None) -> DataFrame:
    """target without the keys of batch, and batch."""
    kept = target.join(batch.select(*keys).distinct(), list(keys), "left_anti") if match is None else target.join(batch, match, "left_anti")
    return kept.select(*target.columns).unionByName(batch.select(*target.columns))


def provider_as_daily(batch: DataFrame) -> DataFrame:
    """Provider daily bars in the shape of the curated daily table."""
    return batch.select("ticker", market_date(F.col("timestamp")).alias("trading_date"), "open", "high", "low", "close", F.col("close").alias("adjusted_close"), "volume", F.lit(1).cast("long").alias("source_rows"))


def refreshed_summary(summary: DataFrame, daily: DataFrame, touched: DataFrame) -> DataFrame:
    """summary with the rows of touched tickers computed again from daily."""
    fresh = symbol_summary(daily.join(touched, "ticker", "left_semi"))
    return summary.join(touched, "ticker", "left_anti").select(*fresh.columns).unionByName(fresh)


def coverage_gaps(jobs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Jobs (ticker, feed, start_date, end_date) that no coverage record of exactly this range answers."""
    return jobs.join(coverage, ["ticker", "feed", "start_date", "end_date"], "left_anti")
