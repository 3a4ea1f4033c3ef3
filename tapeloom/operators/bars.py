"""Deduplication and resampling of bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import clock

INTERVALS = (5, 15, 60)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    return keep_first(rows, keys, [c.desc() for c in order])


def daily_bars(prices: DataFrame, order: Column | None = None) -> DataFrame:
    """One bar for each ticker and New York date. Partial aggregation leaves one row per ticker, date and task to shuffle.

    order tells rows of one instant apart; prices normally has one row per ticker and timestamp.
    """
    at = F.col("timestamp") if order is None else order
    adjusted = F.max_by("adjusted_close", at) if "adjusted_close" in prices.columns else F.max_by("close", at)
    return prices.groupBy("ticker", clock.market_date(F.col("timestamp")).alias("trading_date")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        adjusted.alias("adjusted_close"), F.sum("volume").alias("volume"), F.count("*").alias("source_rows"),
    )


def symbol_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy("ticker").agg(
        F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("*").alias("trading_days"), F.sum("source_rows").alias("source_rows")
    )


def session_minutes(minutes: DataFrame, feed: str | None = None, start=None, end=None) -> DataFrame:
    """Minute rows of regular sessions with their local time; start and end are inclusive New York dates.

    The date range is also given as instants, which reach the Parquet scan.
    """
    rows = minutes if feed is None else minutes.where(F.col("feed") == feed)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(clock.day_bounds(start, start)[0]))
    if end is not None:
        rows = rows.where(F.col("timestamp") < F.lit(clock.day_bounds(end, end)[1]))
    rows = rows.withColumn("local", clock.market_time(F.col("timestamp")))
    return rows.where(clock.in_regular_session(F.col("local")))


def intraday_bars(session: DataFrame, minutes: int) -> DataFrame:
    """Bars of `minutes` minutes, anchored at the half hour, from session_minutes(). timestamp is local wall-clock time."""
    if minutes not in INTERVALS:
        raise ValueError(f"Interval must be one of: {', '.join(map(str, INTERVALS))}")
    bucket = F.window("local", f"{minutes} minutes", f"{minutes} minutes", f"{30 % minutes} minutes")
    bars = session.groupBy("ticker", bucket.alias("_bucket"), F.col("local").cast("date").alias("session_date")).agg(
        F.min_by("open", "local").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "local").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
        F.try_divide(F.sum(F.coalesce("vwap", "close") * F.col("volume")), F.sum("volume")).alias("vwap"), F.count("*").alias("source_minutes"),
    )
    return bars.select("ticker", F.col("_bucket.start").alias("timestamp"), *bars.columns[2:])
