"""Feature tables of an archive."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.clock import as_date, day_bounds
from tapeloom.operators import bars, features
from tapeloom.plans.catalog import Archive, Upsert
from tapeloom.shared import written
from tapeloom.sources.provider import FEEDS


@dataclass(frozen=True)
class ResearchDatasetResult:
    interval_minutes: int
    bars: int
    feature_ready_rows: int
    technical_ready_rows: int
    symbols: int
    sessions: int
    first_session: date
    last_session: date
    table: str


def table_name(minutes: int) -> str:
    if minutes not in bars.INTERVALS:
        raise ValueError(f"Interval must be one of: {', '.join(map(str, bars.INTERVALS))}")
    return f"research_features_{minutes}m"


def _ready(columns: tuple[str, ...]) -> Column:
    ready = F.col("future_return").isNotNull()
    for c in columns:
        ready = ready & F.col(c).isNotNull()
    return ready


def summary(featured: DataFrame) -> DataFrame:
    """Counts of a feature table, in one aggregation."""
    return featured.agg(
        F.count("*").alias("bars"), F.count_if(_ready(features.BASELINE)).alias("feature_ready_rows"), F.count_if(_ready(features.FEATURE_SETS["technical"])).alias("technical_ready_rows"),
        F.countDistinct("ticker").alias("symbols"), F.countDistinct("session_date").alias("sessions"), F.min("session_date").alias("first_session"), F.max("session_date").alias("last_session"),
    )


def build_research_dataset(archive: Archive, *, interval_minutes: int = 15, feed: str = "sip", start: str | None = None, end: str | None = None) -> ResearchDatasetResult:
    """Write the feature table of one interval and its metadata row, in one commit."""
    archive.require()
    table = table_name(interval_minutes)
    if feed not in FEEDS:
        raise ValueError("Feed must be iex, sip, or otc")
    first, last = as_date(start, "Start date"), as_date(end, "End date")
    if first and last and first > last:
        raise ValueError("Start date must not be after end date")
    if not archive.has("provider_minute_bars"):
        raise ValueError("The archive does not contain one-minute provider bars")
    since, until = first and day_bounds(first, first)[0], last and day_bounds(last, last)[1]
    session = bars.session_minutes(archive.read("provider_minute_bars", since=since, until=until), feed, first, last)
    featured = written(features.research_features(bars.intraday_bars(session, interval_minutes), interval_minutes), "features")
    found = summary(featured).first()
    if not found["bars"]:
        raise ValueError("No regular-session minute bars matched the requested selection")
    row = archive.spark.range(1).select(F.lit(interval_minutes).alias("interval_minutes"), F.lit(feed).alias("feed"), F.lit(found["first_session"]).alias("start_date"), F.lit(found["last_session"]).alias("end_date"), F.lit(found["bars"]).alias("bar_count"), F.current_timestamp().alias("built_at"))
    # rows sorted within files take the place of an index: row groups hold narrow ranges
    order = ("ticker", "session_date", "timestamp")
    archive.commit({table: featured.repartitionByRange(*order).sortWithinPartitions(*order), "research_dataset_metadata": Upsert(row)})
    return ResearchDatasetResult(interval_minutes, *[found[c] for c in ("bars", "feature_ready_rows", "technical_ready_rows", "symbols", "sessions", "first_session", "last_session")], table)


def load_research_dataset(archive: Archive, *, interval_minutes: int = 15) -> DataFrame:
    archive.require()
    table = table_name(interval_minutes)
    if not archive.has(table):
        raise ValueError(f"Research dataset {table} has not been built; run research-build first")
    return archive.read(table).orderBy("timestamp", "ticker")
