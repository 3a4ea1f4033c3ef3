"""Reading an archive: statistics, symbols, one instrument's daily prices, where an update starts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.clock import as_date
from tapeloom.plans.catalog import Archive
from tapeloom.sources.legacy import ticker_of
from tapeloom.sources.provider import normalized_symbols


def archive_statistics(archive: Archive) -> dict[str, object]:
    """Added up from the runs' summaries; daily bars are read only where runs meet."""
    now = archive.require().snapshot()
    day = lambda c: F.date_from_unix_date(c.cast("int"))
    daily = now.summaries("daily_prices").agg(F.countDistinct("ticker").alias("symbols"), F.coalesce(F.sum("rows"), F.lit(0)).alias("daily_rows"), day(F.min("since")).alias("first_date"), day(F.max("until")).alias("last_date"))
    return {**daily.first().asDict(), "raw_rows": sum(e.rows for e in now.entries("prices")), "database_bytes": archive.bytes()}


def list_archive_symbols(archive: Archive) -> list[str]:
    return [r.ticker for r in archive.require().read("symbol_summary").select("ticker").orderBy("ticker").collect()]


def next_update_start(archive: Archive, symbols: list[str]) -> str:
    """The day after the oldest last date of the symbols."""
    wanted = normalized_symbols(symbols)
    summary = archive.require().read("symbol_summary").where(F.col("ticker").isin(wanted))
    found = summary.agg(F.collect_set("ticker").alias("have"), F.min("last_date").alias("oldest")).first()  # of the symbols asked for
    if missing := sorted(set(wanted) - set(found.have)):
        raise ValueError("Provide --start when adding symbols not already in the archive: " + ", ".join(missing))
    return (found.oldest + timedelta(days=1)).isoformat()


def load_daily_prices(archive: Archive, ticker: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date (midnight UTC), Open, High, Low, Close, Volume of one instrument in order; dates are inclusive and cut before any indicator sees the rows."""
    archive.require()
    name = ticker.strip().upper()
    if not ticker_of(f"CurrentData({name}).csv"):
        raise ValueError("Ticker contains unsupported characters")
    rows = archive.read("daily_prices", [name], as_date(start or None, "Start date"), as_date(end or None, "End date"))
    out = rows.select(F.col("trading_date").cast("timestamp").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    if out.isEmpty():
        raise ValueError(f"No daily prices found for ticker {name}")
    return out.orderBy("Date")
