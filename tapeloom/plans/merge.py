"""Merging provider bars into an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import upsert, validate
from tapeloom.plans.catalog import Append, Archive, Upsert


def log_rows(batch: DataFrame) -> DataFrame:
    """One row per feed with its time range; row and symbol counts are those of the whole batch."""
    total = batch.agg(F.count("*").alias("rows_merged"), F.countDistinct("ticker").alias("symbols_updated"))
    return batch.groupBy("feed").agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")).crossJoin(F.broadcast(total))


def merge_provider_daily_bars(archive: Archive, bars: DataFrame) -> dict[str, int]:
    """Keep provider bars in a table of their own, and let them replace the same symbol and New York date of the daily table.

    bars is read once, into the archive's landing folder; what is checked is what is merged. All tables change in one commit, which writes the batch's rows
    and nothing else. Two provider bars of one date both go into the daily table. Merges may run at the same time: all survive, the later counts.
    """
    archive.require()
    validate.require_columns(bars.columns, validate.PROVIDER_COLUMNS, "Missing provider columns")
    with archive.landed(bars) as landed:
        batch = validate.provider_bars(landed)
        counts = batch.agg(F.count("*").alias("rows_merged"), F.countDistinct("ticker").alias("symbols_updated")).first()
        if counts.rows_merged:
            archive.commit({
                "provider_daily_bars": Upsert(batch.withColumn("fetched_at", F.current_timestamp())),
                "daily_prices": Upsert(upsert.provider_as_daily(batch)),
                "provider_update_log": Append(log_rows(batch).withColumn("updated_at", F.current_timestamp()).select("updated_at", "feed", "first_timestamp", "last_timestamp", "rows_merged", "symbols_updated")),
            })
    return counts.asDict()
