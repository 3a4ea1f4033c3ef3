"""Row checks: a classifier that names what is wrong with each row, and checks that fail on a bad table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tried.
REASONS = ("missing_or_invalid_value", "non_positive_price", "negative_volume", "inconsistent_high", "inconsistent_low")


def rejection_reason(time: str = "timestamp") -> Column:
    """The first reason that applies to a bar, or null."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = F.lit(False)
    for name in (time, "open", "high", "low", "close", "volume"):
        missing = missing | F.col(name).isNull()
    for x in (o, h, low, c, v):
        missing = missing | F.isnan(x)
    return (
        F.when(missing, REASONS[0])
        .when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), REASONS[1])
        .when(v < 0, REASONS[2])
        .when(h < F.greatest(o, low, c), REASONS[3])
        .when(low > F.least(o, h, c), REASONS[4])
    )


def classify(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", rejection_reason())


def rejection_counts(classified: DataFrame, keys: Sequence[str] = ("source_file", "ticker")) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.count("*").alias("rejected_rows"))


def require_columns(names: Sequence[str], required: Sequence[str], message: str) -> None:
    if missing := sorted(set(required) - set(names)):
        raise ValueError(f"{message}: {', '.join(missing)}")


def raise_first(rows: DataFrame, checks: Sequence[tuple[Column, str]]) -> int:
    """Count all checks in one pass over rows and raise the message of the first that any row fails. Returns the number of rows."""
    counts = rows.agg(F.count("*"), *[F.count_if(bad) for bad, _ in checks]).first()
    for n, (_, message) in zip(counts[1:], checks):
        if n:
            raise ValueError(message)
    return counts[0]


PROVIDER_COLUMNS = ("ticker", "timestamp", "open", "high", "low", "close", "volume", "trade_count", "vwap", "feed")


def provider_bars(bars: DataFrame, feed: str | None = None, one_per_instant: bool = True) -> DataFrame:
    """Provider bars with tickers in upper case, typed, checked as a whole, and the last input row kept for equal keys, or, without one_per_instant, all.

    A null ticker is a missing value. Rows are ordered by _arrival, or, without that column, by their arrival in bars, as far as Spark knows it.
    """
    require_columns(bars.columns, PROVIDER_COLUMNS, "Missing provider columns")
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")).alias(c)
    rows = bars.select(
        F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), F.col("timestamp").try_cast("timestamp").alias("timestamp"),
        *[number(c) for c in ("open", "high", "low", "close", "volume", "trade_count", "vwap")], F.col("feed").cast("string").alias("feed"),
        F.col("_arrival") if "_arrival" in bars.columns else F.monotonically_increasing_id().alias("_arrival"),
    )
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = F.lit(False)
    for name in ("ticker", "timestamp", "open", "high", "low", "close", "volume", "feed"):
        missing = missing | F.col(name).isNull()
    checks = [(missing, "Provider bars contain missing or invalid required values")]
    if feed is not None:
        checks.append((~F.col("feed").eqNullSafe(feed), "Provider bars do not match the requested feed"))
    checks += [
        ((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "Provider bars contain non-positive prices"),
        (F.col("volume") < 0, "Provider bars contain negative volume"),
        (h < F.greatest(o, low, c), "Provider bars contain an inconsistent high price"),
        (low > F.least(o, h, c), "Provider bars contain an inconsistent low price"),
    ]
    raise_first(rows, checks)
    if not one_per_instant:
        return rows.drop("_arrival")
    from tapeloom.operators.bars import keep_last

    keys = ["ticker", "timestamp"] if feed is None else ["feed", "ticker", "timestamp"]
    return keep_last(rows, keys, [F.col("_arrival")]).drop("_arrival")
