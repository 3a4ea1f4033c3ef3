"""Component scores, their sum, and Buy, Hold or Sell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.frames import ANALYSIS, Names
from tapeloom.operators import blocks
from tapeloom.operators.indicators import add_indicators, indicator_blocks
from tapeloom.operators.validate import require_columns


def _graded(value: Column, low: float, lower: float, high: float, higher: float) -> Column:
    """2 below low, 1 below lower, -2 above higher, -1 above high, else 0; missing values score 0."""
    return F.when(value < low, 2).when(value < lower, 1).when(value > higher, -2).when(value > high, -1).otherwise(0)


def component_scores(close: Column, previous_histogram: Column) -> dict[str, Column]:
    hist = F.col("macd_histogram")
    return {
        "score_bollinger": _graded(F.col("bollinger_percent_b"), 0.0, 0.2, 0.8, 1.0),
        "score_rsi": _graded(F.col("rsi_14"), 30.0, 40.0, 60.0, 70.0),
        "score_macd": F.when((hist > 0) & (previous_histogram <= 0), 2).when((hist < 0) & (previous_histogram >= 0), -2).when(hist > 0, 1).when(hist < 0, -1).otherwise(0),
        "score_stochastic": F.when(F.col("stochastic_k") < 20, 1).when(F.col("stochastic_k") > 80, -1).otherwise(0),
        "score_money_flow": F.when(F.col("cmf_20") > 0.10, 1).when(F.col("cmf_20") < -0.10, -1).otherwise(0),
        "score_trend": F.when(close > F.col("sma_50"), 1).when(close < F.col("sma_50"), -1).otherwise(0),
    }


def add_signal_scores(rows: DataFrame, names: Names = ANALYSIS) -> DataFrame:
    """Add the six scores, signal_score and signal. Any column named score_... that rows already has counts too.

    The label stays Hold until all seven inputs are there; the score is not held back.
    """
    needed = [names.close, "sma_50", "bollinger_percent_b", "rsi_14", "macd_histogram", "stochastic_k", "cmf_20"]
    require_columns(rows.columns, needed, "Missing required indicator columns")
    return _scored(rows.withColumn("_before", F.lag("macd_histogram").over(names.series())), names, needed)


def _scored(out: DataFrame, names: Names, needed: list[str]) -> DataFrame:
    scores = component_scores(F.col(names.close), F.col("_before"))
    out = out.withColumns({k: v.cast("long") for k, v in scores.items()}).drop("_before")
    total = F.lit(0).cast("long")
    for name in out.columns:
        if name.startswith("score_"):
            total = total + F.coalesce(F.col(name), F.lit(0))
    warm = F.lit(True)
    for name in needed:
        warm = warm & F.col(name).isNotNull()
    out = out.withColumn("signal_score", total)
    return out.withColumn("signal", F.when(warm & (F.col("signal_score") >= 3), "Buy").when(warm & (F.col("signal_score") <= -3), "Sell").otherwise("Hold"))


def analyze_prices(bars: DataFrame, names: Names = ANALYSIS) -> DataFrame:
    """Indicators and signals of all instruments."""
    return bars.transform(add_indicators, names).transform(add_signal_scores, names)


def analyze_prices_in_blocks(bars: DataFrame, names: Names = ANALYSIS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """The same for instruments of any length, in blocks of time."""
    return blocks.without_blocks(signal_blocks(bars, names, block_rows)[0])


def signal_blocks(bars: DataFrame, names: Names, block_rows: int) -> tuple[DataFrame, Names]:
    """Indicators and signals in blocks of time, without halos; and names whose windows stay within blocks."""
    rows, own = indicator_blocks(bars, names, block_rows)
    needed = [names.close, "sma_50", "bollinger_percent_b", "rsi_14", "macd_histogram", "stochastic_k", "cmf_20"]
    return _scored(blocks.earlier(rows, {"_before": ("macd_histogram", 1)}, own, block_rows), names, needed), own
