"""Technical indicators of all instruments at once.

Work goes in stages of plain columns and windows. All windows of all stages partition by instrument and order by time, so Spark plans
one exchange and one sort for the whole set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.frames import ANALYSIS, Names, ewm, full, so_far
from tapeloom.operators import blocks
from tapeloom.operators.validate import require_columns

INDICATORS = (
    "sma_20", "sma_50", "bollinger_mid", "bollinger_upper", "bollinger_lower", "bollinger_percent_b", "rsi_14", "macd", "macd_signal",
    "macd_histogram", "atr_14", "stochastic_k", "stochastic_d", "obv", "cmf_20",
)


def sma(value: Column, w: WindowSpec, rows: int) -> Column:
    return full(F.avg, value, w, rows)


def nonzero(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def bollinger(close: Column, w: WindowSpec, rows: int = 20, deviations: float = 2.0) -> dict[str, Column]:
    """Middle, upper and lower band (population deviation) and the place of the close between them."""
    return bands(close, full(F.avg, close, w, rows), full(F.stddev_pop, close, w, rows), deviations)


def bands(close: Column, mid: Column, dev: Column, deviations: float = 2.0) -> dict[str, Column]:
    upper, lower = mid + deviations * dev, mid - deviations * dev
    return {"bollinger_mid": mid, "bollinger_upper": upper, "bollinger_lower": lower, "bollinger_percent_b": F.try_divide(close - lower, nonzero(upper - lower))}


def gains_and_losses(step: Column) -> tuple[Column, Column]:
    """Positive parts of a step and of its opposite; null where the step is."""
    return F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))


def rsi(gain: Column, loss: Column, w: WindowSpec, period: int = 14) -> Column:
    """Wilder's relative strength index. Without losses it is 100, without any movement 50."""
    return strength(ewm(gain, 1 / period, w, period), ewm(loss, 1 / period, w, period))


def strength(up: Column, down: Column) -> Column:
    return F.when((down == 0) & (up > 0), 100.0).when((down == 0) & (up == 0), 50.0).otherwise(100 - 100 / (1 + F.try_divide(up, nonzero(down))))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def stochastic_k(close: Column, low: Column, high: Column, w: WindowSpec, period: int = 14) -> Column:
    lowest, highest = full(F.min, low, w, period), full(F.max, high, w, period)
    return F.try_divide(100 * (close - lowest), nonzero(highest - lowest))


def flow_multiplier(close: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.try_divide(2 * close - low - high, nonzero(high - low)), F.lit(0.0))


def chaikin_money_flow(flow: Column, volume: Column, w: WindowSpec, period: int = 20) -> Column:
    return F.try_divide(full(F.sum, flow, w, period), nonzero(full(F.sum, volume, w, period)))


def with_steps(bars: DataFrame, names: Names) -> DataFrame:
    """First stage: what the windows of the next stage run over."""
    w = names.series()
    o, h, low, c, v = (F.col(x).cast("double") for x in (names.open, names.high, names.low, names.close, names.volume))
    rows = bars.withColumn("_previous", F.lag(c).over(w))
    gain, loss = gains_and_losses(c - F.col("_previous"))
    return rows.withColumns({
        "_gain": gain, "_loss": loss, "_range": true_range(h, low, F.col("_previous")),
        "_signed": F.coalesce(F.signum(c - F.col("_previous")), F.lit(0.0)) * v, "_flow": flow_multiplier(c, low, h) * v,
    })


def _checked(bars: DataFrame, names: Names) -> None:
    if names.key is None and "ticker" in bars.columns:
        raise ValueError("The table has a ticker column: give names with key='ticker'")
    require_columns(bars.columns, [names.open, names.high, names.low, names.close, names.volume], "Missing required price columns")


def _trailing(names: Names) -> dict[str, Column]:
    """What only looks back some rows."""
    w = names.series()
    c, low, h, v = (F.col(x).cast("double") for x in (names.close, names.low, names.high, names.volume))
    return {"sma_20": sma(c, w, 20), "sma_50": sma(c, w, 50), **bollinger(c, w), "stochastic_k": stochastic_k(c, low, h, w), "cmf_20": chaikin_money_flow(F.col("_flow"), v, w)}


def add_indicators(bars: DataFrame, names: Names = ANALYSIS) -> DataFrame:
    """bars and the INDICATORS. A table of many tickers needs names with a key: as one series it would be mixed up, and one task's work."""
    _checked(bars, names)
    w, c = names.series(), F.col(names.close).cast("double")
    rows = with_steps(bars, names).withColumns({
        **_trailing(names), "rsi_14": rsi(F.col("_gain"), F.col("_loss"), w), "macd": ewm(c, 2 / 13, w) - ewm(c, 2 / 27, w), "atr_14": ewm(F.col("_range"), 1 / 14, w, 14),
        "obv": F.sum("_signed").over(so_far(w)),
    })
    rows = rows.withColumns({"macd_signal": ewm(F.col("macd"), 2 / 10, w), "stochastic_d": full(F.avg, F.col("stochastic_k"), w, 3)})
    return rows.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).select(*bars.columns, *INDICATORS)


def add_indicators_in_blocks(bars: DataFrame, names: Names = ANALYSIS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """The same columns for instruments of any length: a history is cut into blocks of time, each a task's work (see blocks)."""
    rows, _ = indicator_blocks(bars, names, block_rows)
    return rows.select(*bars.columns, *INDICATORS)


def indicator_blocks(bars: DataFrame, names: Names, block_rows: int) -> tuple[DataFrame, Names]:
    """bars in blocks of time, without halos, with the INDICATORS; and names whose windows stay within blocks."""
    _checked(bars, names)
    rows, own = blocks.in_blocks(bars, names, block_rows)
    c, low, h, v = (F.col(x).cast("double") for x in (names.close, names.low, names.high, names.volume))
    rows = with_steps(rows, own).withColumn("stochastic_k", stochastic_k(c, low, h, own.series()))
    rows = rows.withColumn("stochastic_d", full(F.avg, F.col("stochastic_k"), own.series(), 3))
    rows = blocks.scanned(rows, {
        "_up": blocks.Mean(F.col("_gain"), 1 / 14, 14), "_down": blocks.Mean(F.col("_loss"), 1 / 14, 14), "_fast": blocks.Mean(c, 2 / 13), "_slow": blocks.Mean(c, 2 / 27),
        "atr_14": blocks.Mean(F.col("_range"), 1 / 14, 14), "obv": blocks.Total(F.col("_signed")), "macd_signal": blocks.MeanOfSpread(c, 2 / 13, 2 / 27, 2 / 10),
    }, own, {
        "sma_20": blocks.Trailing(c, 20, "avg"), "sma_50": blocks.Trailing(c, 50, "avg"), "_dev": blocks.Trailing(c, 20, "stddev_pop"),
        "_flow_20": blocks.Trailing(F.col("_flow"), 20, "sum"), "_volume_20": blocks.Trailing(v, 20, "sum"),
    })
    rows = rows.withColumns({**bands(c, F.col("sma_20"), F.col("_dev")), "cmf_20": F.try_divide(F.col("_flow_20"), nonzero(F.col("_volume_20")))})
    rows = rows.withColumns({"rsi_14": strength(F.col("_up"), F.col("_down")), "macd": F.col("_fast") - F.col("_slow")})
    rows = rows.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return rows.select(*bars.columns, *INDICATORS, blocks.PLACE, blocks.BLOCK, blocks.IS_HALO), own
