"""Backward-looking features of intraday bars and the return of the next bar.

A ratio to a price of 0 is missing, or, where infinite values are asked for, what floating-point division gives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.clock import OPEN_SECOND
from tapeloom.functions.frames import ARCHIVE, Ratio, change, ewm, floating_ratio, full, so_far, trailing
from tapeloom.operators import blocks
from tapeloom.operators import indicators as ind

BASELINE = (
    "intrabar_return", "return_1", "return_4", "return_16", "range_pct", "close_location", "volume_ratio_20", "realized_volatility_20", "sma_ratio_20",
    "rsi_14", "bar_coverage", "minute_sin", "minute_cos",
)
TECHNICAL_ONLY = (
    "sma_ratio_50", "bollinger_percent_b", "bollinger_bandwidth", "macd_pct", "macd_signal_pct", "macd_histogram_pct", "atr_pct", "stochastic_k",
    "stochastic_d", "obv_pressure_4", "cmf_20", "vwap_distance", "trade_count_ratio_20",
)
FEATURE_SETS = {"baseline": BASELINE, "technical": BASELINE + TECHNICAL_ONLY}


def feature_columns(feature_set: str) -> tuple[str, ...]:
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"Feature set must be one of: {', '.join(FEATURE_SETS)}")
    return FEATURE_SETS[feature_set]


def _ratio(infinite: bool) -> Ratio:
    return floating_ratio if infinite else F.try_divide


def _baseline_back(w: WindowSpec, minutes: int, ratio: Ratio) -> dict[str, Column]:
    """The baseline features that only look back some rows, but for the volatility of return_1."""
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    progress = 2 * math.pi * ((F.hour("timestamp") * 60 + F.minute("timestamp")) - OPEN_SECOND // 60) / F.lit(390.0)
    return {
        "intrabar_return": ratio(c, o) - 1, "return_1": change(c, w, 1, ratio), "return_4": change(c, w, 4, ratio), "return_16": change(c, w, 16, ratio),
        "range_pct": ratio(h - low, o), "close_location": F.try_divide(c - low, ind.nonzero(h - low)),
        "volume_ratio_20": F.try_divide(v, full(F.avg, v, w, 20)) - 1, "sma_ratio_20": ratio(c, ind.sma(c, w, 20)) - 1,
        "bar_coverage": F.col("source_minutes") / F.lit(float(minutes)), "minute_sin": F.sin(progress), "minute_cos": F.cos(progress),
    }


def _volatility(w: WindowSpec) -> Column:
    return full(F.stddev_pop, F.col("return_1"), w, 20)


def _technical_back(w: WindowSpec, ratio: Ratio) -> dict[str, Column]:
    """The further features that only look back some rows, and _k, of which stochastic_k and stochastic_d are made."""
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    band = ind.bollinger(c, w)
    return {
        "sma_ratio_50": ratio(c, ind.sma(c, w, 50)) - 1, "bollinger_percent_b": band["bollinger_percent_b"],
        "bollinger_bandwidth": F.try_divide(band["bollinger_upper"] - band["bollinger_lower"], band["bollinger_mid"]),
        "_k": ind.stochastic_k(c, low, h, w), "cmf_20": ind.chaikin_money_flow(F.col("_flow"), v, w),
        "vwap_distance": F.try_divide(c, F.col("vwap")) - 1, "trade_count_ratio_20": F.try_divide(F.col("trade_count"), full(F.avg, F.col("trade_count"), w, 20)) - 1,
    }


def _stochastics(w: WindowSpec) -> dict[str, Column]:
    return {"stochastic_k": F.col("_k") / 100, "stochastic_d": full(F.avg, F.col("_k"), w, 3) / 100}


def _by_price(ratio: Ratio) -> dict[str, Column]:
    c, macd, signal = (F.col(x) for x in ("close", "_macd", "_signal"))
    return {"macd_pct": ratio(macd, c), "macd_signal_pct": ratio(signal, c), "macd_histogram_pct": ratio(macd - signal, c), "atr_pct": ratio(F.col("_atr"), c)}


def add_baseline(bars: DataFrame, minutes: int, infinite: bool = False) -> DataFrame:
    """The thirteen baseline features. Windows run over an instrument's whole history, across sessions."""
    w = ARCHIVE.series()
    rows = ind.with_steps(bars, ARCHIVE).withColumns({**_baseline_back(w, minutes, _ratio(infinite)), "rsi_14": ind.rsi(F.col("_gain"), F.col("_loss"), w)})
    return rows.withColumn("realized_volatility_20", _volatility(w))


def add_technical(rows: DataFrame, infinite: bool = False) -> DataFrame:
    """The thirteen further features, normalised by price or volume; rows is from add_baseline()."""
    w, c = ARCHIVE.series(), F.col("close")
    rows = rows.withColumns({
        **_technical_back(w, _ratio(infinite)), "_macd": ewm(c, 2 / 13, w) - ewm(c, 2 / 27, w), "_atr": ewm(F.col("_range"), 1 / 14, w, 14), "_obv": F.sum("_signed").over(so_far(w)),
    })
    rows = rows.withColumns({
        "_signal": ewm(F.col("_macd"), 2 / 10, w), **_stochastics(w),
        "obv_pressure_4": F.try_divide(F.col("_obv") - F.lag("_obv", 4).over(w), full(F.sum, F.col("volume"), w, 4)),
    })
    return rows.withColumns(_by_price(_ratio(infinite)))


def add_target(rows: DataFrame, minutes: int, infinite: bool = False) -> DataFrame:
    """future_return: the next bar's close over its open, if it follows at once and ends by 16:00 of the same session."""
    w = ARCHIVE.series("session_date")
    following = F.lead("timestamp").over(w)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    close_at = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(16))
    adjacent = (following == F.col("timestamp") + step) & (following + step <= close_at)
    return rows.withColumn("future_return", F.when(adjacent, _ratio(infinite)(F.lead("close").over(w), F.lead("open").over(w)) - 1))


def research_features(bars: DataFrame, minutes: int, infinite: bool = False) -> DataFrame:
    """Bars, all 26 features and the target."""
    rows = add_target(add_technical(add_baseline(bars, minutes, infinite), infinite), minutes, infinite)
    return rows.select(*bars.columns, *FEATURE_SETS["technical"], "future_return")


def research_features_in_blocks(bars: DataFrame, minutes: int, block_rows: int = blocks.BLOCK_ROWS, infinite: bool = False) -> DataFrame:
    """The same columns for instruments of any length: a history is cut into blocks of time, each a task's work (see blocks).

    The target looks ahead, but within one session only, and is made before the cut.
    """
    rows, own = blocks.in_blocks(add_target(bars, minutes, infinite), ARCHIVE, block_rows)
    w, c, signed = own.series(), F.col("close").cast("double"), F.col("_signed")
    rows = ind.with_steps(rows, own).withColumns({**_baseline_back(w, minutes, _ratio(infinite)), **_technical_back(w, _ratio(infinite))})
    four = trailing(w, 4)
    rows = rows.withColumns({
        **_stochastics(w), "realized_volatility_20": _volatility(w), "_volume_4": full(F.sum, F.col("volume"), w, 4),
        "_signed_4": F.coalesce(F.sum(signed).over(four), F.lit(0.0)), "_count_4": F.count(signed).over(four),
    })
    rows = blocks.scanned(rows, {
        "_up": blocks.Mean(F.col("_gain"), 1 / 14, 14), "_down": blocks.Mean(F.col("_loss"), 1 / 14, 14), "_fast": blocks.Mean(c, 2 / 13), "_slow": blocks.Mean(c, 2 / 27),
        "_atr": blocks.Mean(F.col("_range"), 1 / 14, 14), "_count": blocks.Total(F.when(signed.isNotNull(), 1.0)),
        "_signal": blocks.MeanOfSpread(c, 2 / 13, 2 / 27, 2 / 10),
    }, own)
    # the on-balance volume of four rows before is there if a value came before the last four
    rows = rows.withColumns({
        "rsi_14": ind.strength(F.col("_up"), F.col("_down")), "_macd": F.col("_fast") - F.col("_slow"),
        "obv_pressure_4": F.when(F.col("_count") > F.col("_count_4"), F.try_divide(F.col("_signed_4"), F.col("_volume_4"))),
    })
    return rows.withColumns(_by_price(_ratio(infinite))).select(*bars.columns, *FEATURE_SETS["technical"], "future_return")
