"""Indicators against pandas, series by series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.frames import ANALYSIS, Names, ewm, ewm_by_fold
from tapeloom.operators import indicators, signals

NAMES = Names(key="ticker", time="t", open="open", high="high", low="low", close="close", volume="volume")


def series(seed, n, flat=()):
    g = np.random.default_rng(seed)
    close = 100 + np.cumsum(g.normal(0, 1, n))
    for a, b in flat:
        close[a:b] = close[a]
    wide = np.where(np.isin(np.arange(n), [i for a, b in flat for i in range(a, b)]), 0, g.uniform(0.1, 2, n))
    return pd.DataFrame({"ticker": f"T{seed}", "t": range(n), "open": close, "high": close + wide, "low": close - wide, "close": close, "volume": g.integers(0, 100, n).astype(float)})


@pytest.fixture(scope="module")
def found(spark):
    frames = [series(1, 150), series(2, 90, [(0, 40)]), series(3, 120, [(60, 110)]), series(4, 1), series(5, 20)]
    prices = pd.concat(frames)
    return {t: x.sort_values("t").reset_index(drop=True) for t, x in indicators.add_indicators(spark.createDataFrame(prices), NAMES).toPandas().groupby("ticker")}


def close_to(a, b):
    assert np.array_equal(np.isnan(a.astype(float)), np.isnan(b.astype(float)))
    np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9)


def test_rolling_and_ewm_match_pandas(found):
    for x in found.values():
        c = x["close"]
        close_to(x["sma_20"], c.rolling(20, min_periods=20).mean())
        close_to(x["sma_50"], c.rolling(50, min_periods=50).mean())
        close_to(x["bollinger_upper"], c.rolling(20, min_periods=20).mean() + 2 * c.rolling(20, min_periods=20).std(ddof=0))
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        close_to(x["macd"], macd)
        close_to(x["macd_signal"], macd.ewm(span=9, adjust=False).mean())
        step = c.diff()
        up, down = (v.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for v in (step.clip(lower=0), -step.clip(upper=0)))
        rsi = (100 - 100 / (1 + up / down.replace(0, np.nan))).mask((down == 0) & (up > 0), 100.0).mask((down == 0) & (up == 0), 50.0)
        close_to(x["rsi_14"], rsi)
        before = c.shift(1)
        true = pd.concat([x["high"] - x["low"], (x["high"] - before).abs(), (x["low"] - before).abs()], axis=1).max(axis=1)
        close_to(x["atr_14"], true.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean())
        close_to(x["obv"], (np.sign(step).fillna(0) * x["volume"]).cumsum())
        low, high = x["low"].rolling(14, min_periods=14).min(), x["high"].rolling(14, min_periods=14).max()
        k = 100 * (c - low) / (high - low).replace(0, np.nan)
        close_to(x["stochastic_k"], k)
        close_to(x["stochastic_d"], k.rolling(3, min_periods=3).mean())
        m = ((2 * c - x["low"] - x["high"]) / (x["high"] - x["low"]).replace(0, np.nan)).fillna(0) * x["volume"]
        close_to(x["cmf_20"], m.rolling(20, min_periods=20).sum() / x["volume"].rolling(20, min_periods=20).sum().replace(0, np.nan))


def test_constant_series_has_zero_macd(found):
    assert (found["T2"]["macd_histogram"][:40] == 0).all()


def test_known_values(spark):
    close = spark.createDataFrame([(i, float(i + 1)) for i in range(39)], "Date int, Close double").withColumns({n: F.col("Close") for n in ("Open", "High", "Low")}).withColumn("Volume", F.lit(1.0))
    x = indicators.add_indicators(close).orderBy("Date").toPandas()
    assert x["bollinger_mid"][29] == pytest.approx(20.5)
    assert x["rsi_14"][38] == 100.0 and x["rsi_14"].notna().idxmax() == 14
    obv = spark.createDataFrame([(0, 10.0, 100.0), (1, 11.0, 200.0), (2, 10.0, 50.0), (3, 10.0, 400.0)], "Date int, Close double, Volume double").withColumns({n: F.col("Close") for n in ("Open", "High", "Low")})
    assert indicators.add_indicators(obv).orderBy("Date").toPandas()["obv"].tolist() == [0, 200, 150, 150]


def test_fold_agrees_with_native(spark):
    rows = spark.createDataFrame([(1, i, None if i % 7 == 3 or i < 2 else float(np.sin(i) * 50)) for i in range(300)], "k int, t int, x double")
    w = Names(key="k", time="t").series()
    out = rows.select("t", ewm(F.col("x"), 1 / 14, w, 5).alias("a"), ewm_by_fold(F.col("x"), 1 / 14, w, 5).alias("b")).toPandas()
    close_to(out["a"], out["b"])


def test_one_exchange_and_no_python(spark):
    rows = spark.createDataFrame(series(1, 60))
    plan = signals.analyze_prices(rows.repartition(3), NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="Missing required price columns"):
        indicators.add_indicators(spark.range(1), ANALYSIS)


def test_indicators_without_the_private_mean(spark, monkeypatch):
    """The public fold gives the same indicators as Spark's own weighted mean."""
    from tapeloom.functions import frames

    frame = spark.createDataFrame(pd.concat([series(6, 120), series(7, 60, [(10, 30)])]))
    want = indicators.add_indicators(frame, NAMES).orderBy("ticker", "t").toPandas()
    monkeypatch.setattr(frames, "weighted_mean", None)
    got = indicators.add_indicators(frame, NAMES).orderBy("ticker", "t").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="ticker column"):
        indicators.add_indicators(frame.toDF("ticker", "Date", "Open", "High", "Low", "Close", "Volume"))
