"""Series in blocks of time against one window over the whole series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import shared
from tapeloom.functions import frames
from tapeloom.functions.frames import Names
from tapeloom.operators import backtest, blocks, features, indicators, signals
from tests.test_indicators import NAMES, series

FLAT = [(100, 400), (600, 640)]


@pytest.fixture(scope="module")
def prices(spark):
    frames_ = [series(1, 1500, FLAT), series(2, 90, [(0, 90)]), series(3, 128), series(4, 1), series(5, 65), series(6, 500, [(0, 300)])]
    return spark.createDataFrame(pd.concat(frames_)).repartition(7)


def rows(df, columns):
    return df.select("ticker", "t", *columns).toPandas().sort_values(["ticker", "t"]).reset_index(drop=True)


def same(got, want, columns):
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].astype(float), want[c].astype(float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-8, err_msg=c)


def test_indicators_do_not_depend_on_blocks(spark, prices):
    want = rows(indicators.add_indicators(prices, NAMES), indicators.INDICATORS)
    for block_rows in (64, 1000):
        same(rows(indicators.add_indicators_in_blocks(prices, NAMES, block_rows), indicators.INDICATORS), want, indicators.INDICATORS)


def test_without_the_private_mean(prices, monkeypatch):
    want = rows(indicators.add_indicators(prices, NAMES), ("macd", "rsi_14", "macd_signal"))
    monkeypatch.setattr(frames, "weighted_mean", None)
    same(rows(indicators.add_indicators_in_blocks(prices, NAMES, 256), ("macd", "rsi_14", "macd_signal")), want, ("macd", "rsi_14", "macd_signal"))


def test_flat_series_have_no_macd_over_block_starts(prices):
    got = rows(indicators.add_indicators_in_blocks(prices, NAMES, 64), ("macd", "macd_histogram", "rsi_14"))
    flat = got[(got.ticker == "T2") | ((got.ticker == "T6") & (got.t < 300))]
    assert (flat.macd == 0).all() and (flat.macd_histogram == 0).all() and (flat.rsi_14.dropna() == 50).all()


def test_signals_and_backtest_do_not_depend_on_blocks(spark, prices):
    scored = signals.analyze_prices(prices, NAMES)
    got = signals.analyze_prices_in_blocks(prices, NAMES, 64)
    assert got.columns == scored.columns
    a, b = rows(got, ("signal", "signal_score")), rows(scored, ("signal", "signal_score"))
    assert a.equals(b) and set(a.signal) == {"Buy", "Hold", "Sell"}
    columns = ("action", "cash", "shares", "equity", "traded", "fee")
    for block_rows in (2, 64, 5000):
        same(rows(backtest.simulate_in_blocks(scored, names=NAMES, block_rows=block_rows), columns), rows(backtest.simulate(scored, names=NAMES), columns), columns)
    with pytest.raises(ValueError, match="less than"):
        backtest.simulate_in_blocks(scored, transaction_cost_bps=10_000, names=NAMES)


def test_research_features_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    tables = []
    for ticker, n in (("A", 700), ("B", 61), ("C", 3), (None, 150)):
        close = 50 + rng.normal(0, 1, n).cumsum().round(2) / 10
        day = pd.Timestamp("2026-01-05 09:30") + pd.to_timedelta(np.arange(n) // 26, "D") + pd.to_timedelta(np.arange(n) % 26 * 15, "min")
        tables.append(pd.DataFrame({
            "ticker": ticker, "timestamp": day, "session_date": day.date, "open": close - 0.1, "high": close + 0.3, "low": close - 0.4, "close": close,
            "volume": np.where(rng.random(n) < 0.1, 0.0, rng.integers(1, 900, n)), "trade_count": rng.integers(1, 50, n).astype(float), "vwap": close + 0.05, "source_minutes": 15,
        }))
    made = pd.concat(tables)
    made = made[rng.random(len(made)) > 0.05]
    bars = spark.createDataFrame(made).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("volume", F.when(F.rand(3) > 0.03, F.col("volume"))).withColumn("extra", F.lit("x"))
    bars = spark.createDataFrame(bars.collect(), bars.schema)
    columns = (*features.FEATURE_SETS["technical"], "future_return")
    ordered = lambda df: df.toPandas().sort_values(["ticker", "timestamp"]).reset_index(drop=True)
    want = features.research_features(bars, 15)
    whole = ordered(want)
    assert whole[list(columns)].notna().any().all()
    for block_rows in (64, 130):
        got = features.research_features_in_blocks(bars, 15, block_rows)
        assert got.columns == want.columns
        same(ordered(got), whole, columns)
    assert features.research_features_in_blocks(bars.where("false"), 15).count() == 0


def test_one_ticker_spreads_over_all_tasks(spark):
    n = 200_000
    hot = spark.range(n).select(F.lit("HOT").alias("ticker"), F.col("id").alias("t"), *[(100 + F.sin(F.col("id") / 50)).alias(c) for c in ("open", "close")], (102 + F.sin(F.col("id") / 50)).alias("high"), (98 + F.sin(F.col("id") / 50)).alias("low"), F.lit(1.0).alias("volume"))
    found = indicators.add_indicators_in_blocks(hot, NAMES, 4096)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ticker" not in plan.replace(" ", "") or "_block" in plan
    for line in plan.splitlines():
        if "windowspecdefinition" in line and "_segment" not in line:
            assert "_block" in line.split("windowspecdefinition(")[1], line
    cut, own = blocks.in_blocks(hot, NAMES, 4096)
    sizes = [r["count"] for r in blocks.without_halos(cut).groupBy("_block").count().collect()]
    assert len(sizes) == math.ceil(n / 4096) and max(sizes) == 4096
    assert cut.where("_halo AND _block < 48").groupBy("_block").count().agg(F.min("count"), F.max("count")).first() == (64, 64)
    last = found.orderBy(F.desc("t")).select("macd", "obv").first()
    x = pd.Series(100 + np.sin(np.arange(n) / 50))
    assert last.macd == pytest.approx((x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()).iloc[-1], abs=1e-8)
    assert last.obv == np.sign(x.diff()).fillna(0).sum()


def test_null_keys_no_key_and_no_rows(spark, prices):
    columns = ("obv", "macd", "sma_20")
    null = prices.withColumn("ticker", F.when(F.col("ticker") != "T1", F.col("ticker")))
    got = rows(indicators.add_indicators_in_blocks(null, NAMES, 64), columns)
    want = rows(indicators.add_indicators(null, NAMES), columns)
    same(got[got.ticker.isna()], want[want.ticker.isna()], columns)
    one = Names(key=None, time="t")
    single = prices.where("ticker = 'T1'").drop("ticker")
    a = indicators.add_indicators_in_blocks(single, one, 64).orderBy("t").toPandas()
    same(a, indicators.add_indicators(single, one).orderBy("t").toPandas(), columns)
    assert indicators.add_indicators_in_blocks(prices.where("false"), NAMES).count() == 0
    with pytest.raises(ValueError, match="halo"):
        blocks.in_blocks(prices, NAMES, 10)


def test_means_over_missing_values_do_not_depend_on_blocks(spark, prices):
    """Before the first value, inside and over whole blocks."""
    gone = F.col("t").between(0, 70) | F.col("t").between(200, 340) | (F.col("t") % 7 == 3)
    holes = prices.withColumn("close", F.when(~gone, F.col("close")))
    columns = ("macd", "macd_signal", "rsi_14", "sma_20", "bollinger_upper", "cmf_20", "obv")
    want = rows(indicators.add_indicators(holes, NAMES), columns)
    for block_rows in (64, 1000):
        same(rows(indicators.add_indicators_in_blocks(holes, NAMES, block_rows), columns), want, columns)


def test_a_backtest_cuts_its_series_once(spark, prices, monkeypatch):
    """Signals and backtest share their blocks, the signal line needs no scan of its own, and no window runs from a block's start on."""
    made, plans = [], []

    def noted(df, name):
        made.append(name)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return shared.written(df, name)

    monkeypatch.setattr(blocks, "written", noted)
    found = backtest.analyze_and_simulate_in_blocks(prices, names=NAMES, block_rows=64)
    assert sorted(made) == ["carry"] * 3 + ["local"] * 3 + ["series"]
    assert not any("unboundedpreceding" in line and "_block" in line for plan in plans for line in plan.splitlines())
    columns = ("action", "cash", "shares", "equity", "traded", "fee")
    same(rows(found, columns), rows(backtest.simulate(signals.analyze_prices(prices, NAMES), names=NAMES), columns), columns)


def test_earlier_rows_come_over_block_starts(spark, prices):
    cut, own = blocks.in_blocks(prices, NAMES, 2, halo=0)
    found = blocks.earlier(cut, {"one": ("close", 1), "two": ("close", 2)}, own, 2)
    w = NAMES.series()
    want = prices.withColumns({"one": F.lag("close", 1).over(w), "two": F.lag("close", 2).over(w)})
    same(rows(found, ("one", "two")), rows(want, ("one", "two")), ("one", "two"))
    with pytest.raises(ValueError, match="looked back"):
        blocks.earlier(cut, {"three": ("close", 3)}, own, 2)
