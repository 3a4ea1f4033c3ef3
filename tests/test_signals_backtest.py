import numpy as np
import pandas as pd
import pytest

from tapeloom import analyze_prices, generate_demo_prices, run_backtest
from tapeloom.functions.frames import Names
from tapeloom.operators import backtest


def test_scores_add_up_and_repeat(spark):
    a, b = (analyze_prices(generate_demo_prices(120, seed=7)).orderBy("Date").toPandas() for _ in range(2))
    assert (a["signal"][:49] == "Hold").all()
    parts = [c for c in a.columns if c.startswith("score_")]
    assert len(parts) == 6 and (a[parts].sum(axis=1) == a["signal_score"]).all()
    pd.testing.assert_frame_equal(a, b)


def by_hand(rows, cash=10_000.0, bps=5.0):
    c, shares, out, trades, before = bps / 1e4, 0.0, [], [], "Hold"
    for o, close, signal in rows:
        if before == "Buy" and cash > 0:
            shares, cash = cash / (o * (1 + c)), 0.0
            trades.append(("Buy", o, shares, shares * o * c))
        elif before == "Sell" and shares > 0:
            trades.append(("Sell", o, shares, shares * o * c))
            cash, shares = shares * o * (1 - c), 0.0
        out.append(cash + shares * close)
        before = signal
    return out, trades


@pytest.mark.parametrize("bps", [0.0, 5.0, 10_000.0, 12_000.0])
def test_matches_a_row_loop(spark, bps):
    g = np.random.default_rng(3)
    rows = [(float(o), float(o + g.normal(0, 1)), str(s)) for o, s in zip(100 + np.cumsum(g.normal(0, 1, 300)), g.choice(["Buy", "Sell", "Hold"], 300, p=[0.1, 0.1, 0.8]))]
    frame = spark.createDataFrame([("A", i, *r) for i, r in enumerate(rows)], "k string, d int, open double, close double, signal string")
    sim = backtest.simulate(frame, 10_000.0, bps, Names(key="k", time="d")).orderBy("d").toPandas()
    equity, trades = by_hand(rows, bps=bps)
    np.testing.assert_allclose(sim["equity"], equity, rtol=1e-9, atol=1e-9)
    done = sim[sim["action"] != 0]
    assert len(done) == len(trades)
    np.testing.assert_allclose(done["fee"].astype(float), [t[3] for t in trades], rtol=1e-9, atol=1e-9)


def five(spark):
    return spark.createDataFrame([(f"2026-01-0{i + 1}", 10.0 + i, 10.5 + i, s) for i, s in enumerate(["Buy", "Hold", "Sell", "Hold", "Hold"])], "Date string, Open double, Close double, signal string")


def test_next_open_fills_and_costs(spark):
    free, paid = run_backtest(five(spark), transaction_cost_bps=0.0), run_backtest(five(spark), transaction_cost_bps=50.0)
    trades = free.trades.orderBy("Date").collect()
    assert [(t.Action, t.Price) for t in trades] == [("Buy", 11.0), ("Sell", 13.0)]
    assert paid.metrics["final_equity"] < free.metrics["final_equity"] and free.metrics["trade_count"] == 2
    with pytest.raises(ValueError, match="Initial cash"):
        run_backtest(five(spark), initial_cash=0)
    with pytest.raises(ValueError, match="Transaction cost"):
        run_backtest(five(spark), transaction_cost_bps=-1)
