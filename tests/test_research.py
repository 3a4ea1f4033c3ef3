from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom import Archive
from tapeloom.operators import bars, features
from tapeloom.plans import dataset, walkforward

MINUTES = "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string"


def minute_rows(spark):
    made = [("14:29", 90, 91, 89, 90, 10, 1, 90), ("14:30", 100, 101, 99, 100.5, 10, 1, 100), ("14:31", 100.5, 102, 100, 101, 20, 2, 101), ("14:44", 101, 103, 100, 102, 30, 3, 102), ("14:45", 102, 104, 101, 103, 40, 4, 103), ("21:00", 110, 111, 109, 110, 50, 5, 110)]
    return spark.createDataFrame([("AAA", datetime.fromisoformat(f"2026-01-05T{t}:00+00:00"), *map(float, x), "sip") for t, *x in made], MINUTES)


def test_golden_bars(spark, tmp_path):
    a = Archive(tmp_path / "db")
    a.commit({"provider_minute_bars": minute_rows(spark).withColumn("fetched_at", F.current_timestamp())})
    r = dataset.build_research_dataset(a, interval_minutes=15)
    assert (r.bars, r.technical_ready_rows, r.sessions, r.table) == (2, 0, 1, "research_features_15m")
    x, y = dataset.load_research_dataset(a, interval_minutes=15).collect()
    assert x.timestamp == datetime(2026, 1, 5, 9, 30) and (x.open, x.high, x.low, x.close, x.volume, x.source_minutes) == (100, 103, 99, 102, 60, 3)
    assert x.future_return == pytest.approx(103 / 102 - 1) and y.future_return is None
    assert a.read("research_dataset_metadata").count() == 1
    with pytest.raises(ValueError, match="has not been built"):
        dataset.load_research_dataset(a, interval_minutes=5)
    with pytest.raises(ValueError, match="No regular-session"):
        dataset.build_research_dataset(a, start="2030-01-01")


def test_filter_reaches_the_scan(spark, tmp_path):
    minute_rows(spark).write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = bars.session_minutes(spark.read.parquet(str(tmp_path / "m")), "sip", date(2026, 1, 5), date(2026, 1, 6))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_no_look_ahead(spark):
    at = [datetime(2026, 1, 5, 9, 30) + timedelta(minutes=5 * i) for i in range(70)]
    frame = pd.DataFrame({"ticker": "AAA", "timestamp": at, "open": np.arange(70) + 100.0, "high": np.arange(70) + 101.5, "low": np.arange(70) + 99.5, "close": np.arange(70) + 100.7 + np.sin(np.arange(70)) / 4, "volume": np.arange(70) + 100.0, "trade_count": np.arange(70) + 10.0, "vwap": np.arange(70) + 100.4, "source_minutes": 5})
    changed = frame.copy()
    changed.loc[69, ["open", "high", "low", "close", "volume", "vwap"]] *= 10
    out = []
    for f in (frame, changed):
        rows = spark.createDataFrame(f).withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "session_date": F.col("timestamp").cast("date")})
        out.append(features.research_features(rows, 5).orderBy("timestamp").toPandas()[list(features.FEATURE_SETS["technical"])].iloc[:69])
    pd.testing.assert_frame_equal(*out)
    assert out[0].iloc[-1].notna().all()


def sessions(spark):
    days = pd.bdate_range("2026-01-01", periods=60)
    made = []
    for d, day in enumerate(days):
        for r in range(6):
            way = 1 if (d + r) % 2 else -1
            made.append((f"T{r % 3}", datetime(day.year, day.month, day.day, 10, r), day.date(), way * 0.001, *[way * (1 + i / 100) for i in range(len(features.BASELINE))]))
    return spark.createDataFrame(made, "ticker string, timestamp timestamp_ntz, session_date date, future_return double, " + ", ".join(f"{c} double" for c in features.BASELINE))


def test_ratios_to_a_price_of_zero(spark):
    at = [datetime(2026, 1, 5, 9, 30) + timedelta(minutes=15 * i) for i in range(4)]
    made = [("AAA", t, t.date(), o, 3.0, 0.0, c, 5.0, 1.0, 1.0, 15) for t, o, c in zip(at, (1.0, 0.0, 0.0, 2.0), (0.0, 1.0, 0.0, 2.0))]
    rows = spark.createDataFrame(made, "ticker string, timestamp timestamp_ntz, session_date date, open double, high double, low double, close double, volume double, trade_count double, vwap double, source_minutes long")
    names = ("intrabar_return", "range_pct", "return_1", "future_return")
    found = lambda df: [tuple("nan" if x != x else x for x in r) for r in df.orderBy("timestamp").select(*names).collect()]
    inf, nan = float("inf"), "nan"
    plain = [(-1.0, 3.0, None, None), (None, None, None, None), (None, None, -1.0, 0.0), (0.0, 1.5, None, None)]
    floating = [(-1.0, 3.0, None, inf), (inf, inf, inf, nan), (nan, inf, -1.0, 0.0), (0.0, 1.5, inf, None)]
    for make in (features.research_features, features.research_features_in_blocks):
        assert found(make(rows, 15)) == plain and found(make(rows, 15, infinite=True)) == floating
    ready = features.research_features(rows, 15, infinite=True)
    assert walkforward.labelled(ready, ("range_pct",), 5.0).count() == 0 and walkforward.labelled(ready, ("range_pct",), 5.0, infinite=True).count() == 2


def test_walk_forward(spark):
    r = walkforward.evaluate(sessions(spark), train_sessions=20, test_sessions=10, holdout_sessions=10)
    assert (r.metrics["folds"], r.metrics["test_rows"], r.metrics["holdout_rows"]) == (3, 180, 60)
    assert r.metrics["accuracy"] > 0.99
    gross, net = (r.metrics[f"average_{k}_bps_per_confident_signal"] for k in ("gross", "net"))
    assert gross - net == pytest.approx(10)
    assert all(f.train_end < f.test_start for f in r.folds.collect())
    assert r.coefficients.count() == len(features.BASELINE) and r.symbols.count() == 3
    for bad in (dict(train_sessions=5), dict(test_sessions=0), dict(confidence=0.4), dict(feature_set="x"), dict(train_sessions=60)):
        with pytest.raises(ValueError):
            walkforward.evaluate(sessions(spark), **{**dict(train_sessions=20, test_sessions=10, holdout_sessions=10), **bad})


def test_fit_is_the_exact_optimum(spark):
    """Against Newton's method on the same penalised, weighted loss."""
    g = np.random.default_rng(0)
    x = g.normal(0, 1, (400, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x[:, 0] + 0.3 * x[:, 1] + g.normal(0, 1, 400) > 1.2).astype(int)
    # places 0 to 3 in turn; both folds train on 1 and 2, the rows of x, and neither on 0 and 3
    rows = [(1 + k % 2, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y))] + [(p, 9.0, 9.0, 9.0, 1) for p in (0, 3)]
    frame = spark.createDataFrame(rows, "place int, a double, b double, c double, target_up int").repartition(3).withColumn("session_date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("place")))
    moments, spans = walkforward.session_moments(frame, ("a", "b", "c")), {1: (1, 3), 2: (1, 3)}
    one = walkforward.fold_statistics(moments.where("place IN (1, 2)").withColumn("place", F.col("place") - 1), 1, 2, 1, ("a", "b", "c"))
    both = one.unionByName(one.withColumn("fold", F.lit(2)))
    models = walkforward.fit_folds(frame, ("a", "b", "c"), both, spans)
    np.testing.assert_allclose(models[1].means, x.mean(0))
    np.testing.assert_allclose(models[1].scales, x.std(0))
    with pytest.raises(RuntimeError, match="not settled"):
        walkforward.fit_folds(frame, ("a", "b", "c"), both, spans, most_steps=1)
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    b = np.zeros(4)
    penalty = np.diag([0, 1, 1, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + penalty, z.T @ (w * (p - y)) + penalty @ b)
    for fold in (1, 2):
        np.testing.assert_allclose([models[fold].intercept, *models[fold].coefficients], b, atol=1e-8)
    with pytest.raises(ValueError, match="one target class"):
        walkforward.fit_folds(frame, ("a", "b", "c"), both.withColumn("up", F.col("n")), spans)


def test_training_rows_are_those_of_each_fold(spark):
    placed = spark.range(60).selectExpr("cast(id as int) AS place")
    for train, test, folds in ((20, 10, 4), (20, 3, 13), (25, 40, 1)):
        got = sorted((r.fold, r.place) for r in walkforward.training_rows(placed, folds, train, test).collect())
        assert got == [(k, p) for k in range(1, folds + 1) for p in range((k - 1) * test, (k - 1) * test + train) if p < 60]
