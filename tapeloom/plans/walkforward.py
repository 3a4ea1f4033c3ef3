"""Chronological walk-forward evaluation of a logistic model.

Sessions get a place by date; a row belongs to the test part of at most one fold and to the training part of those after it. No row is copied for the folds
it trains. Means and deviations of all folds are put together from moments of sessions, one row each, and a Newton step of all folds is one pass in which a
row adds to the gradients and curvatures of each of its folds; the driver sees (1 + features)² numbers a fold. Coefficients are a small table that test
rows are joined with, and the reports are made from predictions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.features import feature_columns
from tapeloom.operators.validate import require_columns
from tapeloom.shared import written


@dataclass(frozen=True)
class WalkForwardResult:
    folds: DataFrame
    predictions: DataFrame
    symbols: DataFrame
    coefficients: DataFrame
    metrics: dict[str, object]


def labelled(dataset: DataFrame, columns: tuple[str, ...], target_move_bps: float, infinite: bool = False) -> DataFrame:
    """Complete rows that move by more than the threshold, and whether they move up. Infinite values are missing, unless they are asked for."""
    threshold = target_move_bps / 10_000
    complete = F.abs("future_return") > threshold
    for c in ("future_return", *columns):
        complete = complete & F.col(c).isNotNull()
        if not infinite:
            complete = complete & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = dataset.select("ticker", "timestamp", F.col("session_date").cast("date").alias("session_date"), "future_return", *columns)
    return rows.where(complete).withColumn("target_up", (F.col("future_return") > threshold).cast("int"))


def session_folds(rows: DataFrame, train: int, test: int, holdout: int) -> DataFrame:
    """session_date, place, holdout, test_fold. The window runs over one row per session."""
    sessions = rows.select("session_date").distinct()
    w = Window.partitionBy().orderBy("session_date")
    sessions = sessions.withColumns({"place": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy())})
    sessions = sessions.withColumn("holdout", F.col("place") >= F.col("_n") - holdout)
    fold = F.when(~F.col("holdout") & (F.col("place") >= train), (F.floor((F.col("place") - train) / test) + 1).cast("int"))
    return sessions.select("session_date", "place", "holdout", fold.alias("test_fold"))


def _check(train: int, test: int, holdout: int, move: float, confidence: float, cost: float) -> None:
    for bad, message in (
        (train < 20, "Training window must contain at least 20 sessions"), (test < 1, "Test window must contain at least one session"),
        (holdout < 0, "Holdout window cannot be negative"), (move < 0, "Target move cannot be negative"),
        (not 0.5 <= confidence < 1, "Confidence must be at least 0.5 and less than 1"), (cost < 0, "Transaction cost cannot be negative"),
    ):
        if bad:
            raise ValueError(message)


@dataclass(frozen=True)
class FoldModel:
    """A fold's coefficients and intercept on standardised features, with the means and population deviations used."""

    coefficients: np.ndarray
    intercept: float
    means: np.ndarray
    scales: np.ndarray


def fold_spans(folds: int, train: int, test: int) -> dict[int, tuple[int, int]]:
    """The first place that each fold trains on, and the one after its last."""
    return {k: ((k - 1) * test, (k - 1) * test + train) for k in range(1, folds + 1)}


def training_rows(placed: DataFrame, folds: int, train: int, test: int) -> DataFrame:
    """A table of sessions with each once for each fold it trains: fold k trains on the places from (k - 1) * test on, `train` of them."""
    first = F.greatest(F.floor((F.col("place") - train) / test) + 2, F.lit(1))
    last = F.least(F.floor(F.col("place") / test) + 1, F.lit(folds))
    return placed.where(first <= last).withColumn("fold", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def session_moments(placed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each place: its session_date, rows, rows that move up, and of each feature mean and variance."""
    return placed.groupBy("place").agg(F.min("session_date").alias("session_date"), F.count("*").alias("n"), F.sum("target_up").alias("up"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns])


def fold_statistics(moments: DataFrame, folds: int, train: int, test: int, columns: tuple[str, ...]) -> DataFrame:
    """fold, n, up, train_start, train_end, and of each feature the mean m_ and the population deviation s_, put together from session_moments()."""
    rows = training_rows(moments, folds, train, test)
    means = [(F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n")).alias(f"a_{c}") for c in columns]
    centres = rows.groupBy("fold").agg(F.sum("n").alias("rows"), F.sum("up").alias("ups"), F.min("session_date").alias("train_start"), F.max("session_date").alias("train_end"), *means)
    spread = lambda c: F.sum(F.col("n") * (F.col(f"v_{c}") + (F.col(f"m_{c}") - F.col(f"a_{c}")) ** 2))
    around = rows.join(F.broadcast(centres), "fold").groupBy("fold", "rows", "ups", "train_start", "train_end", *[f"a_{c}" for c in columns])  # one row a fold
    return around.agg(*[F.sqrt(spread(c) / F.col("rows")).alias(f"s_{c}") for c in columns]).withColumnsRenamed({"rows": "n", "ups": "up", **{f"a_{c}": f"m_{c}" for c in columns}})


def fold_outline(placed: DataFrame, folds: int, train: int, test: int) -> DataFrame:
    """What of each fold's report does not depend on a model."""
    spans = training_rows(session_moments(placed, ()), folds, train, test).groupBy("fold").agg(F.min("session_date").alias("train_start"), F.max("session_date").alias("train_end"), F.sum("n").alias("train_rows"))
    persists = F.col("target_up") == (F.col("return_1") > 0).cast("int")
    tested = placed.where("test_fold is not null").groupBy(F.col("test_fold").alias("fold")).agg(
        F.min("session_date").alias("test_start"), F.max("session_date").alias("test_end"), F.count("*").alias("test_rows"), (100 * F.avg("target_up")).alias("up_target_pct"), _accuracy(persists).alias("persistence_accuracy")
    )
    return spans.join(tested, "fold")


def _curvature(columns: tuple[str, ...], spans: dict[int, tuple[int, int]], models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]]):
    """Sums of a batch for each fold: loss, gradient and curvature of the weighted logistic loss at the fold's present coefficients."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            place, x, up = frame["place"].to_numpy(), frame[list(columns)].to_numpy(dtype=np.float64), frame["target_up"].to_numpy()
            for fold, (beta, means, scales, weights) in models.items():
                mine = (place >= spans[fold][0]) & (place < spans[fold][1])
                if not mine.any():
                    continue
                z, y = np.column_stack([np.ones(mine.sum()), (x[mine] - means) / scales]), up[mine]
                w, line = np.where(y == 1, weights[1], weights[0]), z @ beta
                p = 1 / (1 + np.exp(-np.clip(line, -700, 700)))
                loss = (w * (np.logaddexp(0, line) - y * line)).sum()
                sums = np.concatenate([[loss], z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None])).reshape(-1)])
                yield pd.DataFrame({"fold": np.int32(fold), "i": np.arange(len(sums), dtype=np.int32), "v": sums})

    return run


def fit_folds(rows: DataFrame, columns: tuple[str, ...], statistics: DataFrame, spans: dict[int, tuple[int, int]], most_steps: int = 200, tolerance: float = 1e-9) -> dict[int, FoldModel]:
    """The exact optimum of each fold by Newton's method, all folds a step at a time; rows (place, target_up, features) are read once a step.

    The penalty is half the squared coefficients (C = 1 on a sum of losses), the intercept is free, and classes weigh n / (2 n_class). A step that raises
    the loss is halved. A fold that has not settled after most_steps is an error.
    """
    models, d = {}, len(columns)
    for r in statistics.collect():  # one row for each fold
        if not r.n or r.up in (0, r.n):
            raise ValueError("A training fold contains only one target class")
        means, scales = np.array([r[f"m_{c}"] for c in columns]), np.array([r[f"s_{c}"] or 1.0 for c in columns])
        models[r.fold] = (np.zeros(d + 1), means, scales, (r.n / (2 * (r.n - r.up)), r.n / (2 * r.up)))
    penalty, best, open_ = np.r_[0.0, np.ones(d)], {}, set(models)
    for _ in range(most_steps):
        if not open_:
            break
        low, high = min(spans[k][0] for k in open_), max(spans[k][1] for k in open_)
        wanted = rows.where((F.col("place") >= low) & (F.col("place") < high)).select("place", "target_up", *columns)
        sums = wanted.mapInPandas(_curvature(columns, spans, {k: models[k] for k in open_}), "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v"))
        found = {k: np.zeros(1 + (d + 1) + (d + 1) ** 2) for k in open_}
        for r in sums.collect():
            found[r.fold][r.i] = r.v
        for k in sorted(open_):
            beta, *rest = models[k]
            loss = found[k][0] + 0.5 * (penalty * beta**2).sum()
            if k in best and loss > best[k][0] + 1e-12 * abs(loss):
                step = (best[k][1] - beta) / 2  # back half the way
            else:
                best[k] = (loss, beta)
                slope = found[k][1 : d + 2] + penalty * beta
                step = -np.linalg.solve(found[k][d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty), slope)
            models[k] = (beta + step, *rest)
            if np.abs(step).max() < tolerance:
                open_.discard(k)
    if open_:
        raise RuntimeError(f"The fit of folds {sorted(open_)} has not settled after {most_steps} steps")
    return {k: FoldModel(beta[1:], float(beta[0]), means, scales) for k, (beta, means, scales, _) in models.items()}


def with_probability(rows: DataFrame, models: dict[int, FoldModel], columns: tuple[str, ...]) -> DataFrame:
    """rows (test_fold, features) with probability_up by the model of their fold; the table of models has one row for each fold."""
    made = [(k, m.intercept - float((m.coefficients * m.means / m.scales).sum()), (m.coefficients / m.scales).tolist()) for k, m in models.items()]
    table = rows.sparkSession.createDataFrame(made, "test_fold int, _free double, _slopes array<double>")
    line = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in columns]), "_slopes", lambda x, b: x * b), F.col("_free"), lambda s, x: s + x)
    return rows.join(F.broadcast(table), "test_fold").withColumn("probability_up", 1 / (1 + F.exp(-line))).drop("_free", "_slopes")


def _accuracy(right: Column) -> Column:
    return F.avg(right.cast("double"))


def _balanced(target: Column, predicted: Column) -> Column:
    """Mean recall over the classes that are present."""
    up, down = F.avg(F.when(target == 1, predicted.cast("double"))), F.avg(F.when(target == 0, 1 - predicted.cast("double")))
    return F.coalesce((up + down) / 2, up, down)


def _confident(cost_bps: float) -> dict[str, Column]:
    on = F.col("action") != 0
    gross = F.avg(F.when(on, F.col("action") * F.col("future_return") * 10_000))
    return {
        "confident_rows": F.count_if(on), "confident_accuracy": F.avg(F.when(on, (F.col("target_up") == (F.col("action") == 1).cast("int")).cast("double"))),
        "average_gross_bps": gross, "average_net_bps": gross - 2 * cost_bps,
    }


def predicted(placed: DataFrame, models: dict[int, FoldModel], columns: tuple[str, ...], confidence: float) -> DataFrame:
    """Test rows with probability_up, predicted_up, persistence_up and action (1 long, -1 short, 0 nothing)."""
    p = F.col("probability_up")
    return with_probability(placed.where("test_fold is not null"), models, columns).withColumns({
        "predicted_up": (p >= 0.5).cast("int"), "persistence_up": (F.col("return_1") > 0).cast("int"),
        "action": F.when(p >= confidence, 1).when(p <= 1 - confidence, -1).otherwise(0),
    }).drop("holdout")


def _right() -> Column:
    return F.col("target_up") == F.col("predicted_up")


def _persists() -> Column:
    return F.col("target_up") == F.col("persistence_up")


def fold_report(predictions: DataFrame, cost_bps: float) -> DataFrame:
    return predictions.groupBy(F.col("test_fold").alias("fold")).agg(
        F.min("session_date").alias("test_start"), F.max("session_date").alias("test_end"), F.count("*").alias("test_rows"), (100 * F.avg("target_up")).alias("up_target_pct"),
        _accuracy(_right()).alias("accuracy"), _balanced(F.col("target_up"), F.col("predicted_up")).alias("balanced_accuracy"), _accuracy(_persists()).alias("persistence_accuracy"),
        *[c.alias(k) for k, c in _confident(cost_bps).items()],
    )


def symbol_report(predictions: DataFrame, cost_bps: float) -> DataFrame:
    symbols = predictions.groupBy("ticker").agg(F.count("*").alias("test_rows"), _accuracy(_right()).alias("accuracy"), *[c.alias(k) for k, c in _confident(cost_bps).items()])
    return symbols.orderBy(F.desc_nulls_last("average_net_bps"), F.desc("confident_rows"))


def coefficient_report(table: DataFrame) -> DataFrame:
    """Of rows (fold, feature, coefficient), how large and how stable each feature's coefficients are."""
    return table.groupBy("feature").agg(
        F.avg("coefficient").alias("mean_coefficient"), F.avg(F.abs("coefficient")).alias("mean_absolute_coefficient"), F.stddev_samp("coefficient").alias("coefficient_std"),
        (100 * F.avg((F.col("coefficient") > 0).cast("double"))).alias("positive_fold_pct"),
    ).orderBy(F.desc("mean_absolute_coefficient"))


def evaluate(dataset: DataFrame, *, train_sessions: int = 126, test_sessions: int = 21, holdout_sessions: int = 21, feature_set: str = "baseline", target_move_bps: float = 5.0, confidence: float = 0.55, transaction_cost_bps: float = 5.0) -> WalkForwardResult:
    columns = feature_columns(feature_set)
    require_columns(dataset.columns, ["ticker", "timestamp", "session_date", "future_return", *columns], "Missing research columns")
    _check(train_sessions, test_sessions, holdout_sessions, target_move_bps, confidence, transaction_cost_bps)
    spark = dataset.sparkSession
    rows = labelled(dataset, columns, target_move_bps)
    sessions = session_folds(rows, train_sessions, test_sessions, holdout_sessions)
    placed = written(rows.join(F.broadcast(sessions), "session_date"), "placed")  # one row per session
    count = placed.agg(F.countDistinct("session_date").alias("n"), F.max("test_fold").alias("folds"), F.countDistinct(F.when(F.col("holdout"), F.col("session_date"))).alias("h"), F.count_if("holdout").alias("rows"), F.min(F.when(F.col("holdout"), F.col("session_date"))).alias("a"), F.max(F.when(F.col("holdout"), F.col("session_date"))).alias("b")).first()
    if not count["n"]:
        raise ValueError("No rows exceed the requested target-move threshold")
    needed = train_sessions + test_sessions + holdout_sessions
    if count["n"] < needed:
        raise ValueError(f"At least {needed} sessions are required; dataset contains {count['n']}")
    shape = (count["folds"], train_sessions, test_sessions)
    statistics = written(fold_statistics(session_moments(placed, columns), *shape, columns), "statistics")
    models = fit_folds(placed, columns, statistics, fold_spans(*shape))
    if len(models) < count["folds"]:
        raise ValueError("A training fold contains only one target class")
    predictions = written(predicted(placed, models, columns, confidence), "predictions")
    spans = statistics.select("fold", "train_start", "train_end", F.col("n").alias("train_rows"))
    folds = written(spans.join(fold_report(predictions, transaction_cost_bps), "fold"), "folds").orderBy("fold")
    table = spark.createDataFrame([(k, c, float(b)) for k, m in models.items() for c, b in zip(columns, m.coefficients)], "fold int, feature string, coefficient double")
    metrics = _overall(predictions, _right(), _persists(), feature_set, len(columns), count, transaction_cost_bps)
    return WalkForwardResult(folds, predictions, symbol_report(predictions, transaction_cost_bps), coefficient_report(table), metrics)


def _overall(predictions: DataFrame, right: Column, persists: Column, feature_set: str, n_features: int, count, cost_bps: float) -> dict[str, object]:
    t, p = F.col("target_up"), F.col("predicted_up")
    hits = F.count_if((t == 1) & (p == 1))
    out = predictions.agg(
        F.count("*").alias("test_rows"), _accuracy(right).alias("accuracy"), _balanced(t, p).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(hits, F.sum(p)), F.lit(0.0)).alias("precision_up"), F.coalesce(F.try_divide(hits, F.sum(t)), F.lit(0.0)).alias("recall_up"),
        F.coalesce(F.try_divide(2 * hits, F.sum(p) + F.sum(t)), F.lit(0.0)).alias("f1_up"), F.sum(t).alias("up_rows"), (F.count("*") - F.sum(t)).alias("down_rows"),
        F.greatest(F.avg(t), 1 - F.avg(t)).alias("majority_baseline_accuracy"), _accuracy(persists).alias("persistence_accuracy"),
        (100 * F.avg((F.col("action") != 0).cast("double"))).alias("confident_coverage_pct"), *[c.alias(k) for k, c in _confident(cost_bps).items()],
    ).first().asDict()
    out["average_gross_bps_per_confident_signal"], out["average_net_bps_per_confident_signal"] = out.pop("average_gross_bps"), out.pop("average_net_bps")
    nan = lambda v: float("nan") if v is None else v
    return {"feature_set": feature_set, "features": n_features, "folds": count["folds"], **{k: nan(v) for k, v in out.items()}, "holdout_sessions": count["h"], "holdout_rows": count["rows"], "holdout_start": count["a"], "holdout_end": count["b"]}


evaluate_walk_forward = evaluate
