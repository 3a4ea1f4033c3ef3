"""A long-only simulation that acts on a bar's signal at the next bar's open, for all instruments at once.

All cash goes in and all shares go out, so a signal that repeats the position does nothing: the position is the last signal other
than Hold, and wealth is a running product of one factor for each trade. No row loop is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.frames import ANALYSIS, Names, so_far
from tapeloom.operators import blocks, signals
from tapeloom.operators.validate import require_columns


@dataclass(frozen=True)
class BacktestResult:
    """equity_curve and trades are lazy; metrics is one row for each instrument (a dict for a table of one)."""

    equity_curve: DataFrame
    trades: DataFrame
    metrics: dict | DataFrame


def _check(columns: list[str], names: Names, initial_cash: float, cost_bps: float) -> None:
    require_columns(columns, [names.time, names.open, names.close, "signal"], "Missing required backtest columns")
    if initial_cash <= 0:
        raise ValueError("Initial cash must be greater than zero")
    if cost_bps < 0:
        raise ValueError("Transaction cost cannot be negative")


def simulate(rows: DataFrame, initial_cash: float = 10_000.0, transaction_cost_bps: float = 5.0, names: Names = ANALYSIS) -> DataFrame:
    """One row per bar: action (1 bought, -1 sold, 0 nothing), cash, shares, equity, fee and traded shares."""
    _check(rows.columns, names, initial_cash, transaction_cost_bps)
    w, cost = names.series(), transaction_cost_bps / 10_000
    upto = so_far(w)
    keys = [names.key] if names.key else []
    out = rows.select(*keys, names.time, F.col(names.open).cast("double").alias("_open"), F.col(names.close).cast("double").alias("_close"), F.lag("signal").over(w).alias("_prior"))
    wanted = F.last(F.when(F.col("_prior") == "Buy", 1).when(F.col("_prior") == "Sell", 0), ignorenulls=True).over(upto)
    out = out.withColumn("_held", F.coalesce(wanted, F.lit(0)))
    if cost >= 1:
        # a sale leaves nothing to buy with
        out = out.withColumn("_sold", F.when(F.lag("_held", 1, 0).over(w) > F.col("_held"), 1).otherwise(0))
        out = out.withColumn("_held", F.when(F.max("_sold").over(upto) > 0, 0).otherwise(F.col("_held"))).drop("_sold")
    out = out.withColumn("action", F.col("_held") - F.lag("_held", 1, 0).over(w))
    factor = F.when(F.col("action") == 1, 1 / (F.col("_open") * (1 + cost))).when(F.col("action") == -1, F.col("_open") * abs(1 - cost)).otherwise(F.lit(1.0))
    out = out.withColumn("_units", initial_cash * F.exp(F.sum(F.ln(F.nullif(factor, F.lit(0.0)))).over(upto)))
    if cost >= 1:
        sign = 0.0 if cost == 1 else -1.0
        out = out.withColumn("_units", F.when(F.min("action").over(upto) < 0, sign * F.col("_units")).otherwise(F.col("_units")))
    out = out.withColumns({
        "cash": F.when(F.col("_held") == 1, 0.0).otherwise(F.col("_units")), "shares": F.when(F.col("_held") == 1, F.col("_units")).otherwise(0.0),
        "traded": F.when(F.col("action") == 1, F.col("_units")).when(F.col("action") == -1, F.lag("_units").over(w)),
    })
    out = out.withColumns({"equity": F.col("cash") + F.col("shares") * F.col("_close"), "fee": F.col("traded") * F.col("_open") * cost})
    return out.select(*keys, names.time, F.col("_open").alias("open"), F.col("_close").alias("close"), "action", "cash", "shares", "equity", "traded", "fee")


def simulate_in_blocks(rows: DataFrame, initial_cash: float = 10_000.0, transaction_cost_bps: float = 5.0, names: Names = ANALYSIS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """simulate() for instruments of any length, in blocks of time. Costs of all that is traded or more (10,000 basis points) are simulate()'s alone."""
    _check(rows.columns, names, initial_cash, transaction_cost_bps)
    keys = [names.key] if names.key else []
    cut, own = blocks.in_blocks(rows.select(*keys, names.time, names.open, names.close, "signal"), names, block_rows, halo=0)
    return _simulate_blocks(cut, own, initial_cash, transaction_cost_bps, names, block_rows)


def analyze_and_simulate_in_blocks(bars: DataFrame, initial_cash: float = 10_000.0, transaction_cost_bps: float = 5.0, names: Names = ANALYSIS, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """simulate() of the bars' own signals for instruments of any length; a history is cut into blocks once for both."""
    _check([*bars.columns, "signal"], names, initial_cash, transaction_cost_bps)
    return _simulate_blocks(*signals.signal_blocks(bars, names, block_rows), initial_cash, transaction_cost_bps, names, block_rows)


def _simulate_blocks(rows: DataFrame, own: Names, initial_cash: float, transaction_cost_bps: float, names: Names, block_rows: int) -> DataFrame:
    cost = transaction_cost_bps / 10_000
    if cost >= 1:
        raise ValueError("Transaction cost must be less than what is traded")
    keys = [names.key] if names.key else []
    asked = F.when(F.col("signal") == "Buy", 1).when(F.col("signal") == "Sell", 0)
    out = rows.select(*keys, names.time, F.col(names.open).cast("double").alias("_open"), F.col(names.close).cast("double").alias("_close"), asked.alias("_asked"), blocks.PLACE, blocks.BLOCK, blocks.IS_HALO)
    out = blocks.earlier(blocks.scanned(out, {"_wanted": blocks.Last(F.col("_asked"))}, own), {"_now": ("_wanted", 1), "_then": ("_wanted", 2)}, own, block_rows)
    out = out.withColumns({"_held": F.coalesce("_now", F.lit(0)), "action": F.coalesce("_now", F.lit(0)) - F.coalesce("_then", F.lit(0))})
    factor = F.when(F.col("action") == 1, 1 / (F.col("_open") * (1 + cost))).when(F.col("action") == -1, F.col("_open") * (1 - cost)).otherwise(F.lit(1.0))
    out = blocks.scanned(out.withColumn("_step", F.ln(F.nullif(factor, F.lit(0.0)))), {"_grown": blocks.Total(F.col("_step"))}, own)
    units = initial_cash * F.exp("_grown")
    out = out.withColumns({
        "cash": F.when(F.col("_held") == 1, 0.0).otherwise(units), "shares": F.when(F.col("_held") == 1, units).otherwise(0.0),
        "traded": F.when(F.col("action") == 1, units).when(F.col("action") == -1, initial_cash * F.exp(F.col("_grown") - F.coalesce("_step", F.lit(0.0)))),
    })
    out = out.withColumns({"equity": F.col("cash") + F.col("shares") * F.col("_close"), "fee": F.col("traded") * F.col("_open") * cost})
    return out.select(*keys, names.time, F.col("_open").alias("open"), F.col("_close").alias("close"), "action", "cash", "shares", "equity", "traded", "fee")


def equity_curve(simulated: DataFrame, names: Names = ANALYSIS) -> DataFrame:
    keys = [names.key] if names.key else []
    return simulated.select(*keys, names.time, F.col("cash").alias("Cash"), F.col("shares").alias("Shares"), F.col("equity").alias("Equity"))


def trades(simulated: DataFrame, names: Names = ANALYSIS) -> DataFrame:
    keys = [names.key] if names.key else []
    action = F.when(F.col("action") == 1, "Buy").otherwise("Sell")
    return simulated.where("action != 0").select(*keys, names.time, action.alias("Action"), F.col("open").alias("Price"), F.col("traded").alias("Shares"), F.col("fee").alias("Fee"))


def metrics(simulated: DataFrame, initial_cash: float, transaction_cost_bps: float, names: Names = ANALYSIS) -> DataFrame:
    """One row for each instrument, in one aggregation."""
    keys = [names.key] if names.key else []
    final = F.max_by("equity", names.time)
    return simulated.groupBy(*keys).agg(
        F.lit(float(initial_cash)).alias("initial_cash"), final.alias("final_equity"), (100 * (final / initial_cash - 1)).alias("total_return_pct"),
        (100 * (F.max_by("close", names.time) / F.min_by("open", names.time) - 1)).alias("buy_and_hold_return_pct"),
        F.count_if(F.col("action") != 0).alias("trade_count"), F.lit(float(transaction_cost_bps)).alias("transaction_cost_bps"),
    )


def run_backtest(analysis: DataFrame, initial_cash: float = 10_000.0, transaction_cost_bps: float = 5.0, names: Names = ANALYSIS) -> BacktestResult:
    """Simulate and summarise. A table of one instrument gives its metrics as a dict."""
    simulated = simulate(analysis, initial_cash, transaction_cost_bps, names)
    found = metrics(simulated, initial_cash, transaction_cost_bps, names)
    if names.key is None:
        row = found.first()
        if row is None or row["final_equity"] is None:
            raise ValueError("Analysis data is empty")
        return BacktestResult(equity_curve(simulated, names), trades(simulated, names), row.asDict())
    return BacktestResult(equity_curve(simulated, names), trades(simulated, names), found)
