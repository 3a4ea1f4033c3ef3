"""Market-bar analytics on Spark DataFrames."""

from tapeloom.operators.backtest import BacktestResult, run_backtest
from tapeloom.operators.signals import analyze_prices
from tapeloom.plans.archive import load_daily_prices
from tapeloom.plans.catalog import Archive
from tapeloom.sources.legacy import build_archive
from tapeloom.sources.prices import generate_demo_prices

__all__ = ["Archive", "BacktestResult", "analyze_prices", "build_archive", "generate_demo_prices", "load_daily_prices", "run_backtest"]
