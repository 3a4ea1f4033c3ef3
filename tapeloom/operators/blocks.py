"""Series in blocks of time, so that one instrument's history is many tasks' work.

Rows are cut by range of (instrument, time), numbered in their series, and dealt by (instrument, block of block_rows rows). Two things reach over a block's start:

* Trailing frames. Each block is given copies of the last rows of the one before it (its halo), which frames may look back on and which are dropped at the end.
* Recursions (exponential means, running sums, the last value). Each block runs its recursion from nothing, in arrays inside a task, and is summed up as a map
  from what the series had before it to what it has after it: y -> a y + b, a sum, a last value. The maps of a series' blocks, one row each, are composed in
  order, and each row is given what came in at its block's start.

A row's place in its series is a column, so what follows sorts by a number, and rows keep their blocks from one step to the next: only in_blocks() cuts.

No window runs over a whole series. Defined cases: a null key is a series of its own; rows of one series and instant keep some order, the same in every
step; a series shorter than a block is one block; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapeloom.functions.frames import Names
from tapeloom.shared import written

BLOCK_ROWS, HALO = 65_536, 64
BLOCK, IS_HALO, PLACE = "_block", "_halo", "_at"


def in_blocks(rows: DataFrame, names: Names, block_rows: int = BLOCK_ROWS, halo: int = HALO) -> tuple[DataFrame, Names]:
    """rows with their place in the series and their block, halo copies among them, and names whose windows stay within blocks."""
    if halo > block_rows:
        raise ValueError("A block must hold a halo")
    keys = [names.key] if names.key else []
    cut = rows.repartitionByRange(*keys, names.time).sortWithinPartitions(*keys, names.time)
    cut = written(cut.withColumns({"_segment": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "series")
    sizes = cut.groupBy(*keys, "_segment").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").withColumnRenamed("_segment", "_cut")
    same = F.col("_segment") == F.col("_cut")
    if keys:
        sizes = sizes.withColumnRenamed(names.key, "_key")
        same = same & F.col(names.key).eqNullSafe(F.col("_key"))
    at = F.col("_before") + F.col("_place") - F.col("_first")
    placed = cut.join(sizes, same).withColumn(PLACE, at).select(*rows.columns, PLACE)
    own = F.floor(F.col(PLACE) / F.lit(block_rows)).cast("long")
    near_end = F.col(PLACE) % block_rows >= block_rows - halo
    placed = placed.withColumn(BLOCK, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    placed = placed.withColumn(IS_HALO, F.col(BLOCK) != own)
    return placed, replace(names, time=PLACE, block=BLOCK)


def without_halos(rows: DataFrame) -> DataFrame:
    return rows.where(f"NOT {IS_HALO}")


def without_blocks(rows: DataFrame) -> DataFrame:
    return without_halos(rows).drop(BLOCK, IS_HALO, PLACE)


def earlier(rows: DataFrame, wanted: Mapping[str, tuple[str, int]], names: Names, block_rows: int) -> DataFrame:
    """rows of scanned() with a column for each of wanted (a column, and how many rows back): what the series had there. A block's first rows get it from
    the last ones of the block before, so that no halo is needed for what is known only after a scan."""
    keys, back_most = [names.key] if names.key else [], max(back for _, back in wanted.values())
    if back_most > block_rows:
        raise ValueError("A block must hold the rows looked back on")
    ends = rows.where(F.col(PLACE) % block_rows >= block_rows - back_most)
    out = rows
    for name, (column, back) in wanted.items():
        met = ends.select(*[F.col(k).alias(f"_k{k}") for k in keys], (F.col(PLACE) + back).alias("_to"), F.col(column).alias(f"_met{name}"))
        same = F.col(PLACE) == F.col("_to")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k{k}"))
        out = out.join(F.broadcast(met), same, "left").drop("_to", *[f"_k{k}" for k in keys])  # a few rows a block
    first = F.col(PLACE) % block_rows
    found = {name: F.when(first < back, F.col(f"_met{name}")).otherwise(F.lag(column, back).over(names.series())) for name, (column, back) in wanted.items()}
    return out.withColumns(found).drop(*[f"_met{name}" for name in wanted])


@dataclass(frozen=True)
class Mean:
    """The recursive mean y = (1 - alpha) y + alpha x from the first value on, null before min_periods values."""

    value: Column
    alpha: float
    min_periods: int = 1


@dataclass(frozen=True)
class MeanOfSpread:
    """The recursive mean of the difference of two recursive means of value (MACD's signal line), null before the first value."""

    value: Column
    fast: float
    slow: float
    alpha: float


@dataclass(frozen=True)
class Total:
    """The running sum of values; null before the first."""

    value: Column


@dataclass(frozen=True)
class Last:
    """The last value that is not null, up to this row."""

    value: Column


@dataclass(frozen=True)
class Trailing:
    """avg, sum or stddev_pop of the last `rows` values, null unless all are there. It looks back on halo copies, so `rows` is at most one more than a halo."""

    value: Column
    rows: int
    how: str


Recursion = Mean | MeanOfSpread | Total | Last
#: What each row of a block, a block's end, and the series before a block say of a recursion. "value" is of the values' own type.
_ROW = {Mean: {"n": "int", "y": "double", "fade": "double", "flat": "double"}, Total: {"y": "value"}, Last: {"y": "value"}}
_ROW[MeanOfSpread] = _ROW[Mean] | {"by_fast": "double", "by_slow": "double"}
_ROW[Trailing] = {"y": "double"}
_END = {Mean: {"n": "long", "y": "double", "first": "double", "flat": "double"}, Total: {"y": "value"}, Last: {"y": "value"}}
_END[MeanOfSpread] = _END[Mean] | {"rows": "long", "fast": "double", "slow": "double", "by_fast": "double", "by_slow": "double"}
_IN = {Mean: {"n": "long", "y": "double", "flat": "double"}, Total: {"y": "value"}, Last: {"y": "value"}}
_IN[MeanOfSpread] = _IN[Mean] | {"fast": "double", "slow": "double"}


def _from_zero(values: np.ndarray, alpha: float) -> np.ndarray:
    """The recursive mean from 0 on, before the first value and after each."""
    y = pd.Series(np.concatenate([[0.0], values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return np.where(np.logical_or.accumulate(np.concatenate([[False], np.isnan(values)])), np.nan, y)


def _frames(how: Trailing, column: pa.Array) -> pa.Array:
    missing = column.is_null().to_numpy(zero_copy_only=False)
    pad = min(how.rows - 1, len(missing))
    if pad == len(missing):
        return pa.nulls(len(missing), pa.float64())
    last = np.lib.stride_tricks.sliding_window_view(column.fill_null(0.0).to_numpy(zero_copy_only=False), how.rows)
    if how.how == "stddev_pop":
        found = (last - last[:, :1]).std(axis=1)  # from the first value on, so that constant values have no deviation at all
    else:
        found = last[:, 0].copy()
        for k in range(1, how.rows):  # in the frame's order, as a window adds them up: a mean is compared with values that may equal it
            found += last[:, k]
        found = found / how.rows if how.how == "avg" else found
    gone = np.lib.stride_tricks.sliding_window_view(missing, how.rows).any(axis=1)
    return pa.array(np.concatenate([np.zeros(pad), found]), mask=np.concatenate([np.ones(pad, bool), gone]))


def _run(how: Recursion, column: pa.Array) -> tuple[dict, dict]:
    """A block's recursion from nothing: columns row by row, and what its end says."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    n = np.cumsum(valid)
    count = int(n[-1])
    if isinstance(how, Last):
        at = np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1))
        y = column.take(pa.array(np.maximum(at, 0), mask=at < 0))
        return {"y": y}, {"y": y[-1].as_py()}
    values = column.drop_null().to_numpy(zero_copy_only=False)
    if isinstance(how, Total):
        y = pa.array(np.concatenate([values[:0], np.zeros(1, values.dtype), np.cumsum(values)])[n], mask=n == 0)
        return {"y": y}, {"y": y[-1].as_py()}
    first = values[0] if count else None
    constant = np.concatenate([[False], np.logical_and.accumulate(values == first)]) if count else np.zeros(1, bool)
    row = {"n": pa.array(n, pa.int32()), "flat": pa.array(np.full(len(n), first if count else 0.0), pa.float64(), mask=~constant[n])}
    end = {"n": count, "first": first, "flat": first if constant[-1] else None}
    if isinstance(how, Mean):
        y = _from_zero(values, how.alpha)
        row |= {"y": pa.array(y[n]), "fade": pa.array((1 - how.alpha) ** n)}
        return row, end | {"y": y[-1]}
    # the difference in each row is known but for what came in to either mean, on which it depends as a fading share
    fast, slow = _from_zero(values, how.fast), _from_zero(values, how.slow)
    base, by_fast, by_slow = (_from_zero(x, how.alpha)[1:] for x in ((fast - slow)[n], (1 - how.fast) ** n, (1 - how.slow) ** n))
    row |= {"y": pa.array(base), "fade": pa.array((1 - how.alpha) ** np.arange(1, len(n) + 1)), "by_fast": pa.array(by_fast), "by_slow": pa.array(by_slow)}
    return row, end | {"rows": len(n), "y": base[-1], "fast": fast[-1], "slow": slow[-1], "by_fast": by_fast[-1], "by_slow": by_slow[-1]}


def _local(specs: Mapping[str, Recursion], frames: Mapping[str, Trailing], ends: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place = table[PLACE].to_numpy()
        if (place[1:] < place[:-1]).any():
            table = table.take(np.argsort(place))
        for name, how in frames.items():
            table = table.append_column(f"_{name}_y", _frames(how, table[f"_{name}_x"].combine_chunks())).drop_columns(f"_{name}_x")
        table = table.filter(pa.compute.invert(table[IS_HALO])).combine_chunks()
        end = {}
        for name, how in specs.items():
            column = table[f"_{name}_x"].combine_chunks() if len(table) else None
            row, end[name] = _run(how, column) if len(table) else ({p: pa.array([], k) for p, k in _arrow(_ROW[type(how)], table[f"_{name}_x"].type).items()}, None)
            table = table.drop_columns(f"_{name}_x")
            for p in _ROW[type(how)]:
                table = table.append_column(f"_{name}_{p}", row[p])
        return table.append_column("_end", pa.array([None] * (len(table) - 1) + [end] * bool(len(table)), ends))

    return run


def _arrow(parts: Mapping[str, str], value: pa.DataType) -> dict[str, pa.DataType]:
    return {p: {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "value": value}[k] for p, k in parts.items()}


def _start(how: Recursion, before: dict, end: dict) -> dict:
    """What a series had before a block; where it had no value yet, means start at the block's first."""
    if isinstance(how, (Total, Last)) or before["n"]:
        return before
    start = dict.fromkeys(before, end["first"]) | {"n": 0}
    return start | ({"y": None if end["first"] is None else 0.0} if isinstance(how, MeanOfSpread) else {})


def _after(how: Recursion, start: dict, end: dict) -> dict:
    """What a series has after a block, from what it had before."""
    if isinstance(how, Total):
        return {"y": start["y"] if end["y"] is None else (start["y"] or 0) + end["y"]}
    if isinstance(how, Last):
        return {"y": start["y"] if end["y"] is None else end["y"]}
    n = start["n"] + end["n"]
    if not n:
        return start
    # a block without values leaves a mean as it was, and a constant series constant
    flat = start["flat"] if not end["n"] or end["flat"] == start["flat"] else None
    faded = lambda y, alpha, into, steps: y + (1 - alpha) ** steps * into
    if isinstance(how, Mean):
        return {"n": n, "y": faded(end["y"], how.alpha, start["y"], end["n"]) if flat is None else flat, "flat": flat}
    if flat is not None:
        return {"n": n, "y": 0.0, "flat": flat, "fast": flat, "slow": flat}
    y = faded(end["y"], how.alpha, start["y"], end["rows"]) + end["by_fast"] * start["fast"] - end["by_slow"] * start["slow"]
    return {"n": n, "y": y, "flat": None, "fast": faded(end["fast"], how.fast, start["fast"], end["n"]), "slow": faded(end["slow"], how.slow, start["slow"], end["n"])}


def _composed(specs: Mapping[str, Recursion], keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        state = {name: {"n": 0, **{p: None for p in _IN[type(how)] if p != "n"}} if "n" in _IN[type(how)] else {"y": None} for name, how in specs.items()}
        out = []
        for block in table.select([*keys, BLOCK, "_end"]).sort_by(BLOCK).to_pylist():
            start = {name: _start(how, state[name], block["_end"][name]) for name, how in specs.items()}
            out.append({**{k: block[k] for k in keys}, BLOCK: block[BLOCK], **{f"_{name}_in_{p}": x for name in specs for p, x in start[name].items()}})
            state = {name: _after(how, start[name], block["_end"][name]) for name, how in specs.items()}
        ends = table.schema.field("_end").type
        kinds = {f"_{name}_in_{p}": k for name, how in specs.items() for p, k in _arrow(_IN[type(how)], ends.field(name).type.field("y").type).items()}
        return pa.Table.from_pylist(out, pa.schema({**{k: table.schema.field(k).type for k in keys}, BLOCK: pa.int64(), **kinds}))

    return run


def scanned(rows: DataFrame, recursions: Mapping[str, Recursion], names: Names, frames: Mapping[str, Trailing] | None = None) -> DataFrame:
    """rows of in_blocks() without halo copies and with a column for each recursion and each trailing frame."""
    keys, frames = [names.key] if names.key else [], frames or {}
    rows_in = rows.withColumns({f"_{name}_x": how.value for name, how in recursions.items()})
    kinds = {name: rows_in.schema[f"_{name}_x"].dataType for name in recursions}
    as_double = {name: kinds[name] if isinstance(how, Last) else T.LongType() if isinstance(how, Total) and isinstance(kinds[name], T.IntegralType) else T.DoubleType() for name, how in recursions.items()}
    rows_in = rows_in.withColumns({f"_{name}_x": F.col(f"_{name}_x").cast(kind) for name, kind in as_double.items()})
    typed = lambda name, k: {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "value": as_double[name]}[k]
    rows_in = rows_in.withColumns({f"_{name}_x": how.value.cast("double") for name, how in frames.items()})
    parts = [T.StructField(f"_{name}_y", T.DoubleType()) for name in frames]
    parts += [T.StructField(f"_{name}_{p}", typed(name, k)) for name, how in recursions.items() for p, k in _ROW[type(how)].items()]
    ends = T.StructType([T.StructField(name, T.StructType([T.StructField(p, typed(name, k)) for p, k in _END[type(how)].items()])) for name, how in recursions.items()])
    specs, wide = ({name: replace(how, value=None) for name, how in x.items()} for x in (recursions, frames))  # a column cannot go to the workers
    schema = T.StructType([*rows.schema.fields, *parts, T.StructField("_end", ends)])
    local = written(rows_in.groupBy(*keys, BLOCK).applyInArrow(_local(specs, wide, to_arrow_type(ends)), schema), "local")
    into = [T.StructField(f"_{name}_in_{p}", typed(name, k)) for name, how in recursions.items() for p, k in _IN[type(how)].items()]
    blocks = local.where("_end IS NOT NULL").select(*keys, BLOCK, "_end")
    carry = blocks.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(_composed(specs, keys), T.StructType([*[rows.schema[k] for k in keys], T.StructField(BLOCK, T.LongType()), *into]))  # a row a block
    carry = written(carry, "carry").withColumnsRenamed({c: f"_c{c}" for c in (*keys, BLOCK)})
    same = F.col(BLOCK) == F.col(f"_c{BLOCK}")
    if keys:
        same = same & F.col(names.key).eqNullSafe(F.col(f"_c{names.key}"))
    found = {name: _result(name, how) for name, how in recursions.items()} | {name: F.col(f"_{name}_y") for name in frames}
    return local.join(carry, same).withColumns(found).select(*rows.columns, *found)


def _result(name: str, how: Recursion) -> Column:
    col = lambda p: F.col(f"_{name}_{p}")
    if isinstance(how, Mean):
        y = F.when(col("flat") == col("in_flat"), col("flat")).otherwise(col("y") + col("fade") * col("in_y"))
        return F.when(col("in_n") + col("n") >= how.min_periods, y)
    if isinstance(how, MeanOfSpread):
        y = col("y") + col("by_fast") * col("in_fast") - col("by_slow") * col("in_slow") + col("fade") * col("in_y")
        return F.when(col("in_n") + col("n") >= 1, F.when(col("flat") == col("in_flat"), 0.0).otherwise(y))
    if isinstance(how, Total):
        return F.when(col("y").isNull(), col("in_y")).otherwise(F.coalesce(col("in_y"), F.lit(0)) + col("y"))
    return F.coalesce(col("y"), col("in_y"))
