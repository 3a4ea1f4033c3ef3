"""A time-varying curriculum: sources mixed to target weights, documents laid out over training by inverted demand.

Each source has a weight schedule over training time t in [0, 1]: linear from (1 + tilt) to (1 - tilt) times its mean, tilt given by
source. Its integral, scaled to the source's target, is the source's cumulative demand for words. Documents of a source
stand in a fixed pseudo-random order; the words before a document, put into the inverse of the demand, give the time at which
it is due. A source that must give more words than it has is read a second time in the same order. Rows are range-sorted by time.

Targets: sources by code point (null last) weigh WEIGHTS in turn and share `total` times all words; none gets more than `repeat`
times its own words, and what it cannot take is shared again by weight until none is above.

The running count of words inside a source is taken in cells (source, slice of the pseudo-random order): cells are summed, cell sums are
accumulated, and rows are accumulated within their cell. A source that holds a third of all rows is many cells, and so is a doc_id (null, say): the order
is that of a digest of id and text. Targets come from one row per source, in one task.

Defined cases: a null or blank text has size 0 and takes 0 words; null sources are one source, the last; rows with equal
doc_id are separate documents, and equal rows take equal places up to their own words; an empty table gives an empty result; extra columns are ignored by mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import store

WEIGHTS = (3.0, 1.0, 2.0)
TILTS = (0.5, -0.5, 0.0)
CELL_ROWS = 100_000
LEAST_SLICES = 256
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target, tilt. sized needs source and size.

    Windows over this table see one row per source. A source stands at its cap exactly if its cap per weight is at
    most the common level at which the others share the rest.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("_place", place).withColumn("weight", _cycle(weights, F.col("_place"))).withColumn("tilt", _cycle(TILTS, F.col("_place")))
    sources = sources.withColumn("_cap", repeat * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("weight"))
    upward = Window.orderBy("_level", "_place")
    everything = Window.partitionBy()
    wanted = total * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("_cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("_share", (wanted - before) / open_weight)
    # shares assume that all sources of lower levels are at their caps; the first source above its share fixes the common level
    level = F.min_by("_share", F.when(F.col("_level") > F.col("_share"), F.struct("_level", "_place"))).over(everything)
    target = F.least(F.col("_cap"), F.col("_common") * F.col("weight"))
    sources = sources.withColumn("_common", level)
    return sources.select("source", "source_size", "weight", F.coalesce(target, F.col("_cap")).alias("target"), "tilt")


def due_time(share: Column, tilt: Column) -> Column:
    """The time t at which a demand with density 1 + tilt * (1 - 2 t) has reached `share` of its whole: the smaller root of tilt t² - (1 + tilt) t + share."""
    b = 1 + tilt
    root = F.sqrt(F.greatest(b * b - 4 * tilt * share, F.lit(0.0)))
    return F.least(F.greatest(2 * share / (b + root), F.lit(0.0)), F.lit(1.0))


def _digest() -> Column:
    """The fixed pseudo-random order of documents."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(part("doc_id"), F.lit("\n"), part("text")).cast("binary"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, repeat: int = 2, cell_rows: int = CELL_ROWS, key: str | None = None) -> DataFrame:
    """All columns of docs' rows that matter to the mix (and the column key, a number for each row, if named), and for each: size, source_size, target, taken,
    and takes: one struct (time, words) for each reading of the document that the mix uses."""
    spark_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), _digest().alias("_key"), *([key] if key else []))
    return mixed_rows(spark_rows, weights, total, repeat, cell_rows, key)


def mixed_rows(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, repeat: int = 2, cell_rows: int = CELL_ROWS, key: str | None = None) -> DataFrame:
    """mixture() for rows (doc_id, source, size, and _key, whose order is that of the documents)."""
    sized = store.written(sized, "sizes")
    slices = max(LEAST_SLICES, -(-sized.count() // cell_rows))
    targets = store.written(source_targets(sized, weights, total, float(repeat)), "targets")
    # the slice is a coarser reading of the key, so slices in order are the keys in order
    sized = sized.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32)).cast("long"))
    cells = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "_slice", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    facts = cells.withColumnRenamed("source", "_s").join(targets.withColumnRenamed("source", "_t"), F.expr("_s <=> _t")).drop("_t").withColumnRenamed("_slice", "_c")
    within = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", *([key] if key else [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("_upto", F.sum("size").over(within))
    rows = rows.join(facts, F.expr("_slice = _c AND source <=> _s"))
    size, words = F.col("size"), F.floor("target")
    start = F.col("_before") + F.col("_upto") - size
    takes = []
    for reading in range(repeat):
        at = start + reading * F.col("source_size")
        take = F.greatest(F.least(size, words - at), F.lit(0))
        takes.append(F.when(take > 0, F.struct(due_time(F.try_divide(at, F.col("target")), F.col("tilt")).alias("time"), take.cast("long").alias("words"))))
    rows = rows.withColumn("takes", F.array_compact(F.array(*takes)))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes", *([key] if key else []))


def curriculum(mixed: DataFrame) -> DataFrame:
    """Rows of mixture() range-sorted by the time of their first reading; documents that the mix leaves out come last."""
    first = F.when(F.size("takes") > 0, F.col("takes")[0]["time"])
    return mixed.withColumn("position", F.round(first, 9)).orderBy(F.col("position").asc_nulls_last(), "doc_id")
