"""What each filter removes in every order of the filters, from one count for each set of failed filters.

A document's mask has a bit for each filter it fails. Documents are counted by part and mask, as are the good and the toxic ones; a part has at most 32
counts, whatever its size. The subset-zeta transform adds up, bit by bit, what every filter subset lets through: the documents whose mask
does not meet it. Each step of each order lies between two neighbouring subsets, so its numbers are differences of two survivors, for labels likewise.

The filters: A too few words, B too many repeated words, C too many capitals, D marks of markup, E the text of a smaller doc_id. Only E looks beyond its row:
the smallest id of each text that stands more than once is found by digest and joined to slim rows, never to texts.

Defined cases: a null text is empty; a null source is the part of the empty string; a null doc_id has no smaller id, is smaller than none and has no label;
rows of one id and text do not make each other fail E; a document is good (toxic) if any label row of its id says so, and each of its rows counts; an
empty table has no parts and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import store

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, MARKUP = 200, 50, 2, "#$%&*|"
BLANKS = r"[ \t\n\x0B\f\r]+"
MEASURES = ("n", "good", "toxic")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failed_alone(text: Column) -> Column:
    """The bits of the filters that look at a text by itself."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    counted = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    marked = F.length(F.translate(text, MARKUP, "")) < F.length(text)
    flags = {"A": counted["words"] < LEAST_WORDS, "B": 100 * counted["distinct"] < LEAST_DISTINCT_PCT * counted["words"], "C": 100 * capitals > MOST_CAPITALS_PCT * F.length(text), "D": marked}
    total = F.lit(0)
    for name, fails in flags.items():
        total = total + F.when(fails, bit(name)).otherwise(0)
    return total


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failed_alone(text).alias("mask"))
    slim = store.written(slim, "masks")
    # a text that a third of all rows hold is one row of each task before the shuffle; in the join its side is skewed, which Spark splits
    firsts = slim.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    met = slim.join(store.written(firsts, "first-ids"), "digest", "left")
    return met.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), bit("E")).otherwise(0)).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part and counts: for each mask a struct of MEASURES, as an array over all masks."""
    said = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = masked.join(said, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return rows.unionByName(marked).groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << len(FILTERS))]).alias(c) for c in MEASURES
    ])


def survivors(cells: DataFrame) -> DataFrame:
    """part and, for each measure, what every filter subset lets through: the sum over all masks that are subsets of the rest (subset-zeta, a pass a bit)."""
    everything = (1 << len(FILTERS)) - 1
    for c in MEASURES:
        for k in range(len(FILTERS)):
            cells = cells.withColumn(c, F.expr(f"transform(sequence(0, {everything}), s -> {c}[s] + IF(s & {1 << k} > 0, {c}[s - {1 << k}], 0L))"))
    return cells.select("part", *[F.reverse(c).alias(c) for c in MEASURES])  # the rest of a subset stands as far from the end as the subset from the start


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter, and the subsets before and after the step; a row for each step of each order."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            rows.append(("".join(order), k + 1, bit(name), before, before | bit(name)))
            before |= bit(name)
    return spark.createDataFrame(rows, "filter_order string, step int, one int, before int, after int")


def _shapley(name: str) -> Column:
    """What a filter removes, summed over all orders: a subset stands before it in |S|! (rest)! of them."""
    n, one, total = len(FILTERS), bit(name), F.lit(0).cast("long")
    for s in range(1 << n):
        if not s & one:
            size = s.bit_count()
            total = total + factorial(size) * factorial(n - 1 - size) * (F.col("n")[s] - F.col("n")[s | one])
    return total


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of the step's filter."""
    everything = (1 << len(FILTERS)) - 1
    kept = store.written(survivors(mask_counts(masks(docs), labels)), "survivors")
    kept = kept.withColumn("values", F.array(*[_shapley(f) for f in FILTERS]))
    at = lambda c, s: F.col(c)[F.col(s)]
    out = kept.crossJoin(F.broadcast(steps(docs.sparkSession)))  # 600 rows
    return out.select(
        "part", "filter_order", "step", at("n", "after").alias("kept"), (at("n", "before") - at("n", "after")).alias("removed"),
        (F.col("n")[0] - at("n", "one") - at("n", "before") + at("n", "after")).alias("redundant"),
        (F.col("n")[F.lit(everything) - F.col("one")] - F.col("n")[everything]).alias("unique_fails"),
        (at("good", "before") - at("good", "after")).alias("good_lost"), (at("toxic", "before") - at("toxic", "after")).alias("toxic_lost"),
        F.col("values")[F.log2(F.col("one")).cast("int")].alias("shapley"),
    )
