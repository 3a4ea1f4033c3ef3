"""Connected components of a table of links, by alternating large-star and small-star steps.

Links are contracted first, LINKS_PER_TASK at a time: a task replaces those it is handed by stars of the same components, so a small table is settled at once
and a large one has short chains. Then each step is one grouping by node, so no component is ever brought together; the number of rounds grows with the
logarithm of the longest chain. Every round is written to the shared folder, which cuts the lineage. What is counted by node or band is written before it
is joined to the rows again, so that Spark can split a node or band that holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import store


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: each node hands its larger neighbours to the smallest of its neighbourhood; small: the smaller ones and itself."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = store.written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = around.join(least, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    handed = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.where("a != m").select("a", F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that itself hangs on none."""
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    roles = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return roles.where("hangs + holds > 1").isEmpty()


LINKS_PER_TASK = 100_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the links (a, b): each node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, top = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
        x, y = top[x], top[y]
        x, y = x[x != y], y[x != y]
    below = top != np.arange(len(nodes))
    return nodes[below], nodes[top[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = np.empty(0, np.int64)
    a, b = (np.concatenate(c) for c in zip((empty, empty), *((r.column(0).to_numpy(), r.column(1).to_numpy()) for r in batches)))
    for at in range(0, len(a), LINKS_PER_TASK):  # parts may be dealt unevenly, and memory stays bounded all the same
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(a[at : at + LINKS_PER_TASK], b[at : at + LINKS_PER_TASK])], names=["a", "b"])


def smallest_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node of its component."""
    links = store.written(links.where("a != b").select("a", "b"), "links")
    shares = links.repartition(max(1, -(-links.count() // LINKS_PER_TASK)))
    now = store.written(shares.mapInArrow(_contract, "a long, b long").distinct(), "star")
    while not _settled(now):
        now = store.written(_star(store.written(_star(now, True), "star"), False), "star")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


SMALL_BAND = 32
TILE = 256
TILE_SIZE = 4_000_000


def tiles(rows: DataFrame, tile: int = TILE, tile_size: int = TILE_SIZE) -> DataFrame:
    """rows (band, node, label, n, and total, the band's sum of sizes) of large bands, copied once for each pair of tiles that a row's tile is in: band, i, j,
    mine, node, label.

    A band of n rows becomes (n / tile)² / 2 groups of at most two tiles each, and of more if its rows are large, so no group grows with its band.
    """
    count = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("total") / tile_size), F.lit(1)).cast("int")
    placed = rows.withColumn("mine", F.pmod(F.xxhash64("node", "band"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return placed.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label")


def linked_classes(members: DataFrame, similar: Callable[[DataFrame], DataFrame], similar_in_tiles: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], None] | None = None, sizes: Callable[[], DataFrame] | None = None, marks: DataFrame | None = None, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(node, label) of the classes of nodes that share a band (members: node, band) and are similar.

    similar keeps those of the pairs (a, b) that are links; similar_in_tiles finds the links between different labels inside each group (band, i, j) of
    tiles(); prepare sees the members of all bands with two nodes or more first; sizes gives (node, size), what a node weighs in a tile, else 1. marks (node, mark)
    and may(mark, mark), false only for nodes that are surely not similar, keep pairs inside the task that joins their band: only the others are handed on.
    First the member met most often of each band is compared with all others. Bands that then lie in one class are done; of the rest,
    small ones are compared in pairs of different classes, and large ones tile by tile, where only links become rows.
    """
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = store.written(members.join(store.written(crowded, "crowded"), "band"), "buckets")
    if prepare:
        prepare(members)
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = members.join(met, "node").groupBy("band").agg(F.max(F.struct("met", F.bitwise_not("node").alias("not_node"))).alias("top"))
    led = members.join(store.written(leaders.select("band", F.bitwise_not("top.not_node").alias("leader")), "leaders"), "band")
    led = led.where(F.col("node") != F.col("leader"))
    if marks is not None:
        led = led.join(marks, "node").join(marks.select(F.col("node").alias("leader"), F.col("mark").alias("_other")), "leader").where(may(F.col("_other"), F.col("mark")))
    pairs = led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    found = store.written(similar(pairs), "links")
    labels = smallest_labels(found)
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    torn = rows.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("band")
    rows = store.written(rows.join(store.written(torn, "torn-bands"), "band"), "torn")
    small = rows.where(F.col("n") <= SMALL_BAND)
    small = small.join(marks, "node") if marks is not None else small.withColumn("mark", F.lit(True))
    other = small.select("band", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("mark").alias("_other"))
    apart = (F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b"))
    pairs = small.join(other, "band").where(apart & may(F.col("mark"), F.col("_other")) if may else apart).select(F.col("node").alias("a"), "b").distinct()
    large = rows.where(F.col("n") > SMALL_BAND)
    totals = (large.join(sizes(), "node") if sizes else large.withColumn("size", F.lit(1))).groupBy("band").agg(F.sum("size").alias("total"))
    large = large.join(store.written(totals, "totals"), "band")
    more = similar(pairs).unionByName(similar_in_tiles(tiles(large)))
    more = store.written(more, "links")
    if more.isEmpty():
        return labels
    return smallest_labels(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
