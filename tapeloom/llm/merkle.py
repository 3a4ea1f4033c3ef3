"""Fixity audit of replicated page archives by Merkle trees.

A record is a page; its hash is the SHA-256 of its id, url and content. Records stand in the archive in order of (page_id, hash); a leaf is an
aligned range of LEAF ids, and FANOUT nodes make a node of the next level up to one root. A leaf's hash is that of the ordered list of its records, each
with its id, hash, copies and bytes, so the offset of every record within the leaf is part of what is hashed; a node's hash covers its children's in
order, with their sizes. Because ranges are fixed by id, a lost or repeated record changes only its own leaf and the way up from it.

Equal records are one row with a number of copies before any shuffle. Different records of one id (all records without an id, say) are
first hashed in shares, runs of their own order, so neither a leaf nor a task grows with an id that a third of all rows share.

audit() compares the roots of two replicas, then only the children of nodes that differ, level by level, and reads records of the
leaves that differ. Offsets of a leaf come from the sizes of the siblings before it on each level, so no running sum spans the archive.

Defined cases: null page_id forms a range of its own before all others; null url or html count as empty; repeated rows are records with
multiplicity; empty tables have the root of no leaves; every id from the least to the greatest long is exact; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm import store

#: A leaf holds 2**LEAF_BITS ids, a node 2**FANOUT_BITS children; shifts divide downwards and are exact for every long.
LEAF_BITS, FANOUT_BITS = 4, 8
LEAF, FANOUT = 1 << LEAF_BITS, 1 << FANOUT_BITS
#: Digits of a record's hash that name its share of an id's records: 16**SHARE_DIGITS shares.
SHARE_DIGITS = 3
#: The leaf of records without an id; those of longs lie above it.
NO_ID = -(1 << 60)


def records(pages: DataFrame) -> DataFrame:
    """One row per distinct record: page_id, leaf, sha256, n_bytes, copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    content = F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), part("url"), part("html")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("n_bytes"))
    rows = rows.groupBy("page_id", "sha256", "n_bytes").agg(F.count("*").alias("copies"))
    return rows.withColumn("leaf", F.coalesce(F.shiftright("page_id", LEAF_BITS), F.lit(NO_ID)).cast("long"))


def _hashed(groups, fields: list[str]):
    """Hash of the groups' ordered rows and their bytes: n_bytes."""
    members = F.sort_array(F.collect_list(F.struct(*fields, "n_bytes")))
    rows = groups.agg(members.alias("_c"), F.sum("n_bytes").alias("n_bytes"))
    line = F.concat_ws(",", F.transform("_c", lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in [*fields, "n_bytes"]])))
    return rows.withColumn("hash", F.sha2(line.cast("binary"), 256)).drop("_c")


def leaves(rows: DataFrame) -> DataFrame:
    """node, hash and n_bytes of level 0."""
    shared = rows.withColumn("n_bytes", F.col("n_bytes") * F.col("copies")).groupBy("leaf", "page_id", F.substring("sha256", 1, SHARE_DIGITS).alias("share"))
    shares = _hashed(shared, ["sha256", "copies"])
    return _hashed(shares.groupBy(F.col("leaf").alias("node")), ["page_id", "share", "hash"]).select("node", "hash", "n_bytes")


def parents(level: DataFrame) -> DataFrame:
    """The next level: at most FANOUT children meet in a row."""
    return _hashed(level.groupBy(F.shiftright("node", FANOUT_BITS).alias("up")), ["node", "hash"]).select(F.col("up").alias("node"), "hash", "n_bytes")


def tree(rows: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Levels 0 to height, each written once."""
    levels = [store.written(leaves(rows), f"{name}-0")]
    for k in range(height):
        levels.append(store.written(parents(levels[-1]), f"{name}-{k + 1}"))
    return levels


def height_of(*tables: DataFrame) -> int:
    """Levels needed until the ids at hand share a node, the null range's aside; floor division leaves -1 and 0 as last two nodes."""
    span = 0
    for t in tables:
        low, high = t.where("page_id is not null").agg(F.min("leaf"), F.max("leaf")).first()
        span = max(span, abs(low or 0), abs(high or 0))
    height = 1
    while FANOUT**height <= span:
        height += 1
    return height


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records of the replica: page_id, status (altered, missing, extra, repeated), the primary's and the replica's hash and copies, and the byte range
    of the record's leaf in the primary archive. One row for each differing (page_id, hash); only where an id, or the null id, has exactly two, one on
    each side, they are one altered record."""
    a, b = store.written(records(primary), "primary"), store.written(records(replica), "replica")
    height = height_of(a, b)
    mine, theirs = tree(a, height, "tree-a"), tree(b, height, "tree-b")
    bad: DataFrame | None = None
    differing: dict[int, DataFrame] = {}
    for level in range(height, -1, -1):
        x, y = mine[level].select("node", F.col("hash").alias("_x")), theirs[level].select("node", F.col("hash").alias("_y"))
        if bad is not None:
            below = F.shiftright("node", FANOUT_BITS)
            up = bad.select(F.col("node").alias("_up"))
            x, y = x.join(up, below == F.col("_up"), "left_semi"), y.join(up, below == F.col("_up"), "left_semi")
        bad = differing[level] = store.written(x.join(y, "node", "full").where("not (_x <=> _y)").select("node"), "differ")
    # the way down from the root gives each differing leaf its start: bytes of earlier siblings on every level, below differing nodes only
    start = None
    for level in range(height, -1, -1):
        up = F.shiftright("node", FANOUT_BITS)
        siblings = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1) if level < height else Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        here = mine[level].withColumn("up", up)
        if level < height:
            here = here.join(differing[level + 1].select(F.col("node").alias("up")), "up", "left_semi")
        here = here.withColumn("start", F.coalesce(F.sum("n_bytes").over(siblings), F.lit(0)))
        if start is not None:
            here = here.join(start.select(F.col("node").alias("up"), F.col("start").alias("_s")), "up").withColumn("start", F.col("start") + F.col("_s"))
        start = here.select("node", "start", "n_bytes")
    ranges = bad.join(start, "node", "left").select(F.col("node").alias("leaf"), F.col("start").alias("range_start"), (F.col("start") + F.col("n_bytes")).alias("range_end"))
    pick = lambda t, side: t.join(bad.select(F.col("node").alias("leaf")), "leaf", "left_semi").select("leaf", F.coalesce("page_id", F.lit(0)).alias("_id"), "sha256", F.col("copies").alias(f"{side}_copies"))
    both = pick(a, "primary").join(pick(b, "replica"), ["leaf", "_id", "sha256"], "full")
    odd = store.written(both.where("not (primary_copies <=> replica_copies)"), "odd")
    # an id with one record on each side only was altered; any other record stands for itself
    only = lambda side, other, c: F.max(F.when(F.col(f"{side}_copies").isNotNull() & F.col(f"{other}_copies").isNull(), F.col(c)))
    sides = [("primary", "replica"), ("replica", "primary")]
    per_id = odd.groupBy("leaf", "_id").agg(F.count("*").alias("_n"), *(only(s, o, "sha256").alias(f"{s}_sha256") for s, o in sides), *(only(s, o, f"{s}_copies").alias(f"{s}_copies") for s, o in sides))
    paired = per_id.where("_n = 2 and primary_sha256 is not null and replica_sha256 is not null")
    altered = store.written(paired.withColumn("status", F.lit("altered")).drop("_n"), "altered")
    single = odd.join(altered.select("leaf", "_id"), ["leaf", "_id"], "left_anti")
    status = F.when(F.col("primary_copies").isNull(), "extra").when(F.col("replica_copies").isNull(), "missing").otherwise("repeated")
    single = single.select("leaf", "_id", *(F.when(F.col(f"{s}_copies").isNotNull(), F.col("sha256")).alias(f"{s}_sha256") for s, _ in sides), *(F.coalesce(f"{s}_copies", F.lit(0)).alias(f"{s}_copies") for s, _ in sides), status.alias("status"))
    out = altered.unionByName(single).join(ranges, "leaf", "left").withColumn("page_id", F.when(F.col("leaf") != NO_ID, F.col("_id")))
    return out.select("page_id", "status", "primary_sha256", "replica_sha256", "primary_copies", "replica_copies", "range_start", "range_end")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for exercising an audit: of each 211 ids one is altered, one cut short, one lost and one written twice."""
    m = F.pmod(F.col("page_id"), F.lit(211))
    html = F.when(m == 3, F.concat(F.lit("#"), F.expr("substr(html, 2)"))).when(m == 5, F.expr("substr(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    rows = pages.select("page_id", "url", html.alias("html"), F.when(m == 7, 0).when(m == 11, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_k", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_k", "_n")
