"""Fingerprints by a randomised edit embedding.

A walk reads a text with shared random bits: at time t it stands on a character and moves on if the bit of (t, character) is 1. The
embedding is the character stood on at each time. Two texts with few edits soon walk in step again, so edit distance becomes
Hamming distance. (After Chakraborty, Goldenberg and Koucký, "Streaming algorithms for embedding and computing edit distance", 2016.)

The shared bits repeat after PERIOD times. A fingerprint samples the embedding at fixed times, SAMPLES for each doubling of time (FIRST doublings
are joined in the first level), and keeps four bits of a hash of each character; so it grows with the logarithm of the length, and texts of different
length share their times. likeness() is the share of equal samples, each level weighted by the time it stands for.

Banding draws samples of one level at a time: of a text's last level, where the text reaches the drawn times, and of the level before, which is always
full; texts that agree on a band meet and are verified by likeness (similar_classes()), after a bound on it from a few words of each (mark_of()) that turns
most pairs away where they meet. Walks of many texts are stepped side by side.

Defined cases: a null text is empty; the fingerprint of an empty text is "" and two empty texts have likeness 1, an empty and another 0;
rows with equal doc_id are ordered by xxhash64 of their text, so that long texts need not be compared; a null doc_id comes last in
descending order; one row is its own next document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import components, store
from tapeloom.llm.kernels import U64, mix64, text_chunks

SAMPLES, FIRST, PERIOD, KINDS = 64, 8, 4096, 256
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _advances() -> np.ndarray:
    """For each character kind and time (modulo PERIOD): steps until the walk leaves the character."""
    bits = (mix64(np.arange(KINDS * PERIOD, dtype=U64) + U64(1 << 40)) >> U64(63)).reshape(KINDS, PERIOD).astype(bool)
    bits[:, -1] = True
    out = np.empty((KINDS, PERIOD), dtype=np.int16)
    out[:, -1] = 1
    for t in range(PERIOD - 2, -1, -1):
        out[:, t] = np.where(bits[:, t], 1, out[:, t + 1] + 1)
    return out


def _sample_times(levels: int = 36) -> np.ndarray:
    """SAMPLES times for each level, one in each stratum: level 0 is [0, 2**FIRST), level k is [2**(FIRST+k-1), 2**(FIRST+k))."""
    out = np.empty((levels, SAMPLES), dtype=np.int64)
    for k in range(levels):
        low, wide = (0, 1 << FIRST) if k == 0 else (1 << (FIRST + k - 1), 1 << (FIRST + k - 1))
        jitter = (mix64(np.arange(SAMPLES) + 1000 * k) >> U64(11)).astype(np.float64) * 2.0**-53
        out[k] = low + ((np.arange(SAMPLES) + jitter) * (wide / SAMPLES)).astype(np.int64)
    out[0, 0] = 0  # so that any text but the empty one has a sample
    return out


_TIMES = _sample_times()
_tables: list[tuple[np.ndarray, list[list[int]]]] = []
#: With fewer walks than this under way, each is finished by itself.
FEW = 48


def kinds_of(text: str) -> np.ndarray:
    """Each code point's kind, a hash to KINDS values."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(U64)
    with np.errstate(over="ignore"):
        return ((points * U64(0x9E3779B97F4A7C15)) >> U64(56)).astype(np.uint8)


def walks(kinds: np.ndarray, sizes: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The times at which the walks leave each character, for texts that stand one after the other in kinds; a walk starts at 0, or at its `begin`.

    All walks take one step at a time together, the longest first, so that those under way are always a prefix.
    """
    if not _tables:
        table = _advances()
        _tables.append((table.reshape(-1), table.tolist()))
    advance, rows = _tables[0]
    out = np.empty(len(kinds), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    time = np.zeros(len(sizes), dtype=np.int64) if begin is None else begin[order].astype(np.int64)
    ordered = sizes[order]
    step, under_way = 0, len(sizes)
    while True:
        under_way = int(np.searchsorted(-ordered[:under_way], -step, side="left"))
        if under_way < FEW:
            break
        # the walks under way stay the same for as long as the shortest of them lasts
        last = int(ordered[under_way - 1])
        t, place = time[:under_way], at[:under_way] + step
        for _ in range(last - step):
            t += advance[(kinds[place].astype(np.int64) << 12) | (t & (PERIOD - 1))]
            out[place] = t
            place += 1
        step = last
    for k in range(under_way):
        now, found = int(time[k]), []
        low, high = int(at[k]) + step, int(at[k]) + int(ordered[k])
        for row in map(rows.__getitem__, kinds[low:high].tobytes()):
            now += row[now & 4095]
            found.append(now)
        out[low:high] = found
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    kinds = [kinds_of(t) for t in texts]
    sizes = np.array([len(k) for k in kinds], dtype=np.int64)
    leaves = np.split(walks(np.concatenate([np.empty(0, np.uint8), *kinds]), sizes), np.cumsum(sizes)[:-1])
    return [fingerprint_of(k, w) for k, w in zip(kinds, leaves)]


def fingerprint_of(kinds: np.ndarray, leaves: np.ndarray) -> str:
    """Hexadecimal samples of the embedding: a level's samples that fall past the end are "-"."""
    if not len(leaves):
        return ""
    end = int(leaves[-1])
    levels = 1 + max(0, (end - 1).bit_length() - FIRST)
    times = _TIMES[:levels].reshape(-1)
    inside = times < end
    stood = np.searchsorted(leaves, times[inside], side="right")
    out = np.full(len(times), ord("-"), dtype=np.uint8)
    out[inside] = HEX[kinds[stood] & 15]
    return out.tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Estimated share of equal places of two embeddings, from their fingerprints."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    levels = max(len(x), len(y)) // SAMPLES
    x, y = (np.concatenate([v, np.full(levels * SAMPLES - len(v), 45, np.uint8)]).reshape(levels, SAMPLES) for v in (x, y))
    used, equal = ((x != 45) | (y != 45)).sum(axis=1), ((x == y) & (x != 45)).sum(axis=1)
    weight = np.array([1 << FIRST] + [1 << (FIRST + k) for k in range(levels - 1)], dtype=np.float64) / SAMPLES
    return float((weight * equal).sum() / (weight * used).sum())


BANDS, BAND_SAMPLES = 24, 7
_RANKED = [np.argsort(mix64(np.arange(SAMPLES) + 7919 * (band + 1))) for band in range(BANDS)]


def band_keys(fingerprint: str) -> list[int]:
    """Keys of bit-sampled bands over the last two levels, or, where there is one level only, over its samples up to the last two powers of two.

    Each band draws BAND_SAMPLES samples. A sample past the end of the text says nothing, so a band that draws one gives no key.
    """
    filled = len(fingerprint.rstrip("-"))
    full, rest = divmod(filled, SAMPLES)
    if full:
        spans = [((full - 1) * SAMPLES, SAMPLES, SAMPLES), (full * SAMPLES, SAMPLES, rest)]
    else:
        top = 1 << filled.bit_length() - 1
        spans = [(0, top, top), (0, top // 2, top // 2)]
    keys = []
    for first, drawn_from, reached in spans:
        for band, ranked in enumerate(_RANKED if reached else []):
            drawn = [i for i in ranked.tolist() if i < drawn_from][:BAND_SAMPLES]
            if max(drawn) < reached:
                said = f"{first}/{drawn_from}/{band}/" + "".join(fingerprint[first + i] for i in drawn)
                keys.append(int.from_bytes(hashlib.blake2b(said.encode(), digest_size=8).digest(), "little", signed=True))
    return keys


MARK = "struct<weight:bigint,full:int,rest:int,f0:bigint,f1:bigint,p0:bigint,p1:bigint>"


def mark_of(fingerprint: str) -> tuple[int, ...]:
    """What bounds a text's likeness to others: the weight of its samples, its number of full levels and of samples past them, and two bits of each sample of
    the last full level and of the one after it."""
    full, rest = divmod(len(fingerprint.rstrip("-")), SAMPLES)
    bits = []
    for level in (full - 1, full):
        said = fingerprint[level * SAMPLES : (level + 1) * SAMPLES].rstrip("-") if level >= 0 else ""
        for plane in (0, 1):
            word = sum((int(c, 16) >> plane & 1) << i for i, c in enumerate(said))
            bits.append(word - (1 << 64) if word >> 63 else word)
    return (SAMPLES * (full and 2 << full) + rest * (2 << max(full, 1)), full, rest, *bits)


def _marks(fingerprints: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mark_of(f) for f in fingerprints], columns=["weight", "full", "rest", "f0", "f1", "p0", "p1"])


def may_be_alike(least: float):
    """Whether two texts with these marks can have likeness `least`: what is unequal for sure, by length and by the two bits, is held against it."""

    def may(a: Column, b: Column) -> Column:
        below = lambda m: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), m))
        unequal = lambda x, y, m: F.bit_count((x[0].bitwiseXOR(y[0])).bitwiseOR(x[1].bitwiseXOR(y[1])).bitwiseAND(m))
        part, level = (lambda m: (m["p0"], m["p1"])), (lambda m: (m["f0"], m["f1"]))
        weight = lambda k: F.call_function("shiftleft", F.lit(2).cast("long"), F.greatest(k, F.lit(1)))  # noqa: E731  of a sample of level k
        same = weight(a["full"] - 1) * unequal(level(a), level(b), F.lit(-1).cast("long")) + weight(a["full"]) * unequal(part(a), part(b), below(F.least(a["rest"], b["rest"])))
        longer = weight(a["full"]) * unequal(part(a), level(b), below(a["rest"]))  # b's last full level is a's last one
        shorter = weight(b["full"]) * unequal(part(b), level(a), below(b["rest"]))
        step = b["full"] - a["full"]
        lost = F.when(step == 0, same).when(step == 1, longer).when(step == -1, shorter).otherwise(0)
        return F.least(a["weight"], b["weight"]) - lost >= (least - 1e-9) * F.greatest(a["weight"], b["weight"])

    return may


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive bucket by bucket in descending order, each bucket closed by a copy of the next bucket's first row."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []
    for batch in batches:
        arrived = list(zip(*(c.to_pylist() for c in batch.columns)))
        for a, b in text_chunks([r[2] for r in arrived], 4_000_000):
            rows = _compared([*held, *arrived[a:b]])
            held = [] if arrived[b - 1][3] else [arrived[b - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)


def _compared(arrived: list[tuple]) -> list[tuple]:
    """Each row (bucket, doc_id, text, guest) with the one after it in its bucket."""
    kinds = [kinds_of(r[2]) for r in arrived]
    sizes = np.array([len(k) for k in kinds], dtype=np.int64)
    leaves = np.split(walks(np.concatenate(kinds), sizes), np.cumsum(sizes)[:-1])
    marks = [fingerprint_of(k, w) for k, w in zip(kinds, leaves)]
    pairs = [i for i in range(len(arrived) - 1) if not arrived[i][3] and arrived[i][0] == arrived[i + 1][0]]
    stay = [len(kinds[i]) - len(kinds[i]) // 3 for i in pairs]
    heads = [kinds[i + 1][: len(kinds[i]) // 3] for i in pairs]
    begin = np.array([leaves[i][k - 1] if k else 0 for i, k in zip(pairs, stay)], dtype=np.int64)
    lengths = np.array([len(h) for h in heads], dtype=np.int64)
    ends = np.split(walks(np.concatenate([np.empty(0, np.uint8), *heads]), lengths, begin), np.cumsum(lengths)[:-1]) if pairs else []
    out = []
    for i, k, head, end in zip(pairs, stay, heads, ends):
        _, doc_id, text, _ = arrived[i]
        edited = text[:k] + arrived[i + 1][2][: len(text) // 3]
        mark = fingerprint_of(np.concatenate([kinds[i][:k], head]), np.concatenate([leaves[i][:k], end]))
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        out.append((doc_id, len(text), sha, marks[i], mark, likeness(marks[i], mark), likeness(marks[i], marks[i + 1])))
    return out


def _in_buckets(rows: DataFrame, total: int, rows_per_bucket: int) -> DataFrame:
    """rows (doc_id, _tie, ...) with _bucket, a struct whose order is the descending order of ids, of about rows_per_bucket rows each.

    Buckets are bounded by quantiles of the id. An id that would fill several by itself (null ids, say) is a run of buckets of its own, by ranges of
    the hash that orders its rows.
    """
    # ascending order of the key is descending order of the id; a null id is last
    rows = rows.withColumn("_key", F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf"))))
    n = -(-total // rows_per_bucket)
    bounds = rows.where("doc_id is not null").approxQuantile("_key", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    splits = [-float("inf"), *sorted({b for b in bounds if abs(b) != float("inf")}), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(rows).withColumn("_range", F.col("_range").cast("int"))
    else:
        rows = rows.withColumn("_range", F.lit(0))
    # the complement of an id falls as the id rises, and every long has one; null sorts before all complements, so it is told apart first
    rows = rows.withColumn("_place", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("id")))
    crowded = rows.groupBy("_range", "_place").count().where(F.col("count") > 4 * rows_per_bucket)
    shares = F.ceil(F.col("count") / rows_per_bucket).cast("int")
    crowded = crowded.groupBy(F.col("_range").alias("_in")).agg(F.sort_array(F.collect_list(F.struct("_place", shares.alias("shares")))).alias("_crowded"))
    # at most total / (4 * rows_per_bucket) ids, fewer than there are buckets
    rows = rows.join(F.broadcast(crowded), F.col("_range") == F.col("_in"), "left")
    before = F.coalesce(F.size(F.filter("_crowded", lambda c: c["_place"] < F.col("_place"))), F.lit(0))
    own = F.try_element_at(F.filter("_crowded", lambda c: c["_place"] == F.col("_place")), F.lit(1))["shares"]
    share = F.when(own.isNotNull(), F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * own))
    bucket = F.struct("_range", (2 * before + own.isNotNull().cast("int")).alias("part"), F.coalesce(F.least(share, own - 1), F.lit(0)).cast("int").alias("share"))
    return rows.withColumn("_bucket", bucket).drop("_key", "_range", "_in", "_crowded")


def edit_fingerprints(docs: DataFrame, rows_per_bucket: int = 500, max_buckets: int = 1 << 16) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Rows are dealt into buckets of the descending order, and each bucket gets a copy of the next one's first row, so neighbours meet
    without any ordering in one task and each text is shuffled once. The driver sees the bounds and one key for each bucket, about max_buckets at most
    (buckets grow beyond that).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    rows = _in_buckets(rows.withColumn("_tie", F.xxhash64("text")), total, max(rows_per_bucket, -(-total // max_buckets)))
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct("_place", "_tie")).alias("_first")).collect()
    firsts.sort(key=lambda r: tuple(r["_bucket"]))
    # the first row of a bucket also closes the bucket before it; that of the first bucket closes the last
    guests = [(r["_bucket"], k, r["_first"], (k or len(firsts)) - 1) for k, r in enumerate(firsts)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in ("_bucket", "_place", "_tie")}
    table = spark.createDataFrame(guests, f"_at {kinds['_bucket']}, _number int, _first struct<_place:{kinds['_place']},_tie:bigint>, _before int")
    here = F.struct(F.col("_number").alias("b"), F.lit(False).alias("g"))
    places = F.when(F.struct("_place", "_tie") == F.col("_first"), F.array(here, F.struct(F.col("_before").alias("b"), F.lit(True).alias("g"))))
    dealt = rows.join(F.broadcast(table), F.col("_bucket") == F.col("_at")).select("doc_id", "text", "_tie", F.explode(F.coalesce(places, F.array(here))).alias("_p"))
    dealt = dealt.select(F.col("_p.b").alias("bucket"), "doc_id", "text", F.col("_p.g").alias("guest"), "_tie")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "_tie").drop("_tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_compare, schema)


def _fingerprint(texts: pd.Series) -> pd.Series:
    texts = texts.fillna("").tolist()
    return pd.Series([f for a, b in text_chunks(texts, 4_000_000) for f in fingerprints(texts[a:b])], dtype="object")


def text_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    mark = F.pandas_udf(_fingerprint, "string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text").cast("string")).alias("fingerprint"))


def _bands(fingerprints: pd.Series) -> pd.Series:
    return fingerprints.map(band_keys)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def likenesses(fingerprints: list[str]) -> np.ndarray:
    """likeness() of any two of the fingerprints, none of them empty."""
    levels = max(map(len, fingerprints)) // SAMPLES
    rows = np.frombuffer("".join(f.ljust(levels * SAMPLES, "-") for f in fingerprints).encode(), dtype=np.uint8).reshape(len(fingerprints), -1)
    weight = np.repeat(np.array([1 << FIRST] + [1 << (FIRST + k) for k in range(levels - 1)], dtype=np.float64) / SAMPLES, SAMPLES)
    said = rows != 45
    out = np.empty((len(rows), len(rows)))
    for i, row in enumerate(rows):
        out[i] = ((rows == row) & said) @ weight / ((said | said[i]) @ weight)
    return out


def _links_in_tile(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        label, mine, node = (frame[c].to_numpy() for c in ("label", "mine", "node"))
        linked = likenesses(frame["fingerprint"].tolist()) >= least
        linked &= (label[:, None] != label[None, :]) & (node[:, None] < node[None, :])
        if len(set(mine)) > 1:
            linked &= mine[:, None] != mine[None, :]  # pairs of one tile are met in that tile's own group
        x, y = np.nonzero(linked)
        return pd.DataFrame({"a": node[x], "b": node[y]})

    return run


def similar_classes(fingerprints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) for rows (doc_id, fingerprint): classes are joined by pairs that share a band
    and whose likeness is at least `least`. Equal fingerprints are one class; an empty one links with empty ones only; a null doc_id is linked like any
    other, and a class without any id has a null class_id; an empty table gives no rows."""
    bands, alike, mark = F.pandas_udf(_bands, "array<long>"), F.pandas_udf(_likeness, "double"), F.pandas_udf(_marks, MARK)
    rows = store.written(fingerprints.select("doc_id", "fingerprint"), "fingerprints")
    marks = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    nodes = store.written(marks.select("fingerprint", "first_id", F.monotonically_increasing_id().alias("node")), "marks")
    marked = store.written(nodes.where("fingerprint != ''").select("node", mark("fingerprint").alias("mark")), "bounds")
    members = store.written(nodes.where("fingerprint != ''").select("node", F.explode(bands("fingerprint")).alias("band")), "bands")

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("fingerprint").alias("_a")), "a")
        both = both.join(nodes.select(F.col("node").alias("b"), F.col("fingerprint").alias("_b")), "b")
        return both.where(alike("_a", "_b") >= least).select("a", "b")

    def similar_in_tiles(tiled: DataFrame) -> DataFrame:
        with_fingerprints = tiled.join(nodes.select("node", "fingerprint"), "node")
        return with_fingerprints.groupBy("band", "i", "j").applyInPandas(_links_in_tile(least), "a long, b long").distinct()

    labels = components.linked_classes(members, similar, similar_in_tiles, marks=marked, may=may_be_alike(least))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_ids = store.written(labelled.groupBy("label").agg(F.min("first_id").alias("class_id")), "class-ids")
    classes = store.written(labelled.join(least_ids, "label").select("fingerprint", "class_id"), "classes")
    return rows.join(classes, "fingerprint").select("doc_id", "class_id")
