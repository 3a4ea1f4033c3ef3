"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text without its white space is cut where its own content says, so equal texts are cut alike: its UTF-8 bytes are read one by one, and a chunk ends at
the first place after MIN_CHUNK bytes at which each of the last four characters falls in a quarter of all characters, another one for each of the four
(a hash of the last four characters; one place in about 256), or after MAX_CHUNK bytes. No mark or script is needed for that, and an insertion changes
only the chunks around it. A recipe is the ordered list of its chunks' identifiers. A chunk's identifier is the SHA-256 of its bytes (each written as the
character of its number, in UTF-8), verified: all chunks
that share one are compared byte by byte where they meet (equal chunks meet as one row before the shuffle), and an identifier that
stood for two contents is replaced in every recipe by a digest of another kind. Texts are equal if their lists are equal; only lists, never whole
texts, are grouped and joined. Texts are normalised, cut and hashed once, into a table from which the recipes and the chunks to verify are read.

Defined cases: a null text is empty, and blank texts are all equal (their recipe is the empty list); of equal texts the one with
most code points, then the smallest doc_id, stays, a null doc_id coming after all others; rows that agree in both, equal in text or not, cannot be told
apart and all stay, unless a row number is given, which then decides; a row of the same id with fewer code points goes; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import store

MIN_CHUNK, MAX_CHUNK = 1024, 8192
BLANKS = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    """The text without its white space; one search of the bytes for each blank is cheaper than a pattern."""
    norm = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        norm = F.replace(norm, F.lit(blank), F.lit(""))
    return norm


def _sampled_character(place: int) -> str:
    """A quarter of all characters, by the last byte of their UTF-8, which varies most in every script: bytes whose product with an odd number has 0 for its
    top two bits, spread evenly and differently for each place."""
    factor = (0x9D, 0x6B, 0xC5, 0x37)[place]
    fits = [b for b in range(192) if ((b & 63 if b > 127 else b) * factor * (1 if b < 128 else 4) + 29 * place) % 256 < 64]
    listed = lambda low, high: "".join(f"\\x{b:02x}" for b in fits if low <= b < high)
    return rf"(?:[{listed(0, 128)}]|[\xc0-\xff][\x80-\xbf]{{0,2}}[{listed(128, 192)}])"


BOUNDARY = "".join(_sampled_character(k) for k in range(4))


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text's bytes in order, each byte as the character of its number. The last one may be short; every other one ends in BOUNDARY or has `most` bytes."""
    characters = F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(characters, F.lit(rf"(?s).{{{least},{most - 16}}}?{BOUNDARY}|.{{{most}}}|.+"), F.lit(0))


def chunked(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, key: str | None = None) -> DataFrame:
    """doc_id, n_chars, text_sha256 and the ordered chunks (digest, chunk), and the column key, if named."""
    carried = [F.col(key).alias("_row")] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"), *carried)
    parts = F.transform(chunks(F.col("norm"), least, most), lambda c: F.struct(F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest"), c.alias("chunk")))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), parts.alias("chunks"), *(["_row"] if key else []))


def clashing_identifiers(cut: DataFrame) -> DataFrame:
    """Chunk digests that stand for more than one content: every chunk is compared with the others of its digest."""
    pieces = cut.select(F.explode("chunks").alias("c")).select("c.digest", "c.chunk")
    return pieces.distinct().groupBy("digest").count().where("count > 1").select("digest")


def told_apart(rows: DataFrame, cut: DataFrame, clashes: DataFrame) -> DataFrame:
    """rows with another recipe for texts that hold a clashing identifier: digests of another kind of all their chunks."""
    bad = rows.select("text_sha256", F.explode("recipe").alias("digest")).join(clashes, "digest", "left_semi").select("text_sha256").distinct()
    other = cut.select("text_sha256", F.transform("chunks", lambda c: F.unhex(F.sha2(c["chunk"].cast("binary"), 512))).alias("_other"))
    other = other.join(bad, "text_sha256", "left_semi").distinct()
    return rows.join(other, "text_sha256", "left").withColumn("recipe", F.coalesce("_other", "recipe")).drop("_other")


def duplicate_groups(docs: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs. If the column key, a number for each row, is named, it is carried
    along and exactly one row of each group is kept."""
    cut = store.written(chunked(docs, least, most, key), "chunks")
    carried = ["_row"] if key else []
    rows = cut.select("doc_id", "n_chars", "text_sha256", F.col("chunks.digest").alias("recipe"), *carried)
    clashes = store.written(clashing_identifiers(cut), "clashes")
    if not clashes.isEmpty():
        rows = told_apart(rows, cut, clashes)
    # the least of these structs stays: most code points, an id before none, the smallest id
    best = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *carried)
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(best).alias("_best"))
    groups = groups.select("recipe", "group_size", F.col("_best.doc_id").alias("keep_id"), (-F.col("_best.chars")).alias("_chars"), *([F.col("_best._row").alias("_keep")] if key else []))
    # from a written table, a list that a third of all rows share is a skewed side of the join, which Spark splits
    out = rows.join(store.written(groups, "groups"), "recipe")
    kept = F.col("_row") == F.col("_keep") if key else F.expr("doc_id <=> keep_id AND n_chars = _chars")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *([F.col("_row").alias(key)] if key else []))
