"""Price files of one instrument: reading, checking, writing, and generated demo prices."""

from __future__ import annotations

import os
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.bars import keep_last
from tapeloom.operators.validate import raise_first
from tapeloom.shared import delete, located

PRICE_COLUMNS = ("Date", "Open", "High", "Low", "Close", "Volume")
DATE_NAMES = ("date", "datetime", "timestamp")
LEAST_ROWS = 60


def parsed_instant(text):
    """An instant from text in ISO or the usual American notation, or null."""
    formats = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text.cast("string"), F.lit(f)) for f in formats])


def normalize_prices(frame: DataFrame) -> DataFrame:
    """Date (an instant) and the five numbers, checked as a whole; of equal dates the last input row stays, in order of Date.

    Names are matched without case or surrounding blanks. Fewer than 60 rows after deduplication are an error.
    """
    canonical = {c.lower(): c for c in PRICE_COLUMNS} | dict.fromkeys(DATE_NAMES, "Date")
    found = {}
    for name in frame.columns:
        if (c := canonical.get(name.strip().lower())) and c not in found:
            found[c] = F.col(f"`{name}`")
    if missing := [c for c in PRICE_COLUMNS if c not in found]:
        raise ValueError(f"Missing required CSV columns: {', '.join(missing)}")
    number = lambda c: F.when(~F.isnan(found[c].try_cast("double")), found[c].try_cast("double")).alias(c)
    rows = frame.select(parsed_instant(found["Date"]).alias("Date"), *[number(c) for c in PRICE_COLUMNS[1:]], F.monotonically_increasing_id().alias("_arrival"))
    o, h, low, c = (F.col(x) for x in ("Open", "High", "Low", "Close"))
    gap = F.lit(False)
    for name in PRICE_COLUMNS:
        gap = gap | F.col(name).isNull()
    raise_first(rows, [
        (gap, "Price data contains missing or invalid values"), ((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "Prices must be greater than zero"),
        (F.col("Volume") < 0, "Volume cannot be negative"), (h < F.greatest(o, c, low), "High must be the largest price in each row"),
        (low > F.least(o, c, h), "Low must be the smallest price in each row"),
    ])
    kept = keep_last(rows, ["Date"], [F.col("_arrival")]).drop("_arrival")
    if kept.count() < LEAST_ROWS:
        raise ValueError(f"At least {LEAST_ROWS} price rows are required for indicator warm-up")
    return kept.orderBy("Date")


def load_prices(path: str | os.PathLike, spark: SparkSession | None = None) -> DataFrame:
    """A CSV file with a header, in any store that Spark reads. All columns are read as text, by name, and typed by normalize_prices()."""
    spark = spark or SparkSession.active()
    system, where = located(spark, path)
    if not system.exists(where) or not system.getFileStatus(where).isFile():
        raise FileNotFoundError(f"Price file not found: {path}")
    return normalize_prices(spark.read.csv(where.toString(), header=True, inferSchema=False))


def save_csv(frame: DataFrame, path: str | os.PathLike) -> str | os.PathLike:
    """One CSV file with a header, in the frame's order, in any store that Spark writes; for reports. Returns the path as it was given.

    Tasks write the parts, committed by Spark, to a hidden folder beside the file. They are then joined there, one after the other, as a stream of
    bytes, and the whole takes the file's name, in place of a file that has it. If anything fails the folder goes and an earlier file stays as it was.
    """
    spark = frame.sparkSession
    system, target = located(spark, path)
    folder = f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}"
    write = lambda rows, name: rows.write.option("timestampFormat", "yyyy-MM-dd HH:mm:ssXXX").csv(f"{folder}/{name}")
    try:
        write(frame, "rows")
        write(spark.range(1).select(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(frame.columns)]), "header")
        if system.getUri().getScheme() == "file":
            system = system.getRaw()  # no file of checksums, which a later edit by hand would belie
        whole = system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{target.getName()}"))
        _join(spark, system, [*_parts(spark, system, f"{folder}/header"), *_parts(spark, system, f"{folder}/rows")], whole)
        _take_name(spark, system, whole, target)
    finally:
        delete(spark, folder)
    return path


def _parts(spark: SparkSession, system: JavaObject, folder: str) -> list[JavaObject]:
    """The data files that Spark wrote, in the order of their partitions."""
    found = [s.getPath() for s in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    numbered = [(int(p.getName().split("-")[1]), p.getName(), p) for p in found if p.getName().startswith("part-")]
    return [p for _, _, p in sorted(numbered, key=lambda n: n[:2])]


def _join(spark: SparkSession, system: JavaObject, parts: list[JavaObject], whole: JavaObject) -> None:
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = system.create(whole, True)
    try:
        for part in parts:
            stream = system.open(part)
            try:
                copy(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()


def _take_name(spark: SparkSession, system: JavaObject, whole: JavaObject, target: JavaObject) -> None:
    """Rename, replacing a file of that name."""
    if system.exists(target) and system.getFileStatus(target).isDirectory():
        raise FileExistsError(f"A folder has the name of the file: {target.toString()}")
    if system.getUri().getScheme() == "file":
        system.rename(whole, target)
        system.delete(system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{target.getParent().toString()}/.{target.getName()}.crc")), False)
        return
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    replacing = spark.sparkContext._gateway.new_array(kind, 1)
    replacing[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(whole, target, replacing)


def generate_demo_prices(rows: int = 260, seed: int = 42, spark: SparkSession | None = None) -> DataFrame:
    """A made-up series for demonstrations: `rows` business days from 2 January 2024, the same for the same seed. Noise is hashed from day and seed."""
    if rows < LEAST_ROWS:
        raise ValueError(f"Demo data requires at least {LEAST_ROWS} rows")
    spark = spark or SparkSession.active()
    noise = lambda name: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1_000_003)) / F.lit(1_000_003.0)  # noqa: E731  in [0, 1)
    day = F.date_add(F.lit("2024-01-02").cast("date"), (F.col("id") + 2 * F.floor((F.col("id") + 1) / 5)).cast("int"))  # two days more for each weekend passed
    drift = F.col("id") * 0.0005 + 0.04 * F.sin(F.col("id") / 10.0)
    walk = F.sum(0.006 * (noise("step") - 0.5)).over(Window.orderBy("id"))  # one short series
    series = spark.range(rows).withColumn("close", 100 * F.exp(drift + walk)).withColumn("open", F.col("close") * (0.996 + 0.008 * noise("open")))
    width = 0.002 + 0.01 * noise("width")
    return normalize_prices(series.select(
        day.cast("string").alias("Date"), F.col("open").alias("Open"), (F.greatest("open", "close") * (1 + width)).alias("High"), (F.least("open", "close") * (1 - width)).alias("Low"),
        F.col("close").alias("Close"), F.floor(600_000 + 1_800_000 * noise("volume")).cast("double").alias("Volume"),
    ))
