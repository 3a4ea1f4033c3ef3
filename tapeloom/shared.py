"""Tables written between steps, in the folder that driver and executors share.

A table that written() made is deleted when nothing can read it any more: no DataFrame, and none derived from it, holds the table's file index. That is
looked up whenever another table is written, by reclaim(), and at the end of the program, when what is left goes too.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tapeloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tapeloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def located(spark: SparkSession, path: str | os.PathLike) -> tuple[JavaObject, JavaObject]:
    """The file system that holds a path, and the path as it knows it. A relative path on the local one starts at this process's folder."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    where = make(os.fspath(path))
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file" and where.toUri().getScheme() is None:
        where = make(os.path.abspath(os.fspath(path)))
    return system, system.makeQualified(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = located(spark, path)
    system.delete(where, True)


def written_to(df: DataFrame, path: str) -> DataFrame:
    """Write df to a new folder and return a scan of it."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: By Spark application, its session and the tables that written() made: a weak reference in the JVM to the file index of each, and its path.
_made: dict[str, tuple[SparkSession, list[tuple[object, str]]]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a scan of it: later uses do not recompute it, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    reclaim(spark)
    path = fresh_path(spark, name)
    out = written_to(df, path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _, tables = _made.setdefault(spark.sparkContext.applicationId, (spark, []))
    tables.append((spark._jvm.java.lang.ref.WeakReference(files), path))
    return out


def reclaim(spark: SparkSession, collect: bool = False) -> int:
    """Delete the tables that nothing reads any more. Returns how many are left.

    With collect, garbage is collected before, for a second at most: plans that have just run are let go of by Spark's listeners a little later.
    """
    _, tables = _made.get(spark.sparkContext.applicationId, (spark, []))
    before, until = len(tables), time.monotonic() + 1
    while True:
        if collect and tables:
            gc.collect()
            spark._jvm.System.gc()
        dead = [t for t in tables if t[0].refersTo(None)]
        for _, path in dead:
            delete(spark, path)
        tables[:] = [t for t in tables if t not in dead]
        if not collect or not tables or len(tables) < before or time.monotonic() > until:
            return len(tables)
        time.sleep(0.2)


@atexit.register
def _at_exit() -> None:
    for application, (spark, tables) in _made.items():
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == application:
            for _, path in tables:
                delete(spark, path)
