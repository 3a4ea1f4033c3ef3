"""An archive: log-structured Parquet tables under one folder, changed together.

Nothing that was written is written again. A commit adds runs of new files, sorted by part, ticker and time, and then one numbered record to the log, made
only if that number is still free: writers that lose the race read what has come in between and try the next one. A record names the files it adds with
their ranges of ticker and time, and the files that no longer count. A snapshot is what the records up to some version leave.

Upserts need no look at what they replace: of a key, the rows of the newest run count. Files of one part whose ranges do not meet are scanned as they
are; only where ranges of several runs meet are rows compared, and only rows inside the newer ranges. A read of some tickers or times is handed only the
files in that range. Each run also leaves a row for every file and ticker (rows, first and last time), from which statistics are added up without reading bars.
When a part has many runs the newest ones of like size are folded into one, so each row is folded a logarithmic number of times.

Replaced files stay until vacuum(), so a DataFrame that was read before a commit can still be counted after it. Files go through Spark and Hadoop's file
system, so the folder may be on any store with a rename that does not overwrite.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, timezone
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Table schemas, with the columns that hold what the archive promises.
SCHEMAS = {
    "prices": "ticker string, timestamp timestamp, open double, high double, low double, close double, adjusted_close double, volume double, source_file string",
    "daily_prices": "ticker string, trading_date date, open double, high double, low double, close double, adjusted_close double, volume double, source_rows long",
    "symbol_summary": "ticker string, first_date date, last_date date, trading_days long, source_rows long",
    "import_log": "source_file string, ticker string, imported_rows long, rejected_rows long, error string",
    "import_rejections": "source_file string, ticker string, reason string, rejected_rows long",
    "provider_daily_bars": "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string, fetched_at timestamp",
    "provider_update_log": "updated_at timestamp, feed string, first_timestamp timestamp, last_timestamp timestamp, rows_merged long, symbols_updated long",
    "provider_minute_bars": "ticker string, timestamp timestamp, open double, high double, low double, close double, volume double, trade_count double, vwap double, feed string, fetched_at timestamp",
    "provider_minute_coverage": "ticker string, feed string, start_date date, end_date date, row_count long, completed_at timestamp",
    "provider_minute_update_log": "completed_at timestamp, feed string, start_date date, end_date date, symbols_requested long, symbols_with_bars long, rows_merged long",
    "research_dataset_metadata": "interval_minutes int, feed string, start_date date, end_date date, bar_count long, built_at timestamp",
}


@dataclass(frozen=True)
class Layout:
    """How a table is kept: its key, what tells a row's part, and the column of its time."""

    keys: tuple[str, ...]
    part: Callable[[], Column] | None = None
    time: str | None = None


LAYOUTS = {
    "daily_prices": Layout(("ticker", "trading_date"), lambda: F.year("trading_date").cast("string"), "trading_date"),
    "provider_daily_bars": Layout(("ticker", "timestamp"), lambda: F.year("timestamp").cast("string"), "timestamp"),
    "provider_minute_bars": Layout(("feed", "ticker", "timestamp"), lambda: F.concat_ws("-", "feed", F.date_format("timestamp", "yyyy-MM")), "timestamp"),
    "provider_minute_coverage": Layout(("ticker", "feed", "start_date", "end_date"), lambda: F.concat_ws("-", "feed", F.date_format("start_date", "yyyy-MM")), "start_date"),
    "research_dataset_metadata": Layout(("interval_minutes",)),
}
#: Rows of a file, runs of a part before they are folded, and seconds that replaced files are kept.
FILE_ROWS, MOST_RUNS, KEPT_SECONDS = 4_000_000, 8, 7 * 86_400


@dataclass(frozen=True)
class Upsert:
    """Rows that take the place of all rows of their keys."""

    batch: DataFrame


@dataclass(frozen=True)
class Append:
    rows: DataFrame


class ConflictError(RuntimeError):
    """Another commit changed what this one was made from."""


@dataclass(frozen=True)
class Entry:
    """A file of a table kept in parts (or the folder of another table's run), with what it holds; the rows of a higher seq count over those of a lower."""

    path: str
    run: str
    seq: int = 0
    part: str = ""
    rows: int = 0
    low: str | None = None
    high: str | None = None
    since: int | None = None
    until: int | None = None

    def meets(self, low: str | None, high: str | None, since: int | None, until: int | None) -> bool:
        """Whether a range of tickers and times, open where None, may hold rows of this file."""
        apart = lambda a, b: a is not None and b is not None and a > b
        return not (apart(self.low, high) or apart(low, self.high) or apart(self.since, until) or apart(since, self.until))


@dataclass
class State:
    """What the log leaves up to a version."""

    version: int = 0
    tables: dict[str, dict[str, Entry]] = field(default_factory=dict)
    touched: dict[str, int] = field(default_factory=dict)
    dropped: dict[str, float] = field(default_factory=dict)
    since_full: int = 0

    def apply(self, version: int, record: dict) -> None:
        self.version = version
        for table, paths in record.get("drop", {}).items():
            own = self.tables.get(table, {})
            for path in list(own) if paths is None else paths:
                if own.pop(path, None):
                    self.dropped[path] = record["at"]
            if paths is None:
                self.tables.pop(table, None)
        for table, entries in record.get("add", {}).items():
            own = self.tables.setdefault(table, {})
            for e in entries:
                own[e["path"]] = Entry(**{"seq": version, **e})
                self.since_full += 1
        for path in record.get("forget", ()):
            self.dropped.pop(path, None)
        for table in {*record.get("drop", {}), *record.get("add", {})}:
            self.touched[table] = version

    def written(self) -> dict:
        return {"version": self.version, "touched": self.touched, "dropped": self.dropped, "tables": {t: [asdict(e) for e in own.values()] for t, own in self.tables.items()}}

    @staticmethod
    def read(full: dict) -> State:
        return State(full["version"], {t: {e["path"]: Entry(**e) for e in own} for t, own in full["tables"].items()}, dict(full["touched"]), dict(full["dropped"]))


def clusters(entries: Sequence[Entry]) -> list[list[Entry]]:
    """Files in groups whose ranges meet within a part, directly or through others."""
    found: list[list[Entry]] = []
    for part in sorted({e.part for e in entries}):
        own = sorted((e for e in entries if e.part == part), key=lambda e: e.low or "")
        groups: list[list[Entry]] = []
        for e in own:
            met = [g for g in groups if any(x.meets(e.low, e.high, e.since, e.until) for x in g)]
            groups = [g for g in groups if g not in met] + [[e, *(x for g in met for x in g)]]
            passed = [g for g in groups if all(x.high is not None and x.high < (e.low or "") for x in g)]
            found += passed
            groups = [g for g in groups if g not in passed]
        found += groups
    return found


def as_number(value: date | datetime | str | None) -> int | None:
    """A date as days, an instant as microseconds; both since 1970."""
    if value is None:
        return None
    if isinstance(value, datetime):
        return round(value.astimezone(timezone.utc).timestamp() * 1_000_000)
    return (value - date(1970, 1, 1)).days


class Snapshot:
    """The archive at one version. Later commits do not change what it reads."""

    def __init__(self, archive: Archive, state: State):
        self.archive, self.state, self.version = archive, state, state.version

    def has(self, table: str) -> bool:
        return table in self.state.tables

    def entries(self, table: str) -> list[Entry]:
        return list(self.state.tables.get(table, {}).values())

    def files(self, table: str, tickers: Sequence[str] | None = None, since: date | datetime | None = None, until: date | datetime | None = None) -> list[Entry]:
        """The files that may hold rows of these tickers from `since` to `until`, both included."""
        names = sorted(tickers) if tickers is not None else [None]
        a, b = as_number(since), as_number(until)
        return [e for e in self.entries(table) if any(e.meets(n, n, a, b) for n in names)]

    def read(self, table: str, tickers: Sequence[str] | None = None, since: date | datetime | None = None, until: date | datetime | None = None) -> DataFrame:
        """The table, or its rows of some tickers and times; one of a known schema that was never written is empty."""
        if table == "symbol_summary":
            return self.symbol_summary()
        if not self.has(table) and table not in SCHEMAS:
            raise ValueError(f"The archive has no table {table}")
        rows = self._merged(table, self.files(table, tickers, since, until))
        layout = LAYOUTS.get(table)
        if tickers is not None:
            rows = rows.where(F.col("ticker").isin(list(tickers)))
        for bound, after in ((since, True), (until, False)):
            if bound is not None:
                at = F.col(layout.time)
                rows = rows.where(at >= F.lit(bound) if after else at <= F.lit(bound))
        return rows

    def _scan(self, table: str, entries: Sequence[Entry]) -> DataFrame:
        spark, root = self.archive.spark, self.archive.root
        if not entries:
            return spark.createDataFrame([], SCHEMAS[table])
        reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
        return reader.parquet(*[f"{root}/{e.path}" for e in entries])

    def _merged(self, table: str, entries: Sequence[Entry]) -> DataFrame:
        """Rows of files, the newest run's of each key where runs meet."""
        layout = LAYOUTS.get(table)
        if layout is None:
            return self._scan(table, entries)
        plain, layered = [], []
        for group in clusters(entries):
            (layered if len({e.seq for e in group}) > 1 else plain).append(group)
        out = [self._scan(table, [e for g in plain for e in g])] if plain or not layered else []
        if layered:
            files = [e for g in layered for e in g]
            oldest = {id(e) for g in layered for e in g if e.seq == min(x.seq for x in g)}
            newer = [e for e in files if id(e) not in oldest]
            bases = [e for e in files if id(e) in oldest]
            outside = F.lit(False)
            if layout.time and all(e.since is not None for e in newer):
                first, last = min(e.since for e in newer), max(e.until for e in newer)
                bound = (lambda n: F.timestamp_micros(F.lit(n))) if layout.time == "timestamp" else (lambda n: F.date_from_unix_date(F.lit(n)))
                outside = (F.col(layout.time) < bound(first)) | (F.col(layout.time) > bound(last))
                out.append(self._scan(table, bases).where(outside))
            ranked = [self._scan(table, [e for e in files if e.seq == s]).withColumn("_seq", F.lit(s)) for s in sorted({e.seq for e in files})]
            ranked = reduce(DataFrame.unionByName, ranked).where(~outside)
            newest = F.max("_seq").over(Window.partitionBy(*layout.keys))
            out.append(ranked.withColumn("_newest", newest).where("_seq = _newest").drop("_seq", "_newest"))
        return reduce(DataFrame.unionByName, out)

    # statistics ------------------------------------------------------------------------------------------------------------------------
    def summaries(self, table: str) -> DataFrame:
        """ticker, rows, since, until, source_rows: partial sums of the table. Bars are read only where runs meet."""
        clean, layered = [], []
        for group in clusters(self.entries(table)):
            (layered if len({e.seq for e in group}) > 1 else clean).extend(group)
        spark, names = self.archive.spark, ("ticker", "rows", "since", "until", "source_rows")
        out = [spark.createDataFrame([], "ticker string, rows long, since long, until long, source_rows long")]
        if clean:
            paths = spark.createDataFrame([(e.path,) for e in clean], "path string")
            kept = spark.read.parquet(*[f"{self.archive.root}/data/{run}.summary" for run in sorted({e.run for e in clean})])
            out.append(kept.join(paths, "path", "left_semi").select(*names))
        if layered:
            out.append(_by_ticker(self._merged(table, layered), table).select(*names))
        return reduce(DataFrame.unionByName, out)

    def symbol_summary(self) -> DataFrame:
        total = self.summaries("daily_prices").groupBy("ticker").agg(F.min("since").alias("a"), F.max("until").alias("b"), F.sum("rows").alias("trading_days"), F.sum("source_rows").alias("source_rows"))
        day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
        return total.select("ticker", day("a").alias("first_date"), day("b").alias("last_date"), "trading_days", "source_rows")


def _by_ticker(rows: DataFrame, table: str, *more: Column) -> DataFrame:
    time_column = LAYOUTS[table].time
    at = F.unix_micros(time_column) if dict(rows.dtypes)[time_column] == "timestamp" else F.unix_date(time_column)
    source = F.sum("source_rows") if "source_rows" in rows.columns else F.lit(None).cast("long")
    return rows.groupBy(*more, "ticker").agg(F.count("*").alias("rows"), F.min(at).cast("long").alias("since"), F.max(at).cast("long").alias("until"), source.alias("source_rows"))


class Archive:
    def __init__(self, root: str | Path, spark: SparkSession | None = None):
        self.root = str(root).rstrip("/")
        self.spark = spark or SparkSession.active()
        jvm = self.spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)
        self._conf = self.spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._known = State()

    # the log ---------------------------------------------------------------------------------------------------------------------------
    def _records(self) -> dict[int, bool]:
        """Versions in the log, and whether each has a full state too."""
        if not self._fs.exists(self._path("log")):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("log"))]
        full = {int(n.split(".")[0]) for n in names if n.endswith(".full") and not n.startswith(".")}
        return {int(n.split(".")[0]): int(n.split(".")[0]) in full for n in names if n.endswith(".json") and not n.startswith(".")}

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"log/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The archive now, or as it was at a version."""
        records = self._records()
        last = max((v for v in records if version is None or v <= version), default=0)
        start = max((v for v, full in records.items() if full and v <= last), default=0)
        if version is None and start <= self._known.version <= last:
            state = self._known
        else:
            state = State.read(self._load(f"{start:020d}.full")) if start else State()
        for v in range(state.version + 1, last + 1):
            state.apply(v, self._load(f"{v:020d}.json"))
        if version is None:
            self._known = state
        copy = State(state.version, {t: dict(own) for t, own in state.tables.items()}, dict(state.touched), dict(state.dropped), state.since_full)
        return Snapshot(self, copy)

    def _put(self, name: str, content: dict) -> bool:
        """Make a file of the log if there is none of its name."""
        draft, final = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":  # a rename of a local file overwrites; a link does not
                place = lambda p: jvm.java.nio.file.Path.of(jvm.java.net.URI.create("file://" + p.toUri().getRawPath()))
                jvm.java.nio.file.Files.createLink(place(final), place(draft))
            else:
                whole = lambda p: p.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(whole(draft), whole(final), self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def _claim(self, version: int, record: dict) -> bool:
        return self._put(f"{version:020d}.json", record)

    def _recorded(self, make: Callable[[Snapshot], dict]) -> Snapshot:
        """Add the record that make() gives for the present state, at the first free version."""
        while True:
            now = self.snapshot()
            if self._claim(now.version + 1, {"at": time.time(), **make(now)}):
                break
        now = self.snapshot()
        if now.state.since_full > sum(len(own) for own in now.state.tables.values()) // 2 + 8:  # the log read so far pays for a full state
            self._put(f"{now.version:020d}.full", now.state.written())
            self._known.since_full = 0
        return now

    def exists(self) -> bool:
        return bool(self._records())

    def require(self) -> Archive:
        if not self.exists():
            raise FileNotFoundError(f"Archive not found: {self.root}")
        return self

    def version(self) -> int:
        return max(self._records(), default=0)

    # reading ---------------------------------------------------------------------------------------------------------------------------
    def has(self, table: str) -> bool:
        return self.snapshot().has(table)

    def tables(self) -> list[str]:
        return sorted(self.snapshot().state.tables)

    def read(self, table: str, tickers: Sequence[str] | None = None, since: date | datetime | None = None, until: date | datetime | None = None) -> DataFrame:
        return self.snapshot().read(table, tickers, since, until)

    # writing ---------------------------------------------------------------------------------------------------------------------------
    def _write(self, table: str, frame: DataFrame, run: str) -> list[Entry]:
        """Write a run; returns its files."""
        place, layout = f"data/{run}", LAYOUTS.get(table)
        if layout is None or layout.part is None:
            frame.write.option("compression", "zstd").parquet(f"{self.root}/{place}")
            return [Entry(place, run, rows=self.spark.read.schema(frame.schema).parquet(f"{self.root}/{place}").count())]
        names = [f.split()[0] for f in SCHEMAS[table].split(", ")]
        order = ("part", "ticker", layout.time)
        parted = frame.select(*names).withColumn("part", layout.part()).repartitionByRange(*order).sortWithinPartitions(*order)
        parted.write.options(compression="zstd", maxRecordsPerFile=FILE_ROWS).partitionBy("part").parquet(f"{self.root}/{place}")
        if not any(s.getPath().getName().startswith("part=") for s in self._fs.listStatus(self._path(place))):
            return []
        stored = self.spark.read.schema(SCHEMAS[table] + ", part string").parquet(f"{self.root}/{place}")
        path = F.concat(F.lit(f"{place}/part="), "part", F.lit("/"), F.col("_metadata.file_name"))
        summary = f"{self.root}/{place}.summary"
        _by_ticker(stored.select("*", path.alias("path")), table, F.col("part"), F.col("path")).write.option("compression", "zstd").parquet(summary)
        ranges = self.spark.read.parquet(summary).groupBy("path", "part").agg(F.sum("rows").alias("rows"), F.min("ticker").alias("low"), F.max("ticker").alias("high"), F.min("since").alias("since"), F.max("until").alias("until"))
        return [Entry(run=run, **r.asDict()) for r in ranges.collect()]  # a row a file

    def _discard(self, runs: Sequence[str]) -> None:
        for run in runs:
            self._fs.delete(self._path(f"data/{run}"), True)
            self._fs.delete(self._path(f"data/{run}.summary"), True)

    @contextmanager
    def landed(self, frame: DataFrame) -> Iterator[DataFrame]:
        """frame written once below the archive for as long as the block runs: what a source gave is read from it only once. _arrival holds the order of its rows."""
        place = self._path(f"landing/{uuid.uuid4().hex}")
        try:
            frame.withColumn("_arrival", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(place.toString())
            yield self.spark.read.parquet(place.toString())
        finally:
            self._fs.delete(place, True)

    def commit(self, tables: Mapping[str, DataFrame | Upsert | Append], replace_all: bool = False, base: Snapshot | None = None) -> int:
        """Change all tables at once: a DataFrame replaces a table, Upsert and Append add to it. A failure on the way leaves the archive as it was.

        Commits that add never conflict, and all survive; where they meet the later one counts. A table is only replaced if no other commit has changed it
        since base (by default, since this commit began). Returns the version.
        """
        base = base or self.snapshot()
        runs = {t: f"{t}-{uuid.uuid4().hex}" for t in tables}
        fresh = {t: not isinstance(change, (Upsert, Append)) for t, change in tables.items()}
        try:
            added = {}
            for table, change in tables.items():
                frame = change if fresh[table] else change.batch if isinstance(change, Upsert) else change.rows
                if isinstance(change, Upsert) and table not in LAYOUTS:
                    raise ValueError(f"The table {table} has no key")
                added[table] = self._write(table, frame, runs[table])

            def record(now: Snapshot) -> dict:
                for table in now.state.touched if replace_all else [t for t in tables if fresh[t]]:
                    if now.state.touched.get(table, 0) > base.version:
                        raise ConflictError(f"{table} was changed by another commit")
                gone = dict.fromkeys(now.state.tables if replace_all else [t for t in tables if fresh[t] and now.has(t)])
                return {"drop": gone, "add": {t: [{k: v for k, v in asdict(e).items() if k != "seq"} for e in entries] for t, entries in added.items()}}

            now = self._recorded(record)
        except Exception:
            self._discard(list(runs.values()))
            raise
        for table in tables:
            if not fresh[table]:
                self._fold(table, MOST_RUNS)
        return now.version

    def forget(self, tables: list[str]) -> None:
        """Drop tables."""
        self._recorded(lambda now: {"drop": {t: None for t in tables if now.has(t)}})

    # folding and clearing up -----------------------------------------------------------------------------------------------------------
    def compact(self, table: str) -> int:
        """Fold the runs of every part that has several into one. Returns how many parts were folded."""
        return self._fold(table, 2, whole=True)

    def _fold(self, table: str, most: int, whole: bool = False) -> int:
        folded = 0
        for part in sorted({e.part for e in self.snapshot().entries(table)}):
            now = self.snapshot()
            own = [e for e in now.entries(table) if e.part == part]
            newest = sorted({e.seq for e in own}, reverse=True)
            if len(newest) < most:
                continue
            rows = {s: sum(e.rows for e in own if e.seq == s) for s in newest}
            taken, total = 1, rows[newest[0]]
            while taken < len(newest) and (whole or 2 * total >= rows[newest[taken]]):  # the next older run, unless it is much larger
                total += rows[newest[taken]]
                taken += 1
            old = [e for e in own if e.seq in newest[:taken]]
            if taken > 1:
                folded += self._replaced(now, table, old, max(e.seq for e in old))
        return folded

    def _replaced(self, now: Snapshot, table: str, old: list[Entry], seq: int) -> bool:
        """Put one run in the place of files, if none of them has gone meanwhile."""
        run = f"{table}-{uuid.uuid4().hex}"
        paths = [e.path for e in old]
        try:
            added = [replace(e, seq=seq) for e in self._write(table, now._merged(table, old), run)]

            def record(latest: Snapshot) -> dict:
                if not set(paths) <= set(latest.state.tables.get(table, {})):
                    raise ConflictError(f"{table} was folded by another commit")
                return {"drop": {table: paths}, "add": {table: [asdict(e) for e in added]}}

            self._recorded(record)
            return True
        except ConflictError:
            self._discard([run])
            return False
        except Exception:
            self._discard([run])
            raise

    def vacuum(self, kept_seconds: float = KEPT_SECONDS) -> int:
        """Delete files that were replaced, and runs that were never committed, more than kept_seconds ago. Returns how many paths went."""
        now, until = self.snapshot(), time.time() - kept_seconds
        gone = [p for p, at in now.state.dropped.items() if at <= until]
        for path in gone:
            self._fs.delete(self._path(path), True)
        live = {e.run for own in now.state.tables.values() for e in own.values()} | {p.split("/")[1] for p in now.state.dropped if p not in gone}
        lost = []
        if self._fs.exists(self._path("data")):
            for s in self._fs.listStatus(self._path("data")):
                if s.getPath().getName().removesuffix(".summary") not in live and s.getModificationTime() / 1000 <= until:
                    lost.append(s.getPath())
        for path in lost:
            self._fs.delete(path, True)
        if gone:
            self._recorded(lambda _: {"forget": gone})
        return len(gone) + len(lost)

    def bytes(self) -> int:
        return int(self._fs.getContentSummary(self._path("")).getLength())

    def delete(self) -> None:
        self._fs.delete(self._path(""), True)
        self._known = State()

    def rename_to(self, other: Archive) -> None:
        """Put this archive in the place of another."""
        if other._fs.exists(other._path("")):
            other.delete()
        if not self._fs.rename(self._path(""), other._path("")):
            raise RuntimeError(f"Could not move {self.root} to {other.root}")
        other._known = State()
