"""Conversations brought back to the grammar (s?(ua)+)? of role initials by the cheapest edits.

Rows are taken in order of turn. Each row is kept (K), given another role (R, 1), deleted (D, 2), and turns with empty text may be inserted (I, 5); a row's fault
(blank, duplicate or truncated) says what is allowed. The grammar has four states: nothing yet, after the system turn, after a user turn, after an answer.

Method. Slim rows (role initial and fault, no text) are hash-partitioned by conversation and block of turns. In each task, pieces of at most PIECE rows
go to DuckDB in batches; a recursive query advances one turn for all pieces of the batch at once, and keeps for each state a piece can begin in and each
state it is in the minimum cost with its audit, the ASCII-least of equal ones. So a long conversation is spread over tasks. Its pieces are chained by cost
and audit where they meet its texts, hash-partitioned by conversation and read in order as a stream, to which the audit is applied.

Two audits of one cost that have consumed the same rows never begin one another (what is longer has inserted more and costs more), so the least
of a state stays the least whatever follows.

Defined cases: a null conv_id is a conversation of its own; null role and text are one space, a null turn comes before all others and counts in no gap; rows of
one turn are in the order of role, then of the text's SHA-256; equal rows are copies of each other, each with its letter in the audit; roles count by their first
character; turns may be any long, and a gap beyond a long is the greatest long; an empty table gives no rows; extra columns are ignored. What is hashed
for one conversation is one sequence, so it is one task's stream; memory holds a batch of its rows and its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import store

PIECE, BATCH, BLOCK = 256, 16_384, 256
EMPTY, SYSTEM, USER, ANSWER = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The state after a turn of this initial in each state; None: not in the grammar.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ANSWER, None)}
#: The role that an inserted or changed turn takes in each state.
ROLES = ("user", "user", "assistant", "user")
FAIR_PAIRS = ("su", "ua", "au")
LARGEST = 2**63 - 1


# --- damage --------------------------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with each row damaged by the remainder of its key's crc32, and `dropped` for rows that go (they still tell of their conversation)."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    out = out.withColumns({
        "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "dropped": F.col("_kind") == 0,
    })
    return out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def whole(rows: DataFrame) -> DataFrame:
    """Rows without damage, in the same shape."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(False).alias("dropped"))


# --- faults ----------------------------------------------------------------------------------------------------------------------------------


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def own_fault(text: Column) -> Column:
    """1 for a blank text, 3 for one that does not end a sentence, else 0."""
    bare = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


def slim_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, dropped, fault, and `again`: the same role and text stand at an earlier turn. (Of one turn, equal rows follow each other.)"""
    slim = _digested(rows).select("conv_id", "turn", "role", "digest", "dropped", own_fault(F.col("text")).alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    # met first where a text of a role first stands; a text that fills a conversation is one row of each task before the shuffle
    first = slim.where("not dropped").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("conv_id", "role", "digest", "first")
    first = store.written(first, "first-turns").withColumnsRenamed({"conv_id": "_conv", "role": "_role", "digest": "_digest"})
    met = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    return met.select(*slim.columns, F.coalesce(place > F.col("first"), F.lit(False)).alias("again"))


# --- pieces: the recursive query -------------------------------------------------------------------------------------------------------------


def moves() -> list[tuple[int, str, int, str, int, bool]]:
    """(state, initial or '' for any, state after, letters, cost, whether the row stays): up to two insertions, then an edit of one row."""
    found = []
    for state in range(4):
        at, letters, cost = state, "", 0
        for _ in range(3):
            found.append((state, "", at, letters + "D", cost + DELETE, False))
            found += [(state, i, after[at], letters + "K", cost, True) for i, after in NEXT.items() if after[at] is not None]
            role = ROLES[at]
            found.append((state, "", NEXT[role[0]][at], letters + "R", cost + REROLE, True))
            at, letters, cost = NEXT[role[0]][at], letters + "I", cost + INSERT
    return found


WALK = f"""
WITH RECURSIVE walk(unit, start, n, state, best) USING KEY (unit, start, state) AS (
  SELECT unit, start, 0, start, {{'cost': 0, 'audit': ''}} FROM units, (VALUES ({EMPTY}), ({SYSTEM}), ({USER}), ({ANSWER})) AS s(start)
  UNION
  SELECT w.unit, w.start, w.n + 1, m.after, min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND t.fault = 3 THEN {TRUNCATED} ELSE 0 END, 'audit': w.best.audit || m.letters}})
  FROM walk w JOIN turns t ON t.unit = w.unit AND t.place = w.n
  JOIN moves m ON m.state = w.state AND m.initial IN ('', t.initial) AND NOT (m.stays AND t.fault IN (1, 2))
  GROUP BY w.unit, w.start, w.n + 1, m.after)
SELECT unit, list({{'start': start, 'state': state, 'cost': best.cost, 'audit': best.audit}}) AS ways FROM walk JOIN units USING (unit) WHERE n = length GROUP BY unit
"""

COUNTS = """
SELECT unit, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
       count(*) FILTER (place > 0 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal, first(initial ORDER BY place) AS first_initial, last(initial ORDER BY place) AS last_initial,
       min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT turn) AS turns
FROM (SELECT *, lag(initial) OVER (PARTITION BY unit ORDER BY place) AS before FROM turns) GROUP BY unit
"""


def _engine():
    import duckdb

    engine = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    engine.execute("CREATE TABLE moves(state INTEGER, initial VARCHAR, after INTEGER, letters VARCHAR, cost BIGINT, stays BOOLEAN)")
    engine.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    return engine


_WAY = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_PIECE = pa.struct([
    ("ways", pa.list_(_WAY)), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first_initial", pa.string()), ("last_initial", pa.string()),
    *[(c, pa.int64()) for c in ("first_turn", "last_turn", "turns")],
])
PIECE_TYPE = (
    "struct<ways array<struct<start int, state int, cost long, audit string>>, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, first_turn long, last_turn long, turns long>"
)


@dataclass
class _Batch:
    """Pieces that wait for the engine: the key of each, and their rows."""

    keys: list[tuple] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    columns: dict[str, list] = field(default_factory=lambda: {c: [] for c in ("unit", "place", "turn", "initial", "fault")})

    def solved(self, engine) -> pa.RecordBatch:
        turns = pa.table(self.columns, schema=pa.schema([("unit", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("initial", pa.string()), ("fault", pa.int32())]))
        units = pa.table({"unit": pa.array(range(len(self.keys)), pa.int64()), "length": pa.array(self.lengths, pa.int64())})
        engine.register("turns", turns)
        engine.register("units", units)
        ways = dict(engine.execute(WALK).fetchall())
        found = engine.execute(COUNTS)
        names = [d[0] for d in found.description][1:]
        pieces = [None] * len(self.keys)
        for unit, *counts in found.fetchall():
            pieces[unit] = {"ways": ways[unit], **dict(zip(names, counts))}
        conv, block, piece = (pa.array([k[j] for k in self.keys], pa.int64()) for j in range(3))
        return pa.RecordBatch.from_arrays([conv, block, piece, pa.array(pieces, _PIECE)], names=["conv_id", "block", "piece_no", "piece"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, sorted by conversation, block and order, as pieces with their ways through the grammar."""
    engine, waiting, open_key, before = _engine(), _Batch(), None, None
    number = size = 0
    for batch in batches:
        for conv, block, turn, role, digest, fault, again in zip(*[c.to_pylist() for c in batch.columns]):
            row = (turn, role, digest)
            if open_key != (conv, block):
                open_key, before, number, fresh = (conv, block), None, 0, True
            elif fresh := size == PIECE:
                number += 1
            if fresh:
                if len(waiting.columns["unit"]) >= BATCH:
                    yield waiting.solved(engine)
                    waiting = _Batch()
                waiting.keys.append((conv, block, number))
                waiting.lengths.append(0)
                size = 0
            twice = again or row == before
            for column, value in zip(waiting.columns.values(), (len(waiting.keys) - 1, size, turn, role[:1], fault if fault == 1 or not twice else 2)):
                column.append(value)
            size += 1
            waiting.lengths[-1], before = size, row
    if waiting.keys:
        yield waiting.solved(engine)


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, block, piece_no, piece: what is known of each run of at most PIECE rows of a conversation."""
    block = F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)).cast("long"), F.lit(-(2**62)))
    slim = slim_rows(rows).where("not dropped").withColumn("block", block)
    dealt = slim.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "digest")
    return dealt.select("conv_id", "block", "turn", "role", "digest", "fault", "again").mapInArrow(_pieces, f"conv_id long, block long, piece_no long, piece {PIECE_TYPE}")


# --- chaining pieces and applying the audit --------------------------------------------------------------------------------------------------


@dataclass
class _Conversation:
    """One conversation: first its pieces come, then its rows in the same order."""

    conv_id: int | None
    ways: dict[int, tuple[int, int]] = field(default_factory=lambda: {EMPTY: (0, 0)})  # by state: cost, and rank of the audit so far
    trail: list[dict[int, tuple[int, str]]] = field(default_factory=list)  # by piece and state: the state it began in, and its audit
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0))
    first_turn: int | None = None
    last_turn: int | None = None
    last_initial: str | None = None
    audit: str | None = None
    cost: int = 0
    letter: int = 0
    state: int = EMPTY
    lines: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def add_piece(self, piece: dict) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for way in piece["ways"]:
            if way["start"] in self.ways:
                cost, rank = self.ways[way["start"]]
                made = (cost + way["cost"], rank, way["audit"], way["start"])
                best[way["state"]] = min(best.get(way["state"], made), made)
        order = sorted(best, key=lambda s: best[s][1:3])
        self.ways = {s: (best[s][0], order.index(s)) for s in best}
        self.trail.append({s: (best[s][3], best[s][2]) for s in best})
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.counts[name] += piece[name]
        if self.last_initial is not None and self.last_initial + piece["first_initial"] not in FAIR_PAIRS:
            self.counts["illegal"] += 1
        self.last_initial = piece["last_initial"]
        if piece["first_turn"] is not None:
            self.counts["turns"] -= piece["first_turn"] == self.last_turn
            self.first_turn = piece["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = piece["last_turn"]

    def settle(self) -> None:
        """The cheapest way to an end of the grammar, followed back through the pieces."""
        endings = {EMPTY: "", SYSTEM: "II", USER: "I", ANSWER: ""}
        cost, _, state = min((c + INSERT * len(endings[s]), rank, s) for s, (c, rank) in self.ways.items())
        parts, self.cost = [endings[state]], cost
        for piece in reversed(self.trail):
            state, audit = piece[state]
            parts.append(audit)
        self.audit, self.trail = "".join(reversed(parts)), []

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.state = NEXT[role[:1]][self.state]

    def add_row(self, role: str, text: str) -> None:
        if self.audit is None:
            self.settle()
        self._insertions()
        letter = self.audit[self.letter]
        self.letter += 1
        if letter != "D":
            self._line(ROLES[self.state] if letter == "R" else role, text)

    def _insertions(self) -> None:
        while self.letter < len(self.audit) and self.audit[self.letter] == "I":
            self._line(ROLES[self.state], "")
            self.letter += 1

    def result(self) -> tuple:
        if self.audit is None:
            self.settle()
        self._insertions()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]
        return (self.conv_id, min(gaps, LARGEST), *[self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")], self.cost, self.audit, self.digest.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each conversation, from its pieces and then its rows."""
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv, kind, piece, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv)
            if kind == 0:
                now.add_piece(piece)
            elif kind == 1:
                now.add_row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _REPORT)], schema=_REPORT)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.result(), _REPORT)], schema=_REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """REPORT's columns, one row for each conversation of rows (conv_id, turn, role, text, dropped)."""
    solved = pieces(rows).select("conv_id", F.lit(0).alias("kind"), "block", "piece_no", "piece", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("piece_no", "long"), ("piece", PIECE_TYPE))]
    texts = _digested(rows).where("not dropped").select("conv_id", F.lit(1).alias("kind"), *nothing, "turn", "role", "text", "digest")
    known = rows.select("conv_id").distinct().select("conv_id", F.lit(2).alias("kind"), *nothing, *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))])
    all_rows = solved.unionByName(texts).unionByName(known).repartition("conv_id")
    ordered = all_rows.sortWithinPartitions("conv_id", "kind", "block", "piece_no", "turn", "role", "digest")
    return ordered.select("conv_id", "kind", "piece", "role", "text").mapInArrow(_applied, REPORT)
