"""Conversation repair against a search over all edit sequences, and against a plain walk for long conversations."""

import hashlib
import itertools
import random
import zlib

from tapeloom.llm import conversation_repair as cr
from tapeloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANK)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def fits(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def search(rows):
    """Cheapest edits by trying all of them: for each row an edit, and up to two turns put in at each place."""
    kinds, best = faults(rows), None
    adds = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*[("D",) if k in ("blank", "duplicate") else ("D", "K", "Ruser", "Rassistant") for k in kinds]):
        cost = sum({"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and k == "truncated" else 0) for e, k in zip(edits, kinds))
        for added in itertools.product(adds, repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, added))
            if best and total > best[0]:
                continue
            lines, audit = [], ""
            for i, extra in enumerate(added):
                lines += [(r, "") for r in extra]
                audit += "I" * len(extra)
                if i < len(rows):
                    audit += edits[i][0]
                    if edits[i] != "D":
                        lines.append((edits[i][1:] or rows[i][2], rows[i][3]))
            if fits("".join(r[:1] or "-" for r, _ in lines)):
                made = (total, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                best = min(best or made, made)
    return best


def walk(rows):
    """The same by dynamic programming over whole lines of edits, one row after another."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    ways = {"0": (0, "", [])}
    for (_, _, role, text), kind in zip(rows, faults(rows)):
        new = {}
        def offer(state, way):
            new[state] = min(new.get(state, way), way)
        spread = [(s, w) for s, w in ways.items()]
        for _ in range(2):
            for s, (c, a, lines) in list(spread):
                r = "assistant" if s == "u" else "user"
                spread.append((step[(s, r[0])], (c + 5, a + "I", lines + [r + ":"])))
        for s, (c, a, lines) in spread:
            offer(s, (c + 2, a + "D", lines))
            if kind in ("blank", "duplicate"):
                continue
            extra = 5 if kind == "truncated" else 0
            if (s, role[:1]) in step:
                offer(step[(s, role[:1])], (c + extra, a + "K", lines + [f"{role}:{text}"]))
            r = "assistant" if s == "u" else "user"
            offer(step[(s, r[0])], (c + extra + 1, a + "R", lines + [f"{r}:{text}"]))
        ways = new
    ends = []
    for s, (c, a, lines) in ways.items():
        more = {"0": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[s]
        ends.append((c + 5 * len(more), a + "I" * len(more), lines + more))
    cost, audit, lines = min(ends)
    return cost, audit, "\n".join(lines)


def report(rows, way):
    kinds = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = way(rows) if rows else (0, "", "")
    return (min(gaps, 2**63 - 1), *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def check(frame, rows, way, damage):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    spaced = lambda own: [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
    want = {conv: report(in_order(damaged(own) if damage else spaced(own)), way) for conv, own in by_conv.items()}
    found = cr.repaired((cr.damaged if damage else cr.whole)(frame)).collect()
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r


def short_conversations(seed, n, most):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(["One.", "Two!", "cut", "", " ", "Three?\n", "it is.", None])))
    return rows


def test_against_all_edit_sequences(spark):
    rows = short_conversations(1, 60, 3)
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, search, False)


def test_walk_agrees_with_search():
    for own in itertools.groupby(short_conversations(2, 80, 3), key=lambda r: r[0]):
        own = in_order([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own[1]])
        assert walk(own) == search(own)


def test_damaged_and_longer_conversations(spark):
    rows = short_conversations(3, 150, 12)
    rows += [(1000, t, r, x) for t in (None, None, 3, 3, 9, -5) for r, x in (("user", "same."), ("assistant", "x."))]
    rows += [(None, t, "user", f"no id {t}.") for t in range(5)] + [(None, None, "user", "no id 1.")]
    rows += [(1001, t, "user", "t.") for t in (-(2**63), 2**63 - 1)] + [(1002, 1, "", "nothing."), (1002, 1, "", "nothing.")]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows, walk, True)


def test_a_long_conversation_in_pieces(spark):
    rng = random.Random(5)
    rows = [(7, rng.choice([t, t, None, t * 40]), rng.choice(["user", "assistant", "assistant", "system"]), f"Turn {rng.randint(0, 900)}{rng.choice('.!?,')}") for t in range(1500)]
    rows += [(8, 0, "user", "again and again.")] * 700 + [(9, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    check(frame, rows, walk, True)
    made = cr.pieces(cr.damaged(frame)).where("conv_id = 7")
    assert made.count() > 100 and made.selectExpr("max(piece.blank + piece.turns) AS n").first().n <= cr.PIECE


def test_empty_table_clashing_names_and_dropped_conversations(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert cr.repaired(cr.damaged(none)).count() == 0
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    frame = spark.createDataFrame(gone, SCHEMA).withColumns({n: F.lit("x") for n in ("block", "kind", "piece", "digest", "_kind", "dropped", "fault", "again")})
    found = cr.repaired(cr.damaged(frame)).collect()
    assert len(found) == len(gone) > 5
    assert {tuple(r)[1:] for r in found} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_against_walk(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = report(in_order(damaged([r for r in rows if r[0] == conv])), walk)
    assert {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()} == want
