"""op11 against a backward dynamic program over whole strings, written apart from the operator."""

import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.conversations import Repair, Seen, damaged, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute(rows):
    """The figures of one conversation, rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]

    # The roles so far are one of: nothing, "s", any that end in u, any that end in a.
    def allowed(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @cache
    def rest(i, state, inserts):
        """(cost, audit, turns) from row i on: cheapest, then ASCII-least."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if after := allowed(state, role[0]):
                    cost, audit, turns = rest(i, after, inserts + 1)
                    ways.append((cost + 3, "I" + audit, (f"{role}:",) + turns))
        if i < len(rows):
            cost, audit, turns = rest(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for edit, role, price in (("K", rows[i][2], 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if role and (after := allowed(state, role[0])):
                        cost, audit, turns = rest(i + 1, after, 0)
                        ways.append((cost + price + more, edit + audit, (f"{role}:{rows[i][3]}",) + turns))
        return min(ways, default=(10**9, "", ()))

    cost, audit, turns = rest(0, "", 0)
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def expected(rows):
    found = {conv: [] for conv, *_ in rows}
    for row in damage(rows):
        found[row[0]].append(row)
    return {conv: brute(of) for conv, of in found.items()}


def shown(df):
    return {r["conv_id"]: tuple(r[c] for c in OUT[1:]) for r in df.select(*OUT).collect()}


def test_op11_on_the_table(spark, small):
    from weftline.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_conversation_repair"](spark, small)
    assert found.columns == OUT
    assert shown(found) == expected(rows)


def test_op11_on_broken_conversations(spark):
    draw = random.Random(5)
    texts = ["Yes.", "No!", "why", "", " \t", None, "Yes. ", "ok?\n", "a.b"]
    rows = [(conv, draw.choice([None, turn, turn, turn, turn + draw.randrange(3)]), draw.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), draw.choice(texts) if draw.random() < 0.4 else f"T{turn}{draw.choice('.?x')}") for conv in [None, *range(300)] for turn in range(draw.randrange(1, 9))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(repair_conversations(damaged(df.withColumn("conv", F.lit(1)).withColumn("present", F.lit(False)).withColumn("times", F.lit(2))))) == expected(rows)


def test_dropped_conversation_and_empty_table(spark):
    turns = next((c, t) for c in range(1000) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    found = repair_conversations(damaged(spark.createDataFrame([(*turns, "user", "Hi.")], SCHEMA)))
    assert shown(found) == {turns[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = repair_conversations(damaged(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and empty.schema["conv_id"].dataType == T.LongType()


def test_giant_conversation_over_batches(spark):
    """One conversation of 30,000 turns in batches of 1,000, with everything spilled, among small ones."""
    draw = random.Random(3)
    rows = [(7, t, draw.choice(["user", "assistant"]), f"{draw.randrange(9000)}{draw.choice('.?x')}") for t in range(30_000)] + [(c, t, "user", "Hi.") for c in range(20) if c != 7 for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = repair_conversations(df, spool_bytes=1, held=100)
        got = shown(found)
        turns = repaired_turns(df, found).filter("conv_id = 7").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = Repair()
    ordered = sorted(r for r in rows if r[0] == 7)
    whole.rows([r[1] for r in ordered], [r[2] for r in ordered], [r[3] for r in ordered])
    assert got[7] == whole.end()
    assert [r["position"] for r in turns] == list(range(len(turns)))
    assert "".join(r["role"][0] for r in turns) == "ua" * (len(turns) // 2)
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == got[7][-1]


def test_repaired_turns_hash_to_the_digest(spark, small):
    rows = damaged(spark.read.parquet(f"{small}/conversations.parquet"))
    found = repair_conversations(rows)
    made = {}
    for r in repaired_turns(rows, found).orderBy("conv_id", "position").collect():
        made.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(made.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_seen_keeps_all_digests():
    draw = random.Random(1)
    digests = [draw.randrange(500).to_bytes(16, "big") for _ in range(3000)]
    seen, known = Seen(held=20), set()
    for start in range(0, 3000, 37):
        part = digests[start : start + 37]
        for digest, old in zip(part, seen.of(part), strict=True):
            assert old == (digest in known)
            known.add(digest)
    assert len(seen.runs) > 3
