"""Repair of conversation structure: a cheapest edit of every conversation to `(s?(ua)+)?`.

A conversation is streamed in the order of its turns, and the state of a dynamic program over the four states of that
pattern is carried from row to row and from batch to batch. Of the rows that have passed only two things are kept: one
byte for each state of each row, which says where the state's best edits come from, and the digests of earlier turns.
Both are spilled where a conversation is giant. The repaired text isn't kept at all: every state has a running hash of
what its best edits give.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\v\f\r"
#: States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a row may do to the edits, in ASCII order; a code is a place in this list.
WORDS = ("D", "IK", "IR", "K", "R")
RELABEL = INSERT = BROKEN = 3
DELETE = 4
#: A user turn follows anything but a user turn, an assistant turn only a user turn. One inserted turn mends the rest.
STEPS = {"s": [(START, 0, SYSTEM)], "u": [(START, 0, USER), (SYSTEM, 0, USER), (ASSISTANT, 0, USER), (USER, 1, USER)], "a": [(USER, 0, ASSISTANT), (START, 1, ASSISTANT), (SYSTEM, 1, ASSISTANT), (ASSISTANT, 1, ASSISTANT)]}
#: Inserts after the last row by its state.
ENDS = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def _edges(initial: str, kept: int | None) -> list[tuple[int, str, int, int]]:
    """(state before, word, state after, cost) of a row; kept is what not deleting it costs, None if it must go."""
    found = [(state, "D", state, DELETE) for state in range(4)]
    if kept is not None:
        found += [(i, "I" * k + "K", j, INSERT * k + kept) for i, k, j in STEPS.get(initial, ())]
        found += [(i, "I" * k + "R", j, INSERT * k + RELABEL + kept) for role in "ua" for i, k, j in STEPS[role]]
    return found


EDGES = {(initial, kept): _edges(initial, kept) for initial in ("s", "u", "a", "") for kept in (None, 0, BROKEN)}
NEVER = 1 << 62


class Seen:
    """Digests of a conversation's turns: a set, and beyond `held` of them sorted runs in a file."""

    def __init__(self, held: int = 1 << 18):
        self.held, self.fresh, self.runs, self.file = held, set(), [], None

    def of(self, digests: list[bytes]) -> list[bool]:
        """Whether each was seen before, earlier ones of the list included."""
        old = np.zeros(len(digests), bool)
        if self.runs:
            asked = np.array(digests, "S16")
            for run in self.runs:
                at = np.minimum(np.searchsorted(run, asked), len(run) - 1)
                old |= run[at] == asked
        found = []
        for digest, known in zip(digests, old.tolist(), strict=True):
            known = known or digest in self.fresh
            found.append(known)
            if not known:
                self.fresh.add(digest)
        if len(self.fresh) > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            run = np.sort(np.array(list(self.fresh), "S16"))
            self.file.seek(0, 2)
            start = self.file.tell()
            self.file.write(run.tobytes())
            self.file.flush()
            self.runs.append(np.memmap(self.file, "S16", "r", start, (len(run),)))
            self.fresh = set()
        return found


class Repair:
    """One conversation, row by row.

    Of two ways to a state the cheaper one is kept, of equally cheap ones the one whose edits are ASCII-least. Edits up to
    a row that end in different states differ before either ends, so `rank`, the order of the states' edits, decides.
    """

    def __init__(self, spool_bytes: int = 4 << 20, held: int = 1 << 18):
        self.best = [(0, 0, hashlib.sha256())] + [(NEVER, 0, None)] * 3
        self.back, self.block = tempfile.SpooledTemporaryFile(spool_bytes), bytearray()
        self.seen = Seen(held)
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.before = None

    def rows(self, turns: list[int | None], roles: list[str], texts: list[str]) -> None:
        """The next rows of the conversation, in order."""
        known = self.seen.of([hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() for role, text in zip(roles, texts, strict=True)])
        for turn, role, text, again in zip(turns, roles, texts, known, strict=True):
            if turn is not None and turn != self.last:
                self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = role[:1]
            body, kept = text.rstrip(BLANK), 0
            if not body:
                self.blank, kept = self.blank + 1, None
            elif again:
                self.duplicate, kept = self.duplicate + 1, None
            elif body[-1] not in ".!?":
                self.truncated, kept = self.truncated + 1, BROKEN
            self.step(role, text, kept)

    def step(self, role: str, text: str, kept: int | None) -> None:
        best = self.best
        reached: list[tuple | None] = [None] * 4
        for i, word, j, cost in EDGES[role[:1] if role[:1] in ("s", "u", "a") else "", kept]:
            if best[i][0] < NEVER:
                way = (best[i][0] + cost, best[i][1], word, i)
                if reached[j] is None or way < reached[j]:
                    reached[j] = way
        order = {w: n for n, w in enumerate(sorted((way[1], way[2]) for way in reached if way))}
        line = None
        self.best = []
        for j, way in enumerate(reached):
            if way is None:
                self.block.append(0)
                self.best.append((NEVER, 0, None))
                continue
            cost, rank, word, i = way
            made = best[i][2]
            if word != "D":
                made = made.copy()
                state = i
                if word[0] == "I":
                    state = ASSISTANT if i == USER else USER
                    made.update(self.line(i, ROLES[state], b""))
                line = text.encode() if line is None else line
                made.update(self.line(state, role if word[-1] == "K" else ROLES[j], line))
            self.block.append(WORDS.index(word) << 2 | i)
            self.best.append((cost, order[rank, word], made))
        if len(self.block) >= 1 << 16:
            self.back.write(self.block)
            self.block = bytearray()

    @staticmethod
    def line(state: int, role: str, text: bytes) -> bytes:
        """A turn of the repaired text; all but the first follow a line feed."""
        return (b"" if state == START else b"\n") + role.encode() + b":" + text

    def end(self) -> tuple[int, int, int, int, int, int, str, str]:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ways = [(cost + INSERT * len(ENDS[j]), rank, j) for j, (cost, rank, _) in enumerate(self.best) if cost < NEVER]
        cost, _, state = min(ways)
        made, at = self.best[state][2].copy(), state
        for role in ENDS[state]:
            made.update(self.line(at, ROLES[role], b""))
            at = role
        audit = bytearray(b"I" * len(ENDS[state]))
        self.back.write(self.block)
        place = self.back.tell()
        while place:
            start = max(0, place - (1 << 16))
            self.back.seek(start)
            block = self.back.read(place - start)
            for row in range(len(block) - 4, -1, -4):
                code = block[row + state]
                audit += WORDS[code >> 2][::-1].encode()
                state = code & 3
            place = start
        self.back.close()
        audit.reverse()
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit.decode(), made.hexdigest()


def _ordered(turns: DataFrame, *first: str) -> DataFrame:
    return turns.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text")


def _rows(turns: DataFrame) -> DataFrame:
    """conv (text), turn, role, text, present: nulls are one blank; a row that isn't present only says that its conversation is there."""
    present = F.coalesce("present", F.lit(True)) if "present" in turns.columns else F.lit(True)
    blank = F.lit(" ")
    return turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), present.alias("present"))


def _pieces(frame: pd.DataFrame) -> Iterator[tuple[str | None, pd.DataFrame]]:
    """The stretches of a batch that belong to one conversation."""
    conv = frame["conv"].tolist()
    edges = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
    for start, stop in zip([0, *edges], [*edges, len(conv)], strict=True):
        if stop > start:
            yield conv[start], frame.iloc[start:stop]


def repair_conversations(turns: DataFrame, spool_bytes: int = 4 << 20, held: int = 1 << 18) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conv_id of turns.

    turns has conv_id, turn, role and text, and may have `present`: rows without it only keep their conversation in the
    result (zeros, an empty audit, the hash of nothing). Null roles and texts count as one blank, so they are blank turns;
    a null turn comes first and counts for no gap; a null conv_id is a conversation of its own. Rows of one turn come by
    role and text. Repeated rows are duplicates. A role whose initial is none of s, u, a, an empty one too, can't be kept
    as it is. Other columns are not read. An empty table gives no rows.

    One conversation is one stream, as its hash is that of a sequence; a task holds `held` digests, spool_bytes of back
    pointers and one batch of it, and spills the rest (16 bytes a distinct turn, 4 a row) to a file without a name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, out = None, None, []
        for frame in frames:
            for key, part in _pieces(frame):
                if state is None or key != conv:
                    if state is not None:
                        out.append((conv, *state.end()))
                    conv, state = key, Repair(spool_bytes, held)
                part = part[part["present"]]
                turn = [None if none else t for t, none in zip(part["turn"].tolist(), part["no_turn"].tolist(), strict=True)]
                state.rows(turn, part["role"].tolist(), part["text"].tolist())
            if out:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        if state is not None:
            yield pd.DataFrame([(conv, *state.end())], columns=NAMES)

    rows = _ordered(_rows(turns)).select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "present")
    found = rows.mapInPandas(run, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return found.withColumn("conv", F.col("conv").cast(turns.schema["conv_id"].dataType)).withColumnRenamed("conv", "conv_id")


NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text: the repaired conversations, by the audits that repair_conversations gave for the same turns.

    A conversation's audit comes before its rows, and its edits are made as they pass.
    """
    rows = _rows(turns).filter("present").select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    heads = audits.select(F.col("conv_id").cast("string").alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state, n = "", 0, START, 0
        for frame in frames:
            out = []
            for conv, kind, role, text in zip(*(frame[c].tolist() for c in ("conv", "kind", "role", "text")), strict=True):
                if kind == 0:
                    audit, at, state, n = text, 0, START, 0
                else:
                    while audit[at] == "I":
                        state, at, n = ASSISTANT if state == USER else USER, at + 1, n + 1
                        out.append((conv, n - 1, ROLES[state], ""))
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        state = SYSTEM if edit == "K" and role[:1] == "s" else ASSISTANT if state == USER else USER
                        out.append((conv, n, role if edit == "K" else ROLES[state], text))
                        n += 1
                if audit.count("I", at) == len(audit) - at:
                    for at in range(at, len(audit)):
                        state, n = ASSISTANT if state == USER else USER, n + 1
                        out.append((conv, n - 1, ROLES[state], ""))
                    at = len(audit)
            if out:
                yield pd.DataFrame(out, columns=["conv", "position", "role", "text"])

    found = _ordered(heads.unionByName(rows), "kind").select("conv", "kind", "role", "text").mapInPandas(run, "conv string, position long, role string, text string")
    return found.withColumn("conv", F.col("conv").cast(turns.schema["conv_id"].dataType)).withColumnRenamed("conv", "conv_id")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: turns damaged by crc32(`conv_id:turn`) % 20 (nulls: one blank).

    0 drops the row (it isn't present), 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 gives it to the user.
    """
    blank = F.lit(" ")
    code: Column = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    rows = turns.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"), F.when(code <= 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (code != 0).alias("present"), F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "present", F.explode("times")).drop("col")
