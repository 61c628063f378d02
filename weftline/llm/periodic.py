"""Maximal runs of repeated words, by string synchronising sets.

Words of many texts lie in one array, with a mark between texts that equals nothing. Periods up to SMALL are read off by
comparing neighbours. Every longer period q belongs to the scale t = 2^k with t <= q < 2t. A position i is selected at
scale t if the least hash of the blocks of t words at i..i+t is that of the first or of the last of them. Whether it is
depends on its context of 2t words alone, and every t neighbouring positions hold one, so in a run of period q (four
periods or more) selected positions with equal contexts lie exactly q apart, and neighbours among them propose it.
Blocks that lie in a run of at most a fourth of their length are not selected: such regions are periodic through and
through, were found at a lower scale, and would select every position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import slices

WORD = r"[^\x20\x09-\x0D]+"
#: A run has so many words and so many periods at least.
LEAST, PERIODS = 6, 4
#: Periods read off neighbours; the scales begin above.
SMALL = 3
NEVER = np.uint64((1 << 64) - 1)
#: Odd factors of a 64-bit mixing function; fixed values.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers; none is NEVER."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return np.minimum(x ^ (x >> np.uint64(31)), NEVER - np.uint64(1))


def doubled(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of 2 * size words from those of blocks of `size`."""
    n = max(0, len(ids) - size)
    return mixed(ids[:n] * MIX[0] + ids[size : size + n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of `width` values, from minima running to the left and right in blocks of that width."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, NEVER)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def matching(words: np.ndarray, place: int, period: int, step: int) -> int:
    """How many words from `place` on (step 1) or before it (step -1) equal those a period later."""
    found, width = 0, 32
    while True:
        if step > 0:
            x, y = words[place + found : place + found + width], words[place + period + found : place + period + found + width]
            x = x[: len(y)]
        else:
            start = max(0, place - found - width)
            x, y = words[start : place - found][::-1], words[start + period : place + period - found][::-1]
        if not len(x):
            return found
        differ = x != y
        at = int(differ.argmax())
        if differ[at]:
            return found + at
        found, width = found + len(x), width * 2


def primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the period is the smallest of a stretch of at least two of them: no shorter word repeated makes it up."""
    rest, factor = period, 2
    while rest > 1:
        if rest % factor:
            factor = factor + 1 if factor * factor <= rest else rest
            continue
        short = period // factor
        if np.array_equal(words[start : start + period - short], words[start + short : start + period]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def enough(length: int, period: int) -> bool:
    return length >= max(LEAST, PERIODS * period)


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period. `longest` is the length of the longest text in words."""
    runs: list[tuple[int, int, int]] = []
    for period in range(1, min(SMALL, longest // PERIODS) + 1):
        same = np.concatenate(([False], words[:-period] == words[period:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if enough(stop - start + period, period) and primitive(words, start, period):
                runs.append((start, stop - start + period, period))
    scale = SMALL + 1
    if longest < PERIODS * scale:
        return sorted(runs, key=lambda run: (run[0], run[2]))
    ids = mixed(words.astype(np.uint64) * MIX[0])
    for size in (1 << k for k in range(scale.bit_length() - 1)):
        ids = doubled(ids, size)
    while PERIODS * scale <= longest:
        contexts = doubled(ids, scale)
        positions = selected(ids, scale, runs)
        seen = contexts[positions]
        order = np.argsort(seen, kind="stable")
        one, next_one = positions[order[:-1]], positions[order[1:]]
        apart = next_one - one
        near = (seen[order[:-1]] == seen[order[1:]]) & (apart >= scale) & (apart < 2 * scale)
        one, apart = one[near], apart[near]
        order, reached, last = np.lexsort((one, apart)), -1, 0
        for place, period in zip(one[order].tolist(), apart[order].tolist(), strict=True):
            if period == last and place < reached:
                continue
            start = place - matching(words, place, period, -1)
            stop = place + matching(words, place, period, 1)
            last, reached = period, stop
            if enough(stop - start + period, period) and primitive(words, start, period):
                runs.append((start, stop - start + period, period))
        ids, scale = contexts, 2 * scale
    return sorted(runs, key=lambda run: (run[0], run[2]))


def selected(ids: np.ndarray, scale: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The synchronising set: positions by the hashes of their blocks of `scale` words. Blocks within runs of a fourth of their length don't count.

    Below LEAST words a block may be periodic and in no run, so what counts would not depend on the context alone.
    """
    if scale >= LEAST:
        inside = np.zeros(len(ids) + 1, np.int32)
        for start, length, period in runs:
            if PERIODS * period <= scale <= length:
                inside[start] += 1
                inside[start + length - scale + 1] -= 1
        ids = np.where(np.cumsum(inside[:-1]) > 0, NEVER, ids)
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least = least_of(ids, scale + 1)
    return np.flatnonzero((least != NEVER) & ((least == ids[:-scale]) | (least == ids[scale:])))


def runs_of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """find_runs of each text, all searched as one array."""
    lengths = np.array([len(words) for words in texts], np.int64)
    numbers = pd.factorize(np.array([word for words in texts for word in words], dtype=object))[0]
    gaps = np.arange(1, len(texts) + 1)
    words = np.insert(numbers, np.cumsum(lengths), -gaps) if len(texts) else numbers
    starts = np.cumsum(lengths + 1) - lengths - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(words, int(lengths.max(initial=0))):
        of = int(np.searchsorted(starts, start, "right")) - 1
        found[of].append((start - int(starts[of]), length, period))
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, without those that a run repeats after its first period, joined by one blank."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join(compress(words, kept.tolist()))


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period), strongest (the run of greatest length / period, ties: smallest start, then period; null without runs), collapsed: the text without what runs repeat.

    Every whole text is searched. A null or empty text has no words and no runs, and collapses to the empty text. Texts are
    searched together in blocks of block_bytes; a longer text alone, in memory proportional to it. Repeated rows and null
    ids are searched each. Other columns are not read. An empty table gives no rows.
    """
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for batch in batches:
            for part in slices(batch, text_bytes=block_bytes):
                texts = [find(text or "") for text in part.column("text").to_pylist()]
                found = runs_of_texts(texts)
                strongest = [max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None) for runs in found]
                shown = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                best = [r and dict(zip(("start", "length", "period"), r, strict=True)) for r in strongest]
                kept = [collapsed(words, runs) for words, runs in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shown, pa.list_(kind)), pa.array(best, kind), pa.array(kept, pa.string())], ["doc_id", "runs", "strongest", "collapsed"])

    return source.mapInArrow(run, schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the strongest run), runs_sha256, collapsed_sha256 of what periodic_runs finds."""
    found = periodic_runs(docs)
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document (by h = crc32 of the id) the words from a = g % n on repeat p = 1 + (n - a) // (3 + g % 8) of them, g = h // 10.

    Texts without words, and documents without an id, stay as they are.
    """
    h: Column = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    plan = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    plan = plan.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    # Whole periods are repeated and the last one is cut, so no word is looked up by its place.
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    planted = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))), F.lit(1), F.col("n"))
    return plan.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
