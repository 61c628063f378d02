"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are ordered by a seeded hash and cut into equally many blocks, whose order is
permuted again for each source. The mix draws blocks along that order: whole passes over the source,
then the blocks of one more pass until the source's target is met. Where the target falls inside a
block, the block is cut finer by further hash bits until single documents are left. The numbers of
blocks drawn from the sources are exact quotas; a binary tree over the output shards splits them by
multivariate-hypergeometric draws, so a shard holds what a random deal would give it, and what
shards draw never overlaps within a pass. Within its shard each copy of a document has a place of its
own, by a seeded hash of the document and the copy. Only per-source figures ever reach the driver, of at
most MAX_SOURCES sources.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WS, listed, materialize

BITS = 10
BLOCKS = 1 << BITS
LEVELS = 4
#: More sources than these stop the job: targets and quotas are the driver's, and their table, of some 300 bytes a source, is broadcast.
MAX_SOURCES = 100_000
#: A shard is put in order in 2**CELL_BITS ranges of the hash, so that its order is more than one task's work.
CELL_BITS = 12
#: The `row` of rows that needn't be told apart.
NEVER = (1 << 62) - 1
TIED = pa.schema({"tied_source": pa.string(), "tied_place": pa.int64()})


@dataclass(frozen=True)
class Plan:
    """What one source gives: target words, whole passes, the hash order below which documents come once more, blocks by shard.

    Where several rows lie at `below`, they are to give `tied` words more (else None), and those with a `row` below `rows` do.
    """

    source: str | None
    size: int
    target: float
    passes: int
    below: int
    shards: list[int]
    tied: float | None = None
    rows: int = 0


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Words by source. Sources by code point, null last, have the weights in turn; none gets more than most times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left, heavy = total - sum(full.values()), sum(w for s, w in weight.items() if s not in full)
        got = {s: left * w / heavy for s, w in weight.items() if s not in full}
        over = {s: most * sizes[s] for s, x in got.items() if x > most * sizes[s]}
        full |= over
        if not over or len(full) == len(order):
            return full | {s: x for s, x in got.items() if s not in full}


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard the blocks of each source; a node's blocks go to its two sides by a multivariate-hypergeometric draw."""

    def node(colors: np.ndarray, first: int, n: int) -> list[list[int]]:
        if n == 1:
            return [colors.tolist()]
        half = n // 2
        rng = np.random.default_rng([seed, first, n])
        left = rng.multivariate_hypergeometric(colors, int(colors.sum()) * half // n, method="marginals")
        return node(left, first, half) + node(colors - left, first + half, n - half)

    return node(np.array(quotas, np.int64), 0, shards)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null counts as none."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]+", ""), f"[^{WS}]+[{WS}]*", "x")).cast("long")


def _hash_order(seed: int) -> Column:
    """40 bits of a document (doc_id and text): a block number permuted for each source, then finer bits."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    s = F.xxhash64(F.lit(seed + 1), F.col("source"))
    block = F.shiftrightunsigned(h, 64 - BITS)
    permuted = (block * (s.bitwiseAND(F.lit(BLOCKS - 1)).bitwiseOR(F.lit(1))) + F.shiftrightunsigned(s, 64 - BITS)).bitwiseAND(F.lit(BLOCKS - 1))
    return F.shiftleft(permuted, BITS * (LEVELS - 1)) + F.shiftrightunsigned(h, 64 - BITS * LEVELS).bitwiseAND(F.lit((1 << BITS * (LEVELS - 1)) - 1))


def _row_order(seed: int) -> Column:
    """40 bits of a row, to tell rows alike apart; they are kept only where they are written at once."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed + 3), F.monotonically_increasing_id()), 64 - BITS * LEVELS)


@dataclass(frozen=True)
class Cut:
    """Where a source's order is cut: what lies below `below` is taken. rest words more are wanted of the n rows at `below`, of `size` words."""

    below: int
    rest: float = 0.0
    size: int = 0
    n: int = 0


def _cuts(slim: DataFrame, rest: dict[str | None, float], place: str = "place") -> dict[str | None, Cut]:
    """Each level sums the words by block where a source's rest falls, and goes on in the block that reaches it."""
    found = {s: Cut(0, x) for s, x in rest.items()}
    open_ = {s for s, x in rest.items() if x > 0}
    for level in range(LEVELS):
        if not open_:
            break
        shift = BITS * (LEVELS - 1 - level)
        asked = listed(slim.sparkSession, [(s, float(found[s].rest), found[s].below >> shift + BITS) for s in open_], pa.schema({"asked": pa.string(), "rest": pa.float64(), "cell": pa.int64()}))
        inside = slim["source"].eqNullSafe(asked["asked"]) & (F.shiftright(place, shift + BITS) == asked["cell"])
        units = slim.join(F.broadcast(asked), inside).groupBy("source", "rest", F.shiftright(place, shift).alias("unit")).agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
        reached = units.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("unit"))).filter("upto > rest")
        first = {r["source"]: r["at"] for r in reached.groupBy("source").agg(F.min(F.struct("unit", "size", "n", "upto")).alias("at")).collect()}
        for s in list(open_):
            at = first.get(s)
            if at is None:
                found[s] = Cut(found[s].below + (1 << shift + BITS))
                open_.discard(s)
            else:
                found[s] = Cut(at["unit"] << shift, found[s].rest - at["upto"] + at["size"], at["size"], at["n"])
    return found


def _tied(rows: DataFrame, below: dict[str | None, int]) -> DataFrame:
    """rows at the place where their source is cut, of the given sources."""
    asked = listed(rows.sparkSession, list(below.items()), TIED)
    return rows.join(F.broadcast(asked), rows["source"].eqNullSafe(asked["tied_source"]) & (rows["place"] == asked["tied_place"]), "left_semi")


def plan_mix(slim: DataFrame, weights: tuple[int, ...], share: float, most: float, shards: int, seed: int) -> list[Plan]:
    """slim: source, size, place, and row, which tells rows at one place apart. A source is cut between documents, and between rows alike where its cut falls on them."""
    found = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in found}
    if not sizes:
        return []
    want = targets(sizes, weights, share, most)
    passes = {s: min(int(want[s] // sizes[s]), int(most)) if sizes[s] else 0 for s in sizes}
    cuts = _cuts(slim, {s: want[s] - passes[s] * sizes[s] if sizes[s] else 0.0 for s in sizes})
    below = {s: cut.below + (cut.n == 1 and 2 * cut.rest >= cut.size) for s, cut in cuts.items()}
    tied = {s: cut.rest for s, cut in cuts.items() if cut.n > 1}
    rows = cut_rows(slim, {s: below[s] for s in tied}, tied) if tied else {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    quotas = [passes[s] * BLOCKS + -(-(below[s] + (s in tied)) // (1 << BITS * (LEVELS - 1))) for s in order]
    dealt = split_quotas(quotas, shards, seed)
    return [Plan(s, sizes[s], want[s], passes[s], below[s], [x[i] for x in dealt], tied.get(s), rows.get(s, 0)) for i, s in enumerate(order)]


def cut_rows(rows: DataFrame, below: dict[str | None, int], rest: dict[str | None, float]) -> dict[str | None, int]:
    """For each source the `row` up to which its rows at one place are taken once more, so that they come nearest to its rest."""
    cuts = _cuts(_tied(rows, below), rest, "row")
    return {s: cut.below + (2 * cut.rest >= cut.size > 0) for s, cut in cuts.items()}


def _deal(rows: DataFrame, plans: list[Plan]) -> DataFrame:
    """rows (source, size, place, ...) with source_size, target and shards, the output shard of each copy."""
    kinds = pa.schema({"plan_source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "passes": pa.int32(), "below": pa.int64(), "rows": pa.int64(), "upto": pa.list_(pa.int64())})
    of_plans = [(p.source, p.size, p.target, p.passes, p.below, p.rows, np.cumsum(p.shards).tolist()) for p in plans]
    sources = listed(rows.sparkSession, of_plans, kinds)
    once_more = (F.col("place") < F.col("below")) | ((F.col("place") == F.col("below")) & (F.col("row") < F.col("rows")))
    copies = F.col("passes") + F.when(once_more, 1).otherwise(0)
    drawn = F.when((copies > 0) & (F.col("size") > 0), F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    block = F.shiftright("place", BITS * (LEVELS - 1))
    shard = lambda i: F.size(F.filter("upto", lambda x: x <= i * BLOCKS + block))
    return rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["plan_source"])).withColumn("shards", F.transform(drawn, shard))


def _slim(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    return materialize(docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), _hash_order(seed).alias("place"), _row_order(seed).alias("row")), "mix")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, shards (the output shard of each copy), source.

    Sizes are words; a null or empty text has none and is never taken. A null source is a source, the last. What is taken
    of a source is within one document of its target, whatever its doc_ids: null and repeated ones are told apart by their
    texts, and of rows alike in doc_id and text as many are taken as come nearest. A very long text is taken whole or not at
    all. An empty table gives no rows; more than MAX_SOURCES sources stop the job. Reruns agree, as sets of rows.
    """
    slim = _slim(docs, seed)
    dealt = _deal(slim, plan_mix(slim, weights, share, most, shards, seed))
    return dealt.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"), "shards", "source")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """The mix itself: doc (a struct of docs' own columns), shard, position; a row for each time that a document is taken.

    What mix_sources says of it holds. Positions count from 0 in each shard, by a hash of seed, document (doc_id, source and text)
    and copy, and the rows lie in that order: partitions hold ranges of (shard, position) that follow each other. Only rows
    alike in doc_id, source and text can change places between runs.
    """
    of_text = F.xxhash64("text").alias("of_text")
    slim = _slim(docs, seed, of_text)
    plans = plan_mix(slim, weights, share, most, shards, seed)
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"), _hash_order(seed).alias("place"), of_text)
    taken = _deal(rows.withColumn("row", F.lit(NEVER)), plans)
    if tied := {p.source: p for p in plans if p.tied is not None}:
        # Rows alike are numbered where they are written; what the plan took of them by the slim table is taken of these.
        below = {s: p.below for s, p in tied.items()}
        alike = materialize(_tied(rows, below).withColumn("row", _row_order(seed)), "mix-alike")
        cut = cut_rows(alike, below, {s: p.tied for s, p in tied.items()})
        others = rows.join(F.broadcast(listed(docs.sparkSession, list(below.items()), TIED)), F.col("source").eqNullSafe(F.col("tied_source")) & (F.col("place") == F.col("tied_place")), "left_anti")
        taken = _deal(others.withColumn("row", F.lit(NEVER)), plans).unionByName(_deal(alike, [replace(p, rows=cut.get(p.source, 0)) for p in plans]))
    taken = _shuffle_keys(taken, seed, "doc")
    cells = _shuffle_keys(_deal(slim, plans), seed).groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("shard").alias("cell_shard"), F.col("cell").alias("cell_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = ["order", "doc_id", "source", "copy", "of_text"]
    placed = taken.repartitionByRange("shard", "cell").sortWithinPartitions("shard", "cell", *order)
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order)) - 1
    placed = placed.withColumn("within", within).join(F.broadcast(cells), (F.col("shard") == F.col("cell_shard")) & (F.col("cell") == F.col("cell_cell")), "left")
    return placed.select("doc", "shard", (F.col("before") + F.col("within")).alias("position"))


def _shuffle_keys(dealt: DataFrame, seed: int, *kept: str) -> DataFrame:
    """A row for each copy: shard, cell and order (a hash of the copy, and its first bits), and what the copy is told apart by."""
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("source"), F.col("of_text"), F.col("copy")), 1)
    copies = dealt.select("doc_id", "source", "of_text", *kept, F.posexplode("shards").alias("copy", "shard")).withColumn("order", order)
    return copies.withColumn("cell", F.shiftright("order", 63 - CELL_BITS).cast("int"))
