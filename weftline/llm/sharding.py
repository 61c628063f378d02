"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until they fit, then one exchange.

The sort key is (hash of the text, doc_id), so equal texts lie together. Boundaries between shards start as
the whole key range; each round counts the exact bytes in equal steps of the ranges where boundaries still lie
and keeps the step that holds the boundary, until the bytes below it are within the tolerance. A group of equal
texts is split between shards, by doc_id, only if it holds more than `whole` of a shard's bytes. Rounds read a
table of keys and sizes, never texts, and return 4096 counts per open boundary. Then each document moves once, to
its shard and its place in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release

STEP = 12
LOWEST = -(1 << 63)
#: monotonically_increasing_id holds the partition from this bit on.
PARTITION_BIT = 33


@dataclass
class Boundary:
    """Keys from (hash, doc_id) on go right; below: exact bytes to the left."""

    hash: int
    doc_id: int
    below: int


def _unsigned(h: Column) -> Column:
    """Bits whose unsigned order is the signed order of h."""
    return h.bitwiseXOR(F.lit(LOWEST))


def find_boundaries(slim: DataFrame, shards: int, tolerance: float, whole: float) -> list[Boundary]:
    """slim: h, key_id, size. tolerance and whole are shares of a shard's bytes."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    aims = [total * (i + 1) / shards for i in range(shards - 1)]
    near = tolerance * total / shards
    done: dict[int, Boundary] = {}
    open_ = {i: (0, 0) for i in range(len(aims))}  # boundary: prefix of the hash, bytes below it
    depth = 0
    while open_ and depth < 64 and total:
        step = min(STEP, 64 - depth)
        rows = slim if not depth else slim.filter(F.shiftrightunsigned(_unsigned(F.col("h")), 64 - depth).isin([_signed(p) for p, _ in open_.values()]))
        depth += step
        counts: dict[int, list[tuple[int, int]]] = {}
        unit = F.shiftrightunsigned(_unsigned(F.col("h")), 64 - depth) if depth < 64 else _unsigned(F.col("h"))
        for r in rows.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).collect():
            u = r["unit"] % (1 << 64)
            counts.setdefault(u >> step, []).append((u, r["size"]))
        for i, (prefix, below) in list(open_.items()):
            for u, size in sorted(counts[prefix]):
                edge = (u << 64 - depth) + LOWEST
                after = (u + 1 << 64 - depth) + LOWEST
                if below + size >= aims[i] - near:
                    if abs(below - aims[i]) <= near:
                        done[i] = Boundary(edge, LOWEST, below)
                    elif abs(below + size - aims[i]) <= near and after < 1 << 63:
                        done[i] = Boundary(after, LOWEST, below + size)
                    else:
                        open_[i] = u, below
                    break
                below += size
            if i in done:
                del open_[i]
    for i, (u, below) in open_.items() if total else ():
        done[i] = _within_group(slim, u + LOWEST, below, aims[i], near, whole * total / shards)
    return [done[i] for i in sorted(done)]


def _signed(prefix: int) -> int:
    return prefix - (1 << 64) if prefix >= 1 << 63 else prefix


def _within_group(slim: DataFrame, h: int, below: int, aim: float, near: float, whole: float) -> Boundary:
    """The boundary falls into one group of equal texts: keep a small one whole, else find the doc_id."""
    group = slim.filter(F.col("h") == h)
    low, high, size = group.agg(F.min("key_id"), F.max("key_id"), F.sum("size")).first()
    if size <= whole:
        left = aim - below < size / 2 or h == (1 << 63) - 1
        return Boundary(h, LOWEST, below) if left else Boundary(h + 1, LOWEST, below + size)
    while low < high:
        width = -(-(high - low + 1) // (1 << STEP))
        unit = F.floor((F.col("key_id").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long")
        for unit_no, size in sorted((r["unit"], r["size"]) for r in group.filter(F.col("key_id").between(low, high)).groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).collect()):
            if below + size > aim - near:
                low, high = low + unit_no * width, min(high, low + (unit_no + 1) * width - 1)
                break
            below += size
        if abs(below - aim) <= near:
            break
    return Boundary(h, low, below)


def shard_of(boundaries: list[Boundary], h: Column, key_id: Column) -> Column:
    """Number of boundaries at or below the key."""
    if not boundaries:
        return F.lit(0)
    edges = F.array(*(F.struct(F.lit(b.hash).cast("bigint").alias("h"), F.lit(b.doc_id).cast("bigint").alias("key_id")) for b in boundaries))
    key = F.struct(h.alias("h"), key_id.alias("key_id"))
    return F.size(F.filter(edges, lambda b: b <= key))


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, whole: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc (docs' own columns), doc_id, size, text_crc32, law ("bytes"), shard, slot (its rank in the shard's key order, from 0), grown_shard (null).

    The documents themselves are dealt to their shards, in one exchange, and lie there as a written table in the order of
    (shard, slot). A null text has size 1 (no bytes, plus one) and the checksum of nothing, as an empty one. A null doc_id
    sorts first. Repeated rows have equal keys: they share a shard and take slots in any order. A very long text is one row
    of its shard. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col), F.lit(LOWEST)).alias("key_id"), (F.octet_length(text) + 1).cast("long").alias("size")]
    slim = materialize(docs.select(*keys), "shard-keys")
    boundaries = find_boundaries(slim, shards, tolerance, whole)
    release(slim)
    rows = docs.select(*keys, F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(boundaries, F.col("h"), F.col("key_id")))
    order = ["shard", "h", "key_id"]
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shards")
    before = Window.partitionBy("run_shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy(F.col("shard").alias("run_shard"), F.shiftright("at", PARTITION_BIT).alias("run")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    starts = runs.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).drop("rows", "first")
    # One row for each partition and shard that meet: partitions and shards together at most.
    of_run = (F.col("shard") == F.col("run_shard")) & (F.shiftright("at", PARTITION_BIT) == F.col("run"))
    placed = dealt.join(F.broadcast(starts), of_run)
    return placed.select("doc", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
