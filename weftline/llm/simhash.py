"""SimHash fingerprints by signed votes of weighted terms, and search by permuted block tables.

A term is a pair of neighbouring words (a text of one word has that word as its term); it votes once for each
occurrence, weighted by its length. Its 64-bit hash says for each bit whether the vote is for or against. Votes are
summed four bits to a long, in lanes of 16 bits, over runs of terms too short to overflow a lane, so one term costs
sixteen additions in generated code. The sign of each sum is a bit of the fingerprint.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WS, materialize

BITS = 64
LANES = 4
PACKED = BITS // LANES
LANE_MASK = 0x0001000100010001
LOWEST = -(1 << 63)
#: The heaviest term weighs this much; 2 ** RUN_BITS of it leave a lane of 16 bits one bit free.
HEAVIEST = 4
RUN_BITS = 12


def weight_of(first: Column, second: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(HEAVIEST), F.shiftright(F.octet_length(first) + F.octet_length(F.coalesce(second, F.lit(""))), 2))).cast("long")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys must tell rows apart. One row per input row: keys, fingerprint (long). A text without words has fingerprint 0."""
    split = texts.select(*keys, F.split(F.btrim(text_col, F.lit(" \t\n\x0b\f\r")), rf"[{WS}]+").alias("words"))
    each = split.select(*keys, "words", F.posexplode("words").alias("term_at", "word"))
    following = F.try_element_at("words", F.col("term_at") + 2)
    n = F.size("words")
    terms = each.select(
        *keys,
        F.shiftright("term_at", RUN_BITS).alias("run"),
        F.xxhash64("word", following).alias("h"),
        F.when((F.col("term_at") == n - 1) & (n > 1) | (F.col("word") == "") & (n == 1), 0).otherwise(weight_of(F.col("word"), following)).alias("w"),
    )
    lane = lambda k: F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANE_MASK))
    packed = terms.groupBy(*keys, "run").agg(*(F.sum(F.col("w") * lane(k)).alias(f"p{k}") for k in range(PACKED)), F.sum("w").alias("w"))
    unpacked = [F.shiftrightunsigned(f"p{k}", 16 * lane_no).bitwiseAND(F.lit(0xFFFF)) for lane_no in range(LANES) for k in range(PACKED)]
    summed = packed.groupBy(*keys).agg(F.sum("w").alias("w"), *(F.sum(x).alias(f"v{i}") for i, x in enumerate(unpacked)))
    bit = lambda i: F.when(F.col(f"v{i}") * 2 > F.col("w"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0))
    return summed.select(*keys, reduce(add, map(bit, range(BITS))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def literal(values: list, kind: str) -> Column:
    """A constant array, however long, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass(frozen=True)
class Buckets:
    """Ranges of doc_id, dealt evenly: coarse and fine splitters. Rows without an id have ranges of the text's hash, numbered down from -1."""

    coarse: list[int]
    fine: list[list[int]]
    null_bits: int

    def number(self, doc_id: Column, text_hash: Column) -> Column:
        width = max(map(len, self.fine), default=0) + 1
        below = lambda splits: F.size(F.filter(splits, lambda s: s <= doc_id))
        c = below(literal(self.coarse, "array<bigint>"))
        of_id = c * width + below(F.element_at(literal(self.fine, "array<array<bigint>>"), c + 1))
        slice_ = F.shiftrightunsigned(text_hash.bitwiseXOR(F.lit(LOWEST)), 64 - self.null_bits).cast("int")
        return F.when(doc_id.isNotNull(), of_id).otherwise(-1 - slice_)


def bucket_ranges(ids: DataFrame, n: int) -> Buckets:
    """About n ranges of equally many ids, from approximate percentiles of the id column alone."""
    splits = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] or []
    splits = sorted(set(splits))
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    return Buckets([g[0] for g in groups[1:]], [groups[0], *(g[1:] for g in groups[1:])] if groups else [[]], max(1, n.bit_length()))


def with_next(docs: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, at, guest, doc_id, text, next_text: the next document in descending doc_id, of the last the first.

    Documents are dealt to ranges of doc_id, and the first of each range is lent as a guest to the range above it (the
    first of all to the lowest), so each range finds its neighbours alone. Rows without an id come last, by a hash of the
    text, in ranges of that hash.
    """
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    ranges = bucket_ranges(docs.select("doc_id"), n_buckets)
    own = rows.withColumn("range", ranges.number(F.col("doc_id"), F.col("text_hash")))
    place = F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(LOWEST))).alias("down"), "text_hash")
    heads = {r["range"]: r["head"] for r in own.groupBy("range").agg(F.min(place).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    host = dict(zip(order, order[-1:] + order[:-1], strict=True))
    numbers = range(order[-1], order[0] + 1) if order else range(0)
    of_range = lambda value, kind: F.try_element_at(literal([value(b) if b in heads else None for b in numbers], f"array<{kind}>"), F.col("range") + (1 - numbers.start))
    is_head = place == F.struct(of_range(lambda b: heads[b]["down"], "bigint").alias("down"), of_range(lambda b: heads[b]["text_hash"], "bigint").alias("text_hash"))
    lent = F.when(is_head, of_range(host.get, "int"))
    places = F.filter(F.array(F.struct(F.col("range").cast("int").alias("bucket"), F.lit(False).alias("guest")), F.struct(lent.alias("bucket"), F.lit(True).alias("guest"))), lambda p: p["bucket"].isNotNull())
    dealt = own.select("doc_id", "text", "text_hash", F.inline(places))
    within = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text_hash")
    return dealt.withColumn("at", F.row_number().over(within)).withColumn("next_text", F.lead("text").over(within)).drop("text_hash")


def fingerprint_documents(docs: DataFrame, n_buckets: int | None = None, radius: int = 3, every: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    n_within: of documents whose id is divisible by `every`, how many documents have fingerprints within the radius.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document's. null counts as empty; an empty text has fingerprint 0, and 0s are alike. Repeated doc_ids are
    documents of their own, ordered by a hash of the text; a null doc_id comes last. A table of one row is its own next.
    A very long text is cut into runs of terms, whose votes are summed apart. Ranges of ids are n_buckets, or four times
    the shuffle partitions; each is one task's work.
    """
    n = n_buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), n)
    length = F.char_length("text")
    cut = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    both = paired.select("bucket", "at", "guest", "doc_id", length.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "at", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    stacked = both.select("bucket", "at", "guest", "doc_id", "n_chars", F.when(F.col("guest"), F.lit("")).otherwise(F.sha2("edited", 256)).alias("edited_sha256"), F.posexplode(F.when(F.col("guest"), F.array("text")).otherwise(F.array("text", "edited"))).alias("which", "text"))
    prints = materialize(fingerprints(stacked, keys), "fingerprints")
    rows = prints.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edit"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("at"))
    paired = materialize(rows.withColumn("next", following).filter(~F.col("guest")), "fingerprint-pairs")
    own, edit = F.col("fingerprint"), F.col("edit")
    shown = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return count_within(paired, F.coalesce(F.col("doc_id") % every == 0, F.lit(False)), radius).select(
        "doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(edit).alias("edited_fingerprint"), likeness(own, edit).alias("near_edited"), likeness(own, F.coalesce("next", own)).alias("near_next"), "n_within"
    )


def block_tables(n_rows: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table the bit ranges (start, width) that form its key.

    64 bits are cut into m blocks; fingerprints within the radius agree on some m - radius of them, and each choice of
    these is a table. m is radius + 2, and one more for every time that rows outgrow keys of that many bits 64-fold.
    """
    m = radius + 2
    while m < radius + 4 and BITS * (m - radius) // m + 6 < n_rows.bit_length():
        m += 1
    edges = [BITS * i // m for i in range(m + 1)]
    blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]
    return [list(x) for x in combinations(blocks, m - radius)]


def within_radius(queries: DataFrame, fingerprints_: DataFrame, radius: int = 3) -> DataFrame:
    """query, fingerprint, distance for all pairs within the radius of distinct query values and distinct stored values.

    Both have a column fingerprint (long, not null); equal values count once, so copies never multiply. A pair that
    agrees in several tables is taken from the first of them.
    """
    stored = fingerprints_.select("fingerprint").distinct()
    asked = queries.select(F.col("fingerprint").alias("query")).distinct()
    masks = [sum(((1 << width) - 1) << start for start, width in table) for table in block_tables(stored.count(), radius)]
    masks = [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("table"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
        return df.select(name, F.inline(keys))

    q, f = keyed(asked, "query"), keyed(stored, "fingerprint")
    apart = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    on = (q["table"] == f["table"]) & (q["key"] == f["key"]) & (F.bit_count(apart) <= radius) & (q["table"] == first)
    return q.join(f, on).select("query", "fingerprint", F.bit_count(apart).alias("distance"))


def count_within(rows: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """rows (fingerprint, ...) with n_within for those that ask: how many rows, itself among them, have a fingerprint within the radius."""
    copies = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    found = within_radius(rows.filter(asked), copies, radius).join(copies, "fingerprint").groupBy("query").agg(F.sum("copies").alias("n_within"))
    answered = rows.filter(asked).join(found, F.col("fingerprint") == F.col("query"), "left").drop("query")
    return answered.unionByName(rows.filter(~asked).withColumn("n_within", F.lit(None).cast("long")))
