"""Exact dedup by content-defined chunk recipes.

A text is cut where its own content says so, each chunk gets the SHA-256 of its bytes as identifier, and the
text's recipe is the ordered list of them. Distinct chunks travel once, to verify that no two chunks share an
identifier; after that only recipes move. Equal recipes are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import NO_ID, WS, join_groups, keep_marked, materialize, row_keys

#: A chunk ends, after `least` characters, at the first blank that follows one of these word ends, or after `most`.
#: Word ends are chosen so that about one blank in thirty ends a chunk.
WORD_ENDS = "(?:[aeiouy][lrsz]|[.!?]|\\P{ASCII})"


def normalise(text: Column) -> Column:
    """Runs of white space become one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{WS}]*|\x20[{WS}]+", " ")


def chunks(text: Column, least: int = 1024, most: int = 8192) -> Column:
    """The text's content-defined chunks in order; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 3}}}?{WORD_ENDS}\x20|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """docs with norm (normalised text) and chunk (its chunks)."""
    return docs.withColumn("norm", normalise(F.col("text"))).withColumn("chunk", chunks(F.col("norm")))


def identifiers(chunk: Column) -> Column:
    return F.transform(chunk, lambda c: F.unhex(F.sha2(c, 256)))


def verify_chunks(docs: DataFrame) -> None:
    """Every distinct chunk moves once, with map-side aggregation; two different ones under one identifier stop the job."""
    each = recipes(docs).select(F.explode("chunk").alias("chunk")).select(F.sha2("chunk", 256).alias("id"), "chunk")
    clash = each.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not clash.isEmpty():
        raise ValueError("different chunks share an identifier")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, key, text_hash, text_sha256, first (key and text_hash of the row that stays), group_size of every row."""
    verify_chunks(docs)
    listed = recipes(docs).select("doc_id", *row_keys(), F.sha2("norm", 256).alias("text_sha256"), identifiers(F.col("chunk")).alias("recipe"))
    table = materialize(listed, "recipes")
    groups = table.groupBy("recipe").agg(F.min(F.struct("key", "text_hash")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    joined = join_groups(table, groups.filter("group_size > 1"), ["recipe"], F.struct("key", "text_hash"))
    return joined.withColumns({"first": F.coalesce("first", F.struct("key", "text_hash")), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal after white space runs become one blank; null counts as empty, and empty texts are equal to each
    other. The smallest doc_id of equal texts stays (a null doc_id only where there is no other). Of rows that repeat
    the staying doc_id each is kept. A very long text is many chunks and one recipe. Other columns are not read. An
    empty table gives no rows.
    """
    keep = F.col("first.key")
    return grouped(docs).select("doc_id", F.nullif(keep, F.lit(NO_ID)).alias("keep_id"), "group_size", (F.col("key") == keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs' own columns, one row for each text: the row that exact_groups keeps, of rows that repeat it any one."""
    return keep_marked(docs, grouped(docs).select("key", "text_hash", (F.col("first") == F.struct("key", "text_hash")).alias("keep")))
