"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is two aggregations and joins on node ids, with map-side minima, and is cut off by a written table; the
number of rounds grows with the logarithm of the graph. No part of the graph is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release


SALTS = 64


def _frequent(pairs: DataFrame) -> list[int]:
    """Of nodes u with over 1000 pairs the 1024 with the most: any other has at most a 1024th of the pairs."""
    counts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1000")
    return [r["u"] for r in counts.orderBy(F.desc("n")).limit(1024).select("u").collect()]


def _star(pairs: DataFrame, keep_larger: bool, frequent: list[int]) -> DataFrame:
    """pairs (u, v): link u's neighbours to the least of u and its neighbours. Pairs of a frequent u are joined by a salted key."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hot = F.col("u").isin(*frequent) if frequent else F.lit(False)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = pairs.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = salted.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"])
    if keep_larger:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges (u, v), longs or binary, in any direction, with repeats and loops: node, component (its least node). Nodes without an edge to another node are left out."""
    current = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), tag)
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, True, _frequent(both)).filter("u <> v").distinct(), tag)
        small = materialize(_star(large, False, _frequent(large)).filter("u <> v").distinct(), tag)
        release(current, large)
        current = small
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    least = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least.select("node", F.col("node").alias("component")))
