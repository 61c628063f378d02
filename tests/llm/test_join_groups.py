"""Joins of rows to groups: frequent values, null keys, clashes of names, empty tables."""

from collections import Counter

from pyspark.sql import functions as F

from weftline.llm.common import join_groups


def test_frequent_and_null_keys(spark):
    keys = [1] * 3000 + [None] * 1500 + list(range(2, 500)) * 2
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k int")
    groups = spark.createDataFrame([(k, 10 * k) for k in range(1, 400)] + [(None, -1)], "k int, g int")
    left = join_groups(rows, groups, ["k"], F.col("id"))
    assert Counter(map(tuple, left.collect())) == Counter((k, i, None if k is None or k >= 400 else 10 * k) for i, k in enumerate(keys))
    inner = join_groups(rows, groups, ["k"], F.col("id"), "inner")
    assert inner.count() == sum(k is not None and k < 400 for k in keys)
    assert left.columns == ["k", "id", "g"]


def test_given_counts_only_deal(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("k"))
    groups = spark.createDataFrame([(0, "even"), (1, "odd")], "k long, g string")
    counts = spark.createDataFrame([], "of long, n long")
    found = join_groups(rows, groups, ["k"], F.col("id"), counts=counts)
    assert sorted(map(tuple, found.groupBy("g").count().collect())) == [("even", 2500), ("odd", 2500)]
    assert join_groups(rows.limit(0), groups, ["k"], F.col("id")).isEmpty()
