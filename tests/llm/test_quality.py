"""op12: held-out accuracy, bounds of what is learnt, and edge rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm.quality import classify_quality, held_out, labelled_sample, score_quality, train


def area(scores, labels):
    """Share of pairs of a good and a bad text that are in order."""
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == label] for label in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark, small):
    from weftline.llm.queries import QUERIES

    folder = small.replace("sf0.001", "sf0.1")
    found = QUERIES["op12_quality"](spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    labels = [r["quality"] for r in rows]
    assert area([r["score"] for r in rows], labels) > 0.97
    assert sum(r["predicted"] == y for r, y in zip(rows, labels, strict=True)) / len(rows) > 0.95
    # Calibrated: the mean score is near the share of good texts, overall and on either side.
    assert abs(sum(r["score"] for r in rows) / len(rows) - sum(labels) / len(rows)) < 0.04


def test_labels_held_out_change_nothing(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, classify_quality(docs, labels).collect())) == sorted(map(tuple, classify_quality(docs.drop("lang", "source"), wrong).collect()))


def test_sample_is_bounded(spark):
    """Rows that repeat count against the bound, and long texts are passed over."""
    docs = spark.createDataFrame([(1, "good text")] * 500 + [(2, "bad $$$")] * 500 + [(3, "x" * 2000), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (9, 1), (4, None), (None, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, F.lit(True), per_class=20, longest=1000)
    assert sorted(set(rows)) == [("bad $$$", 0), ("good text", 1)] and len(rows) == 40


@pytest.mark.parametrize(("labels", "low", "high"), [([], 0.5, 0.5), ([(1, 1)], 0.5, 1.0), ([(1, 1), (2, 0)], 0.0, 1.0)])
def test_few_labels_and_edge_rows(spark, labels, low, high):
    docs = spark.createDataFrame([(1, "fine words here.", 3), (2, "b$$$ d$$$", 3), (3, None, 3), (3, "", 3), (None, "x " * 100_000, 3)], "doc_id long, text string, score int")
    rows = classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(rows) == 5 and all(low <= r["score"] <= high for r in rows)
    empty = [r["score"] for r in rows if r["doc_id"] == 3]
    assert empty[0] == empty[1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert classify_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_score_keeps_columns_and_order_of_likeness(spark):
    good = [f"the {w} of and to {w}ing." for w in ("anat", "erha", "ntble", "iner", "thon")] * 30
    bad = [f"{w}$$$ {w}%%% {w}***" for w in ("anat", "erha", "ntble", "iner", "thon")] * 30
    model = train([(t, 1) for t in good] + [(t, 0) for t in bad])
    rows = score_quality(spark.createDataFrame([(1, good[0], "a"), (2, bad[0], "b")], "doc_id long, text string, score string"), model).collect()
    assert rows[0]["doc"]["score"] == "a" and rows[0]["score"] > 0.9 and rows[1]["score"] < 0.1
