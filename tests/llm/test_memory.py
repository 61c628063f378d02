"""What stands in an executor's memory beside its heap: batches for Python workers, and the workers."""

import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.language import with_language
from weftline.llm.mixing import mix_documents
from weftline.llm.ngram_join import document_sets

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
STAGES = {
    "language": with_language,
    "sets": document_sets,
    "bpe": lambda docs: bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
}


@pytest.fixture
def unbounded(spark):
    was = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)
    if was is not None:
        spark.conf.set(BOUND, was)


def documents(spark, n=4000):
    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words of it ")), 200)
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 2 == 0, "s").alias("source"))


def largest(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", STAGES)
def test_texts_go_to_workers_in_small_batches(unbounded, stage):
    docs = documents(unbounded)
    STAGES[stage](docs)
    assert largest(docs) < 4 << 20


def test_a_bound_that_is_set_stays(unbounded):
    unbounded.conf.set(BOUND, "12345678")
    STAGES["sets"](documents(unbounded, 10))
    assert unbounded.conf.get(BOUND) == "12345678"


def test_mix_starts_no_workers_of_its_own(spark):
    mixed = mix_documents(documents(spark, 60))
    plan = mixed._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert mixed.count() == 90


def test_codec_leaves_few_holes():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    tracemalloc.start()
    try:
        codec = bpe.BpeCodec(ranks, P.PATTERN)
        live, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * live
    assert all(x < y for x, y in zip(codec.pair_keys[:-1], codec.pair_keys[1:], strict=True))
