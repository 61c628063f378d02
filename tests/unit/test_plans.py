"""What the optimizer makes of the queries: pruned scans, pushed filters, no shuffle where none is needed."""

import re

import pytest

from weftline.catalog import QUERIES


def plan(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)", text)]


@pytest.mark.parametrize("name", ["rule_tokens", "word_contexts", "lines_per_document", "companded_codes", "number_ranges", "text_normal_forms", "page_addresses", "run_length_rows"])
def test_narrow_queries_do_not_shuffle(spark, small, name):
    assert "Exchange" not in plan(spark, small, name)


@pytest.mark.parametrize(
    "name, columns",
    [("run_length_rows", {"l_orderkey", "l_linenumber", "l_quantity"}), ("lines_per_document", {"doc_id", "text"}), ("corpus_vocabularies", {"lang", "source", "n_chars"}), ("value_moments", {"event_type", "value"})],
)
def test_scans_read_only_what_is_used(spark, small, name, columns):
    assert all(found <= columns for found in read_columns(plan(spark, small, name)))


def test_filters_reach_the_scan(spark, small):
    text = plan(spark, small, "complete_orders")
    assert "EqualTo(l_returnflag,R)" in text and "GreaterThan(c_acctbal" in text
    assert "CartesianProduct" not in text


def test_counts_are_summed_before_they_are_shuffled(spark, small):
    text = plan(spark, small, "document_token_counts")
    assert text.count("HashAggregate") >= 2 and "Python" not in text


@pytest.mark.parametrize(
    "name, tables",
    [("token_statistics", 1), ("bigram_transitions", 1), ("vocabulary_ids", 1), ("modulo_split", 1), ("word_span_sums", 1), ("information_gains", 2), ("running_offsets", 3), ("pattern_entities", 1)],
)
def test_each_table_is_scanned_once(spark, small, name, tables):
    df = QUERIES[name](spark, small)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == tables
