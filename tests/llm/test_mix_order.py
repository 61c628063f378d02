"""The mix is dealt to shards and each shard is shuffled."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from weftline.llm.mixing import mix_documents, mix_sources, targets


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 900 if i % 50 else None, f"word {i} " * (i % 9), "ab"[i % 2] if i % 7 else None, 0) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")


def test_mix_is_dealt_and_shuffled(docs):
    got = [(r["doc"]["doc_id"], r["doc"]["text"], r["shard"], r["position"]) for r in mix_documents(docs).collect()]
    dealt = Counter((r["doc_id"], s) for r in mix_sources(docs).collect() for s in r["shards"])
    assert Counter((i, s) for i, _, s, _ in got) == dealt and len(got) > 900
    places = defaultdict(list)
    for _, _, s, p in got:
        places[s].append(p)
    assert len(places) == 16 and all(x == list(range(len(x))) for x in places.values())
    assert [s for _, _, s, _ in got] == sorted(s for _, _, s, _ in got)
    ids = [i for i, *_ in got if i is not None]
    assert sum(a == b for a, b in zip(ids, ids[1:])) < 20 and abs(sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) - 0.5) < 0.1
    assert sorted(got, key=str) == sorted(((r["doc"]["doc_id"], r["doc"]["text"], r["shard"], r["position"]) for r in mix_documents(docs.repartition(5)).collect()), key=str)
    assert mix_documents(docs.limit(0)).count() == 0


def test_stage_writes_that_order(spark, docs, tmp_path):
    want = [(r["doc"]["doc_id"], r["doc"]["text"]) for r in mix_documents(docs).orderBy("shard", "position").collect()]
    mixed = dict(corpus_pipeline.STAGES)["source_mix"](spark, docs, "")
    assert [(r["doc_id"], r["text"]) for r in mixed.collect()] == want


def levelled(sizes, weights, share, most):
    """Targets by bisection: the level at which sources get weight times level, but most times their size at most."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    low, high, total = 0.0, 1e12, share * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * sizes[s], weight[s] * mid) for s in sizes) < total:
            low = mid
        else:
            high = mid
    return {s: min(most * sizes[s], weight[s] * high) for s in sizes}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, None: 300}, {"x": 1, "y": 0, "z": 7, "zz": 90, None: 1}, {"\U0001f600": 50, "\uffff": 60, "é": 70}])
def test_targets_against_bisection(sizes):
    want = levelled(sizes, (5, 2, 1), 1.5, 2.0)
    got = targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix_meets_those_targets(docs):
    sizes, taken, seen = Counter(), Counter(), {}
    rows = {(r["doc_id"], r["text"], r["source"]) for r in docs.collect()}
    words = lambda t: len(t.split())
    for r in docs.collect():
        sizes[r["source"]] += words(r["text"])
    want = levelled(sizes, (5, 2, 1), 1.5, 2.0)
    for r in mix_sources(docs).collect():
        s = next(s for s in sizes if sizes[s] == r["source_size"])
        assert r["target"] == pytest.approx(want[s], abs=1e-6)
        taken[s] += r["taken"]
        seen[s] = r["source_size"]
    assert rows and seen == dict(sizes)
    assert all(abs(taken[s] - want[s]) <= 2 * 2 * 9 for s in sizes)


def test_targets_where_ids_are_null_or_rows_are_alike(spark):
    """A source of null ids, one of a single repeated id, one of rows alike in all, and one beside them."""
    rows = [(None, " ".join(["w"] * (1 + i % 19)) + f" {i}", "a") for i in range(300)] + [(7, f"t {i} " * (i % 11), "b") for i in range(300)]
    rows += [(9, "the very same text", "c")] * 400 + [(i, f"x {i}", "d") for i in range(5000)] + [(None, None, "a"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    for weights in ((5, 2, 1), (1, 1, 2), (1, 7, 1)):
        want = levelled(sizes, weights, 1.5, 2.0)
        taken, alike = Counter(), Counter()
        for r in mix_sources(docs, weights).collect():
            taken[r["source"]] += r["taken"]
            alike[r["taken"]] += r["source"] == "c"
        assert all(abs(taken[s] - want[s]) <= 24 for s in sizes) and abs(taken["c"] - want["c"]) <= 4
        mixed = Counter()
        places = defaultdict(list)
        for r in mix_documents(docs, weights).collect():
            mixed[r["doc"]["source"]] += len((r["doc"]["text"] or "").split())
            places[r["shard"]].append(r["position"])
        assert mixed == Counter({s: n for s, n in taken.items() if n})
        assert all(x == list(range(len(x))) for x in places.values())
