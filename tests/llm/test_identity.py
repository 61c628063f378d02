"""Rows that repeat doc_ids or have none, with links; many groups of equal texts."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_text_operators import brute_links, order
from weftline.llm import ngram_join
from weftline.llm.ngram_join import drop_near_copies, ngram_jaccard
from weftline.llm.sharding import shard_documents

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
C = " ".join(f"c{i}" for i in range(60))


@pytest.mark.parametrize("shared", [7, None])
def test_links_are_between_texts_not_ids(spark, shared):
    rows = [(1, A), (shared, A + " more"), (shared, B + " more"), (9, B), (shared, "x y"), (shared, ""), (shared, C), (shared, C), (None, C + " end"), (shared, A + " more")]
    df = spark.createDataFrame([(i, t, "e", 0) for i, t in rows], "doc_id long, text string, set_id string, key int")
    want = brute_links(rows)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    texts = sorted((order(r["doc_id"]), r["text"]) for r in kept.collect())
    of_b = (9, B) if shared is None else (7, B + " more")
    assert Counter(t[:1] for _, t in texts) == Counter(["a", "b", "x", "", "c"])
    assert (order(of_b[0]), of_b[1]) in texts and (order(1), A) in texts and len(texts) == 5


def test_large_canopies_are_cut_by_size_without_losing_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[: 60 + i])) for i in range(240)] + [(1000 + i, " ".join(words[i : i + 120])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard(df, 16).collect())
    assert got == sorted(brute_links(rows))


@pytest.mark.parametrize("alike, block", [(1, 8), (10**6, 8)])
def test_links_do_not_depend_on_what_is_put_into_one_canopy(spark, monkeypatch, alike, block):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(4, 60))]
        rows.append((10 * i, " ".join(own + passage * (i % 3 > 0))))
        if i % 4 == 0:
            rows += [(10 * i + k, " ".join(x if rng.random() > 0.02 * k else word() for x in rows[-1][1].split())) for k in range(1, 5)]
    monkeypatch.setattr(ngram_join, "ALIKE", alike)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), block).collect())
    assert got == sorted(brute_links(rows)) and sum(r[3] for r in got) > 40


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_shards_of_many_pairs_of_equal_texts(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", f"concat('text ', id % {n // 2}, repeat(' word', cast(id % {n // 2} % 7 AS int))) AS text")
    got = shard_documents(df).collect()
    assert len(got) == n and all(r["doc"]["doc_id"] == r["doc_id"] and r["text_crc32"] == zlib.crc32(r["doc"]["text"].encode()) for r in got)
    of_text, bytes_of, slots, load = defaultdict(set), Counter(), defaultdict(list), Counter()
    for r in got:
        of_text[r["doc"]["text"]].add(r["shard"])
        bytes_of[r["doc"]["text"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert all(len(x) == 1 or bytes_of[t] > 0.01 * mean for t, x in of_text.items()) and sum(map(len, of_text.values())) <= n // 2 + 15
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * mean + 2 * max(r["size"] for r in got)


def test_shards_of_rows_alike(spark):
    df = spark.createDataFrame([(None, "same"), (None, "same"), (None, None), (4, ""), (4, "")] * 40, "doc_id long, text string")
    got = shard_documents(df).drop("doc").collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 200 and all(sorted(x) == list(range(len(x))) for x in slots.values())
