"""The pipeline's near-copy stage has its own rule, five words and 0.8; op8 keeps four and 0.85."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import near, real  # noqa: F401
from weftline.llm.ngram_join import drop_near_copies, ngram_jaccard, signatures


def shingles(text, n):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def links(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    out = {i: 0 for i, _ in docs}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x & y and 100 * len(x & y) >= percent * len(x | y):
                out[i] += 1
                out[j] += 1
    return out


@pytest.fixture(scope="module")
def edited(spark):
    """A text of 104 words, 100 shingles of five: with a paragraph appended, with a block replaced, and with too long a paragraph."""
    w = [f"w{i}" for i in range(104)]
    rows = [(1, w), (2, w + [f"new{i}" for i in range(22)]), (3, w + [f"far{i}" for i in range(60)]), (4, w[:40] + [f"x{i}" for i in range(7)] + w[47:])]
    return spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_copies_between_the_two_rules(spark, edited):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, edited, "").collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in drop_near_copies(edited).collect()) == [1, 2, 3, 4]


def test_links_of_the_stage(near):  # noqa: F811
    docs = [(r["doc_id"], r["text"]) for r in near.collect()]
    got = {r["doc_id"]: r["n_links"] for r in ngram_jaccard(near, 64, 5, 80).collect()}
    want = links(docs, 5, 80)
    assert got == want != links(docs, 4, 85)


def test_signatures_meet_at_the_lower_threshold():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(6, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop, add = (int(rng.integers(0, n // 8 + 2)) for _ in range(2))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            met += 1
            assert len(np.intersect1d(signatures(a, 80), signatures(b, 80)))
    assert met > 500
