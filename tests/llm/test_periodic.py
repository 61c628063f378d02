"""op13 against runs found by comparing all words, for all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.periodic import periodic_runs, run_digests, runs_of_texts, with_planted_runs


def brute_runs(words):
    n, found, covered = len(words), [], {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, stop = i, j + q
            # Of equal stretches the smaller period comes first; a stretch that a smaller period makes up isn't a run of this one.
            if stop - start >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(start, stop - p)) for p in range(1, q)):
                found.append((start, stop - start, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=6), max_size=4))
def test_runs_of_repetitive_texts(texts):
    """Powers of short words in a row, several texts in one array: every run and no other."""
    words = [[c for piece, times in text for c in piece * times] for text in texts]
    assert runs_of_texts(words) == [brute_runs(w) for w in words]


def test_runs_of_nested_and_long_periods():
    draw = random.Random(2)
    for _ in range(150):
        unit = [draw.choice("abcd") for _ in range(draw.randrange(1, 5))]
        for _ in range(draw.randrange(1, 4)):
            unit = unit * draw.randrange(1, 6) + [draw.choice("abcdefgh") for _ in range(draw.randrange(4))]
        words = [draw.choice("ab") for _ in range(draw.randrange(8))] + unit[:90] * draw.randrange(1, 7) + [draw.choice("ab") for _ in range(draw.randrange(8))]
        assert runs_of_texts([words, words[::-1]]) == [brute_runs(words), brute_runs(words[::-1])]


def test_op13_on_the_table(spark, small):
    from weftline.llm.queries import QUERIES

    found = QUERIES["op13_periodic_runs"](spark, small)
    assert found.columns == COLUMNS
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(brute_row(r["doc_id"], r["text"]) for r in rows)
    assert sum(r[1] for r in got) > 5


def test_edge_rows(spark):
    long = "x y z " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a b"), (5, long), (5, long), (7, "é" * 3 + " é" * 9)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, runs int, words string")
    got = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"]) for r in run_digests(df).collect()}
    assert got == {(1, 0, None, None, None), (2, 0, None, None, None), (3, 0, None, None, None), (None, 1, 0, 6, 1), (5, 1, 0, 180_000, 3), (7, 1, 1, 9, 1)}
    assert run_digests(df).count() == len(rows)
    assert periodic_runs(df.limit(0)).count() == 0
    assert {r["collapsed"] for r in periodic_runs(df).filter("doc_id = 5").collect()} == {"x y z"}


def test_planted_words(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcdefg") for _ in range(draw.randrange(40)))) for i in range(400)] + [(None, "a b"), (10, None)]
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] != 10}
    for doc_id, text in rows:
        if doc_id != 10:
            assert re.findall(r"\S+", got[doc_id]) == planted(doc_id, text)
