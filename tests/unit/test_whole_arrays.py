"""Queries over whole arrays and whole vocabularies, on tables that are longer than any prefix of theirs."""

from collections import Counter

import numpy as np
import pytest

from weftline.catalog import QUERIES
from weftline.catalog.models import sentences
from weftline.functions import signal as s
from weftline.operators import alignment as al
from weftline.operators import tagging as tg
from weftline.operators import tree as tr


@pytest.fixture(scope="module")
def long_users(spark, tmp_path_factory):
    """Users 1, 2 and 3 with 150, 70 and 20 events; the values past the first 64 are larger than those before."""
    at = tmp_path_factory.mktemp("events")
    values = {u: [float((u * 7 + i * i) % 37) + (200 if i >= 64 else 20) for i in range(n)] for u, n in ((1, 150), (2, 70), (3, 20))}
    rows = [(u * 1000 + i, u, v) for u, x in values.items() for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{at}/events.parquet")
    return str(at), values


def test_warp_distances_are_of_whole_arrays(spark, long_users):
    path, values = long_users
    got = {r["user_id"]: r["distance"] for r in QUERIES["warp_distances"](spark, path).collect()}
    assert got == {u: pytest.approx(al.warp([v + 1 for v in values[u]], [v + 1 for v in values[u + 1]], al.log_square)[0], abs=2e-6) for u in (1, 2)}


def test_warp_cost_is_that_of_the_path():
    rng = np.random.default_rng(1)
    for n, m in [(0, 3), (1, 1), (1, 9), (9, 1), (7, 12), (30, 11)]:
        a, b = rng.random(n) + 1, rng.random(m) + 1
        assert al.warp_cost(a, b, lambda x, y: (np.log(x) - np.log(y)) ** 2) == pytest.approx(al.warp(a, b, al.log_square)[0])


def test_warp_distance_of_spectra(spark):
    rows = [([[1.0, 2.0, 9.0, 9.0], [3.0, 4.0, 0.0, 0.0]], [[1.0, 1.0, 0.0, 0.0], [5.0, 4.0, 1.0, 1.0], [3.0, 3.0, 3.0, 3.0]]), (None, [[1.0, 2.0]]), ([], [[1.0, 2.0]])]
    got = [r["distance"] for r in al.warp_distance(spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>"), "a", "b").collect()]
    assert got == [pytest.approx(al.warp(*rows[0], al.half_l1)[0]), None, 0.0]


def test_vocoded_is_of_whole_arrays(spark, long_users):
    path, values = long_users
    envelope = np.array([0.5, 0.3, -0.2, 0.1, 0.05, 0.02])
    for r in QUERIES["vocoded"](spark, path).collect():
        x = np.array(values[r["user_id"]])
        y = s.vocode(np.tile(envelope, (len(x), 1)), x, rate=4000)
        assert (r["samples"], r["peak"]) == (20 * len(x), round(float(np.abs(y).max()), 3))


def test_fft_magnitudes_are_of_every_frame(spark, long_users):
    path, values = long_users
    got = {(r["user_id"], r["frame"], r["bin"]): r["magnitude"] for r in QUERIES["fft_magnitudes"](spark, path).collect()}
    want = {}
    for u, x in values.items():
        for f in range(0, len(x), 64):
            m = np.abs(np.fft.fft(x[f : f + 64], 64))
            want |= {(u, f // 64, k): m[k] for k in range(64)}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}


def fine(tags):
    """Where a word stands: before a mark or the end, after a short word, elsewhere."""
    out = []
    for i, t in enumerate(tags):
        after = tags[i + 1] if i + 1 < len(tags) else "P"
        out.append(t if t in "PN" else t + ("e" if after == "P" else "b" if i and tags[i - 1] == "S" else "c"))
    return out


def test_viterbi_tags_decide_by_context(spark, tmp_path):
    """More (word, tag) pairs than 20,000, words of several tags and words seen once, against one model of all of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26**k % 26] for k in range(4))
    shape = lambda i: word(i).capitalize() if i % 3 == 0 else str(i) if i % 7 == 0 else word(i)[:2] if i % 11 == 0 else word(i) + ("," if i % 5 == 0 else "")
    rows = [(d, " ".join(shape(d * 100 + i * 7 % 173) for i in range(100)) + ".") for d in range(340)]
    rows += [(None, "Abcd the 12."), (None, "The abcd, 13."), (0, "Other words here."), (999, ""), (998, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [(r["doc_id"], r["sent_id"], r["words"], fine(r["tags"])) for r in sentences(spark, str(tmp_path)).collect()]
    counts, known, pairs = {}, {}, {}
    for _, _, words, tags in held:
        for w, t in zip(words, tags, strict=True):
            counts[t] = counts.get(t, 0) + 1
            known.setdefault(w, {})[t] = known.get(w, {}).get(t, 0) + 1
        for move in zip(tags, [*tags[1:], "_"], strict=True):
            pairs[move] = pairs.get(move, 0) + 1
    assert sum(map(len, known.values())) > 20_000
    lexicon = {w: of for w, of in known.items() if sum(of.values()) > 1}
    assert 100 < len(lexicon) < len(known)
    bags = [(t, sorted(tg.suffix_bag(w, 3)), n) for w, of in lexicon.items() for t, n in of.items()]
    suffixes = tr.grow(spark.createDataFrame(bags, "label string, feats array<string>, n long"), cut_off=200, max_depth=3)
    assert suffixes.leaves() > 2
    firsts = {}
    for (a, _), n in pairs.items():
        firsts[a] = firsts.get(a, 0) + n
    total = sum(counts.values()) + sum(sum(of.values()) for of in lexicon.values())
    model = tg.TagModel(counts, lexicon, {(a, b): n / firsts[a] for (a, b), n in pairs.items()}, suffixes, total)
    want = [(d, s, " ".join(tg.viterbi(words, model))) for d, s, words, _ in held]
    got = [(r["doc_id"], r["sent_id"], r["tags"]) for r in QUERIES["viterbi_tags"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    alone = [(d, s, " ".join(max(model.candidates(w), key=lambda c: c[1])[0] for w in words)) for d, s, words, _ in held]
    assert sum(a != b for a, b in zip(alone, want, strict=True)) > 50


def test_tags_of_the_tables_are_ambiguous(spark, small):
    """A tenth of the tokens and more have several tags, and context decides them better than their most frequent tag."""
    given = {(r["doc_id"], r["sent_id"]): r["tags"].split() for r in QUERIES["viterbi_tags"](spark, small).collect()}
    rows = [(r["words"], fine(r["tags"]), given[r["doc_id"], r["sent_id"]]) for r in sentences(spark, small).collect()]
    of = {}
    for words, tags, _ in rows:
        for w, t in zip(words, tags, strict=True):
            of.setdefault(w, Counter())[t] += 1
    tokens = [(w, t, g) for row in rows for w, t, g in zip(*row, strict=True)]
    assert sum(len(of[w]) > 1 for w, _, _ in tokens) > len(tokens) / 10
    assert sum(of[w].most_common(1)[0][0] != g for w, _, g in tokens) > len(tokens) / 10
    several = [(w, t, g) for w, t, g in tokens if len(of[w]) > 1]
    right, alone = sum(t == g for _, t, g in several), sum(of[w].most_common(1)[0][0] == t for w, t, _ in several)
    assert right > 0.8 * len(several) and right > 1.1 * alone
    # The edge rows: no line is left out, and an empty model tags nothing.
    assert len(given) == len(rows) and tg.viterbi([], tg.TagModel({}, {}, {})) == []
