"""Trees over many labels, stems, features of pauses, and signals row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.catalog import QUERIES
from weftline.catalog.models import sound_tree
from weftline.catalog.numeric import user_arrays
from weftline.operators import tagging as tg
from weftline.operators import tree as tr
from weftline.operators.entities import pause_features


def test_top_labels_change_neither_splits_nor_entropies(spark):
    rows = [(f"l{i % 7}" if i % 3 else f"rare{i}", [f"a{i % 5}", f"b{i % 2}"], 1 + i % 4) for i in range(300)]
    bags = spark.createDataFrame(rows, "label string, feats array<string>, n int")
    whole, cut = tr.grow(bags, cut_off=10, max_depth=4), tr.grow(bags, cut_off=10, max_depth=4, top=2)

    def check(a, b):
        assert a.feature == b.feature and a.count == b.count and b.entropy == pytest.approx(a.entropy, abs=1e-12)
        assert a.dist[:2] == b.dist and len(b.dist) <= 2
        if a.feature is not None:
            check(a.yes, b.yes)
            check(a.no, b.no)

    check(whole, cut)
    assert len(whole.dist) > 100


def test_trees_of_one_label_and_of_no_rows(spark):
    schema = "label string, feats array<string>, n int"
    one = tr.grow(spark.createDataFrame([("x", ["a"], 3), ("x", ["b"], 4)], schema), cut_off=1, top=1)
    assert one.feature is None and one.dist == [("x", 1.0)] and one.entropy == 0
    assert tr.grow(spark.createDataFrame([], schema), top=1).count == 0


def test_scripts_put_one_ending_for_another(spark):
    assert [tg.script_of(*e) for e in (("ies", "y"), ("aux", "al"), ("en", ""), ("tions", "tion"))] == ["3|y", "2|l", "2|", "1|"]
    for off, on in tg.ENDINGS:
        cut, _, put = tg.script_of(off, on).partition("|")
        assert ("stem" + off)[: len("stem" + off) - int(cut)] + put == "stem" + on


def test_stems_are_words_themselves(spark):
    words = ["walk", "walks", "walking", "pony", "ponies", "is", "i", "nation", "nations", "natio", "été", "étés", "bus", ""]
    found = {r["word"]: r["script"] for r in tg.stem_scripts(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    # The first ending that fits counts: `tions` before `s`; a stem has three letters at least.
    assert found == {"walk": "0|", "walks": "1|", "walking": "3|", "pony": "0|", "ponies": "3|y", "is": "0|", "i": "0|", "nation": "1|", "nations": "1|", "natio": "0|", "été": "0|", "étés": "1|", "bus": "0|", "": "0|"}


def test_stems_against_every_ending(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("aenst"), rng.integers(1, 8))) for _ in range(3000)})
    held = set(words)

    def script(w):
        for off, on in tg.ENDINGS:
            if w.endswith(off) and len(w) - len(off) >= 3 and w[: len(w) - len(off)] + on in held:
                return tg.script_of(off, on)
        return "0|"

    found = tg.stem_scripts(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted((r["word"], r["script"]) for r in found) == [(w, script(w)) for w in words]
    assert sum(r["script"] != "0|" for r in found) > 100


def paused(words, tags, chunks, phones):
    """Labels and bags, token by token."""
    out, kept = [], [i for i, w in enumerate(words) if w not in (",", ";", ":")]
    for at, i in enumerate(kept):
        after = words[i + 1] if i + 1 < len(words) else None
        kind = chunks[i].split(",")[0].rstrip("0123456789") or "null"
        following = phones[kept[at + 1]].split(" ")[0] if at + 1 < len(kept) else "."
        out.append(("1" if after in (",", ";", ":") else "0", [f"tag:{tags[i]}", f"chunk:{kind}", f"last:{phones[i].split(' ')[-1]}", f"next:{following}"]))
    return out


def test_pause_features(spark):
    rng = np.random.default_rng(3)
    rows = [([], [], [], []), ([","], ["P"], [""], ["sp"])]
    for n in (1, 2, 3, 9, 40, 3000):
        words = rng.choice(["Church", "a", ",", ";", "tall", "."], n).tolist()
        phones = [" ".join(tg.letter_to_sound(w, sound_tree())) for w in words]
        rows.append((words, rng.choice(["U", "S", "P"], n).tolist(), rng.choice(["", "Np1", "Vp12,Np3"], n).tolist(), phones))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(99, None, None, None, None)], "i int, words array<string>, tags array<string>, chunks array<string>, phones array<string>")
    found = {r["i"]: r["f"] for r in df.select("i", pause_features("words", "tags", "chunks", "phones").alias("f")).collect()}
    assert not found.pop(99)
    for i, f in found.items():
        assert [(x["label"], x["feats"]) for x in f] == paused(*rows[i])


def test_words_are_labelled_once_a_batch(spark):
    df = spark.createDataFrame([(1, ["ab", "c", "ab"]), (2, []), (3, None)], "i int, words array<string>")
    found = tg.label_words(df, "words", lambda w, model: model + w, "x", "out").orderBy("i").collect()
    assert [r["out"] for r in found] == [["xab", "xc", "xab"], [], None]


def spectra(x, size, hop):
    padded, window = [0.0] * size + list(x), [0.54 - 0.46 * math.cos(2 * math.pi * j / (size - 1)) for j in range(size)]
    return [np.fft.rfft([padded[i * hop + j] * window[j] for j in range(size)]) for i in range((len(padded) - size) // hop)]


def added(frames, size, hop):
    window = np.hamming(size)
    total, weight = np.zeros(hop * (len(frames) - 1) + size), np.zeros(hop * (len(frames) - 1) + size)
    for i, f in enumerate(frames):
        for j, v in enumerate(np.fft.irfft(f, size)):
            total[i * hop + j] += v * window[j]
            weight[i * hop + j] += window[j] ** 2
    return (total / weight)[size:]


def test_rebuilt_signals_row_by_row(spark, small):
    """The iteration from zero phases, spelled out on the library's transforms of real numbers."""
    users = {r["user_id"]: r["x"] for r in user_arrays(spark, small).collect()}
    rows = QUERIES["rebuilt_signals"](spark, small).collect()
    assert len(rows) == len(users)
    for r in rows:
        x = users[r["user_id"]]
        if len(x) < 8:
            assert (r["n"], r["energy"]) == (0, 0.0)
            continue
        wanted = [np.abs(f) for f in spectra(x, 16, 4)]
        frames = [m.astype(complex) for m in wanted]
        for _ in range(10):
            again = spectra(added(frames, 16, 4), 16, 4)
            phases = [a / np.maximum(np.abs(a), 1e-8) for a in again]
            frames = [m * (phases[i] if i < len(phases) else 1) for i, m in enumerate(wanted)]
        y = added(frames, 16, 4)
        assert r["n"] == len(y)
        assert r["energy"] == pytest.approx(float((y**2).sum()), rel=1e-6, abs=2e-3)


def test_vocoded_row_by_row(spark, small):
    """A fixed envelope is a fixed filter: the excitation convolved with the response of exp of the warped cepstrum."""
    envelope, alpha, size = np.array([0.5, 0.3, -0.2, 0.1, 0.05, 0.02]), 0.42, 1024
    z = np.exp(-2j * np.pi * np.arange(size) / size)
    warped = (z - alpha) / (1 - alpha * z)
    response = np.fft.ifft(np.exp(sum(c * warped**m for m, c in enumerate(envelope)))).real
    users = {r["user_id"]: r["x"] for r in user_arrays(spark, small).collect()}
    for r in QUERIES["vocoded"](spark, small).collect():
        rng, phase, excitation = np.random.default_rng(1), 1.0, []
        for f0 in users[r["user_id"]]:
            for _ in range(20):
                if f0 > 0:
                    phase += f0 / 4000
                    excitation.append(math.sqrt(4000 / f0) if phase >= 1 else 0.0)
                    phase -= phase >= 1
                else:
                    excitation.append(rng.uniform(-1, 1))
                    phase = 1.0
        y = np.convolve(excitation, response)[: len(excitation)]
        assert r["samples"] == len(y)
        assert r["peak"] == pytest.approx(np.abs(y).max(), rel=2e-3, abs=2e-3)


def test_lemmas_have_few_labels(spark, small):
    rows = QUERIES["lemmas"](spark, small).collect()
    changed = [r for r in rows if r["lemma"] != r["word"].lower()]
    assert len(changed) > 50 and all(r["lemma"] for r in rows)


def test_pauses_are_found(spark, small):
    total = QUERIES["phrase_pauses"](spark, small).groupBy("label").agg(F.sum("n").alias("n"))
    assert {r["label"] for r in total.collect()} == {"0", "1"}
