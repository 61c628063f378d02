"""Trees, taggers, chunks, alignments, units, trajectories, signals, audio: against brute force and identities."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import signal as s
from weftline.operators import acoustic as ac
from weftline.operators import alignment as al
from weftline.operators import context as c
from weftline.operators import counts as k
from weftline.operators import tagging as tg
from weftline.operators import tree as tr
from weftline.operators.chunking import Grammar, chunk
from weftline.plans.pipeline import Pipeline, stage
from weftline.sources import audio, sinks


def test_tree_grows_classifies_and_round_trips(spark):
    rows = [("a", ["x", "y"], 4), ("a", ["x"], 3), ("b", ["y"], 5), ("b", ["z"], 2), ("c", ["x", "z"], 6)]
    df = spark.createDataFrame(rows, "label string, feats array<string>, n long")
    tree = tr.grow(df, cut_off=1)
    assert all(tree.label(set(f)) == label for label, f, _ in rows)
    assert tree.count == 20 and tree.entropy == pytest.approx(tr.entropy_of([7, 7, 6]))
    again = tr.parse(tr.dump(tree))
    assert tr.dump(again) == tr.dump(tree) and tr.parse(tr.shrink(tr.dump(tree))).label({"x"}) == "a"
    drawn = tr.graphviz(tree)
    assert drawn.count("green") == tree.leaves() and "yellow" not in drawn
    for largest in (64, 0):
        got = tr.classify(df, tree, "feats", largest_case=largest).collect()
        assert all(r["predicted"] == r["label"] for r in got)
    assert tr.grow(df, cut_off=100).feature is None
    assert spark.createDataFrame(tr.node_rows(tree), tr.NODE_SCHEMA).count() == 2 * tree.leaves() - 1


def test_gain_matches_its_definition(spark):
    rows = [("a", ["x", "y"], 4), ("a", ["x"], 3), ("b", ["y"], 5), ("b", ["z"], 2)]
    got = {r["feature"]: r["gain"] for r in k.information_gain(spark.createDataFrame(rows, "label string, feats array<string>, n long")).collect()}
    h = lambda *n: tr.entropy_of(list(n))
    assert got["x"] == pytest.approx(h(7, 7) - 7 / 14 * h(7) - 7 / 14 * h(7))
    assert got["y"] == pytest.approx(h(7, 7) - 9 / 14 * h(4, 5) - 5 / 14 * h(3, 2))


TAGS = ["A", "B", "C"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["u", "v", "w", "new"]), max_size=5), st.randoms(use_true_random=False))
def test_viterbi_is_the_best_path(words, rng):
    model = tg.TagModel({t: rng.randint(1, 9) for t in TAGS}, {w: {t: rng.randint(1, 5) for t in TAGS if rng.random() < 0.7} for w in "uvw"}, {(a, b): rng.random() + 0.001 for a in TAGS for b in TAGS if rng.random() < 0.8})
    got = tg.viterbi(words, model)
    assert len(got) == len(words)

    def score(tags):
        total = sum(math.log(dict(model.candidates(w))[t]) for w, t in zip(words, tags, strict=True))
        return total + sum(math.log(model.transitions.get(p, 1 / (model.total + 1))) for p in itertools.pairwise(tags))

    if words:
        best = max(score(x) for x in itertools.product(*([t for t, _ in model.candidates(w)] for w in words)))
        assert score(got) == pytest.approx(best)


def test_viterbi_starts_over_after_an_impossible_step():
    model = tg.TagModel({"A": 1, "B": 1}, {"a": {"A": 1}, "b": {"B": 1, "A": 1}}, {("A", "B"): 0.0, ("A", "A"): 0.5})
    assert tg.viterbi(["a", "b"], model) == ["A", "B"] and tg.viterbi([], model) == []


def test_letters_syllables_and_lemmas(spark):
    leaf = lambda x: tr.Node(1, 0, dist=[(x, 1.0)])
    vowels = leaf("C")
    for v in "aeiou":
        vowels = tr.Node(1, 0, f"c0:{v}", leaf("N"), vowels)
    onset = leaf("C")
    for v in "aeiou":
        onset = tr.Node(1, 0, f"c1:{v}", leaf("O"), onset)
    tree = vowels
    node = tree
    while node.no.feature is not None:
        node = node.no
    node.no = onset
    assert tg.syllabify("Banana", tree) == ["ba", "na", "na"] and tg.syllabify(",", tree) == [","]
    assert "".join(tg.syllabify("Strengths", tree)) == "strengths"
    assert tg.letter_to_sound(",", tree) == ["sp"] and tg.letter_to_sound(".", tree) == ["pau"]
    assert tg.stress("x", "N", ["a"], leaf("PS")) == [0] and tg.stress("x", "N", ["a", "b"], leaf("PS")) == [1, 1]
    assert tg.letter_bag("a-bc", 2, 2, "P", "-") == {"c0:b", "plab:P", "c-1:a", "c-2:_", "c1:c", "c2:_"}
    assert tg.rewrite_letters("abc", leaf("*")) == "abc" and tg.rewrite_letters("abc", leaf("__nil__")) == ""
    rows = [("houses", "house"), ("went", "go"), ("Abc", "abc"), ("same", "same")]
    df = spark.createDataFrame(rows, "w string, l string").withColumn("e", tg.edit_script(F.col("w"), F.col("l"))).withColumn("again", tg.apply_edit(F.col("w"), F.col("e")))
    got = {r["w"]: (r["e"], r["again"]) for r in df.collect()}
    assert got == {"houses": ("1|", "house"), "went": ("4|go", "went"), "Abc": ("3|abc", "abc"), "same": ("0|", "same")}
    assert tg.greedy_tags(["A", "b"], leaf("T")) == ["T", "T"]
    assert tg.suffix_bag("ab", 3) == {"e0:b", "e1:a", "e2:_"} and "m:N" in tg.lemma_bag("ab", "N")


def test_chunks():
    grammar = Grammar("Np -> '<D>'? '<A>'* '<N>'\nVp -> '<V>' ('<P>' | '<R>' '<R>')\nRef -> Np Vp")
    assert chunk(["D", "A", "N", "V", "P", "D"], grammar) == ["Np1", "Np1", "Np1", "Vp1", "Vp1", ""]
    assert grammar.match("Np", ["D", "A", "A", "N"], 0) == 0
    assert Grammar("Np -> '<D>'? '<A>'* '<N>'", compat=False).match("Np", ["D", "A", "A", "N"], 0) == 4
    assert grammar.match("Ref", ["N", "V", "R", "R"], 0) == 4
    assert chunk(["D", "N"], grammar) == ["Np1", "Np1"] and chunk(["N"], grammar) == [""] and chunk([], grammar) == []
    for bad in ("X -> ('<A>'", "X -> '<A>' )", "X -> *"):
        with pytest.raises(ValueError):
            Grammar(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ABCD"), max_size=14), st.booleans())
def test_compiled_rules_match_as_parsed_ones(tags, compat):
    text = "Np -> ('<A>' | '<B>') '<B>'+ Tail?\nTail -> '<C>' ('<B>' | '<A>' '<A>'*)\nVp -> '<D>'? '<D>' '<C>'*\nAp -> ('<A>' '<B>' | '<A>')+ '<B>'"
    compiled, plain = Grammar(text, compat), Grammar(text, compat)
    plain.scanners = dict.fromkeys(("Np", "Vp", "Ap", "Pp"))
    assert all(compiled.scanner(kind) is not None for kind in ("Np", "Vp", "Ap"))
    assert chunk(tags, compiled) == chunk(tags, plain)


def test_rules_that_cannot_be_compiled_are_matched_as_parsed():
    grammar = Grammar("Np -> '<A>' Np?\nVp -> ('<A>'? | '<B>') '<B>'\nAp -> '<A>'?")
    assert [grammar.scanner(x) for x in ("Np", "Vp")] == [None] * 2 and grammar.scanner("Ap") is not None
    assert chunk(["B", "A", "A"], Grammar("Ap -> '<A>'?", compat=False)) == ["", "", ""]
    assert chunk(["A", "A", "B"], grammar)[0].startswith("Np1")


def paths(n, m):
    if n == m == 0:
        return [[(0, 0)]]
    return [p + [(n, m)] for a, b in ((n - 1, m), (n, m - 1), (n - 1, m - 1)) if a >= 0 and b >= 0 for p in paths(a, b)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0.1, 9), min_size=1, max_size=4), st.lists(st.floats(0.1, 9), min_size=1, max_size=4))
def test_warping_is_the_cheapest_path(a, b):
    cost, path = al.warp(a, b, al.log_square)
    each = lambda p: sum(al.log_square(a[i], b[j]) for i, j in p)
    assert cost == pytest.approx(min(map(each, paths(len(a) - 1, len(b) - 1))))
    assert cost == pytest.approx(each([(0, 0), *path])) and (0, 0) not in path
    assert cost == pytest.approx(al.warp(b, a, al.log_square)[0])


def test_merging_units_and_matches(spark):
    assert al.merge_reference(["a", "b", "c"], [("a", "x"), ("a", "y"), ("", "pau"), ("c", "z")]) == [("a", "x y"), (None, "pau"), ("b", ""), ("c", "z")]
    units = [al.Unit("p", "f", i, i + 1) for i in range(4)]
    lists = [[(u, abs(u.start - w)) for u in units] for w in (0, 3, 1)]
    joint = lambda x, y: abs(x.start - y.start) * 0.3
    cost, chain = al.select_units(lists, joint)
    best = min(sum(c_ for _, c_ in x) + sum(joint(x[i][0], x[i + 1][0]) for i in range(2)) for x in itertools.product(*lists))
    assert cost == pytest.approx(best) and len(chain) == 3 and al.select_units([], joint) == (0.0, [])
    assert al.blend(np.ones((2, 4)), np.zeros((3, 4)), 0.1) == pytest.approx(np.full((3, 4), 0.9))
    df = spark.createDataFrame([("a", d) for d in range(0, 40, 3)] + [("b", 5)], "p string, d int")
    got = {(r["p"], r["d"], r["unit_d"]) for r in al.duration_range_join(df, df, "p", "d").collect()}
    rows = [(r["p"], r["d"]) for r in df.collect()]
    assert got == {(p, d, e) for p, d in rows for q, e in rows if p == q and abs(d - e) <= 3}


def test_trajectories_solve_their_equations(spark):
    rng = np.random.default_rng(3)
    means, variances = rng.normal(size=(3, 12)), rng.uniform(0.5, 2, (3, 12))
    bands, right = ac.banded_normal(means, 1 / variances)
    full = sum(np.diag(bands[: 12 - j, j], j) + (np.diag(bands[: 12 - j, j], -j) if j else 0) for j in range(3))
    x = ac.trajectory(means, variances)
    assert full @ x == pytest.approx(right)
    w = np.zeros((3, 12, 12))
    for i, weights in enumerate(ac.WINDOWS):
        for t in range(12):
            for d in (-1, 0, 1):
                if weights[d + 1] and (i == 0 or 0 < t < 11):
                    w[i, t, t + d] = weights[d + 1]
    assert sum(m.T @ np.diag(1 / v) @ m for m, v in zip(w, variances, strict=True)) == pytest.approx(full)
    y = ac.spread_variance(x, means, variances, 2.0, 0.01)
    assert abs(y.var() - 2.0) < abs(x.var() - 2.0)
    rows = [(1, i, [float(i), 0.0, 0.0], [1.0, 9.0, 9.0], i != 2) for i in range(5)] + [(2, 0, [1.0, 0.0, 0.0], [1.0] * 3, False)]
    got = {(r["u"], r["t"]): r["value"] for r in ac.generate(spark.createDataFrame(rows, "u long, t long, m array<double>, v array<double>, ok boolean"), "u", "t", "m", "v", "ok").collect()}
    assert len(got) == 6 and got[1, 2] == got[2, 0] == 0.0


def test_question_trees(spark):
    from weftline.catalog.labels import TREES

    trees = ac.parse_trees(TREES)
    labels = ["x^y-a+b=c/STRESS:1", "x^y-pau+b=c/STRESS:0", "x^a-k+b=c/STRESS:0"]
    df = ac.expand_states(spark.createDataFrame([(x,) for x in labels], "label string"), 4)
    for r in ac.tree_leaf(df, "label", trees, "state").collect():
        assert r["leaf"] == trees.state(r["state"]).leaf(ac.answers_of(r["label"], trees.questions))
    assert trees.state(9).leaf({}) == "s4_all" and trees.states[2].leaf({"vowel": False, "pause": True}) == "s2_pause"


def test_gaps_totals_and_distances(spark):
    values = [0.0, 2.0, 0.0, 0.0, 5.0, 0.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "u int, i int, v double")
    assert [r["v_filled"] for r in c.fill_gaps(df, "v", ["u"], "i", "i").orderBy("i").collect()] == pytest.approx([0, 2, 3, 4, 5, 0])
    w = Window.partitionBy("u").orderBy("i")
    assert [r["x"] for r in df.select("i", c.running_total("v", ["u"], ["i"]).alias("x")).orderBy("i").collect()] == pytest.approx(np.cumsum(values))
    assert df.filter("true").select("i", c.after_first_sound(F.col("v"), w).alias("ok")).filter("ok").count() == 5
    assert [r["x"] for r in df.select("i", c.receptive_field("v", w, 3).alias("x")).orderBy("i").collect()][1] == [0.0, 0.0, 2.0]
    flags = c.distance_to_flag(df, F.col("v") > 0, ["u"], "i").orderBy("i").collect()
    assert [(r["prev_flag"], r["next_flag"]) for r in flags] == [(-1, 1), (0, 0), (1, 2), (2, 1), (0, 0), (1, -1)]


def test_counts(spark):
    rows = [("s", i, t) for i, t in enumerate("ABAB")] + [("t", 0, "A")]
    got = {(r["prev"], r["next"]): r["n"] for r in k.bigrams(spark.createDataFrame(rows, "s string, i int, t string"), "t", ["s"], "i").collect()}
    assert got == {("_", "A"): 2, ("A", "B"): 2, ("B", "A"): 1, ("B", "_"): 1, ("A", "_"): 1}
    ids = k.vocabulary(spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (500, "z"), (4, "#")], "i long, v string"), "v", ["i"])
    assert {r["v"]: r["id"] for r in ids.collect()} == {"#": 0, "y": 1, "x": 2, "z": 3}
    split = k.every_nth(spark.createDataFrame([(x,) for x in "cabdefghijkl"], "w string"), "w")
    assert {r["w"] for r in split.filter("part = 'test'").collect()} == {"a", "k"}
    scores = k.f_score(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, g boolean"), "p", "g").first()
    assert tuple(scores) == (0.5, 0.5, 0.5)
    assert k.log_loss(spark.createDataFrame([(0.5,), (0.25,)], "p double"), F.col("p")).first()["loss"] == pytest.approx(math.log(8))
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(k.argmax(F.col("x")).alias("y")).first()["y"] == 1


def test_companding(spark):
    df = spark.createDataFrame([(x / 100,) for x in range(-100, 101)], "x double")
    got = df.select("x", s.mulaw_code(F.col("x")).alias("a"), s.mulaw_code_unsigned(F.col("x")).alias("b"), s.from_code(s.mulaw_code(F.col("x"))).alias("y"), s.mulaw_inverse(s.mulaw(F.col("x"))).alias("z")).collect()
    by = {r["x"]: r for r in got}
    assert (by[0.0]["a"], by[-1.0]["a"], by[0.0]["b"], by[-1.0]["b"]) == (0, -127, 127, 0)
    assert all(abs(r["y"] - r["x"]) < 0.05 and r["z"] == pytest.approx(r["x"]) for r in got)


def test_expressions(spark):
    row = spark.range(1).select(s.hann(3).alias("h"), s.expand_bands(F.transform(F.sequence(F.lit(1), F.lit(26)), lambda x: x)).alias("b"), s.transpose(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).alias("t"), s.pick(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), F.lit(0.5)).alias("p"), s.safe_reciprocal(F.lit(0.0)).alias("r")).first()
    assert row["h"] == pytest.approx([0.5, 1.0, 0.5]) and len(row["b"]) == sum(s.BAND_WIDTHS) == 1025 and row["b"][:3] == [1, 1, 2]
    assert row["t"] == [[1, 3], [2, 4]] and row["p"] == 1 and row["r"] == 1e38


def test_transforms():
    rng = np.random.default_rng(0)
    x = rng.normal(size=64)
    assert s.fft(x) == pytest.approx(np.fft.fft(x)) and s.ifft(s.fft(x)) == pytest.approx(x) and s.magnitude(x) == pytest.approx(np.abs(np.fft.fft(x)))
    with pytest.raises(ValueError):
        s.fft(np.zeros(6))
    assert s.fir_by_transform([1, 2, 3], x) == pytest.approx(np.convolve([1, 2, 3], x)[:64])
    b, a = s.butterworth(3, 0.3)
    assert b.sum() / a.sum() == pytest.approx(1) and np.abs(np.roots(a)).max() < 1
    y = s.recursive_filter([1.0], [1.0, -0.5], np.eye(1, 8)[0])
    assert y == pytest.approx(0.5 ** np.arange(8))
    assert s.best_offset(x[10:40], x[5:40]) == -5
    with pytest.raises(ValueError):
        s.interpolate([1, 1], [0, 1], [1])
    assert np.isnan(s.interpolate([0, 1], [0, 2], [0.5, 2])[1])
    tone = np.sin(2 * np.pi * 0.03 * np.arange(2048))
    target = np.abs(s.stft(tone, 256, 64))
    rebuilt = np.abs(s.stft(s.griffin_lim(target, 64, 20), 256, 64))
    assert np.linalg.norm(target[5:24] - rebuilt[5:24]) < 0.4 * np.linalg.norm(target[5:24])


def test_cepstra_and_synthesis_filter():
    mc, alpha = np.array([0.5, 0.3, -0.2, 0.1, 0.05, 0.02]), 0.42
    b = s.to_filter(mc, alpha)
    assert s.from_filter(b, alpha) == pytest.approx(mc) and s.convert(mc, alpha, 0.0, 5, alpha, 0.0) == pytest.approx(mc)
    filt = s.SynthesisFilter(5, alpha)
    h = np.array([filt.step(math.exp(b[0]) if i == 0 else 0.0, b) for i in range(512)])
    assert np.abs(np.fft.rfft(h, 2048)) == pytest.approx(s.spectrum(mc, alpha, 2048), rel=1e-3)
    assert s.energy(b, alpha) == pytest.approx(float((h**2).sum()), rel=1e-3)
    c_ = s.gain_normalise(mc, -0.5)
    assert s.gain_restore(c_, -0.5) == pytest.approx(mc)
    lpc = s.line_spectrum_to_lpc([0.3, 0.7, 1.2, 1.9])
    assert lpc[0] == 1 and np.abs(np.roots(lpc)).max() < 1
    assert len(s.vocode(np.tile(mc, (4, 1)), np.array([0, 120, 120, 0]), 8000)) == 160


def test_waves(spark, tmp_path):
    x = np.linspace(-1, 1, 101)
    for bits in (8, 16, 24, 32):
        w = audio.parse_wave(audio.render_wave(x, 8000, bits))
        assert (w.rate, w.channels, w.bits) == (8000, 1, bits) and np.abs(w.as_float()[:, 0] - x).max() < 2.1 / (1 << bits - 1)
    assert audio.parse_wave(audio.render_wave(np.array([2.0, -2.0]), 1)).samples[:, 0].tolist() == [32767, -32768]
    (tmp_path / "a.wav").write_bytes(audio.render_wave(np.stack((x, -x), 1), 16000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in audio.read_waves(spark, str(tmp_path)).collect()}
    assert rows["a.wav"]["n_frames"] == 101 and rows["b.wav"]["error"]
    waves = audio.read_waves(spark, str(tmp_path)).filter("error IS NULL")
    left = waves.select(audio.channel(F.col("samples"), F.col("channels"), 0).alias("x")).first()["x"]
    assert len(left) == 101 and left[0] == -32767 and audio.sample_rows(waves).count() == 202
    df = spark.createDataFrame([([0.0, 0.5],)], "x array<double>")
    assert audio.parse_wave(bytes(df.select(audio.wave_bytes(F.col("x"), 8000).alias("b")).first()["b"])).samples[:, 0].tolist() == [0, 16383]
    raw = bytes(df.select(audio.float_bytes(F.col("x"), little=False).alias("b")).first()["b"])
    assert audio.parse_densities(raw, [1], 1, False) == [(0, 1, [0.0], [0.5], None)]


def test_images_and_lines(spark, tmp_path):
    x = np.arange(6).reshape(2, 3)
    assert sinks.ppm(x).startswith(b"P6\n2 3\n255\n") and sinks.png(x).startswith(b"\x89PNG")
    assert sinks.grey_pixels(x).tolist() == [[102, 255], [51, 204], [0, 153]]
    df = spark.createDataFrame([("w", "T", ["a", "b"], [0, 1], ["x", "y"])], "word string, tag string, syllables array<string>, stress array<int>, phonemes array<string>")
    assert df.select(sinks.token_line(df).alias("l")).first()["l"] == "w\tT\ta-'b\tx y"
    sinks.write_lines(df, sinks.lexicon_line(F.col("word"), F.col("phonemes")), str(tmp_path / "l"))
    sinks.write_lines(df, F.col("word"), str(tmp_path / "l"), mode="append")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["w", "w\tx y"]
    offsets = sinks.frame_offsets(spark.createDataFrame([("b", 5), ("a", 3)], "file string, frames long"))
    assert {r["file"]: r["offset"] for r in offsets.collect()} == {"a": 0, "b": 3}
    frames = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.1)], "file string, frame long, v double")
    sinks.write_frames(frames, str(tmp_path / "f"))
    from weftline.sources.text import frame_slice

    assert frame_slice(spark.read.parquet(str(tmp_path / "f")), "a", 1, 3).count() == 1
    images = sinks.spectrum_images(spark.createDataFrame([(1, [[0.0, 1.0], [1.0, 0.0]])], "k long, f array<array<double>>"), "k", "f")
    assert bytes(images.first()["image"]).startswith(b"\x89PNG")


def test_pipeline_checks():
    up = stage("up", "a", "b")(lambda df: df.withColumn("b", F.col("a") + 1))
    again = stage("again", "b", "b")(lambda df: df)
    with pytest.raises(ValueError, match="again needs b"):
        Pipeline({"a"}, [again])
    with pytest.warns(UserWarning, match="provides b again"):
        Pipeline({"a"}, [up, again])
    plan = Pipeline.from_config("[stages]\n# comment\nweftline.plans.stages:sentences\nweftline.plans.stages:tokenize\n", {"doc_id", "text"})
    assert plan.columns == {"doc_id", "text", "sent_id", "line", "words"}


def test_streams(spark, small, tmp_path):
    from weftline.streaming import tokens as stt

    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(small)
    out = stt.run_to_end(stt.event_counts(stream, "1 hour", "30 minutes"), str(tmp_path / "a"), "complete")
    n = spark.read.parquet(f"{small}/events.parquet").count()
    assert out.agg(F.sum("n")).first()[0] == 2 * n
    late = stt.run_to_end(stt.event_counts(stream, "1 hour"), str(tmp_path / "b"))
    assert 0 < late.agg(F.sum("n")).first()[0] <= n


def test_smoothing_splicing_and_pulses():
    assert s.smooth_voiced([0, 3, 6, 9, 0], 1) == pytest.approx([0, 3, 6, 9, 0]) and s.smooth_voiced([1, 1, 4, 1, 1], 1)[1] == pytest.approx(2)
    assert s.smooth_joint(np.array([[0.0], [9.0], [9.0], [4.0]]), 2)[:, 0] == pytest.approx([0, 4 / 3, 8 / 3, 4])
    y = s.splice(np.zeros(100), np.ones(40), 1, 10)
    assert y[:10].sum() == 0 and y[25] == 1 and 0 < y[10] < 1 and s.splice(np.zeros(5), np.ones(3), 9) == pytest.approx(np.zeros(5))
    mc = np.array([0.5, 0.3, -0.2, 0.1, 0.05])
    sharp = s.postfilter(mc, 0.42, 0.4)
    assert s.energy(s.to_filter(sharp, 0.42), 0.42) == pytest.approx(s.energy(s.to_filter(mc, 0.42), 0.42), rel=0.05)
    pulse = s.pulse_from_magnitudes(np.ones(5), 40)
    assert np.argmax(pulse) == 0 and s.circular_shift(pulse, 3)[3] == pulse[0] and s.mean_power(np.ones(4)) == 1.0
    leaf = tr.Node(1, 0, dist=[("1|x", 1.0)])
    assert [tg.lemmatize(w, "N", leaf) for w in ("abc", "A", ".")] == ["abx", "a", "."]


def test_binary_files_and_resampling(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", b"one"), ("b.bin", b"two")], "name string, content binary")
    assert audio.write_binary(df, "name", "content", str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "b.bin").read_bytes() == b"two" and len(list((tmp_path / "out").iterdir())) == 2
    x = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "x array<double>")
    row = x.select(audio.resampled(F.col("x"), 4, 2).alias("y"), audio.within_seconds(F.col("x"), 4, 1.0).alias("ok"), audio.code_pair(F.array(F.lit(0.0)))[0].alias("c")).first()
    assert row["y"] == [0.0, 2.0] and row["ok"] and row["c"] == [127]


def test_text_to_audio_with_defaults(spark):
    from weftline.plans.synthesis import speak

    docs = spark.createDataFrame([(1, "Hello there.\nAgain"), (2, "No!")], "doc_id long, text string")
    got = {(r["doc_id"], r["sent_id"]): audio.parse_wave(bytes(r["wave"])) for r in speak(docs).collect()}
    assert got.keys() == {(1, 0), (1, 1), (2, 0)} and all(w.rate == 4000 and len(w.samples) > 100 and np.abs(w.samples).max() > 1000 for w in got.values())
    for wrong in ({"language": "xx"}, {"coder": "xx"}, {"voice": "xx"}):
        with pytest.raises(ValueError):
            speak(docs, **wrong)
