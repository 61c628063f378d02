"""What keeps queries' work in proportion to their tables: filters side by side, neighbours instead of pairs."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.catalog import QUERIES
from weftline.functions import signal as s
from weftline.operators import acoustic as ac
from weftline.functions.predicates import answers_question, question_regex
from weftline.operators import hybrid as hy
from weftline.operators import tagging as tg
from weftline.operators import tokenize as t
from weftline.operators import tree as tr
from weftline.operators import entities as e
from weftline.operators.alignment import Unit, best_match, duration_range_join, select_units
from weftline.operators.labels import full_labels


def test_synthesis_filters_side_by_side():
    b = np.random.default_rng(5).uniform(-0.5, 0.5, (4, 7))
    held, single = s.SynthesisFilter(3, 0.35, (7,)), [s.SynthesisFilter(3, 0.35) for _ in range(7)]
    for x in (1.0, 0.0, -0.5, 0.25, 0.0, 0.0):
        got = held.step(np.full(7, x), b)
        assert got == pytest.approx([f.step(x, b[:, i]) for i, f in enumerate(single)], abs=1e-14)


def test_small_tables_are_dealt_to_all_cores(spark, small):
    for name in ("synthesis_responses", "staged_responses", "line_spectrum_cepstra"):
        assert QUERIES[name](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("stages", [1, 2, 3])
def test_staged_filters_side_by_side(stages):
    frames = np.random.default_rng(6).uniform(0.1, 0.4, (3, 3, 5))
    x = np.array([1.0, -0.5, 0.0, 0.25, 0.0, 0.0])
    got = s.staged_filter(x, frames, 2, stages, 0.2)
    assert got.shape == (6, 5)
    for i in range(5):
        assert got[:, i] == pytest.approx(s.staged_filter(x, frames[:, :, i], 2, stages, 0.2), abs=1e-14)


@pytest.mark.parametrize("stages", [1, 2, 3])
def test_line_spectra_side_by_side(stages):
    lsp = np.stack([[1.5, 0.4, 0.9, 1.7, 2.5], [2.0, 0.2, 1.1, 1.9, 2.2], [0.5, 0.7, 0.8, 2.0, 3.0]], 1)
    got = s.line_spectrum_to_cepstrum(lsp, stages, 0.1)
    for i in range(3):
        assert got[:, i] == pytest.approx(s.line_spectrum_to_cepstrum(lsp[:, i], stages, 0.1), abs=1e-14)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_range_join_is_dealt_to_all_cores(spark, kind):
    draw = random.Random(4)
    left, right = ([(i, draw.choice(["a", "b", None]), draw.randrange(-9, 10) / (1 if kind == "int" else 2)) for i in range(60)] for _ in range(2))
    frames = [spark.createDataFrame([(i, p, int(d) if kind == "int" else d) for i, p, d in rows], f"id int, phone string, duration {kind}") for rows in (left, right)]
    joined = duration_range_join(*frames, "phone", "duration", 2)
    assert joined.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    number = (lambda d: int(d)) if kind == "int" else (lambda d: d)
    want = sorted((i, j) for i, p, d in left for j, q, e in right if p and p == q and abs(number(d) - number(e)) <= 2)
    assert sorted((r["id"], r["unit_id"]) for r in joined.collect()) == want and len(want) > 100


def test_best_match_against_all_pairs(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("ab"), draw.randrange(2), round(draw.random() * 60, 1)) for i in range(200)] + [(200, "c", 0, 5.0), (201, "c", 0, 35.0), (202, None, 0, 1.0), (203, "a", 0, None)]
    units = spark.createDataFrame(rows, "unit_id long, phone string, duration int, value double")
    found = best_match(units, units.withColumnRenamed("unit_id", "target_id"), ["phone", "duration"], most=0.3)
    want = set()
    for i, phone, duration, value in rows:
        ways = [(abs(value - v), j) for j, p, d, v in rows if value is not None and v is not None and phone is not None and j != i and (p, d) == (phone, duration)]
        if ways and min(ways)[0] < 0.3:
            want.add((i, min(ways)[1], min(ways)[0]))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50


def test_cheapest_units_makes_no_pairs(spark):
    """Many parts of one price, brand and size: the rows that any step of the plan makes stay in proportion."""
    units = spark.range(20_000).select(F.col("id").alias("unit_id"), F.lit("a").alias("phone"), F.lit(1).alias("duration"), (F.col("id") % 3).cast("double").alias("value"))
    found = best_match(units, units.withColumnRenamed("unit_id", "target_id"), ["phone", "duration"]).groupBy("unit_id", "cost").count().collect()
    assert {tuple(r) for r in found} == {(0, 0.0, 6666), (1, 0.0, 6666), (2, 0.0, 6665), (3, 0.0, 1), (4, 0.0, 1), (5, 0.0, 1)}


def test_labels_move_lines_once(spark, small):
    """Neither labels nor what is looked up for them is shuffled; only lines are, as text."""
    for name in ("context_labels", "acoustic_frames", "stream_parameters"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1]
        assert len([line for line in initial.splitlines() if "Exchange hashpartitioning(doc_id" in line]) == 1, name
        assert not [line for line in initial.splitlines() if "Exchange" in line and "label" in line and "Broadcast" not in line], name


def test_a_long_sentence_is_walked_once(spark):
    """Thousands of tokens without a mark, and quotes between them."""
    words = [(1, 0, i, '"' if i % 100 == 7 else "ba", ["ba"], [0], [["b", "a"]]) for i in range(20_000)]
    df = spark.createDataFrame(words, "doc_id long, sent_id long, pos long, word string, syllables array<string>, stress array<int>, phones array<array<string>>")
    got = {r["phone_no"]: r["label"] for r in full_labels(df).collect()}
    assert len(got) == 2 * (20_000 - 200) + 1
    assert "/PREVWORDS:19700/" in got[2 * 19_699] and "/NEXTWORDS:101/" in got[2 * 19_699] and "/QUOTE:1/" in got[2 * 7]


def test_streams_are_looked_up_without_grouping(spark, small):
    plan = QUERIES["stream_parameters"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "phone_no" in line]


@pytest.mark.parametrize("kind", e.KINDS)
def test_entities_are_tried_where_they_can_start(spark, kind):
    """What stands before an entity is not taken, and the same are found as by a pattern that takes it."""
    assert e.entity_pattern(kind).startswith("(?=") and not re.match(e.entity_pattern(kind), " 1 ")
    draw = random.Random(9)
    bits = ["1", "12", "2024", "5 000", "1.250,5", "%", " %", "-", " - ", "/", ":", ".", ",", " ", "\n", "X", "IV", "MCM", "Mr", "Mrs.", "Dr.", "Sir", "Ana", "Pop", "A.", "Jr.", "kg", " m", "ha", "ml", " RON", "am", "h", "May", "@", "a.b", "www.", "https://", "one", "+40", "021", "CE", "\u00e9", "\U0001f600", "_", "(", "!"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(25))) for _ in range(3000)] + ["1%", "a@b-c.d", "1 % 2%", "3 kg 4 kg", "I.O. E.", "+1 222 333 444 555", "X X\n", "12-13"]
    taking = re.compile(f"(?:^|[^A-Za-z0-9_.,/@:-])({e.compose(kind)})(?=[.,;:!?) \\t\\n\\f\\r]|\\Z)")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["entity"]) for r in e.entities(df, (kind,)).collect()) == sorted((i, m[1]) for i, text in enumerate(texts) for m in taking.finditer(text) if re.search(e.HOLDS[kind], text))


def test_written_entities_are_dealt_to_all_cores(spark, small):
    assert QUERIES["written_entities"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lines_are_cut_in_one_pass(spark):
    """By one pattern for a line, without a function for each item, into what the items give one by one."""
    draw = random.Random(13)
    bits = ["a", "bc", "\u00e9", "\U0001f600", "1", ".", "!", "?", "-", ",", ":", ";", "\u2013", " ", "  ", "\t", "\r", "\u2028", "\u00a0", "(", "..."]
    lines = ["".join(draw.choices(bits, k=draw.randrange(16))) for _ in range(4000)] + ["a.\r", "a \r", ".\r b. \t", "", " ", "a.b.c", "!", "x- y-."]

    def cut(line):
        parts = lambda item: re.findall(t.PARTS, item)
        found = [x for x in re.split("[ \t]", line) if x]
        if not found:
            return []
        *plain, last = found
        head = re.match("[^.!?]*", last)[0]
        end = [*parts(head), last[len(head) :]] if re.search("[.!?](?:\r|\u2028)?\\Z", last) else parts(last)
        return [w for x in plain for w in parts(x)] + end

    df = spark.createDataFrame([(x,) for x in [*lines, None]], "line string").select("line", t.tokens_of(F.col("line")).alias("w"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["line"], r["w"]) for r in df.collect()]
    assert got == [(x, cut(x)) for x in lines] + [(None, [])]


@pytest.mark.parametrize("name", ["token_statistics", "bigram_transitions"])
def test_neighbours_are_paired_without_a_function_for_each(spark, small, name):
    assert "lambda" not in QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_targets_alike_meet_units_once(spark, monkeypatch):
    """Of many utterances that say the same, the lattice has the pairs of one, and each gets that one's frames."""
    met = []
    lattice = hy.candidate_lattice
    monkeypatch.setattr(hy, "candidate_lattice", lambda *args: met.append(lattice(*args)) or met[-1])
    frames = lambda k: [[k + i / 8] * 4 for i in range(2)]
    units = [(i, "ab"[i % 2], 2, None if i > 3 else "f", i * 10, i * 10 + 10, frames(i / 4), [100.0 + i, 0.0]) for i in range(6)]
    targets = [(u, p, "ab"[p % 2], 2, frames(p / 3), [120.0, 90.0 + p]) for u in range(200) for p in range(3)]
    held = spark.createDataFrame(units, "unit_id long, phone string, duration int, file string, start long, stop long, frames array<array<double>>, f0 array<double>")
    asked = spark.createDataFrame(targets, "utterance long, position long, phone string, duration int, frames array<array<double>>, f0 array<double>")
    got = hy.hybrid_frames(asked, held).collect()
    assert len(met) == 1 and 0 < met[0].count() <= 9
    of = [sorted((r["frame"], r["unit_id"], *r["sp"], r["f0"]) for r in got if r["utterance"] == u) for u in (0, 77, 199)]
    assert len(got) == 200 * 6 and of[0] == of[1] == of[2] and any(r[1] is not None for r in of[0])


def test_items_are_counted_where_their_texts_are(spark, small):
    initial = QUERIES["whitespace_items"](spark, small)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(doc_id" in initial and "item#" not in "".join(line for line in initial.splitlines() if "Exchange" in line)


def test_utterances_are_vocoded_side_by_side(monkeypatch):
    """In as many steps as the longest has samples, into what the recursion gives sample by sample."""
    rng = np.random.default_rng(17)
    lengths, alpha, rate, hop = [5, 0, 9, 1, 9, 4], 0.42, 4000, 20
    mcs = [rng.uniform(-0.4, 0.4, (n, 4)) for n in lengths]
    f0s = [rng.choice([0.0, 90.0, 350.0, 5000.0], n) for n in lengths]

    def alone(mc, f0):
        draw, phase, out, b = np.random.default_rng(1), 1.0, [], [s.to_filter(c, alpha) for c in mc]
        first, rest, delay = np.zeros((6, 2)), np.zeros(6), np.zeros((6, 5))
        for t in range(len(mc)):
            for i in range(hop):
                c = b[t] + (b[min(t + 1, len(mc) - 1)] - b[t]) * i / hop
                x = draw.uniform(-1, 1) if f0[t] <= 0 else 0.0
                phase = phase + f0[t] / rate if f0[t] > 0 else 1.0
                if f0[t] > 0 and phase >= 1:
                    x, phase = math.sqrt(rate / f0[t]), phase - 1
                x *= math.exp(c[0])
                v = np.zeros(6)
                for k in range(5, 0, -1):
                    first[k, 1] = (1 - alpha**2) * first[k - 1, 0] + alpha * first[k, 1]
                    v[k] = first[k, 1] * c[1]
                w = v * s.PADE
                fed = x + sum(w[k] * (1 if k % 2 else -1) for k in range(1, 6))
                first[1:, 0], first[0, 0], x = v[1:], fed, fed + w[1:].sum()
                v = np.zeros(6)
                for k in range(5, 0, -1):
                    d = delay[k]
                    d[0] = rest[k - 1]
                    d[1] = (1 - alpha**2) * d[0] + alpha * d[1]
                    for j in (2, 3):
                        d[j] += alpha * (d[j + 1] - d[j - 1])
                        v[k] += d[j] * c[j]
                    d[2:] = d[1:-1].copy()
                w = v * s.PADE
                fed = x + sum(w[k] * (1 if k % 2 else -1) for k in range(1, 6))
                rest[1:], rest[0] = v[1:], fed
                out.append(fed + w[1:].sum())
        return out

    steps, step = [], s.SynthesisFilter.step
    monkeypatch.setattr(s.SynthesisFilter, "step", lambda self, x, b: steps.append(1) or step(self, x, b))
    got = dict(s.vocode_in_turn(mcs, f0s, rate, alpha))
    assert len(steps) == 9 * hop and sorted(got) == list(range(6))
    small = dict(s.vocode_in_turn(mcs, f0s, rate, alpha, most=1))
    for i, (mc, f0) in enumerate(zip(mcs, f0s, strict=True)):
        assert got[i] == pytest.approx(alone(mc, f0), abs=1e-11) and (got[i] == small[i]).all()


def test_unit_chains_hold_no_objects_for_rows(spark, tmp_path):
    """Tasks get arrays of numbers; the chains are those of select_units, and a value that is null has none."""
    draw = random.Random(19)
    kinds = ["click", "view", "purchase", "signup", "logout", "error", None]
    rows = [(i, i % 9, draw.choice(kinds), draw.choice([0.0, 2.5, 31.0, 97.5, 140.0])) for i in range(300)] + [(300, 9, "error", None), (301, 9, "view", 7.0), (302, 10, "view", 7.0), (303, 10, "click", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["unit_chains"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("MapInArrow")
    got = {r["user_id"]: (r["cost"], r["starts"]) for r in found.collect()}
    units = [Unit(kind, "f", at, at + 1) for kind in kinds[:5] for at in range(0, 100, 5)]
    for user in range(10):
        of = [(k, v) for _, u, k, v in rows if u == user]
        cost, chain = select_units([[(u, abs(u.start - v)) for u in units if u.phone == k] or [(Unit(k, "f", 0, 1), 0.0)] for k, v in of], lambda a, b: abs(a.start - b.start) * 0.5)
        assert got[user] == (round(cost, 6), " ".join(str(u.start) for u in chain))
    assert got[10] == (None, None) and len(got) == 11


def test_trajectories_are_solved_side_by_side(spark, small, monkeypatch):
    """Utterances of all lengths in a few systems, each with the result that it has alone, however rows are cut into batches."""
    rng = np.random.default_rng(23)
    lengths = [int(n) for n in rng.integers(0, 12, 60)] + [400, 1, 2, 3]
    rows, want = [], {}
    for u, n in enumerate(lengths):
        m, v, ok = rng.normal(size=(3, n)) + 1, rng.uniform(0.2, 2, (3, n)), rng.random(n) < 0.8
        rows += [(u, i, m[:, i].tolist(), v[:, i].tolist(), bool(ok[i])) for i in range(n)]
        x = np.zeros(n)
        if ok.any():
            bands, right = ac.banded_normal(m[:, ok], 1 / v[:, ok])
            k = len(right)
            whole = sum(np.diag(bands[: k - d, d], d) + (np.diag(bands[: k - d, d], -d) if d else 0) for d in range(min(3, k)))
            x[ok] = np.linalg.solve(whole, right)
        want |= {(u, i): x[i] for i in range(n)}
    monkeypatch.setattr(ac, "whole_groups", lambda batches, first, cut=ac.whole_groups: cut(batches, first, 50))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "7")
    try:
        found = ac.generate(spark.createDataFrame(rows, "u int, t long, m array<double>, v array<double>, ok boolean").repartition(3), "u", "t", "m", "v", "ok")
        got = {(r["u"], r["t"]): r["value"] for r in found.collect()}
    finally:
        spark.conf.unset(conf)
    assert got == {k: pytest.approx(x, abs=1e-9) for k, x in want.items()}
    solved, solve = [], ac.solve_banded
    monkeypatch.setattr(ac, "solve_banded", lambda bands, right: solved.append(right.shape) or solve(bands, right))
    ac.trajectories(np.ones((3, 5000)), np.ones((3, 5000)), np.arange(0, 5000, 50), np.full(100, 50))
    assert solved == [(50, 100)]
    plan = QUERIES["total_variances"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "InPandas" not in plan


def test_variances_are_spread_side_by_side(spark, small):
    """As utterance by utterance, each with steps and an end of its own; both trajectories come of one pass, without joins of rows."""
    rng = np.random.default_rng(29)
    lengths = np.array([9, 40, 2, 0, 1, 25, 40])
    n = int(lengths.sum())
    starts, means, variances, on = np.cumsum(lengths) - lengths, rng.normal(size=(3, n)) * 2, rng.uniform(0.1, 2, (3, n)), rng.random(n) < 0.8
    aims = rng.uniform(0.5, 4, 7), rng.uniform(0.02, 0.5, 7)

    def alone(c, m, v, gv_mean, gv_var, on):
        if on.sum() < 2 or c[on].var() == 0:
            return c
        bands, right = ac.banded_normal(m, 1 / v)
        value = lambda x: (right @ x - 0.5 * x @ ac.banded_times(bands, x)) / (3 * len(x)) - 0.5 * (x[on].var() - gv_mean) ** 2 / gv_var
        x, step = np.where(on, (c - c[on].mean()) * np.sqrt(gv_mean / c[on].var()) + c[on].mean(), c), 0.1
        best = value(x)
        for _ in range(100):
            var, mean, k = x[on].var(), x[on].mean(), on.sum()
            slope = (right - ac.banded_times(bands, x)) / (3 * len(x)) - np.where(on, (var - gv_mean) / gv_var * 2 * (x - mean) / k, 0.0)
            curve = np.maximum(np.abs(bands[:, 0]) / (3 * len(x)) + np.where(on, 2 * abs(var - gv_mean) / gv_var / k + 4 * ((x - mean) / k) ** 2 / gv_var, 0.0), 1e-12)
            tried = x + step * slope / curve
            now = value(tried)
            if now > best:
                last, x, best, step = best, tried, now, step * 1.2
                if best - last < 1e-9 * abs(last):
                    break
            else:
                step *= 0.5
        return x

    plain, spread = ac.trajectories(means, variances, starts, lengths, aims, on)
    for i, (at, k) in enumerate(zip(starts, lengths, strict=True)):
        of = slice(at, at + k)
        if k:
            assert plain[of] == pytest.approx(ac.trajectory(means[:, of], variances[:, of]), abs=1e-12)
            assert spread[of] == pytest.approx(alone(plain[of], means[:, of], variances[:, of], aims[0][i], aims[1][i], on[of]), abs=1e-6)
    plan = QUERIES["spread_trajectories"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "InPandas" not in plan and "Join Inner" not in plan.replace("Join Cross", "")


def test_texts_without_digits_are_gone_through_once_for_all_kinds_with_digits(spark, small):
    """Strings are sought in bytes, and entities are those that every kind's own pattern finds by itself."""
    assert len(e.DIGITS) == 14 and set(e.KINDS) - set(e.DIGITS) == {"number_word", "initials", "male", "female", "person", "name", "junior", "roman", "email", "url"}
    assert all(re.search("[0-9]", m) for k in e.DIGITS for m in ["12", "3,5", "12 %", "5 EUR", "1/2/2020", "1999", "14:05", "+40 123 4567"] if re.fullmatch(e.compose(k), m))
    sought = {k for k in e.KINDS if "contains" in str(e.holds(k)).lower()}
    assert sought == {"percent", "money", "male", "female", "person", "junior", "email", "url"}
    draw = random.Random(31)
    bits = ["7", "12", "1.250,5", " EUR", "%", "Mr", " Mrs. ", "Dr. ", "Ana", " Pop", " Jr.", "X", "IV", "a@b.c", "http://x.y", "www.a.b", " one", " ten ", ":05", "/", "-", "2020", " km", " ", ".", "\u00e9", "+40 123 4567", "Sir Tom", "I.O."]
    texts = ["".join(draw.choices(bits, k=draw.randrange(12))) for _ in range(400)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r["doc_id"], r["kind"], r["entity"]) for r in e.entities(df).collect())
    alone = df.select("doc_id", *(F.regexp_extract_all("text", F.lit(e.entity_pattern(k)), F.lit(1)).alias(k) for k in e.KINDS)).collect()
    assert got == sorted((r["doc_id"], k, x) for r in alone for k in e.KINDS for x in r[k] or []) and {k for _, k, _ in got} >= {"money", "person", "email", "url", "roman", "phone", "number_word"}
    initial = QUERIES["pattern_entities"](spark, small)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(doc_id") == 1 == initial.count("Exchange")


def test_hybrid_targets_move_without_their_candidates(spark, monkeypatch):
    """Units alike many times over, recorded one after the other: chosen in one pass as by whole lists of candidates, which are not moved."""
    rng = np.random.default_rng(23)
    shapes = [[[float(x)] * 4 for x in rng.integers(0, 3, n)] for n in (1, 2, 2, 3)]
    sound = lambda: (lambda k: (len(shapes[k]), shapes[k], [float(x) for x in rng.choice([0.0, 100.0, 120.0], len(shapes[k]))]))(rng.integers(0, 4))
    units = [(i, "ab"[rng.integers(0, 2)], n, f"f{i // 10}", i % 10 * 10, i % 10 * 10 + 10, frames, f0) for i in range(300) for n, frames, f0 in [sound()]]
    targets = [(u, p, "abz"[rng.choice(3, p=[0.45, 0.45, 0.1])], n, frames, f0) for u in range(60) for p in range(5) for n, frames, f0 in [sound()]]
    held = spark.createDataFrame(units, "unit_id long, phone string, duration int, file string, start long, stop long, frames array<array<double>>, f0 array<double>")
    asked = spark.createDataFrame(targets, "utterance long, position long, phone string, duration int, frames array<array<double>>, f0 array<double>")
    shown = lambda df: sorted((r["utterance"], r["frame"], r["position"], -1 if r["unit_id"] is None else r["unit_id"], *r["sp"], r["f0"]) for r in df.collect())
    lean = hy.hybrid_frames(asked, held)
    assert "options" not in lean._jdf.queryExecution().executedPlan().toString()
    got = shown(lean)
    monkeypatch.setattr(hy, "JOINTS", 0)
    assert shown(hy.hybrid_frames(asked, held)) == got
    monkeypatch.setattr(hy, "KINDS", 0)
    whole = hy.hybrid_frames(asked, held)
    assert "options" in whole._jdf.queryExecution().executedPlan().toString() and shown(whole) == got
    stock = [x.as_py() for of in hy.choices(held).toArrow().column("units") for x in of]
    assert len(stock) < 100 and len({x[3] for x in got}) > 30 and {x[3] for x in got} - {x["unit_id"] for x in stock} - {-1}


def test_questions_without_inner_wildcards_need_no_regex(spark):
    """Answers are those of the regular expressions, whatever stands around."""
    patterns = ["*-a+*", "-a+", "**b", "b**", "*", "", "a*b", "*c*d*", "*é*", "-a+*", "𝄞*"]
    values = ["", "-a+", "x-a+", "x-a+y", "-a+y", "ab", "xxb", "xb", "bxx", "bx", "a-b", "xcydz", "cyd", "é", "xéy", "𝄞-a+𝄞", "𝄞", "𝄞x", "\n-a+\n", "xé", "-a+-a+-a+", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for skip in (False, True):
        asked = [[p] for p in patterns] + [["*-a+*", "b**"], ["a*b", "-a+"], []]
        by_regex = lambda ps: F.col("v").rlike("|".join(f"(?:{question_regex(p, skip)})" for p in ps)) if ps else F.lit(False)
        got = rows.select("v", *(answers_question(F.col("v"), ps, skip).alias(f"a{i}") for i, ps in enumerate(asked)), *(by_regex(ps).alias(f"b{i}") for i, ps in enumerate(asked))).collect()
        assert all(r[f"a{i}"] == r[f"b{i}"] for r in got for i in range(len(asked))), [(r["v"], asked[i]) for r in got for i in range(len(asked)) if r[f"a{i}"] != r[f"b{i}"]]


@pytest.mark.parametrize("name", ["acoustic_frames", "stream_parameters"])
def test_labels_are_asked_once_and_stay_where_they_are(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "RLIKE" not in plan[: plan.index("MapInArrow run")]
    above = plan[: plan.index("Generate explode")]
    assert "Contains(" not in above and "label#" not in above


def test_words_are_labelled_once_a_task(spark):
    """However many batches a task has."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        number = itertools.count()
        rows = spark.range(0, 60, 1, 1).select(F.array(F.concat(F.lit("w"), (F.col("id") % 3).cast("string"))).alias("words"))
        got = {tuple(r["found"]) for r in tg.label_words(rows, "words", lambda w, _: f"{w}:{next(number)}", None, "found").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == 3


@pytest.mark.parametrize("asked", [("w0:a", "case:upper"), ("p1:A", "w0:a"), ("p2:B", "p1:A"), ("nw0:b", "c:b")])
def test_greedy_tags_walk_the_tree_once_for_what_it_asks(asked, monkeypatch):
    leaf = lambda name: tr.Node(1, 0, dist=[(name, 1.0)])
    make = lambda: tr.Node(1, 0, asked[0], tr.Node(1, 0, asked[1], leaf("A"), leaf("B")), tr.Node(1, 0, asked[1], leaf("B"), leaf("A")))
    walks, label = [], tr.Node.label
    monkeypatch.setattr(tr.Node, "label", lambda self, bag: walks.append(bag) or label(self, bag))
    words, plain, tree = ["a", "ab", "B", "ba", "", "bb"] * 20, [], make()
    for i, word in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else "_"
        plain.append(label(tree, {f"p1:{plain[-1] if plain else '_'}", f"p2:{plain[-2] if i > 1 else '_'}", f"case:{'upper' if word.isupper() else 'first' if word[:1].isupper() else 'lower'}", *tg.suffix_bag(word, 5, "w"), *tg.suffix_bag(after, 5, "nw"), *(f"c:{c}" for c in word)}))
    assert tg.greedy_tags(words, tree) == plain and len(walks) < 40 and tg.greedy_tags(words, tree) == plain and len(walks) < 40
