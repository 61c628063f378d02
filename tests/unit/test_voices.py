"""Hybrid assembly, total variances, staged filters and line spectra: against brute force, written apart from the library."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.catalog import QUERIES
from weftline.catalog.joins import hybrid_inputs
from weftline.catalog.numeric import spread_rows
from weftline.functions import signal as s
from weftline.operators import acoustic as ac
from weftline.operators import alignment as al
from weftline.operators import hybrid as hy
from weftline.plans.synthesis import voice_parameters


def aligned(a, b, part):
    """Least cost of aligning frames and the pairs of a best path, diagonal steps first, then steps of a; the first `part` of the bins count."""
    gap = lambda x, y: sum(abs(p - q) for p, q in zip(x[:part], y[:part], strict=True))
    best = {}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        before = [best[k] for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best]
        best[i, j] = gap(a[i], b[j]) + (min(before) if before else 0.0)
    i, j, pairs = len(a) - 1, len(b) - 1, []
    while (i, j) != (0, 0):
        pairs.insert(0, (i, j))
        i, j = min((k for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in best), key=lambda k: best[k])
    return best[len(a) - 1, len(b) - 1], pairs


def brute(targets, units, reach, most, weight, pauses=("pau", "sp")):
    """Frames of one utterance: all chains are tried."""
    lattice = []
    for t in targets:
        found = []
        for u in units:
            if t["phone"] not in pauses and u["phone"] == t["phone"] and abs(u["duration"] - t["duration"]) <= reach:
                cost = aligned(t["frames"], u["frames"], len(t["frames"][0]) // 2)[0] / len(t["frames"])
                if cost < most:
                    found.append((cost, u))
        lattice.append(sorted(found, key=lambda x: x[1]["unit_id"]) or [(0.0, None)])

    def joint(t, u, t2, u2):
        if u and u2 and u["file"] == u2["file"] and u["stop"] == u2["start"]:
            return 0.0
        a, b = u or t, u2 or t2
        pitch = abs(math.log(a["f0"][-1]) - math.log(b["f0"][0])) if a["f0"][-1] > 0 and b["f0"][0] > 0 else 0.0
        return sum(abs(x - y) for x, y in zip(a["frames"][-1], b["frames"][0], strict=True)) + pitch

    def cost(chain):
        return sum(c for c, _ in chain) + sum(joint(targets[k], x[1], targets[k + 1], y[1]) for k, (x, y) in enumerate(itertools.pairwise(chain)))

    chain = min(itertools.product(*lattice), key=cost)
    sp, f0, ids, joints = [], [], [], set()
    for t, (_, u) in zip(targets, chain, strict=True):
        if u is None:
            joints |= {len(sp), len(sp) + len(t["frames"])}
            sp += [list(x) for x in t["frames"]]
            f0 += list(t["f0"])
        else:
            frames, pitch = [list(x) for x in u["frames"]], list(u["f0"])
            for i, j in aligned(t["frames"], u["frames"], len(t["frames"][0]))[1]:
                frames[j] = [weight * x + (1 - weight) * y for x, y in zip(t["frames"][i], frames[j], strict=True)]
                if t["f0"][i] and pitch[j]:
                    pitch[j] = weight * t["f0"][i] + (1 - weight) * pitch[j]
            sp += frames
            f0 += pitch
        ids += [u and u["unit_id"]] * (len(sp) - len(ids))
    for joint_at in sorted(joints):
        for at in (joint_at - 1, joint_at, joint_at + 1):
            if joint_at and 0 < at < len(sp) - 1:
                sp[at] = [(x + y) / 2 for x, y in zip(sp[at - 1], sp[at + 1], strict=True)]
                if f0[at - 1] and f0[at + 1]:
                    f0[at] = (f0[at - 1] + f0[at + 1]) / 2
    voiced = [i for i, x in enumerate(f0) if x]
    filled = []
    for i in range(len(f0)):
        left, right = max((k for k in voiced if k <= i), default=None), min((k for k in voiced if k >= i), default=None)
        filled.append(0.0 if not voiced else f0[right] if left is None else f0[left] if right is None or left == right else f0[left] + (f0[right] - f0[left]) * (i - left) / (right - left))
    return ids, sp, filled, cost(chain)


TARGET = "utterance long, position long, phone string, duration int, frames array<array<double>>, f0 array<double>"
UNIT = "unit_id long, phone string, duration int, file string, start long, stop long, frames array<array<double>>, f0 array<double>"


def test_hybrid_utterances_against_all_chains(spark):
    draw = random.Random(11)

    def sounds(n, silent=0.3):
        return [[round(draw.random() * 2, 3) for _ in range(4)] for _ in range(n)], [0.0 if draw.random() < silent else round(100 + 80 * draw.random(), 2) for _ in range(n)]

    units = [(i, draw.choice("abc"), n, f"f{i // 4}", i % 4 * 10, i % 4 * 10 + 10, *sounds(n)) for i in range(24) for n in [draw.randrange(1, 6)]]
    units += [(24, "pau", 3, "g", 0, 10, *sounds(3))]
    targets = [(u, p, draw.choice(["a", "b", "c", "pau", "z"]), n, *sounds(n, 1.0 if u == 5 else 0.3)) for u in range(30) for p in range(draw.randrange(1, 5)) for n in [draw.randrange(1, 6)]]
    got = defaultdict(list)
    for r in hy.hybrid_frames(spark.createDataFrame(targets, TARGET), spark.createDataFrame(units, UNIT), reach=1, most=1.2).orderBy("utterance", "frame").collect():
        got[r["utterance"]].append(r)
    held = [dict(zip(("unit_id", "phone", "duration", "file", "start", "stop", "frames", "f0"), u, strict=True)) for u in units]
    seen = set()
    for u in range(30):
        of = [dict(zip(("utterance", "position", "phone", "duration", "frames", "f0"), t, strict=True)) for t in targets if t[0] == u]
        ids, sp, f0, _ = brute(of, held, 1, 1.2, 0.1)
        rows = got[u]
        assert [r["frame"] for r in rows] == list(range(len(ids)))
        assert [r["unit_id"] for r in rows] == ids
        assert np.array([r["sp"] for r in rows]) == pytest.approx(np.array(sp)) and [r["f0"] for r in rows] == pytest.approx(f0)
        seen |= set(ids)
    assert None in seen and len(seen) > 8 and 24 not in seen


def test_hybrid_query_against_all_chains(spark, small):
    """The orders of the table, those with so few chains that all can be tried, frame by frame."""
    targets, units = hybrid_inputs(spark, small)
    held = defaultdict(list)
    for r in units.collect():
        held[r["phone"]].append(r.asDict())
    of, got = defaultdict(list), defaultdict(list)
    for r in targets.collect():
        of[r["utterance"]].append(r.asDict())
    for r in QUERIES["hybrid_utterances"](spark, small).orderBy("utterance", "frame").collect():
        got[r["utterance"]].append(r)
    assert got.keys() == of.keys()
    tried, natural = 0, 0
    for u, lines in of.items():
        lines.sort(key=lambda t: t["position"])
        own = [x for phone in {t["phone"] for t in lines} for x in held[phone]]
        if math.prod(1 + sum(x["phone"] == t["phone"] for x in own) for t in lines) > 3000:
            continue
        ids, sp, f0, _ = brute(lines, own, 1, 2.0, 0.1)
        assert [r["energy"] for r in got[u]] == pytest.approx([sum(x) for x in sp], abs=2e-6) and [r["f0"] for r in got[u]] == pytest.approx(f0, abs=2e-6)
        assert [r["unit_id"] for r in got[u]] == ids
        tried, natural = tried + 1, natural + sum(i is not None for i in ids)
    assert tried > 0.7 * len(of) and natural > 100


def test_costs_of_many_pairs():
    draw = np.random.default_rng(2)
    a, b = ([draw.normal(size=(n, 3)) for n in draw.integers(1, 5, 60)] for _ in range(2))
    want = [aligned(x.tolist(), y.tolist(), 3)[0] for x, y in zip(a, b, strict=True)]
    assert al.warp_costs(a, b) == pytest.approx(want)
    assert [al.warp_cost(x, y, lambda p, q: np.abs(p - q).sum(1)) for x, y in zip(a, b, strict=True)] == pytest.approx(want)


def test_chains_can_be_kept_narrow():
    costs, joint = [np.array([0.0, 1.0]), np.array([5.0, 0.0])], lambda k: np.array([[9.0, 9.0], [0.0, 0.0]])
    assert al.cheapest_chain(costs, joint) == (1.0, [1, 1])
    assert al.cheapest_chain(costs, joint, widest=1) == (9.0, [0, 1])


def test_spread_variance_climbs_its_objective(spark, small):
    draw = np.random.default_rng(3)
    for n in (2, 3, 9, 40):
        means, variances = draw.normal(size=(3, n)) * [[3.0], [0.3], [0.1]], draw.uniform(0.1, 2, (3, n))
        on = draw.random(n) < 0.8
        on[:2] = True
        c = ac.trajectory(means, variances)
        wanted, by = c[on].var() * 2.5 + 0.1, 0.05
        x = ac.spread_variance(c, means, variances, wanted, by, on=on)
        # The objective by whole matrices: rows of windows that fit, weighted by their precisions.
        rows, aims, weights = [], [], []
        for w, (mean, var) in zip(ac.WINDOWS, zip(means, variances, strict=True), strict=True):
            for t in range(n):
                reach = [k for k in (-1, 0, 1) if w[k + 1]]
                if all(0 <= t + k < n for k in reach):
                    rows.append([w[i - t + 1] if abs(i - t) <= 1 else 0.0 for i in range(n)])
                    aims.append(mean[t])
                    weights.append(1 / var[t])
        big, aims, weights = np.array(rows), np.array(aims), np.array(weights)

        def objective(y):
            quadratic = (big * weights[:, None]).T @ big
            return ((big.T @ (weights * aims)) @ y - 0.5 * y @ quadratic @ y) / (3 * n) - 0.5 * (y[on].var() - wanted) ** 2 / by

        start = np.where(on, (c - c[on].mean()) * math.sqrt(wanted / c[on].var()) + c[on].mean(), c)
        assert objective(x) >= objective(start) - 1e-12
        if n == 40:
            assert objective(x) > objective(c) and abs(x[on].var() - wanted) < abs(c[on].var() - wanted)
    rows = spread_rows(spark, small).collect()
    assert len(rows) > 5 and all(abs(r["after"] - r["wanted"]) < abs(r["before"] - r["wanted"]) for r in rows)
    flat = np.ones((3, 4))
    assert (ac.spread_variance(np.ones(4), flat, flat, 2.0, 1.0) == 1).all()


def test_line_spectra_and_staged_filters():
    draw = np.random.default_rng(5)
    for order in (1, 2, 3, 6, 7):
        w = np.sort(draw.uniform(0.1, 3.0, order))
        a = s.line_spectrum_to_lpc(w)
        assert a[0] == 1 and len(a) == order + 1
        for stages in (1, 2, 3):
            gain = 1.7
            c = s.line_spectrum_to_cepstrum(np.array([gain, *w]), stages)
            assert c == pytest.approx(s.line_spectrum_to_cepstrum(np.array([math.log(gain), *w]), stages, log_gain=True))
            z = np.exp(-1j * np.linspace(0.1, 3, 7))
            powers = z[:, None] ** np.arange(order + 1)
            gamma = -1 / stages
            assert np.abs((1 + gamma * (powers @ c)) ** (1 / gamma)) == pytest.approx(gain * np.abs(powers @ a) ** -stages)
    # Round trip: the roots of the two symmetric polynomials are the frequencies again.
    w = np.array([0.3, 0.8, 1.4, 2.2])
    a = np.concatenate((s.line_spectrum_to_lpc(w), [0]))
    found = sorted(x for p in (a + a[::-1], a - a[::-1]) for x in np.angle(np.roots(p)) if 1e-6 < x < math.pi - 1e-6)
    assert found == pytest.approx(w)


@pytest.mark.parametrize("stages", [1, 2, 3])
def test_staged_filter_is_its_polynomial(stages):
    b = np.array([0.0, 0.4, -0.2, 0.1])
    held = s.StagedFilter(3, 0.0, stages)
    got = [held.step(x, b) for x in np.eye(1, 40)[0]]
    want = np.eye(1, 40)[0]
    for _ in range(stages):
        out = []
        for i, x in enumerate(want):
            out.append(x - sum(b[k] * out[i - k] for k in (1, 2, 3) if i >= k))
        want = out
    assert got == pytest.approx(want)
    # On a warped scale each delay is the all-pass (w - alpha) / (1 - alpha w).
    alpha = 0.35
    held = s.StagedFilter(3, alpha, stages)
    h = np.array([held.step(x, s.to_filter(np.array([0.0, 0.2, -0.1, 0.05]), alpha)) for x in np.eye(1, 600)[0]])
    z = np.exp(-1j * np.linspace(0.2, 3, 9))
    warped = (z - alpha) / (1 - alpha * z)
    c = np.array([0.0, 0.2, -0.1, 0.05])
    constant = s.to_filter(c, alpha)[0]
    poly = (warped[:, None] ** np.arange(4)) @ c - constant
    assert (z[:, None] ** np.arange(600)) @ h == pytest.approx((1 + poly) ** -stages, abs=1e-9)


def test_staged_filter_carries_its_state_over_frames():
    """Frames that change: two of one sample each against the recursion by hand."""
    frames = np.stack([s.line_spectrum_to_cepstrum(np.array([g, *w]), 1) for g, w in ((2.0, (0.5, 1.5)), (3.0, (0.9, 2.0)))])
    got = s.staged_filter(np.array([1.0, 0.5, 0.25]), frames, 1, 1)
    a1, a2 = (s.line_spectrum_to_lpc(np.array(w)) for w in ((0.5, 1.5), (0.9, 2.0)))
    y0 = 2.0
    y1 = 3 * 0.5 - a2[1] * y0
    assert got == pytest.approx([y0, y1, 3 * 0.25 - a2[1] * y1 - a2[2] * y0])
    assert a1[0] == a2[0] == 1


def test_masked_moments(spark):
    from weftline.operators.counts import moments

    rows = [(1.0, True), (5.0, False), (3.0, True), (None, True)]
    r = moments(spark.createDataFrame(rows, "v double, ok boolean"), F.col("v"), mask=F.col("ok")).first()
    assert (r["n"], r["least"], r["most"], r["mean"], r["var"]) == (2, 1.0, 3.0, 2.0, 1.0)


def test_seven_streams_of_a_voice(spark):
    """Two labels by hand: one join gives all streams, differences and total variances, durations by state."""
    labels = [(1, 0, "x^x-a+t=o/STRESS:1/"), (1, 1, "x^a-pau+t=o/STRESS:0/")]
    rows = {(r["n"], r["state"]): r for r in voice_parameters(spark.createDataFrame(labels, "u long, n long, label string"), ["u", "n"]).collect()}
    a2, a3, p2 = rows[0, 2], rows[0, 3], rows[1, 2]
    assert len(rows) == 4 and (a2["frames"], a3["frames"], p2["frames"]) == (6, 5, 8)
    assert a2["voiced"] and a2["lf0_mean"] == [4.8, 0.01, 0.0] and a3["lf0_mean"] == [5.0, 0.0, 0.0]
    assert not p2["voiced"] and p2["lf0_mean"][0] == 0.0 and p2["spread"] is False and a2["spread"] is True
    assert len(a2["mgc_mean"]) == 12 and a2["mgc_mean"][4] == 0.02 and a2["bap_mean"][0] == -3.0
    assert a2["gv_lf0_mean"] == [0.03] and a2["gv_mgc_var"] == [0.1, 0.01, 0.01, 0.001] and a2["gv_bap_mean"] == [1.0]
