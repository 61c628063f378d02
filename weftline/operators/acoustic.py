"""Acoustic lookups and parameter generation: question trees, states, smooth trajectories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.predicates import answers_question, question_regex

#: Weights of a frame's neighbours in its static, first and second difference. Fixed values.
WINDOWS = ((0.0, 1.0, 0.0), (-0.5, 0.0, 0.5), (1.0, -2.0, 1.0))


@dataclass
class QuestionTree:
    """One state's tree: nodes are (question, no, yes), where no and yes are node numbers or leaf names."""

    nodes: dict[int, tuple[str, int | str, int | str]] = field(default_factory=dict)
    only_leaf: str | None = None

    def leaf(self, answers: dict[str, bool]) -> str:
        if self.only_leaf is not None:
            return self.only_leaf
        at: int | str = 0
        while not isinstance(at, str):
            question, no, yes = self.nodes[at]
            at = yes if answers[question] else no
        return at

    def as_case(self, answer, at: int | str = 0) -> Column:
        """The leaf as nested CASE expressions over the answers' columns."""
        if self.only_leaf is not None:
            return F.lit(self.only_leaf)
        if isinstance(at, str):
            return F.lit(at)
        question, no, yes = self.nodes[at]
        return F.when(answer(question), self.as_case(answer, yes)).otherwise(self.as_case(answer, no))


@dataclass
class TreeFile:
    questions: dict[str, list[str]]
    states: dict[int, QuestionTree]

    def state(self, number: int) -> QuestionTree:
        """The state's tree; beyond the last, the last one's."""
        return self.states[min(number, max(self.states))]


def parse_trees(text: str) -> TreeFile:
    """Questions (`QS name { "a","b" }`) and trees (`{*}[n]` and a block of `number question no yes`)."""
    questions = {m[1]: re.findall(r'"([^"]*)"|([^\s,{}"]+)', m[2]) for m in re.finditer(r"^QS\s+(\S+)\s*\{([^}]*)\}", text, re.M)}
    found = TreeFile({k: [a or b for a, b in v] for k, v in questions.items()}, {})
    for m in re.finditer(r"^\{\*\}\[(\d+)\][^\n]*\n(?:\{\s*\n(.*?)^\}|\s*\"?([^\s\"{]+)\"?)", text, re.M | re.S):
        tree = found.states[int(m[1])] = QuestionTree(only_leaf=m[3])
        name = lambda x: abs(int(x)) if re.fullmatch(r"-\d+|0", x) else x.strip('"')
        for line in (m[2] or "").splitlines():
            parts = line.split()
            if len(parts) == 4:
                tree.nodes[abs(int(parts[0]))] = parts[1], name(parts[2]), name(parts[3])
    return found


def asked_patterns(*files: TreeFile) -> list[tuple[str, ...]]:
    """The patterns of all questions that trees ask, each once."""
    return sorted({tuple(held.questions[question]) for held in files for tree in held.states.values() for question, _, _ in tree.nodes.values()})


def leaf_column(label: Column, state: Column, trees: TreeFile, answers: dict[tuple[str, ...], Column] | None = None) -> Column:
    """The leaf that a label falls to in its state's tree; beyond the last state, in the last one's. answers by patterns, where they are at hand, are not asked again."""
    last = max(trees.states)
    answer = lambda q: answers[tuple(trees.questions[q])] if answers else answers_question(label, trees.questions[q])
    expr = F.lit(None).cast("string")
    for number, tree in sorted(trees.states.items()):
        expr = F.when(F.least(state, F.lit(last)) == number, tree.as_case(answer)).otherwise(expr)
    return expr


def asked(label: Column, patterns: list[tuple[str, ...]]) -> Column:
    """An array of whether the label answers each question: to be made before labels become rows for their states."""
    return F.array(*(answers_question(label, list(p)) for p in patterns))


def answers_at(answers: str, patterns: list[tuple[str, ...]]) -> dict[tuple[str, ...], Column]:
    """The answers by patterns, out of the column that asked() made."""
    return {p: F.get(answers, i) for i, p in enumerate(patterns)}


def tree_leaf(labels: DataFrame, label: str, trees: TreeFile, state: str, out: str = "leaf", answers: str | None = None) -> DataFrame:
    """out: the leaf that a label falls to in its state's tree, all in expressions. answers: a column of what asked() says of asked_patterns(trees), where it is at hand."""
    return labels.withColumn(out, leaf_column(F.col(label), F.col(state), trees, answers_at(answers, asked_patterns(trees)) if answers else None))


def answers_of(label: str, questions: dict[str, list[str]]) -> dict[str, bool]:
    return {q: any(re.search(question_regex(p), label) for p in patterns) for q, patterns in questions.items()}


def expand_states(labels: DataFrame, states: int = 5, first: int = 2) -> DataFrame:
    """state: a row for each state of every label."""
    return labels.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + states - 1))).alias("state"))


def look_up_densities(states: DataFrame, densities: DataFrame, stream: str) -> DataFrame:
    """mean, var, weight of each (state, leaf) of a stream, by equi-join. Densities are a voice's and don't grow with the labels, so they are broadcast, and labels stay where they are: by leaf, few tasks would have them all."""
    of_stream = densities.filter(F.col("stream") == stream).select("state", "leaf", "mean", "var", "weight")
    return states.join(F.broadcast(of_stream), ["state", "leaf"], "left")


def state_frames(duration_mean: Column) -> Column:
    """Frames that a state lasts: its mean duration, rounded half up."""
    return (duration_mean + 0.5).cast("int")


def voiced_pitch(pitch: Column, weight: Column, threshold: float = 0.5) -> Column:
    """Pitch, 0 where the voicing weight is below the threshold."""
    return F.when(weight < threshold, 0.0).otherwise(pitch)


def banded_normal(means: np.ndarray, precisions: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W'PW as bands (T, 3: the diagonal and two above) and W'Pm of one dimension; means, precisions: (windows, T).

    A further axis is utterances side by side, each as long as lengths says.
    """
    n, beside = means.shape[1], means.shape[2:]
    bands, right = np.zeros((n, 3, *beside)), np.zeros((n, *beside))
    at, end = np.arange(n).reshape(n, *(1 for _ in beside)), n if lengths is None else lengths
    for w, mean, p in zip(WINDOWS, means, precisions, strict=True):
        whole = (at >= bool(w[0])) & (at < end - bool(w[2]))
        mean, p = np.where(whole, mean, 0.0), np.where(whole, p, 0.0)
        for k in (1, 0, -1):
            if not (x := w[k + 1]):
                continue
            of, to = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
            right[to] += x * p[of] * mean[of]
            for d in range(2 - k):
                if y := w[k + d + 1]:
                    bands[to, d] += x * y * p[of]
    return bands, right


def solve_banded(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a symmetric system of half bandwidth 3 by LDL factors and two substitutions; further axes are systems side by side."""
    n, width = bands.shape[:2]
    d, lower = np.zeros_like(right, float), np.zeros_like(bands)
    for i in range(n):
        d[i] = bands[i, 0] - sum(lower[i, k] ** 2 * d[i - k] for k in range(1, min(i, width - 1) + 1))
        for k in range(1, min(n - 1 - i, width - 1) + 1):
            j = i + k
            other = sum(lower[j, k + m] * lower[i, m] * d[i - m] for m in range(1, min(i, width - 1 - k) + 1))
            lower[j, k] = (bands[i, k] - other) / d[i]
    x = right.astype(float).copy()
    for i in range(n):
        x[i] -= sum(lower[i, k] * x[i - k] for k in range(1, min(i, width - 1) + 1))
    x /= d
    for i in range(n - 1, -1, -1):
        x[i] -= sum(lower[i + k, k] * x[i + k] for k in range(1, min(n - 1 - i, width - 1) + 1))
    return x


def trajectory(means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """The likeliest static values given means and variances of values and differences, each (windows, T)."""
    return solve_banded(*banded_normal(means, 1.0 / np.maximum(variances, 1e-10)))


def banded_times(bands: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A symmetric banded matrix times x; further axes are products side by side."""
    out = bands[:, 0] * x
    for k in range(1, bands.shape[1]):
        out[:-k] += bands[:-k, k] * x[k:]
        out[k:] += bands[:-k, k] * x[:-k]
    return out


def spread_variance(c: np.ndarray, means: np.ndarray, variances: np.ndarray, gv_mean: float, gv_var: float, rounds: int = 100, step: float = 0.1, on: np.ndarray | None = None) -> np.ndarray:
    """Ascend the likelihood of a trajectory together with that of its variance over the utterance.

    The start is stretched to the wanted variance; a step that gains makes the next 1.2 times as long, another half. Only
    frames that are `on` count for the variance, are stretched and are drawn to it; all are, if it isn't given.
    """
    on = np.ones(len(c), bool) if on is None else on
    bands, right = banded_normal(means, 1.0 / np.maximum(variances, 1e-10))
    aims = (np.array([v], float) for v in (gv_mean, gv_var))
    return spread_beside(c[:, None], bands[:, :, None], right[:, None], np.array([len(c)]), *aims, on[:, None], rounds, step)[:, 0]


def spread_beside(c: np.ndarray, bands: np.ndarray, right: np.ndarray, lengths: np.ndarray, gv_mean: np.ndarray, gv_var: np.ndarray, on: np.ndarray, rounds: int = 100, step: float = 0.1) -> np.ndarray:
    """spread_variance of utterances side by side (T, utterances), with the equations that banded_normal gives; frames past an utterance's length are zero and not on.

    Each has its own steps, and one that has come to its end is left out of further rounds.
    """
    held, out = on.sum(0), c.copy()

    def moments(x: np.ndarray, on: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.where(on, x, 0.0).sum(0) / held
        return mean, (np.where(on, x - mean, 0.0) ** 2).sum(0) / held

    def objective(x: np.ndarray, var: np.ndarray) -> np.ndarray:
        """The likelihood, but for constants, of trajectories and of the variances of their frames that are on."""
        return ((right * x).sum(0) - 0.5 * (x * banded_times(bands, x)).sum(0)) / size - 0.5 * (var - gv_mean) ** 2 / gv_var

    mean, var = moments(c, on, np.maximum(held, 1))
    going = np.flatnonzero((held >= 2) & (var > 0) & (gv_mean > 0) & (gv_var > 0))
    size, steps = lengths * float(len(WINDOWS)), np.full(len(held), step)
    mean, var, x = mean[going], var[going], c[:, going]
    bands, right, size, gv_mean, gv_var, on, held, steps = (v[..., going] for v in (bands, right, size, gv_mean, gv_var, on, held, steps))
    x = np.where(on, (x - mean) * np.sqrt(gv_mean / var) + mean, x)
    mean, var = moments(x, on, held)
    best = objective(x, var)
    for _ in range(rounds):
        if not len(going):
            break
        slope = (right - banded_times(bands, x)) / size - np.where(on, (var - gv_mean) / gv_var * 2 * (x - mean) / held, 0.0)
        curve = np.maximum(np.abs(bands[:, 0]) / size + np.where(on, 2 * np.abs(var - gv_mean) / gv_var / held + 4 * ((x - mean) / held) ** 2 / gv_var, 0.0), 1e-12)
        tried = x + steps * slope / curve
        tried_mean, tried_var = moments(tried, on, held)
        now = objective(tried, tried_var)
        gains = now > best
        done = gains & (now - best < 1e-9 * np.abs(best))
        x, mean, var, best = (np.where(gains, a, b) for a, b in ((tried, x), (tried_mean, mean), (tried_var, var), (now, best)))
        steps = steps * np.where(gains, 1.2, 0.5)
        if done.any():
            out[:, going[done]] = x[:, done]
            x, mean, var, best, bands, right, size, gv_mean, gv_var, on, held, steps, going = (v[..., ~done] for v in (x, mean, var, best, bands, right, size, gv_mean, gv_var, on, held, steps, going))
    out[:, going] = x
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], first: str, most: int = 65_536) -> Iterator[pa.Table]:
    """Tables of at least `most` rows, but the last, cut only before rows that are the `first` of a group."""
    held, n = [], 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False))
        if len(starts) and n + starts[-1] >= most:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            batch, held, n = batch.slice(starts[-1]), [], 0
        held.append(batch)
        n += len(batch)
    if n:
        yield pa.Table.from_batches(held)


def trajectories(means: np.ndarray, variances: np.ndarray, starts: np.ndarray, lengths: np.ndarray, aims: tuple[np.ndarray, np.ndarray] | None = None, on: np.ndarray | None = None, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Trajectories of utterances that lie one after the other, plain and, with `aims` (their variances' means and variances), spread.

    means, variances: (windows, rows). Utterances of similar lengths are solved side by side, about `most` rows at a time.
    """
    plain, order, done = np.zeros(means.shape[1]), np.argsort(-lengths, kind="stable"), 0
    order = order[lengths[order] > 0]
    spread = plain if aims is None else np.zeros_like(plain)
    while done < len(order):
        of = order[done : done + max(1, most // int(lengths[order[done]]))]
        done += len(of)
        frame = np.arange(lengths[of[0]])[:, None]
        there = frame < lengths[of]
        row = np.where(there, starts[of] + frame, 0)
        bands, right = banded_normal(np.where(there, means[:, row], 0.0), np.where(there, 1.0 / np.maximum(variances[:, row], 1e-10), 0.0), lengths[of])
        bands[:, 0][~there] = 1.0
        x = solve_banded(bands, right)
        plain[row[there]] = x[there]
        if aims is not None:
            bands[:, 0][~there] = 0.0
            taken = there if on is None else there & on[row]
            spread[row[there]] = spread_beside(x, bands, right, lengths[of], aims[0][of], aims[1][of], taken)[there]
    return plain, spread


def generate(df: DataFrame, utterance: str, position: str, mean: str, var: str, voiced: str | None = None, spread: tuple[str, str] | None = None, on: str | None = None, plain: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """utterance, position, value: trajectories from rows that hold arrays of three means and variances (value, differences).

    With `voiced`, the voiced rows are generated by themselves and other rows have value 0; an utterance without a voiced
    row is all zeros. With `spread`, columns of the mean and variance that the utterance's total variance has, the
    trajectory is spread to it (see spread_variance): the columns are a stream's, alike in all rows of an utterance, and
    `on` says which rows take part. `plain` names a column for the trajectory before that; columns to `keep` are passed on.

    Rows come in order, as numbers, and many utterances are solved side by side; one is held whole, but no more than it and
    about 65,536 rows.
    """
    w = Window.partitionBy(utterance).orderBy(position)
    kept = [utterance, position, *keep]
    numbers = {f"_m{k}": F.col(mean)[k].cast("double") for k in range(3)} | {f"_v{k}": F.col(var)[k].cast("double") for k in range(3)} | {f"_a{k}": F.col(x).cast("double") for k, x in enumerate(spread or ())}
    flags = {"_ok": F.col(voiced) if voiced else F.lit(True), "_on": F.col(on) if on else F.lit(True)}
    rows = df.select(*kept, *(x.alias(c) for c, x in numbers.items()), *(F.coalesce(x, F.lit(False)).alias(c) for c, x in flags.items())).withColumn("_first", F.row_number().over(w) == 1)
    taken = [*numbers, "_ok", "_on", "_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_groups(batches, "_first"):
            of = {c: found.column(c).to_numpy() for c in taken}
            group, ok = np.cumsum(of["_first"]) - 1, of["_ok"]
            lengths = np.bincount(group[ok], minlength=group[-1] + 1)
            means, variances = (np.stack([of[f"_{x}{k}"][ok] for k in range(3)]) for x in "mv")
            aims = tuple(of[f"_a{k}"][of["_first"]] for k in range(2)) if spread else None
            values = {c: np.zeros(len(ok)) for c in ("plain", "value")}
            values["plain"][ok], values["value"][ok] = trajectories(means, variances, np.cumsum(lengths) - lengths, lengths, aims, of["_on"][ok])
            made = [pa.array(values["value"]), *([pa.array(values["plain"])] if plain else [])]
            yield from pa.Table.from_arrays([*(found.column(c) for c in kept), *made], names=[*kept, "value", *([plain] if plain else [])]).to_batches()

    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "value double", *([f"`{plain}` double"] if plain else [])]))


def safe_states(state: Column, last: int) -> Column:
    """A state number, at most the last one that a model has."""
    return F.least(state, F.lit(last))
