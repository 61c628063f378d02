"""From labels to audio: streams of densities, frames, trajectories, samples, files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.predicates import is_punct
from weftline.functions.signal import vocode
from weftline.functions.text import syllables
from weftline.operators.acoustic import TreeFile, answers_at, asked_patterns, expand_states, leaf_column, parse_trees, safe_states, spread_variance, state_frames, trajectory, voiced_pitch
from weftline.operators.acoustic import asked as asked_of
from weftline.operators.labels import full_labels
from weftline.operators.tokenize import repeat_rows, tokens
from weftline.sources.audio import render_wave


#: Streams of a whole voice: durations, pitch, spectrum, aperiodicity, and the total variances of the last three.
STREAMS = ("dur", "lf0", "mgc", "bap", "gv-lf0", "gv-mgc", "gv-bap")


def state_parameters(labels: DataFrame, keys: list[str], trees: dict[str, TreeFile], densities: DataFrame, states: int, first: int = 2, voicing: float = 0.5, switch: TreeFile | None = None, on: str = "gv-switch_2") -> DataFrame:
    """keys, label, state and, for every stream, <stream>_mean, <stream>_var and <stream>_weight (a - in its name is _); frames, voiced and spread.

    labels has keys, which tell its rows apart, and label. Each stream is looked up by a join on its own state and leaf with
    densities that are broadcast, and each question is asked once for a label: they are a voice's, and don't grow with the labels, which stay where they are. frames come from `dur`: the state's own mean where the leaf has one for each state, else
    its first, rounded half up. Where the weight of `lf0` is below `voicing` a row is unvoiced and its first pitch mean
    is 0. spread is whether the label's leaf in the `switch` tree is `on`; without a tree it is true.
    """
    patterns = asked_patterns(*trees.values(), *([switch] if switch else []))
    answers = answers_at("_answers", patterns)
    spread = leaf_column(F.col("label"), F.lit(min(switch.states)), switch, answers) == on if switch else F.lit(True)
    rows = expand_states(labels.select(*keys, "label", asked_of(F.col("label"), patterns).alias("_answers")), states, first).withColumn("spread", spread)
    of = {stream: stream.replace("-", "_") for stream in trees}
    asked = {f"_{name}": F.struct(safe_states(F.col("state"), max(trees[stream].states)).cast("int").alias("state"), leaf_column(F.col("label"), F.col("state"), trees[stream], answers).alias("leaf")) for stream, name in of.items()}
    found = rows.select(*keys, "label", "state", "spread", *(column.alias(at) for at, column in asked.items()))
    for stream, name in of.items():
        held = densities.filter(F.col("stream") == stream).groupBy(F.col("state").alias("_state"), F.col("leaf").alias("_leaf")).agg(F.max(F.struct("mean", "var", "weight")).alias(name))
        found = found.join(F.broadcast(held), (F.col(f"_{name}.state") == F.col("_state")) & (F.col(f"_{name}.leaf") == F.col("_leaf")), "left").drop("_state", "_leaf")
    out = found.select(*keys, "label", "state", "spread", *(F.col(name)[part].alias(f"{name}_{part}") for name in of.values() for part in ("mean", "var", "weight")))
    frames = F.greatest(state_frames(F.coalesce(F.get("dur_mean", F.col("state") - first), F.get("dur_mean", 0))), F.lit(1))
    voiced = voiced_pitch(F.lit(1.0), F.coalesce("lf0_weight", F.lit(0.0)), voicing) > 0
    return out.withColumns({"frames": frames, "voiced": voiced}).withColumn("lf0_mean", F.transform("lf0_mean", lambda x, i: F.when((i == 0) & ~F.col("voiced"), 0.0).otherwise(x)))


def smooth(rows: pd.DataFrame, stream: str, ok: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The trajectories (frames, dimensions) of a stream over rows of frames, from its means and variances of values and differences, spread to its total variance where it has one."""
    means, variances = (np.array(rows[f"{stream}_{part}"].tolist(), float)[ok].reshape(int(ok.sum()), 3, -1) for part in ("mean", "var"))
    out = np.zeros((len(rows), means.shape[2]))
    gv = f"gv_{stream}_mean"
    for d in range(means.shape[2] if ok.any() else 0):
        m, v = means[:, :, d].T, variances[:, :, d].T
        x = trajectory(m, v)
        if gv in rows and rows[gv].iloc[0] is not None:
            x = spread_variance(x, m, v, float(rows[gv].iloc[0][d]), float(rows[gv.replace("_mean", "_var")].iloc[0][d]), on=on[ok])
        out[ok, d] = x
    return out


def waves(parameters: DataFrame, utterance: list[str], order: list[str], rate: int = 8000, alpha: float = 0.42) -> DataFrame:
    """utterance, samples, wave: each utterance's states spread over frames, smoothed and synthesised; bytes are a 16-bit file.

    An utterance is one group; it is a sentence, so its length is bounded by what is said in one.
    """
    streams = [c for c in parameters.columns if c.endswith(("_mean", "_var")) and c.removeprefix("gv_").startswith(("mgc", "lf0"))]
    framed = repeat_rows(parameters.select(*utterance, *order, "frames", "voiced", "spread", *streams), F.col("frames"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "step"])
        voiced, on = rows["voiced"].to_numpy(bool), rows["spread"].to_numpy(bool)
        spectra = smooth(rows, "mgc", np.ones(len(rows), bool), on)
        pitch = smooth(rows, "lf0", voiced, on)[:, 0] if voiced.any() else np.zeros(len(rows))
        x = vocode(spectra, np.where(voiced, np.exp(pitch), 0.0), rate, alpha)
        x = x / max(1e-9, np.abs(x).max()) * 0.9 if len(x) else x
        return pd.DataFrame({**{u: [rows[u].iloc[0]] for u in utterance}, "samples": [len(x)], "wave": [render_wave(x, rate)]})

    kinds = dict(framed.dtypes)
    return framed.groupBy(*utterance).applyInPandas(run, ", ".join([*(f"{u} {kinds[u]}" for u in utterance), "samples long, wave binary"]))


#: Questions on labels that a voice's trees ask.
QUESTIONS = """
QS vowel { "*-a+*","*-e+*","*-i+*","*-o+*","*-u+*" }
QS stressed { "/STRESS:1" }
QS pause { "-pau+","-sp+" }
"""
#: Voices by name: trees for each stream, densities (stream, state, leaf, mean, var, weight) and the tree of the variance switch. Means and variances
#: are of values, first and second differences, one after the other; those of durations are one for each state. The voice here is small and made by hand.
VOICES = {
    "small": (
        {
            "dur": '{*}[2]\n{\n 0 vowel -1 "d_vowel"\n -1 pause "d_other" "d_pause"\n}\n',
            "lf0": '{*}[2]\n{\n 0 vowel "p_other" "p_vowel"\n}\n{*}[3]\n{\n 0 stressed "p_other" "p_stressed"\n}\n',
            "mgc": '{*}[2]\n{\n 0 vowel -1 "m_vowel"\n -1 pause "m_other" "m_pause"\n}\n',
            "bap": '{*}[2]\n{\n 0 pause "b_sound" "b_pause"\n}\n',
            "gv-lf0": '{*}[2]\n"v_lf0"\n',
            "gv-mgc": '{*}[2]\n"v_mgc"\n',
            "gv-bap": '{*}[2]\n"v_bap"\n',
        },
        [
            *(("dur", 2, leaf, [float(n), float(n - 1)], [1.0, 1.0], None) for leaf, n in (("d_vowel", 6), ("d_other", 4), ("d_pause", 8))),
            *(("lf0", state, leaf, [x, slope, 0.0], [0.1, 0.05, 0.05], w) for state, leaf, x, slope, w in ((2, "p_vowel", 4.8, 0.01, 0.9), (2, "p_other", 4.6, 0.0, 0.2), (3, "p_stressed", 5.0, 0.0, 0.9), (3, "p_other", 4.7, -0.01, 0.7))),
            *(("mgc", 2, leaf, [*x, *slope, 0.0, 0.0, 0.0, 0.0], [0.1] * 4 + [0.05] * 8, None) for leaf, x, slope in (("m_vowel", [1.2, 0.6, -0.3, 0.1], [0.02, 0.0, 0.0, 0.0]), ("m_other", [0.4, -0.2, 0.2, 0.05], [-0.02, 0.0, 0.0, 0.0]), ("m_pause", [-4.0, 0.0, 0.0, 0.0], [0.0] * 4))),
            *(("bap", 2, leaf, [x, 0.0, 0.0], [0.2, 0.1, 0.1], None) for leaf, x in (("b_sound", -3.0), ("b_pause", 0.0))),
            ("gv-lf0", 2, "v_lf0", [0.03], [0.001], None), ("gv-mgc", 2, "v_mgc", [1.5, 0.1, 0.05, 0.002], [0.1, 0.01, 0.01, 0.001], None), ("gv-bap", 2, "v_bap", [1.0], [0.1], None),
        ],
        '{*}[2]\n{\n 0 pause "gv-switch_2" "gv-switch_1"\n}\n',
    )
}
LANGUAGES, CODERS = ("en",), ("mlsa",)


def spelled(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos, word, syllables, stress, phones of texts by the vowel rule: letters are phones, first syllables are stressed."""
    cut = tokens(docs).select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "word")
    cut = cut.withColumn("syllables", F.when(is_punct(F.col("word")), F.array("word")).otherwise(F.transform(syllables(F.col("word")), F.lower)))
    stress = F.transform("syllables", lambda s, i: (i == 0).cast("int"))
    return cut.withColumns({"stress": stress, "phones": F.transform("syllables", lambda s: F.filter(F.split(s, ""), lambda c: c.rlike(r"\p{L}")))})


def speak(docs: DataFrame, language: str = "en", coder: str = "mlsa", voice: str = "small", rate: int = 4000) -> DataFrame:
    """doc_id, sent_id, samples, wave: each line of docs (doc_id, text) as audio. An unknown language, coder or voice is refused."""
    for name, value, known in (("language", language, LANGUAGES), ("coder", coder, CODERS), ("voice", voice, VOICES)):
        if value not in known:
            raise ValueError(f"unknown {name} {value!r}; there are {', '.join(known)}")
    parameters = voice_parameters(full_labels(spelled(docs)), ["doc_id", "sent_id", "phone_no"], voice)
    return waves(parameters, ["doc_id", "sent_id"], ["phone_no", "state"], rate)


def voice_parameters(labels: DataFrame, keys: list[str], voice: str = "small", states: int = 2) -> DataFrame:
    """state_parameters of labels by one of VOICES."""
    trees, densities, switch = VOICES[voice]
    held = labels.sparkSession.createDataFrame(densities, "stream string, state int, leaf string, mean array<double>, var array<double>, weight double")
    return state_parameters(labels, keys, {k: parse_trees(QUESTIONS + v) for k, v in trees.items()}, held, states, switch=parse_trees(QUESTIONS + switch))
