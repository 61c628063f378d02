"""Signal, letter and merging functions over the tables, each against a closed form in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog.models import grown_sql, sound_tree
from weftline.catalog.numeric import _per_user
from weftline.catalog.registry import query, stored, table
from weftline.catalog.text import WORDS_SQL, split_tokens
from weftline.functions import signal as s
from weftline.operators import counts as k
from weftline.operators import tagging as tg
from weftline.operators import tree as tr
from weftline.operators.alignment import merge_reference
from weftline.operators.dealing import spread

def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded half up, as SQL rounds."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


#: CTE ux: each user's values in order.
UX_SQL = "ux AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS x FROM events GROUP BY user_id)"


@query("SELECT vec_id, i AS row, round(CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 3] AS DOUBLE) * 10 + CAST(embedding[i + 5] AS DOUBLE) * 100, 6) AS value FROM embeddings, (VALUES (0), (1)) r(i)")
def transposed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the transpose of each vector's first six elements, taken as three pairs."""
    x = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(F.get(x, 2 * i), F.get(x, 2 * i + 1)))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(s.transpose(pairs)).alias("row", "r"))
    return rows.select("vec_id", "row", F.round(F.get("r", 0) + F.get("r", 1) * 10 + F.get("r", 2) * 100, 6).alias("value"))


MATRIX_SQL = "m AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS a, p_retailprice AS b, p_size + 2.0::DOUBLE AS d FROM part)"


@query(f"WITH {MATRIX_SQL} SELECT p_partkey, round(d / (a * d + b), 9) AS m11, round(-b / (a * d + b), 9) AS m12, round(1 / (a * d + b), 9) AS m21, round(a / (a * d + b), 9) AS m22 FROM m")
def inverted_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Inverses of [[size + 1, price], [-1, size + 2]]."""

    @F.pandas_udf("m11 double, m12 double, m21 double, m22 double")
    def invert(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.DataFrame:
        found = [s.solve_inverse(np.array([[x, y], [-1.0, z]])).reshape(-1).tolist() for x, y, z in zip(a, b, d, strict=True)]
        return pd.DataFrame(found, columns=["m11", "m12", "m21", "m22"])

    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 1.0).alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_size") + 2.0).alias("d"))
    return rows.select("p_partkey", invert("a", "b", "d").alias("m")).select("p_partkey", "m.*").transform(rounded, 9, "m11", "m12", "m21", "m22")


@query(f"WITH {MATRIX_SQL} SELECT p_partkey, round(a * a - b, 6) AS m11, round(a * b + b * d, 6) AS m12, round(-a - d, 6) AS m21, round(d * d - b, 6) AS m22 FROM m")
def squared_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Those matrices times themselves."""
    m = F.array(F.array(F.col("p_size") + 1.0, F.col("p_retailprice")), F.array(F.lit(-1.0), F.col("p_size") + 2.0))
    rows = table(spark, sf, "part").select("p_partkey", s.matrix_product(m, m).alias("m"))
    return rows.select("p_partkey", *(F.round(F.get(F.get("m", i), j), 6).alias(f"m{i + 1}{j + 1}") for i in (0, 1) for j in (0, 1)))


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] * e[3], 9) AS p0, round(e[1] * e[4] + e[2] * e[3], 9) AS p1, round(e[2] * e[4], 9) AS p2 FROM e")
def polynomial_products(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's first two elements as a polynomial times its next two."""

    @F.pandas_udf("p0 double, p1 double, p2 double")
    def multiply(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([s.multiply_polynomials(np.array(x[:2], float), np.array(x[2:4], float)) for x in col], columns=["p0", "p1", "p2"])

    return table(spark, sf, "embeddings").select("vec_id", multiply(F.slice("embedding", 1, 4)).alias("p")).select("vec_id", "p.*").transform(rounded, 9, "p0", "p1", "p2")


@query("""
    WITH c AS (SELECT event_id, (event_id % 89 + 5) / 100.0::DOUBLE AS cut FROM events), w AS (SELECT event_id, cut, 2 * tan(pi() * cut / 2) AS w FROM c), z AS (SELECT event_id, cut, (2 - w) / (2 + w) AS z FROM w)
    SELECT event_id, cut, round((1 - z) / 2, 9) AS low_b, round(-z, 9) AS a1, round((1 + z) / 2, 9) AS high_b FROM z
""")
def filter_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of every event's first-order low- and high-pass filters, at a cut-off of its own (a share of the Nyquist frequency)."""

    @F.pandas_udf("low_b double, a1 double, high_b double")
    def design(cuts: pd.Series) -> pd.DataFrame:
        known = {}
        for cut in cuts.unique():
            (b, a), (high, _) = s.butterworth(1, cut), s.butterworth(1, cut, high=True)
            known[cut] = float(b[0]), float(a[1]), float(high[0])
        return pd.DataFrame([known[cut] for cut in cuts], columns=["low_b", "a1", "high_b"])

    cuts = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 89 + 5) / 100.0).alias("cut"))
    return cuts.withColumn("f", design("cut")).select("event_id", "cut", "f.*").transform(rounded, 9, "low_b", "a1", "high_b")


@query(f"""
    WITH {UX_SQL} SELECT user_id, round(list_sum(list_transform(range(len(x)), lambda i: x[i + 1] * pow(0.5, len(x) - i))), 6) AS smoothed, round(list_sum(x[greatest(len(x) - 2, 1):len(x)]), 6) AS last_three, round(list_sum(list_transform(x, lambda v: v * v)), 4) AS power,
      x[CASE WHEN len(x) >= 2 THEN len(x) - 1 ELSE 1 END] AS rolled, x[1 + (len(x) - len(x) // 2) % len(x)] AS centred FROM ux
""")
def filtered_values(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of a recursive filter and of a sum over three values, the power, and the first after two kinds of rotation."""

    def fn(x: np.ndarray) -> dict:
        smoothed, summed = s.recursive_filter([0.5], [1.0, -0.5], x), s.fir_by_transform(np.ones(3), x)
        return {"smoothed": [float(smoothed[-1])], "last_three": [float(summed[-1])], "power": [s.mean_power(x) * len(x)], "rolled": [float(s.circular_shift(x, 2)[0])], "centred": [float(s.centre_zero(x)[0])]}

    return _per_user(spark, sf, fn, "user_id long, smoothed double, last_three double, power double, rolled double, centred double").transform(rounded, 6, "smoothed", "last_three").transform(rounded, 4, "power")


@query(f"WITH {UX_SQL} SELECT user_id, unnest(range(len(x))) AS k, round((x[unnest(range(len(x))) + 1] + x[unnest(range(len(x))) + 2]) / 2, 6) AS value FROM ux")
def interpolated_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values half-way between each user's values; null beyond the last."""

    def fn(x: np.ndarray) -> dict:
        at = np.arange(len(x))
        found = s.interpolate(at, x, at + 0.5)
        return {"k": at, "value": [None if np.isnan(v) else float(v) for v in found]}

    return _per_user(spark, sf, fn, "user_id long, k long, value double").transform(rounded, 6, "value")


@query(f"WITH {UX_SQL} SELECT user_id, round(list_sum(list_transform(x, lambda v: -1 + 3 / (1 + exp(-v / 100)))), 6) AS scaled, round(cos(2 * pi() * 0.25 / len(x)), 9) AS phase FROM ux WHERE len(x) > 2")
def rescaled_values(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of each user's values through a logistic curve, and the phase that delays their second frequency by a quarter of a sample."""

    def fn(x: np.ndarray) -> dict:
        if len(x) < 3:
            return {"scaled": [], "phase": []}
        return {"scaled": [float(s.sigmoid_scale(x / 100, -1.0, 2.0).sum())], "phase": [float(s.fractional_shift_phase(len(x), 0.25)[1].real)]}

    return _per_user(spark, sf, fn, "user_id long, scaled double, phase double").transform(rounded, 6, "scaled").transform(rounded, 9, "phase")


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)
    SELECT vec_id, round(e[1] - 0.4 * e[2] + 0.16 * e[3], 9) AS b0, round(e[2] - 0.4 * e[3], 9) AS b1, round(e[1], 9) AS back, round(e[1] + 0.4 * e[2] + 0.16 * e[3], 9) AS warped, round(exp(e[1]), 9) AS h0, round(e[2] * exp(e[1]), 9) AS h1,
      round((e[2] * e[2] + 2 * e[3]) * exp(e[1]) / 2, 9) AS h2, round(exp(e[1]), 6) AS amplitude, round(pow(1 - 0.5 * e[1], -2), 9) AS gain, round(e[2] / (1 - 0.5 * e[1]), 9) AS normal FROM e
""")
def cepstra(spark: SparkSession, sf: str) -> DataFrame:
    """Of each vector's first three elements as a cepstrum: filter coefficients and back, warp, impulse response, spectrum of the first alone, gain."""
    names = ["b0", "b1", "back", "warped", "h0", "h1", "h2", "amplitude", "gain", "normal"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(col: pd.Series) -> pd.DataFrame:
        out = []
        for x in col:
            c = np.array(x, float)
            b, h, g = s.to_filter(c, 0.4), s.impulse_response(c, 3), s.gain_normalise(c, -0.5)
            out.append([float(v) for v in (b[0], b[1], s.from_filter(b, 0.4)[0], s.warp_frequency(c, 0, 0.4)[0], *h, s.spectrum(c[:1], 0.55, 8).mean(), g[0], g[1])])
        return pd.DataFrame(out, columns=names)

    return table(spark, sf, "embeddings").select("vec_id", run(F.slice("embedding", 1, 3)).alias("c")).select("vec_id", "c.*").transform(rounded, 9, *(n for n in names if n != "amplitude")).transform(rounded, 6, "amplitude")


@query(f"""
    WITH {UX_SQL} SELECT user_id, CASE WHEN len(x) >= 6 THEN round(x[2] + (x[6] - x[2]) / 4, 6) END AS joint, round(list_sum(x) + 10 * CASE WHEN len(x) = 1 THEN 0.5 ELSE len(x) - 1 END, 6) AS spliced FROM ux
""")
def joined_units(spark: SparkSession, sf: str) -> DataFrame:
    """A value next to a joint after smoothing, and the sum of samples with others, greater by 10, faded in over them."""

    def fn(x: np.ndarray) -> dict:
        joint = float(s.smooth_joint(x, 3)[2]) if len(x) >= 6 else None
        return {"joint": [joint], "spliced": [float(s.splice(x, x + 10, 0, per_frame=2).sum())]}

    return _per_user(spark, sf, fn, "user_id long, joint double, spliced double").transform(rounded, 6, "joint", "spliced")


def _pass_sql(name: str, source: str) -> str:
    """CTE: one pass of smoothing over the lists of `source`, from left to right, each value beside the one just made."""
    step = "list_append(acc, CASE WHEN acc[len(acc)] <> 0 AND x[CAST(i[1] AS INT)] <> 0 AND x[CAST(i[1] AS INT) + 1] <> 0 THEN (acc[len(acc)] + x[CAST(i[1] AS INT)] + x[CAST(i[1] AS INT) + 1]) / 3 ELSE x[CAST(i[1] AS INT)] END)"
    return f"{name} AS (SELECT user_id, CASE WHEN len(x) < 3 THEN x ELSE list_append(list_reduce(list_prepend([x[1]], list_transform(range(2, len(x)), lambda i: [CAST(i AS DOUBLE)])), lambda acc, i: {step}), x[len(x)]) END AS x FROM {source})"


@query(f"""
    WITH v AS (SELECT user_id, list(CASE WHEN value < 50 THEN 0.0 ELSE CAST(value AS DOUBLE) END ORDER BY event_id) AS x FROM events GROUP BY user_id), {_pass_sql("a", "v")}, {_pass_sql("b", "a")}, {_pass_sql("c", "b")}
    SELECT user_id, generate_subscripts(x, 1) - 1 AS i, round(unnest(x), 6) AS value FROM c
""")
def smoothed_pitches(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's values, those below 50 as 0, smoothed three times in place."""
    return _per_user(spark, sf, lambda x: {"i": np.arange(len(x)), "value": s.smooth_voiced(np.where(x < 50, 0.0, x))}, "user_id long, i long, value double").transform(rounded, 6, "value")


@query("SELECT event_id, CASE WHEN value / 500 >= 0.5 THEN 2 WHEN value / 500 >= 0.25 THEN 1 ELSE 0 END AS picked FROM events")
def picked_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Draws from shares of a quarter, a quarter and a half, at a value of 500 for 1."""
    shares = F.array(F.lit(0.25), F.lit(0.25), F.lit(0.5))
    return table(spark, sf, "events").select("event_id", s.pick(shares, F.col("value") / 500).alias("picked"))


@query("SELECT event_type, CAST(sum(event_id % 5) AS BIGINT) AS frames, CAST(coalesce(sum(CASE WHEN value > 50 THEN event_id % 5 END), 0) AS BIGINT) AS voiced_frames FROM events GROUP BY event_type")
def frame_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All frames and those of voiced states, by type."""
    frames, voiced = k.frame_counts(F.col("event_id") % 5, F.col("value") > 50)
    return table(spark, sf, "events").groupBy("event_type").agg(frames, voiced)


@query("SELECT round(-sum(ln(least(value / 500, 1.0))), 6) AS loss FROM events WHERE value > 0")
def log_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Negative log-likelihood of values as probabilities of 500."""
    return k.log_loss(table(spark, sf, "events").filter("value > 0"), F.least(F.col("value") / 500, F.lit(1.0))).select(F.round("loss", 6).alias("loss"))


@query("""
    WITH w AS (SELECT n_nationkey, lower(n_name) AS n, lower(r_name) AS r FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT n_nationkey, r || ':' || array_to_string(string_split(r, ''), ' ') || '|~:pau|' || n || ':' || array_to_string(string_split(n, ''), ' ') || '|end:' AS merged FROM w
""")
def merged_references(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a region, a nation and one more against a reference that has a pause between them and lacks the last."""

    @F.pandas_udf("string")
    def merge(region: pd.Series, nation: pd.Series) -> pd.Series:
        out = []
        for r, n in zip(region, nation, strict=True):
            found = merge_reference([r, n, "end"], [*((r, c) for c in r), ("", "pau"), *((n, c) for c in n)])
            out.append("|".join(f"{'~' if w is None else w}:{p}" for w, p in found))
        return pd.Series(out)

    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("n_nationkey", merge(F.lower("r_name"), F.lower("n_name")).alias("merged"))


#: Line spectra of two frequencies: a gain and two angles by part.
LSP_SQL = "lp AS (SELECT p_partkey, 1 + p_size / 10.0::DOUBLE AS gain, 0.3 + (p_partkey % 97) / 100.0::DOUBLE AS w1, 1.5 + (p_partkey % 89) / 80.0::DOUBLE AS w2 FROM part)"


def line_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, lsp: a gain and two frequencies."""
    angle = lambda low, mod, by: F.lit(low) + (F.col("p_partkey") % mod) / F.lit(by)
    return table(spark, sf, "part").select("p_partkey", F.array(1 + F.col("p_size") / F.lit(10.0), angle(0.3, 97, 100.0), angle(1.5, 89, 80.0)).alias("lsp"))


def by_stages(fn: Callable[[np.ndarray, int], np.ndarray]) -> Callable[..., Column]:
    """A function of line spectra and stages: fn(spectra side by side, stages), for all rows of a batch with as many stages at once."""

    @F.pandas_udf("array<double>")
    def run(lsp: pd.Series, stages: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(lsp), dtype=object)
        for n in stages.unique():
            at = np.flatnonzero(stages == n)
            out.iloc[at] = list(fn(np.stack([lsp.iat[i] for i in at], 1), int(n)).T)
        return out

    return run


@query(f"""
    WITH {LSP_SQL}, st AS (SELECT *, n, -1.0 / n AS g, [-cos(w1) - cos(w2), 1 - cos(w1) + cos(w2)] AS a FROM lp, (VALUES (1), (2), (3)) s(n))
    SELECT p_partkey, CAST(n AS INT) AS stages, round((pow(gain, g) - 1) / g, 9) AS c0, round(pow(gain, g) * a[1] / g, 9) AS c1, round(pow(gain, g) * a[2] / g, 9) AS c2 FROM st
""")
def line_spectrum_cepstra(spark: SparkSession, sf: str) -> DataFrame:
    """Mel-generalised cepstra of every part's line spectrum, for filters of one, two and three stages; those of a batch are made side by side."""
    rows = line_spectra(spark, sf).transform(spread, "p_partkey").select("p_partkey", "lsp", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("stages"))
    made = by_stages(lambda lsp, n: s.line_spectrum_to_cepstrum(lsp, n, 0.0))
    return rows.withColumn("c", made("lsp", "stages")).select("p_partkey", "stages", *(F.round(F.col("c")[i], 9).alias(f"c{i}") for i in range(3)))


@query(f"""
    WITH {LSP_SQL}, st AS (SELECT *, n, [-cos(w1) - cos(w2), 1 - cos(w1) + cos(w2)] AS a FROM lp, (VALUES (1), (2)) s(n)),
    h1 AS (SELECT p_partkey, n, gain, a, list_reduce(list_prepend([0.0::DOUBLE, 1.0], list_transform(range(7), lambda i: [CAST(i AS DOUBLE)])), lambda acc, i: list_append(acc, -a[1] * acc[-1] - a[2] * acc[-2])) AS h FROM st),
    h2 AS (SELECT p_partkey, n, gain, CASE n WHEN 1 THEN h[2:] ELSE list_transform(range(8), lambda k: list_sum(list_transform(range(k + 1), lambda i: h[i + 2] * h[k - i + 2]))) END AS h FROM h1)
    SELECT p_partkey, CAST(n AS INT) AS stages, unnest(range(8)) AS sample, round(gain * h[unnest(range(8)) + 1], 6) AS value FROM h2
""")
def staged_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Impulse responses of every part's filter, one stage and two behind each other, over frames of three samples; a batch's filters run side by side."""
    rows = line_spectra(spark, sf).transform(spread, "p_partkey").select("p_partkey", "lsp", F.explode(F.array(F.lit(1), F.lit(2))).alias("stages"))
    made = by_stages(lambda lsp, n: s.staged_filter(np.eye(1, 8)[0], np.stack([s.line_spectrum_to_cepstrum(lsp, n)] * 3), 3, n))
    found = rows.select("p_partkey", "stages", F.posexplode(made("lsp", "stages")).alias("sample", "value"))
    return found.select("p_partkey", "stages", F.col("sample").cast("long").alias("sample"), F.round("value", 6).alias("value"))


#: CTE cw: what keeps the first three bins of frames of 8, as weights of a circular convolution, and Hamming weights.
LOW_SQL = "cw AS (SELECT list_transform(range(8), lambda m: (1 + 2 * cos(pi() * m / 4) + 2 * cos(pi() * m / 2)) / 8) AS h, list_transform(range(8), lambda j: 0.54 - 0.46 * cos(2 * pi() * j / 7)) AS w)"


@query(f"""
    WITH {UX_SQL}, {LOW_SQL}, fr AS (SELECT user_id, x, len(x) // 4 AS n, unnest(range(len(x) // 4)) AS i FROM ux),
    wf AS (SELECT user_id, n, i, h, w, list_transform(range(8), lambda j: CASE WHEN 4 * i + j < 8 THEN 0.0 ELSE x[4 * i + j - 7] * w[j + 1] END) AS f FROM fr, cw),
    cv AS (SELECT user_id, n, i, w, list_transform(range(8), lambda k: list_sum(list_transform(range(8), lambda j: h[(k - j + 8) % 8 + 1] * f[j + 1])) * w[k + 1]) AS g FROM wf),
    pt AS (SELECT user_id, n, 4 * i + unnest(range(8)) AS t, unnest(g) AS g, unnest(w) AS w FROM cv)
    SELECT user_id, t - 8 AS sample, round(sum(g) / sum(w * w), 6) + 0.0 AS value FROM pt WHERE t >= 8 GROUP BY user_id, t
""")
def overlap_added(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's values from the spectra of their overlapping frames, phases given and the upper bins silenced."""

    def fn(x: np.ndarray) -> dict:
        spectra = s.stft(x, 8, 4)
        spectra[:, 3:] = 0
        y = s.overlap_add(spectra, 4) if len(spectra) else np.empty(0)
        return {"sample": np.arange(len(y)), "value": np.round(y, 6) + 0.0}

    return _per_user(spark, sf, fn, "user_id long, sample long, value double")


#: Coefficients of a fifth-order rational approximation of exp. Fixed values.
EXP_SQL = "[0.4999391, 0.1107098, 0.01369984, 0.0009564853, 0.00003041721]"


@query(f"""
    WITH cf AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS c0, 0.9 - (p_partkey % 97) / 60.0::DOUBLE AS c1, 0.7 - (p_partkey % 89) / 70.0::DOUBLE AS c2 FROM part),
    ea AS (SELECT p_partkey, c0, unnest([1, 2]) AS no, unnest([c1, c2]) AS c FROM cf), nd AS (SELECT p_partkey, c0, no, list_transform({EXP_SQL}, lambda p, i: p * pow(c, i)) AS u FROM ea),
    sg AS (SELECT *, list_transform(u, lambda v, i: CASE i % 2 WHEN 1 THEN -v ELSE v END) AS d FROM nd),
    hs AS (SELECT p_partkey, c0, no, list_reduce(list_concat([[0.0::DOUBLE, 0, 0, 0, 0]], list_transform(range(12), lambda k: [CAST(CASE WHEN k = 0 THEN 1 ELSE coalesce(u[k], 0) END AS DOUBLE)])),
      lambda acc, x: list_append(acc, x[1] - d[1] * acc[-1] - d[2] * acc[-2] - d[3] * acc[-3] - d[4] * acc[-4] - d[5] * acc[-5]))[6:] AS h FROM sg),
    bo AS (SELECT p_partkey, any_value(c0) AS c0, any_value(h) FILTER (no = 1) AS h1, any_value(h) FILTER (no = 2) AS h2 FROM hs GROUP BY p_partkey)
    SELECT p_partkey, unnest(range(12)) AS sample, round(exp(c0) * unnest(list_transform(range(12), lambda k: list_sum(list_transform(range(k // 2 + 1), lambda j: h2[j + 1] * h1[k - 2 * j + 1])))), 6) + 0.0 AS value FROM bo
""")
def synthesis_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Impulse responses of every part's cepstrum of order 2 through the synthesis filter; a batch's filters run side by side."""

    @F.pandas_udf("array<double>")
    def run(c: pd.Series) -> pd.Series:
        b = np.stack(c.to_list(), 1) if len(c) else np.empty((3, 0))
        filt = s.SynthesisFilter(2, 0.0, b.shape[1:])
        return pd.Series(list(np.stack([filt.step(np.exp(b[0]) if i == 0 else np.zeros(b.shape[1]), b) for i in range(12)], 1)))

    step = lambda low, mod, by: F.lit(low) - (F.col("p_partkey") % mod) / F.lit(by)
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size") / F.lit(50.0), step(0.9, 97, 60.0), step(0.7, 89, 70.0)).alias("c")).transform(spread, "p_partkey")
    found = rows.select("p_partkey", F.posexplode(run("c")).alias("sample", "value"))
    return found.select("p_partkey", F.col("sample").cast("long").alias("sample"), (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _leaf(label: str) -> tr.Node:
    return tr.Node(1, 0, dist=[(label, 1.0)])


def _on_words(words: DataFrame, fn, out: str) -> DataFrame:
    """out: fn(word) of each distinct word."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([fn(w) for w in col])

    return words.select("word").distinct().select("word", run("word").alias(out))


@query(rf"""
    WITH {WORDS_SQL}, d AS (SELECT DISTINCT word FROM wd)
    SELECT word, CASE WHEN length(word) = 1 AND NOT regexp_matches(word, '[\p{{L}}\p{{N}}]') THEN CASE WHEN word = ',' THEN 'sp' ELSE 'pau' END
      ELSE array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN lower(word)[i] = 'c' AND i < length(word) AND lower(word)[i + 1] = 'h' THEN 'X' WHEN lower(word)[i] = 'c' THEN 'k' WHEN lower(word)[i] IN ('a', 'e', 'i', 'o', 'u') THEN 'V' WHEN lower(word)[i] = 'h' AND i > 1 AND lower(word)[i - 1] = 'c' THEN '-' ELSE 'C' END), ' ') END AS phones FROM d
""")
def letter_sounds(spark: SparkSession, sf: str) -> DataFrame:
    """Phones of every distinct token by a tree over letters and the label before: ch is one sound, other c's are k, marks are pauses."""
    tree = sound_tree()
    return _on_words(split_tokens(spark, sf), lambda w: " ".join(tg.letter_to_sound(w, tree)), "phones")


@query(rf"WITH {WORDS_SQL}, d AS (SELECT DISTINCT word FROM wd) SELECT word, replace(replace(word, 'e', ''), 'a', 'o') AS rewritten FROM d")
def rewritten_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct token with its letters kept, dropped (e) or replaced (a by o), as a tree says."""
    tree = tr.Node(1, 0, "c0:e", _leaf("__nil__"), tr.Node(1, 0, "c0:a", _leaf("o"), _leaf("*")))
    return _on_words(split_tokens(spark, sf), lambda w: tg.rewrite_letters(w, tree), "rewritten")


#: Endings and scripts as a list in SQL.
ENDINGS_SQL = ", ".join(f"({i}, '{off}', '{on}', '{tg.script_of(off, on)}')" for i, (off, on) in enumerate(tg.ENDINGS))


@query(rf"""
    WITH {WORDS_SQL}, d AS (SELECT DISTINCT word FROM wd WHERE regexp_full_match(word, '\p{{L}}+')), lo AS (SELECT DISTINCT lower(word) AS low FROM d), en(rule, off, put, script) AS (VALUES {ENDINGS_SQL}),
    kn AS (SELECT a.low, rule, script FROM lo a, en, lo b WHERE ends_with(a.low, off) AND length(a.low) - length(off) >= 3 AND b.low = left(a.low, length(a.low) - length(off)) || put),
    sc AS (SELECT low, coalesce(min_by(script, rule), '0|') AS label FROM lo LEFT JOIN kn USING (low) GROUP BY low),
    lw AS (SELECT word, low, label, list_append(list_transform(range(7), lambda i: 'c' || (i + 1) || ':' || CASE WHEN length(low) > i THEN substr(low, length(low) - i, 1) ELSE '_' END), 'm:' || CASE WHEN regexp_matches(word, '^\p{{Lu}}') THEN 'U' WHEN length(word) <= 3 THEN 'S' ELSE 'W' END) AS feats FROM (SELECT word, lower(word) AS low FROM d) JOIN sc USING (low)),
    lc AS (SELECT label, feats, count(*) AS n FROM lw GROUP BY ALL), {grown_sql("lc", "lw", "word, low", 6, 20)}
    SELECT word, CASE WHEN length(low) <= CAST(split_part(predicted, '|', 1) AS INT) THEN low ELSE substr(low, 1, length(low) - CAST(split_part(predicted, '|', 1) AS INT)) || split_part(predicted, '|', 2) END AS lemma FROM pr
""")
def lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas of every distinct word by a tree over its last letters and its tag, grown on those words whose stems are words themselves."""
    words = split_tokens(spark, sf).filter(F.col("word").rlike(r"^\p{L}+\z")).select("word").distinct()
    tag = F.when(F.col("word").rlike(r"^\p{Lu}"), "U").when(F.char_length("word") <= 3, "S").otherwise("W")
    rows = stored(words.select("word", F.lower("word").alias("low"), tag.alias("tag")), "words")
    scripts = tg.stem_scripts(rows.select(F.col("low").alias("word")).distinct()).withColumnRenamed("word", "low")
    feats = tg.lemma_features(F.col("low"), F.col("tag"))
    tree = tr.grow(k.bag_counts(rows.join(scripts, "low"), "script", feats).withColumnRenamed("script", "label"), cut_off=20, max_depth=6, top=1)
    return tr.classify(rows.withColumn("feats", feats), tree, "feats", "found").select("word", tg.apply_edit(F.col("low"), F.col("found")).alias("lemma"))
