"""Series, frames, codes and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog.registry import query, table
from weftline.functions import signal as s
from weftline.operators import context as c
from weftline.operators.acoustic import expand_states, generate, safe_states
from weftline.operators.alignment import nearest, vector_gap, warp_distance
from weftline.operators.counts import argmax, moments, offsets_before, voiced_mean, z_normalise
from weftline.operators.dealing import spread
from weftline.operators.tokenize import batches, frames_of, overlapping_frames_of, repeat_rows

#: CTE ev: events with a position within their user; every fifth has no value.
EV_SQL = "ev AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 5 < 2 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS v FROM events)"


def series(spark: SparkSession, sf: str, deal: bool = False) -> DataFrame:
    """event_id, user_id, i, v: each user's values in order, with gaps (0); with `deal`, for work far beyond the rows' bytes, in several tasks for each core."""
    ev = table(spark, sf, "events")
    ev = spread(ev.select("event_id", "user_id", "value"), "user_id") if deal else ev
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return ev.select("event_id", "user_id", i.cast("long").alias("i"), F.when(F.col("event_id") % 5 < 2, 0.0).otherwise(F.col("value")).alias("v"))


def user_arrays(spark: SparkSession, sf: str, deal: bool = False) -> DataFrame:
    """user_id, x: each user's values as an array in order; with `deal`, for work far beyond the rows' bytes, in several tasks for each core."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    held = table(spark, sf, "events").select("user_id", "event_id", "value")
    return (spread(held, "user_id") if deal else held).groupBy("user_id").agg(F.transform(ordered, lambda e: e["value"]).alias("x"))


@query(f"""
    WITH {EV_SQL}, k AS (SELECT *, last_value(CASE WHEN v <> 0 THEN i END IGNORE NULLS) OVER b AS ai, last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER b AS av,
      first_value(CASE WHEN v <> 0 THEN i END IGNORE NULLS) OVER f AS bi, first_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER f AS bv FROM ev
      WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, i, v, round(CASE WHEN v <> 0 THEN v ELSE coalesce(av + (bv - av) * (i - ai) / nullif(CAST(bi - ai AS DOUBLE), 0), 0.0) END, 6) AS v_filled FROM k
""")
def gap_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Zeros between values interpolated."""
    return c.fill_gaps(series(spark, sf), "v", ["user_id"], "i", "i").select("user_id", "i", "v", F.round("v_filled", 6).alias("v_filled"))


@query(f"""
    WITH {EV_SQL}, n AS (SELECT user_id, i, CAST(trunc(sign(v / 1000) * ln(1 + 255 * abs(v / 1000)) / ln(256) * 127) AS INT) AS code FROM ev),
    h AS (SELECT user_id, i, coalesce(lag(code) OVER w, 0) AS prev, code AS cur, max(abs(code)) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) > 0 AS heard FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, i, CAST(prev AS INT) AS prev, cur FROM h WHERE heard
""")
def code_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Companded codes with the one before, leading silence trimmed."""
    from weftline.sources.sinks import pair_lines

    coded = series(spark, sf).select("user_id", "i", s.mulaw_code(F.col("v") / 1000).alias("code"))
    return pair_lines(coded, "user_id", "i", "code")


@query("""
    SELECT event_id, CAST(trunc(y * 127) AS INT) AS code, CAST(trunc((y + 1) * 127) AS INT) AS code_unsigned, round(sign(y) * (pow(256, abs(y)) - 1) / 255, 6) AS inverse,
      round(sign(CAST(trunc(y * 127) AS INT) / 127.0) * (pow(256.0, abs(CAST(trunc(y * 127) AS INT) / 127.0)) - 1) / 255, 6) AS decoded,
      round(sign(CAST(trunc((y + 1) * 127) AS INT) / 128.0 - 1) * (pow(256.0, abs(CAST(trunc((y + 1) * 127) AS INT) / 128.0 - 1)) - 1) / 255, 6) AS decoded_unsigned
    FROM (SELECT event_id, sign(x) * ln(1 + 255 * abs(x)) / ln(256) AS y FROM (SELECT event_id, CAST(value AS DOUBLE) / 1000 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS x FROM events))
""")
def companded_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Both code ranges, and what they decode to."""
    x = F.col("value") / 1000 * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    coded = table(spark, sf, "events").select("event_id", s.mulaw(x).alias("y"), s.mulaw_code(x).alias("code"), s.mulaw_code_unsigned(x).alias("code_unsigned"))
    return coded.select(
        "event_id", "code", "code_unsigned", F.round(s.mulaw_inverse(F.col("y")), 6).alias("inverse"), F.round(s.from_code(F.col("code")), 6).alias("decoded"), F.round(s.from_code_unsigned(F.col("code_unsigned")), 6).alias("decoded_unsigned")
    )


ARR_SQL = "ua AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS x FROM events GROUP BY user_id)"


@query(f"""
    WITH {ARR_SQL}, f AS (SELECT user_id, list_concat(list_transform(range(16), lambda i: 0.0), x) AS p FROM ua),
    w AS (SELECT user_id, unnest(range((len(p) - 16) // 4)) AS frame, p FROM f)
    SELECT user_id, frame, round(list_sum(p[frame * 4 + 1:frame * 4 + 16]), 6) AS total, round(p[frame * 4 + 1], 6) AS first, round(p[frame * 4 + 16], 6) AS last FROM w
""")
def overlapping_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 16 values every 4."""
    framed = user_arrays(spark, sf).select("user_id", F.posexplode(overlapping_frames_of(F.col("x"), 16, 4)).alias("frame", "w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return framed.select("user_id", F.col("frame").cast("long").alias("frame"), F.round(total, 6).alias("total"), F.round(F.get("w", 0), 6).alias("first"), F.round(F.get("w", 15), 6).alias("last"))


@query(f"""
    WITH {ARR_SQL}, w AS (SELECT user_id, unnest(range((len(x) + 9) // 10)) AS frame, x FROM ua)
    SELECT user_id, frame, round(list_sum(x[frame * 10 + 1:frame * 10 + 10]), 6) AS total, CAST(greatest(0, frame * 10 + 10 - len(x)) AS INT) AS padded, frame // 2 AS batch FROM w
""")
def fixed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 10 values, the last padded, in batches of 2."""
    framed = user_arrays(spark, sf).select("user_id", F.size("x").alias("n"), F.posexplode(frames_of(F.col("x"), 10)).alias("frame", "w"))
    rows = framed.select("user_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.greatest(F.lit(0), F.col("frame") * 10 + 10 - F.col("n")).alias("padded"))
    return batches(rows, F.col("frame"), 2)


@query(f"""
    WITH {EV_SQL}
    SELECT user_id, i, round((coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2, 6) AS d1, round(coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v), 6) AS d2,
      round(sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS running, round(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 319 PRECEDING AND CURRENT ROW), 0), 6) AS field_total
    FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)
""")
def differences(spark: SparkSession, sf: str) -> DataFrame:
    """First and second differences, running totals, and the sum over the last 320 values."""
    w = Window.partitionBy("user_id").orderBy("i")
    d1, d2 = c.deltas("v", w)
    field = F.aggregate(c.receptive_field("v", w, 320), F.lit(0.0), lambda a, x: a + x)
    return series(spark, sf).select("user_id", "i", F.round(d1, 6).alias("d1"), F.round(d2, 6).alias("d2"), F.round(c.running_total("v", ["user_id"], ["i"]), 6).alias("running"), F.round(field, 6).alias("field_total"))


@query("SELECT c_nationkey, o_orderkey, CAST(coalesce(sum(items) OVER (PARTITION BY c_nationkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM (SELECT c_nationkey, o_orderkey, count(*) AS items FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offset of each order's lines in its nation's sequence."""
    held = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("items"))
    joined = held.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return offsets_before(joined, "items", ["c_nationkey"], "o_orderkey").select("c_nationkey", "o_orderkey", F.col("offset").cast("long").alias("start_at"))


@query("SELECT l_orderkey, l_linenumber, step FROM (SELECT l_orderkey, l_linenumber, unnest(range(CAST(l_quantity AS INT) % 7)) AS step FROM lineitem)")
def run_length_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as many times as its quantity modulo 7."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return repeat_rows(items, F.col("l_quantity").cast("int") % 7).select("l_orderkey", "l_linenumber", F.col("step").cast("long").alias("step"))


@query("SELECT n_nationkey, unnest(range(2, 7)) AS state, least(unnest(range(2, 7)), 4) AS clamped FROM nation")
def state_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Five states for each label, clamped to the last that a model has."""
    rows = expand_states(table(spark, sf, "nation").select("n_nationkey"))
    return rows.select("n_nationkey", F.col("state").cast("long").alias("state"), safe_states(F.col("state"), 4).cast("long").alias("clamped"))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 4) AS var, round(coalesce(avg(CASE WHEN value > 50 THEN value END), 0) * 0.7, 6) AS voiced FROM events GROUP BY event_type")
def value_moments(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    voiced = ev.groupBy("event_type").agg(F.round(voiced_mean(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 6).alias("voiced"))
    stats = moments(ev, F.col("value"), ["event_type"])
    return stats.select("event_type", "n", *(F.round(x, 6).alias(x) for x in ("least", "most", "mean", "sd")), F.round("var", 4).alias("var")).join(voiced, "event_type")


@query("""
    WITH e AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), f AS (SELECT vec_id, dim, CAST(value AS DOUBLE) AS value FROM e),
    m AS (SELECT dim, avg(value) AS mean, stddev_pop(value) AS sd FROM f GROUP BY dim)
    SELECT vec_id, dim, round((value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM f JOIN m USING (dim)
""")
def z_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return z_normalise(table(spark, sf, "embeddings"), ["vec_id"], "embedding").select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z", 4).alias("z"))


@query("""
    WITH c AS (SELECT vec_id AS id, embedding AS centre FROM embeddings WHERE vec_id < 16),
    d AS (SELECT v.vec_id, c.id, list_sum(list_transform(list_zip(v.embedding, c.centre), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS gap FROM embeddings v, c)
    SELECT vec_id, id AS centroid FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gap, id) = 1
""")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Of the sixteen first vectors the one nearest to each."""
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors.filter("vec_id < 16").select(F.col("vec_id").alias("id"), F.col("embedding").alias("centre")), "embedding", "vec_id")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS peak, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS energy, len(embedding) AS dims FROM embeddings")
def vector_peaks(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("peak"), F.round(s.scalar_product(x, x), 4).alias("energy"), F.size("embedding").cast("long").alias("dims"))


BANDS_SQL = "[" + ", ".join(map(str, s.BAND_WIDTHS)) + "]"


@query(f"""
    WITH b AS (SELECT vec_id, embedding[1:26] AS e, {BANDS_SQL} AS w FROM embeddings),
    x AS (SELECT vec_id, unnest(e) AS v, unnest(w) AS n, generate_subscripts(e, 1) AS band FROM b)
    SELECT vec_id, band - 1 AS band, n AS bins, CAST(v AS DOUBLE) AS value FROM x
""")
def band_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of each band after 26 bands were spread over 1025, as runs."""
    spread = table(spark, sf, "embeddings").select("vec_id", F.posexplode(s.expand_bands(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.struct(i.alias("band"), F.get("embedding", i).alias("v"))))).alias("bin", "b"))
    return spread.groupBy("vec_id", F.col("b.band").cast("long").alias("band")).agg(F.count(F.lit(1)).cast("int").alias("bins"), F.max(F.col("b.v").cast("double")).alias("value"))


@query("SELECT n, k, round(0.5 * (1 - cos(2 * pi() * (k + 1) / (n + 1))), 9) AS hann, round(0.54 - 0.46 * cos(2 * pi() * k / (n - 1)), 9) AS hamming, round(sin(2 * pi() * 400 * k / 48000), 9) AS tone, round(exp(-pow(k - 10, 2) / (2 * 9.0)), 9) AS bell FROM (SELECT n, unnest(range(n)) AS k FROM (SELECT unnest([32, 240, 1024]) AS n))")
def window_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Hann and Hamming weights, a test tone and a Gaussian bell."""
    parts = [spark.range(1).select(F.lit(n).alias("n"), F.posexplode(F.arrays_zip(s.hann(n).alias("hann"), s.hamming(n).alias("hamming"))).alias("k", "w")) for n in (32, 240, 1024)]
    rows = parts[0].union(parts[1]).union(parts[2])
    k = F.col("k")
    return rows.select("n", k.cast("long").alias("k"), F.round("w.hann", 9).alias("hann"), F.round("w.hamming", 9).alias("hamming"), F.round(s.test_tone(k / 48000, 400), 9).alias("tone"), F.round(s.gaussian(k, 10, 3.0), 9).alias("bell"))


@query("SELECT event_id, round(CASE WHEN abs(x) <= 1e-38 THEN CASE WHEN x >= 0 THEN 1e38 ELSE -1e38 END ELSE 1.0 / x END, 9) AS reciprocal, round(CAST(value AS DOUBLE), 1) AS half_up, CAST(pow(2, ceil(log2(event_id % 1000 + 1))) AS BIGINT) AS power FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) + 1 END AS x FROM events)")
def guarded_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded reciprocals, rounding and frame lengths."""
    from weftline.functions.text import half_up, next_power_of_two

    x = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value") + 1)
    return table(spark, sf, "events").select("event_id", F.round(s.safe_reciprocal(x), 9).alias("reciprocal"), half_up(F.col("value"), 1).alias("half_up"), next_power_of_two(F.col("event_id") % 1000 + 1).alias("power"))


@query("SELECT a.vec_id, b.vec_id AS next_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 4) AS gap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each vector to the one after it."""
    x = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("x").alias("y"))
    return x.join(y, "vec_id").select("vec_id", "next_id", F.round(vector_gap(F.col("x"), F.col("y")), 4).alias("gap"))


def _per_user(spark: SparkSession, sf: str, fn, schema: str) -> DataFrame:
    """fn(x) -> dict of columns for each user's array of values, in Arrow batches."""

    def run(batches_):
        for batch in batches_:
            parts = [pd.DataFrame({"user_id": user, **fn(np.array(x, float))}) for user, x in zip(batch["user_id"], batch["x"], strict=True)]
            yield pd.concat([p for p in parts if len(p)]) if any(map(len, parts)) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return user_arrays(spark, sf).mapInPandas(run, schema)


#: CTE fr: each user's values as frames of 64, the last padded.
FRAMES_SQL = "ux AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS x FROM events GROUP BY user_id), fr AS (SELECT user_id, f AS frame, list_transform(range(64), lambda j: coalesce(x[64 * f + j + 1], 0.0)) AS v FROM (SELECT user_id, x, unnest(range((len(x) + 63) // 64)) AS f FROM ux))"


@query(f"""
    WITH {FRAMES_SQL}, b AS (SELECT user_id, frame, v, unnest(range(64)) AS k FROM fr),
    s AS (SELECT user_id, frame, k, list_sum(list_transform(range(64), lambda j: v[j + 1] * cos(2 * pi() * ((j * k) % 64) / 64))) AS re, list_sum(list_transform(range(64), lambda j: v[j + 1] * sin(2 * pi() * ((j * k) % 64) / 64))) AS im FROM b)
    SELECT user_id, frame, k AS bin, round(sqrt(re * re + im * im), 6) AS magnitude FROM s
""")
def fft_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    """Magnitudes of the transforms of each user's frames of 64 values, the last padded."""

    def fn(x: np.ndarray) -> dict:
        m = s.magnitude(np.pad(x, (0, -len(x) % 64)).reshape(-1, 64))
        frame, bin_ = np.indices(m.shape).reshape(2, -1)
        return {"frame": frame, "bin": bin_, "magnitude": np.round(m.reshape(-1), 6)}

    return _per_user(spark, sf, fn, "user_id long, frame long, bin long, magnitude double")


@query("""
    WITH ux AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS x FROM events GROUP BY user_id),
    fr AS (SELECT user_id, f AS frame, list_transform(range(16), lambda j: coalesce(CASE WHEN 4 * f + j >= 16 THEN x[4 * f + j - 15] END, 0.0) * (0.54 - 0.46 * cos(2 * pi() * j / 15))) AS v FROM (SELECT user_id, x, unnest(range(len(x) // 4)) AS f FROM ux)),
    b AS (SELECT user_id, frame, v, unnest(range(9)) AS k FROM fr),
    s AS (SELECT user_id, frame, k, list_sum(list_transform(range(16), lambda j: v[j + 1] * cos(2 * pi() * ((j * k) % 16) / 16))) AS re, list_sum(list_transform(range(16), lambda j: v[j + 1] * sin(2 * pi() * ((j * k) % 16) / 16))) AS im FROM b),
    l AS (SELECT user_id, frame, k, greatest(log10(greatest(sqrt(re * re + im * im), 1e-12)), -3.0) AS y FROM s),
    m AS (SELECT *, avg(y) OVER w AS mean, CASE WHEN max(y) OVER w = min(y) OVER w THEN 1.0 ELSE stddev_pop(y) OVER w END AS sd FROM l WINDOW w AS (PARTITION BY user_id, k))
    SELECT user_id, frame, k AS bin, round((y - mean) / sd, 6) + 0.0 AS z FROM m
""")
def log_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Log spectra of overlapping windows, normalised over the user's frames."""

    def fn(x: np.ndarray) -> dict:
        z = s.log_spectrum(x, 16, 4, normalise=True)
        frame, bin_ = np.indices(z.shape).reshape(2, -1) if z.size else (np.empty(0, int), np.empty(0, int))
        return {"frame": frame, "bin": bin_, "z": np.round(z.reshape(-1), 6) + 0.0}

    return _per_user(spark, sf, fn, "user_id long, frame long, bin long, z double")


@query()
def rebuilt_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Samples rebuilt from magnitudes alone: length, energy and the shift that fits the original best."""

    def fn(x: np.ndarray) -> dict:
        if len(x) < 8:
            return {"n": [0], "energy": [0.0], "shift": [0]}
        y = s.griffin_lim(np.abs(s.stft(x, 16, 4)), 4, 10)
        return {"n": [len(y)], "energy": [round(float((y**2).sum()), 3)], "shift": [s.best_offset(x, y) if len(y) else 0]}

    return _per_user(spark, sf, fn, "user_id long, n long, energy double, shift long")


#: The banded equations of each user's rows with a value: k says whether the windows fit, then the diagonal, the entries one and two before it and
#: the right side; factors (four numbers a row: diagonal, two multipliers, right side) from the first row on, values from the last one back.
TRAJECTORY_SQL = f"""
    {EV_SQL}, md AS (SELECT user_id, i, v, (coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2 AS d1, coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v) AS d2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    vo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM md WHERE v > 0), vk AS (SELECT *, CASE WHEN j BETWEEN 1 AND n - 2 THEN 1.0::DOUBLE ELSE 0.0 END AS k FROM vo),
    vn AS (SELECT *, coalesce(lag(k) OVER w, 0) AS kp, coalesce(lead(k) OVER w, 0) AS kn, coalesce(lag(d1) OVER w, 0) AS d1p, coalesce(lead(d1) OVER w, 0) AS d1n, coalesce(lag(d2) OVER w, 0) AS d2p, coalesce(lead(d2) OVER w, 0) AS d2n FROM vk WINDOW w AS (PARTITION BY user_id ORDER BY j)),
    sy AS (SELECT user_id, any_value(n) AS n, list([1 + 0.5 * (kp + kn) + 2 * (kp + 4 * k + kn), -4 * (kp + k), 1.5 * kp, v + d1p * kp - d1n * kn + 2 * (d2p * kp - 2 * d2 * k + d2n * kn)] ORDER BY j) AS e FROM vn GROUP BY user_id),
    fa AS (SELECT user_id, n, list_reduce(e, lambda acc, x: list_concat(acc, list_transform([coalesce(x[3] / acc[-8], 0.0)], lambda m2: list_transform([(x[2] - m2 * acc[-3] * coalesce(acc[-8], 0.0)) / acc[-4]],
      lambda m1: [x[1] - m1 * m1 * acc[-4] - m2 * m2 * coalesce(acc[-8], 0.0), m1, m2, x[4] - m1 * acc[-1] - m2 * coalesce(acc[-5], 0.0)])[1])[1])) AS f FROM sy),
    ba AS (SELECT user_id, n, list_reduce(list_prepend([f[4 * n] / f[4 * n - 3]], list_transform(range(n - 2, -1, -1), lambda j: [f[4 * j + 4] / f[4 * j + 1], f[4 * j + 6], coalesce(f[4 * j + 11], 0.0)])), lambda acc, x: list_append(acc, x[1] - x[2] * acc[-1] - x[3] * coalesce(acc[-2], 0.0))) AS xs FROM fa),
    tj AS (SELECT vo.user_id, vo.i, xs[ba.n - vo.j] AS x FROM vo JOIN ba ON ba.user_id = vo.user_id)"""


def voiced_rows(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, i, mean, var, voiced: values and differences with fixed variances."""
    w = Window.partitionBy("user_id").orderBy("i")
    d1, d2 = c.deltas("v", w)
    return series(spark, sf, deal=True).withColumns({"mean": F.array(F.col("v"), d1, d2), "var": F.array(F.lit(1.0), F.lit(0.5), F.lit(0.5)), "voiced": F.col("v") > 0})


@query(f"WITH {TRAJECTORY_SQL} SELECT user_id, i, round(coalesce(x, 0), 6) AS value FROM ev LEFT JOIN tj USING (user_id, i)")
def smooth_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest trajectory of each user's values and differences, over rows that have a value."""
    return generate(voiced_rows(spark, sf), "user_id", "i", "mean", "var", "voiced").select("user_id", "i", F.round("value", 6).alias("value"))


@query(f"""
    WITH {TRAJECTORY_SQL}, mo AS (SELECT user_id, var_pop(v) AS of FROM vo WHERE i % 7 <> 3 GROUP BY user_id), gv AS (SELECT avg(of) AS m FROM mo)
    SELECT user_id, count(*) AS n, round(var_pop(x), 4) AS before, round((SELECT m FROM gv), 4) AS wanted FROM tj WHERE i % 7 <> 3 GROUP BY user_id HAVING count(*) > 1
""")
def total_variances(spark: SparkSession, sf: str) -> DataFrame:
    """The variance of each user's trajectory over its frames that are on, and the one that it is to have: the mean of all users' own."""
    rows = switched_rows(spark, sf)
    plain = generate(rows, "user_id", "i", "mean", "var", "voiced", keep=("voiced", "on")).filter("voiced AND on")
    found = plain.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("before")).filter("n > 1")
    return found.crossJoin(F.broadcast(wanted_variance(rows))).select("user_id", "n", F.round("before", 4).alias("before"), F.round("gv_mean", 4).alias("wanted"))


def switched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """voiced_rows with on: six of seven frames."""
    return voiced_rows(spark, sf).withColumn("on", F.col("i") % 7 != 3)


def wanted_variance(rows: DataFrame) -> DataFrame:
    """gv_mean: the mean of all users' variances of values, over frames that are on."""
    of_users = moments(rows, F.col("mean")[0], ["user_id"], F.col("voiced") & F.col("on")).filter("n > 0")
    return of_users.agg(F.avg("var").alias("gv_mean"))


def spread_rows(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, n, before, after, wanted: total variances of trajectories, plain and spread, over frames that are on (six of seven), and the one wanted, which is held to by a variance of a twentieth of it."""
    rows = switched_rows(spark, sf)
    wanted = wanted_variance(rows).withColumn("gv_var", F.col("gv_mean") / 20)
    both = generate(rows.crossJoin(F.broadcast(wanted)), "user_id", "i", "mean", "var", "voiced", ("gv_mean", "gv_var"), "on", "plain", ("voiced", "on", "gv_mean")).filter("voiced AND on")
    found = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.var_pop("plain").alias("before"), F.var_pop("value").alias("after"), F.first("gv_mean").alias("wanted"))
    return found.filter("n > 1").select("user_id", "n", "before", "after", "wanted")


@query()
def spread_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the variance after spreading, which lies nearer to the one wanted."""
    return spread_rows(spark, sf).select("user_id", "n", *(F.round(x, 4).alias(x) for x in ("before", "after", "wanted")))


#: Rows of the table of least costs, one after the other, each built from left to right.
WARP_SQL = """
    WITH ux AS (SELECT user_id, list(value + 1 ORDER BY event_id) AS x FROM events GROUP BY user_id), p AS (SELECT a.user_id, a.x AS a, b.x AS b FROM ux a JOIN ux b ON b.user_id = a.user_id + 1),
    s AS (SELECT user_id, a, b, list_reduce(list_prepend([pow(ln(a[1]) - ln(b[1]), 2)], list_transform(range(2, len(b) + 1), lambda j: [CAST(j AS DOUBLE)])), lambda acc, j: list_append(acc, acc[len(acc)] + pow(ln(a[1]) - ln(b[CAST(j[1] AS INT)]), 2))) AS first FROM p)
    SELECT user_id, round(list_reduce(list_prepend(first, list_transform(a[2:], lambda v: [v])), lambda prev, x: list_reduce(list_prepend([prev[1] + pow(ln(x[1]) - ln(b[1]), 2)], list_transform(range(2, len(b) + 1), lambda j: [CAST(j AS DOUBLE)])),
      lambda acc, j: list_append(acc, pow(ln(x[1]) - ln(b[CAST(j[1] AS INT)]), 2) + least(prev[CAST(j[1] AS INT) - 1], prev[CAST(j[1] AS INT)], acc[len(acc)]))))[len(b)], 6) AS distance FROM s
"""


@query(WARP_SQL)
def warp_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of warping each user's values, all of them, onto the next user's."""
    x = user_arrays(spark, sf).select("user_id", F.transform("x", lambda v: v + 1).alias("a"))
    y = x.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return warp_distance(x.join(y, "user_id"), "a", "b", scalar=True).select("user_id", F.round("distance", 6).alias("distance"))


@query()
def vocoded(spark: SparkSession, sf: str) -> DataFrame:
    """Samples synthesised from each user's values, all of them, as pitches and a fixed envelope: count and peak."""
    envelope = np.array([0.5, 0.3, -0.2, 0.1, 0.05, 0.02])

    def run(batches_):
        for batch in batches_:
            xs = [np.array(x, float) for x in batch["x"]]
            found = s.vocode_in_turn([np.broadcast_to(envelope, (len(x), len(envelope))) for x in xs], xs, rate=4000)
            rows = [(i, len(y), round(float(np.abs(y).max(initial=0)), 3)) for i, y in found]
            at, samples, peaks = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"user_id": batch["user_id"].iloc[list(at)], "samples": samples, "peak": peaks})

    return user_arrays(spark, sf, deal=True).mapInPandas(run, "user_id long, samples long, peak double")
