"""Writers: token dumps, labels, lexicons, audio, frames, images, matrices."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.counts import offsets_before


def token_line(df: DataFrame) -> Column:
    """word, tag, lemma, chunk, syllables, phonemes, tab-separated; columns that are missing or null are left out.

    Syllables are joined by hyphens, stressed ones start with ', phonemes are joined by blanks.
    """
    have = set(df.columns)
    marked = F.zip_with("syllables", "stress", lambda s, x: F.concat(F.when(x == 1, F.lit("'")).otherwise(F.lit("")), s)) if {"syllables", "stress"} <= have else F.col("syllables") if "syllables" in have else None
    parts = [F.col(c) for c in ("word", "tag", "lemma", "chunk") if c in have]
    if marked is not None:
        parts.append(F.when(F.col("syllables").isNotNull(), F.array_join(marked, "-")))
    if "phonemes" in have:
        parts.append(F.when(F.col("phonemes").isNotNull(), F.array_join("phonemes", " ")))
    return F.concat_ws("\t", *parts)


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "error") -> None:
    """One line of text per row; mode append adds to what is there."""
    df.select(line.alias("value")).write.mode(mode).text(path)


def lexicon_line(word: Column, phonemes: Column) -> Column:
    return F.concat_ws("\t", word, F.array_join(phonemes, " "))


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as Parquet by file, sorted, so that slices read few row groups."""
    frames.repartition("file").sortWithinPartitions("file", "frame").write.parquet(path)


def frame_offsets(files: DataFrame, order: str = "file") -> DataFrame:
    """files (file, frames) with offset: the frames of all files before."""
    return offsets_before(files, "frames", [], order).withColumn("offset", F.col("offset").cast("long"))


def pair_lines(samples: DataFrame, utterance: str = "utt", position: str = "i", code: str = "code") -> DataFrame:
    """utterance, position, prev, cur: codes with the one before (0 at first), silence in front left out."""
    ordered = Window.partitionBy(utterance).orderBy(position)
    prev = F.lag(code, 1, 0).over(ordered)
    heard = F.max(F.abs(code)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) > 0
    return samples.select(utterance, position, prev.alias("prev"), F.col(code).alias("cur"), heard.alias("heard")).filter("heard").drop("heard")


def grey_pixels(spectra: np.ndarray) -> np.ndarray:
    """Rows of 0..255 for a (frames, bins) matrix, the lowest bin at the bottom."""
    x = np.asarray(spectra, float).T[::-1]
    low, high = (x.min(), x.max()) if x.size else (0.0, 0.0)
    return ((x - low) / ((high - low) or 1.0) * 255).astype(np.uint8)


def ppm(spectra: np.ndarray) -> bytes:
    pixels = grey_pixels(spectra)
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.repeat(pixels[..., None], 3, -1).tobytes()


def png(spectra: np.ndarray) -> bytes:
    pixels = grey_pixels(spectra)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def spectrum_images(df: DataFrame, key: str, frames: str, kind: str = "png") -> DataFrame:
    """key, image: a picture of each row's array of spectra."""
    draw = png if kind == "png" else ppm

    @F.pandas_udf("binary")
    def render(col: pd.Series) -> pd.Series:
        return pd.Series([draw(np.array([list(f) for f in x], float)) for x in col])

    return df.select(key, render(F.col(frames)).alias("image"))


def transition_lines(transitions: DataFrame) -> DataFrame:
    """value: `prev next p next p ...`, nexts in order; a row per previous tag."""
    pairs = F.array_sort(F.collect_list(F.struct("next", "p")))
    return transitions.groupBy("prev").agg(pairs.alias("pairs")).select(F.concat_ws(" ", "prev", F.array_join(F.transform("pairs", lambda x: F.concat_ws(" ", x["next"], x["p"].cast("string"))), " ")).alias("value"))
