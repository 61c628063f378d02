"""Readers of text formats: lines, lexicons, counts, labels, matrices, unit indexes, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import is_comment, is_real_phone
from weftline.functions.text import label_context, label_phone

#: Byte order marks with their encodings, the longer first. Fixed values.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def read_lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """value: UTF-8 lines, a byte order mark removed; with comments, lines that start with # are left out."""
    found = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"))
    return found.filter(~is_comment(F.col("value"))) if comments else found


def decoded(content: Column) -> Column:
    """Text of bytes by their byte order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.decode(content, "UTF-8")
    for mark, charset in reversed(MARKS):
        wide = charset.startswith("UTF-32")  # that decoder reads the mark itself
        body = content if wide else F.substring(content, F.lit(len(mark) // 2 + 1), F.length(content))
        out = F.when(head.startswith(mark), F.decode(body, "UTF-32" if wide else charset)).otherwise(out)
    return out


def encoding_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for mark, charset in reversed(MARKS):
        out = F.when(head.startswith(mark), charset).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """path, stem, content of the files with an extension."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "content")


def stems(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """stem of each file with an extension; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"))


def complete_files(spark: SparkSession, path: str, extension: str, others: tuple[str, ...]) -> DataFrame:
    """stems that have a file of the extension and of all the others."""
    found = stems(spark, path, extension)
    for other in others:
        found = found.join(stems(spark, path, other), "stem", "left_semi")
    return found


def file_counts(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """extension, n."""
    listing = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"))
    return listing.filter(F.col("extension").isin(*extensions)).groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


def floats_of(line: Column) -> Column:
    """Numbers of a line, blanks repeated or not."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.cast("float"))


def read_monophones(lines: DataFrame) -> DataFrame:
    """start, stop (5 ms frames), phone of `start stop phone` lines in units of 100 ns."""
    parts = F.split(F.trim("value"), r"\s+")
    frame = lambda i: F.floor(F.get(parts, i).cast("long") / 50_000).cast("int")
    return lines.select(frame(0).alias("start"), frame(1).alias("stop"), F.get(parts, 2).alias("phone"))


def read_full_labels(lines: DataFrame) -> DataFrame:
    """start_ms, stop_ms, duration_ms, phone, context of full-context label lines."""
    parts = F.split(F.trim("value"), r"\s+")
    ms = lambda i: F.floor(F.get(parts, i).cast("long") / 10_000).cast("int")
    label = F.get(parts, 2)
    return lines.select(ms(0).alias("start_ms"), ms(1).alias("stop_ms"), (ms(1) - ms(0)).alias("duration_ms"), label_phone(label).alias("phone"), label_context(label).alias("context"))


def read_units(lines: DataFrame) -> DataFrame:
    """file, phone, start, stop with starts relative to the file's first; phones that start with # are left out."""
    parts = F.split("value", "\t")
    rows = lines.select(F.get(parts, 0).alias("file"), F.get(parts, 1).alias("phone"), F.get(parts, 2).cast("int").alias("start"), F.get(parts, 3).cast("int").alias("stop"))
    first = rows.groupBy("file").agg(F.min("start").alias("first"))
    return rows.filter(is_real_phone(F.col("phone"))).join(first, "file").select("file", "phone", "start", "stop", (F.col("start") - F.col("first")).alias("file_start"))


def frame_slice(frames: DataFrame, file: str, first: int, last: int) -> DataFrame:
    """Frames first..last of a file; on Parquet the filter reaches the scan."""
    return frames.filter((F.col("file") == file) & F.col("frame").between(first, last))


def read_tag_counts(lines: DataFrame) -> DataFrame:
    parts = F.split("value", " ")
    return lines.select(F.get(parts, 0).alias("tag"), F.get(parts, 1).cast("int").alias("n"))


def _pairs(lines: DataFrame, key: str, name: str, value: str, kind: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.filter(F.transform(body, lambda x, i: F.struct(x.alias("a"), F.get(body, i + 1).alias("b"), i.alias("i"))), lambda p: p["i"] % 2 == 0)
    return lines.select(F.get(parts, 0).alias(key), F.explode(pairs).alias("p")).select(key, F.col("p.a").alias(name), F.col("p.b").cast(kind).alias(value))


def read_word_tags(lines: DataFrame) -> DataFrame:
    """word, tag, n of `word (tag n)*` lines."""
    return _pairs(lines, "word", "tag", "n", "int")


def read_transitions(lines: DataFrame) -> DataFrame:
    """prev, next, p of `prev (next p)*` lines."""
    return _pairs(lines, "prev", "next", "p", "double")


def read_lexicon(lines: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """word, lemma, msd of `word lemma msd` lines; a lemma of = is the word. tags (msd, tag) renames msds that it knows."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(parts, 0).alias("word"), F.when(F.get(parts, 1) == "=", F.get(parts, 0)).otherwise(F.get(parts, 1)).alias("lemma"), F.get(parts, 2).alias("msd"))
    if tags is None:
        return rows
    return rows.join(tags, "msd", "left").select("word", "lemma", F.coalesce("tag", "msd").alias("msd"))


def read_sections(text: str) -> dict[str, list[str]]:
    """A grammar file's lines by the section header (NONTERM:, META:, STARTSYM:, PAIR:, RULES:) that they follow."""
    sections: dict[str, list[str]] = {}
    name = ""
    for line in text.splitlines():
        stripped = line.strip()
        if stripped.endswith(":") and stripped[:-1].isupper():
            name = stripped[:-1]
            sections[name] = []
        elif stripped and not stripped.startswith("#"):
            sections.setdefault(name, []).append(stripped)
    return sections


def read_training_rows(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(word_id, item, label, feats) of `label feat feat ...` lines; a blank line ends a word, two end the input."""
    rows, word, item, blank = [], 0, 0, 0
    for line in text.splitlines():
        if not line.strip():
            blank += 1
            if blank == 2:
                break
            word, item = word + 1, 0
            continue
        blank = 0
        label, *feats = line.split()
        rows.append((word, item, label, feats))
        item += 1
    return rows
