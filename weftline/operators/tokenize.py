"""Generators: lines, items, tokens, characters, runs and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that are split off the end of an item. Fixed values.
MARKS = "-,:;–"
#: An item falls into tails that start with a hyphen, stretches without hyphen and comma, and single marks; neither of the
#: first two ends with a mark.
PARTS = f"-[^-]*[^{MARKS}]|[^,-][^,-]*[^{MARKS}]|[^{MARKS}]|[{MARKS}]"
#: The same within a line of items that blanks and tabs part.
LINE_PARTS = rf"-[^- \t]*[^{MARKS} \t]|[^,\- \t][^,\- \t]*[^{MARKS} \t]|[^{MARKS} \t]|[{MARKS}]"
#: A line up to the first . ! ? of its last item, and that item from there.
CLOSING = r"(?s)^((?:.*[ \t])?[^ \t.!?]*)([.!?][^ \t]*)[ \t]*\z"
SPLIT = r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\s]"


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line: every line of every text."""
    return docs.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def items_of(line: Column) -> Column:
    """A line's items: what stands between blanks and tabs."""
    return F.filter(F.split(line, "[ \t]"), lambda x: x != "")


def items(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, pos (from 0), item."""
    return lines(docs).select("doc_id", "line_no", F.posexplode(items_of(F.col("line"))).alias("pos", "item"))


def tokens_of(line: Column) -> Column:
    """The tokens of a sentence (a line): items split at marks, hyphens and commas, and the last item at the first . ! ? if it ends with one.

    A part holds no blank, so a line is cut by one pattern in one pass.
    """
    parts = lambda text: F.regexp_extract_all(text, F.lit(LINE_PARTS), F.lit(0))
    close = F.regexp_extract(line, CLOSING, 2)
    found = F.when(close.rlike("[.!?]$"), F.concat(parts(F.regexp_extract(line, CLOSING, 1)), F.array(close))).otherwise(parts(line))
    return F.coalesce(found, F.array().cast("array<string>"))


def tokenized(df: DataFrame, line: str, out: str) -> DataFrame:
    """df with the tokens of a line column."""
    return df.withColumn(out, tokens_of(F.col(line)))


def tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, sent_id (the line's number), pos (from 0), word. A blank line is no sentence."""
    return lines(docs, text_col).select("doc_id", F.col("line_no").alias("sent_id"), F.posexplode(tokens_of(F.col("line"))).alias("pos", "word"))


def split_words(text: Column) -> Column:
    """Runs of letters and digits, and every other character but white space by itself."""
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def word_spans(docs: DataFrame) -> DataFrame:
    """doc_id, word, start (from 0), stop: runs of word characters with their offsets in characters. Rows of one doc_id are texts of their own."""
    parts = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+"), F.lit(0))
    each = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", F.posexplode(parts).alias("_at", "word"))
    stop = F.sum(F.char_length("word")).over(Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("stop", stop).filter(F.col("word").rlike(r"^[\p{L}\p{Nd}_]"))
    return spans.select("doc_id", "word", (F.col("stop") - F.char_length("word")).alias("start"), "stop")


def join_words(words: Column) -> Column:
    return F.array_join(words, " ")


def characters(words: DataFrame, word_col: str = "word") -> DataFrame:
    """The word column, char_pos (from 0), char."""
    return words.select(word_col, F.posexplode(F.filter(F.split(word_col, ""), lambda c: c != "")).alias("char_pos", "char"))


def phones_of(phonemes: Column) -> Column:
    """Single phones: silent letters (-) dropped, letters with several phones split at dots."""
    return F.flatten(F.transform(F.filter(phonemes, lambda p: p != "-"), lambda p: F.split(p, r"\.")))


def repeat_rows(df: DataFrame, times: Column, name: str = "step") -> DataFrame:
    """Run-length expansion: every row `times` times, numbered from 0; none for 0 or less."""
    return df.select("*", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias(name))


def frames_of(samples: Column, length: int) -> Column:
    """Frames of fixed length, the last one padded with zeros."""
    n = F.ceil(F.size(samples) / F.lit(length)).cast("int")
    padded = F.concat(samples, F.array_repeat(F.lit(0.0), length))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(padded, i * length + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def overlapping_frames_of(samples: Column, window: int, hop: int) -> Column:
    """Overlapping windows over samples padded in front with a window of zeros; the number is (length - window) // hop of the padded samples."""
    padded = F.concat(F.array_repeat(F.lit(0.0), window), samples)
    n = F.floor((F.size(padded) - window) / F.lit(hop)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(padded, i * hop + 1, window))).otherwise(F.array().cast("array<array<double>>"))


def batches(df: DataFrame, position: Column, size: int = 512) -> DataFrame:
    """batch: the number of the training batch that a position falls into."""
    return df.withColumn("batch", F.floor(position / F.lit(size)).cast("long"))
