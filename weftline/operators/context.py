"""Ordered context: windows over words, letters, phones, syllables and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def neighbours(df: DataFrame, value: str, window: WindowSpec, before: int, after: int, pad: str) -> DataFrame:
    """Columns <value>_m<k> and <value>_p<k>: the values k rows before and after, or the padding."""
    back = {f"{value}_m{k}": F.lag(value, k, pad).over(window) for k in range(before, 0, -1)}
    return df.withColumns(back | {f"{value}_p{k}": F.lead(value, k, pad).over(window) for k in range(1, after + 1)})


def neighbours_in(words: Column, before: int, after: int, pad: str, value: str = "word") -> Column:
    """The same of an array that holds a whole sequence, as an array of structs (pos, value, its neighbours): no shuffle."""
    beside = lambda i, k: F.coalesce(F.get(words, i + k), F.lit(pad))
    names = [(f"{value}_m{k}", -k) for k in range(before, 0, -1)] + [(f"{value}_p{k}", k) for k in range(1, after + 1)]
    return F.transform(words, lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias(value), *(beside(i, k).alias(n) for n, k in names)))


def letter_context(word: Column, at: Column, reach: int, pad: str = "_") -> list[Column]:
    """The letters from `reach` before to `reach` after position `at` (from 0) of a word, without a shuffle."""
    return [F.when((at + k >= 0) & (at + k < F.char_length(word)), F.substring(word, at + k + 1, F.lit(1))).otherwise(F.lit(pad)) for k in range(-reach, reach + 1)]


def quinphones(df: DataFrame, phone: str, window: WindowSpec, pad: str = "#", first_after: str | None = None) -> DataFrame:
    """Two phones on each side. With first_after, the phone before the first one is that (a pause) and the one before it the padding."""
    out = neighbours(df, phone, window, 2, 2, pad)
    if first_after is None:
        return out
    number = F.row_number().over(window)
    return out.withColumns({f"{phone}_m1": F.when(number == 1, F.lit(first_after)).otherwise(F.col(f"{phone}_m1")), f"{phone}_m2": F.when(number == 2, F.lit(first_after)).otherwise(F.col(f"{phone}_m2"))})


def place_in_group(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """index (from 1), of (how many), place: single, start, mid or end of the group."""
    index = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    out = df.withColumns({"index": index, "of": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    return out.withColumn("place", F.when(F.col("of") == 1, "single").when(F.col("index") == 1, "start").when(F.col("index") == F.col("of"), "end").otherwise("mid"))


def quote_state(df: DataFrame, is_quote: Column, partition: list[str], order: str) -> DataFrame:
    """in_quote: an odd number of quotes has been seen so far."""
    seen = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("in_quote", F.sum(is_quote.cast("int")).over(seen) % 2 == 1)


def distance_to_marks(df: DataFrame, kind: str, weight: str, partition: list[str], order: str, default: str = "sent_start") -> DataFrame:
    """Type of and distance to the previous and next row whose `kind` is not null, in rows and in summed weight.

    The type is the default in both directions where there is none, and the distance reaches to the edge.
    """
    ordered = Window.partitionBy(*partition).orderBy(order)
    upto, onward = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    mark = F.when(F.col(kind).isNotNull(), F.struct(F.col(kind).alias("kind"), F.col("_row").alias("row"), F.col("_sum").alias("sum")))
    total = F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.withColumns({"_row": F.row_number().over(ordered), "_sum": total, "_rows": F.count(F.lit(1)).over(Window.partitionBy(*partition)), "_all": F.sum(weight).over(Window.partitionBy(*partition))})
    found = numbered.withColumns({"_prev": F.last(mark, ignorenulls=True).over(upto), "_next": F.first(mark, ignorenulls=True).over(onward)})
    return found.withColumns(
        {
            "prev_kind": F.coalesce("_prev.kind", F.lit(default)),
            "prev_rows": F.col("_row") - F.coalesce("_prev.row", F.lit(0)),
            "prev_weight": F.col("_sum") - F.coalesce("_prev.sum", F.lit(0)),
            "next_kind": F.coalesce("_next.kind", F.lit(default)),
            "next_rows": F.coalesce(F.col("_next.row"), F.col("_rows") + 1) - F.col("_row"),
            "next_weight": F.coalesce(F.col("_next.sum"), F.col("_all")) - F.col("_sum"),
        }
    ).drop("_row", "_sum", "_rows", "_all", "_prev", "_next")


def distance_to_flag(df: DataFrame, flag: Column, partition: list[str], order: str) -> DataFrame:
    """prev_flag, next_flag: rows to the nearest flagged row on each side within the partition, the row itself counting as 0; -1 for none."""
    ordered = Window.partitionBy(*partition).orderBy(order)
    number = F.row_number().over(ordered)
    at = df.withColumn("_n", number).withColumn("_f", F.when(flag, F.col("_n")))
    prev = F.last("_f", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("_f", ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return at.withColumns({"prev_flag": F.coalesce(F.col("_n") - prev, F.lit(-1)), "next_flag": F.coalesce(following - F.col("_n"), F.lit(-1))}).drop("_n", "_f")


def fill_gaps(df: DataFrame, value: str, partition: list[str], order: str, position: str) -> DataFrame:
    """<value>_filled: zeros between two non-zero values are interpolated linearly by position; leading and trailing ones stay."""
    ordered = Window.partitionBy(*partition).orderBy(order)
    known = F.when(F.col(value) != 0, F.struct(F.col(position).cast("double").alias("x"), F.col(value).alias("y")))
    found = df.withColumns({"_a": F.last(known, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(known, ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))})
    share = (F.col(position) - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    between = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * share
    return found.withColumn(f"{value}_filled", F.when(F.col(value) != 0, F.col(value)).otherwise(F.coalesce(between, F.lit(0.0)))).drop("_a", "_b")


def running_total(value: str, partition: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def offset_before(value: str, partition: list[str], order: list[str]) -> Column:
    """Sum of the values of all earlier rows; 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def deltas(value: str, window: WindowSpec) -> tuple[Column, Column]:
    """First and second differences with windows (-1/2, 0, 1/2) and (1, -2, 1); rows outside repeat the edge."""
    prev, following = F.coalesce(F.lag(value).over(window), F.col(value)), F.coalesce(F.lead(value).over(window), F.col(value))
    return (following - prev) / 2, prev - 2 * F.col(value) + following


def after_first_sound(value: Column, window: WindowSpec) -> Column:
    """Whether a non-zero value has been seen, the row's own included: a filter on it trims leading silence."""
    return F.max(F.abs(value)).over(window.rowsBetween(Window.unboundedPreceding, 0)) > 0


def receptive_field(value: str, window: WindowSpec, length: int) -> Column:
    """The last `length` values up to this row, padded with zeros in front."""
    held = F.collect_list(F.col(value).cast("double")).over(window.rowsBetween(1 - length, 0))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - F.size(held)), held)


def islands(df: DataFrame, breaks: Column, partition: list[str], order: str, name: str = "island") -> DataFrame:
    """Number of breaks up to the row: rows of a run between breaks share it."""
    return df.withColumn(name, F.sum(breaks.cast("int")).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def syllable_breaks(label: str, window: WindowSpec) -> Column:
    """A syllable starts where a label repeats the one before it, and at an onset (O...) after a nucleus or coda (N..., C...); a word's first letter starts none."""
    prev = F.lag(label, 1).over(window)
    return F.coalesce((F.col(label) == prev) | (F.col(label).startswith("O") & prev.rlike("^[NC]")), F.lit(False))
