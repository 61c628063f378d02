"""String functions for labels and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SYLLABLE = "[^aeiouyAEIOUY]*[aeiouyAEIOUY]+(?:[^aeiouyAEIOUY]+\\z)?|[^aeiouyAEIOUY]+\\z"


def syllables(word: Column) -> Column:
    """Syllables by a vowel rule: consonants go with the vowel after them, the last ones with the one before."""
    return F.regexp_extract_all(word, F.lit(SYLLABLE), F.lit(0))


def ascii_only(text: Column) -> Column:
    """Printable ASCII without backslash escapes (a backslash and up to three characters after it), trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7e]", ""), r"\\.{0,3}", ""))


def label_phone(label: Column) -> Column:
    """The phone of a full-context label: what stands between - and +."""
    return F.regexp_extract(label, r"-([^+]*)\+", 1)


def label_context(label: Column) -> Column:
    """The context fields of a label: what follows the first colon's key, split at slashes."""
    return F.split(F.regexp_replace(label, r"^[^:]*:", ""), "/")


def render_label(center: list[Column], fields: dict[str, Column]) -> Column:
    """A full-context label: pp^p-c+n=nn and then /KEY:VALUE pairs; a null value prints as nothing."""
    pp, p, c, n, nn = (F.coalesce(x.cast("string"), F.lit("")) for x in center)
    pairs = [x for k, v in fields.items() for x in (F.lit(f"/{k}:"), F.coalesce(v.cast("string"), F.lit("")))]
    return F.concat(pp, F.lit("^"), p, F.lit("-"), c, F.lit("+"), n, F.lit("="), nn, *pairs)


def training_line(feats: Column, label: Column, prefix: str = "cl:") -> Column:
    """Features with the prefix, then the label, blank-separated."""
    return F.concat_ws(" ", F.filter(feats, lambda f: f.startswith(prefix)), label)


def underscored(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def half_up(x: Column, scale: int = 0) -> Column:
    return F.round(x, scale)


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")
