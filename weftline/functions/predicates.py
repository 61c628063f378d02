"""Column predicates over words: punctuation, capitals, numbers, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _full(word: Column, pattern: str) -> Column:
    return word.rlike(f"^(?:{pattern})$") & ~word.contains("\n")


def is_punct(word: Column) -> Column:
    """Exactly one ASCII punctuation mark; `...` and an en dash are not."""
    return _full(word, r"\p{Punct}")


def is_mark(char: Column) -> Column:
    """Exactly one character that is neither a letter nor a decimal digit."""
    return (F.char_length(char) == 1) & char.rlike(r"^[^\p{L}\p{Nd}]")


def has_mark(word: Column) -> Column:
    return word.rlike(r"[^\p{L}\p{Nd}]")


def only_marks(word: Column) -> Column:
    """No letter or digit at all; true for an empty word."""
    return ~word.rlike(r"[\p{L}\p{Nd}]")


def ends_with_mark(word: Column) -> Column:
    return F.substring(word, -1, 1).rlike(r"[^\p{L}\p{Nd}]")


def first_is_capital(word: Column) -> Column:
    """The first character is its own upper case and not its own lower case."""
    first = F.substring(word, 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def all_capitals(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def many_capitals(word: Column) -> Column:
    """At least two characters equal their own upper case; digits and marks count."""
    return F.size(F.filter(F.split(word, ""), lambda c: (c != "") & (c == F.upper(c)))) >= 2


def first_char(word: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(word, 1, 1), F.lit("")), F.lit("_"))


def last_char(word: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(word, -1, 1), F.lit("")), F.lit("_"))


def is_numeric(word: Column) -> Column:
    """Digits once dots, commas and hyphens are removed."""
    return F.regexp_replace(word, "[.,-]", "").rlike(r"^\d+$")


def is_label_token(word: Column) -> Column:
    """Words that labels are made of: everything but ASCII punctuation, and of that . , ! ?"""
    return ~is_punct(word) | word.isin(".", ",", "!", "?")


def is_quote(word: Column) -> Column:
    return word.isin('"', "``", "''")


def is_comment(line: Column) -> Column:
    return F.trim(line).startswith("#")


def is_real_phone(phone: Column) -> Column:
    return ~phone.startswith("#")


def lexicon_entry_usable(word: Column, suffix_length: Column, limit: int = 8) -> Column:
    return (suffix_length < limit) & ~word.contains("_")


def first_match(value: Column, cascade: list[tuple[str, Column]], default: Column) -> Column:
    """The result of the first pattern, in order, that the value holds."""
    found = None
    for pattern, result in cascade:
        found = F.when(value.rlike(pattern), result) if found is None else found.when(value.rlike(pattern), result)
    return found.otherwise(default) if found is not None else default


def question_regex(pattern: str, skip_final: bool = False) -> str:
    """A context question as a regular expression: * stands for exactly one character, and it may match anywhere.

    skip_final leaves out the match that ends with the value, as older label matchers did.
    """
    body = "".join("." if c == "*" else re.escape(c) for c in pattern)
    return f"(?s){body}." if skip_final else f"(?s){body}"


def answers_question(value: Column, patterns: list[str], skip_final: bool = False) -> Column:
    """Whether any of the question's patterns occurs in the value. One with * at its ends alone is sought as it stands, that many characters from the value's ends; others are regular expressions."""
    found, rest = None, []
    for p in patterns:
        core, before = p.strip("*"), len(p) - len(p.lstrip("*"))
        if not core or "*" in core:
            rest.append(p)
            continue
        after = len(p) - len(p.rstrip("*")) + skip_final
        at = F.substring(value, F.lit(before + 1), F.char_length(value) - before - after) if before or after else value
        found = at.contains(core) if found is None else found | at.contains(core)
    if rest:
        by_regex = value.rlike("|".join(f"(?:{question_regex(p, skip_final)})" for p in rest))
        found = by_regex if found is None else found | by_regex
    return F.lit(False) if found is None else found
