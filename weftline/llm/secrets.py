"""Secret scans through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must
hold. A block of documents is indexed by trigram (only trigrams that some query names), the queries
are answered by intersecting and uniting posting lists, and the rule runs on the documents that
remain. A rule without a mandatory trigram runs on every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import sha256, slices


@dataclass(frozen=True)
class Rule:
    """kind, pattern, flags; `accept` drops matches that it refuses after they were matched."""

    kind: str
    pattern: str
    flags: int = 0
    accept: Callable[[re.Match], bool] = lambda m: True
    base: bool = False

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)

    @cached_property
    def query(self):
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if self.accept(m)]


#: The base kinds in the order of the contract, then kinds of our own. Fixed values.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, lambda m: len(m[2]) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20, True),
    Rule("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

ALL = ("all",)
WIDEST = 32


def trigram_query(pattern: str):
    """A query that every match of the pattern satisfies, over trigrams of its bytes with A-Z in lower case.

    ALL, a trigram, ("and", ...) or ("or", ...).
    """
    return simplify(_sequence(sre_parser.parse(pattern)))


def _of_strings(strings: set[bytes]):
    """Some string of the set occurs: all trigrams of one of them. ALL if one is too short to have any."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return ("or", *(("and", *(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _exact(op, arg) -> set[bytes] | None:
    """The strings that a node can match, lower-cased, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower().encode()} if arg < 128 else None
    if op is sre.IN:
        found: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                found.add(chr(value).lower().encode())
            elif kind is sre.RANGE and value[1] < 128:
                found |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_sequence(x) for x in arg[1]]
        return set().union(*parts) if all(x is not None for x in parts) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 1:
        inner = _exact_sequence(arg[2])
        return None if inner is None else inner | ({b""} if arg[0] == 0 else set())
    if op is sre.AT:
        return {b""}
    return None


def _exact_sequence(nodes) -> set[bytes] | None:
    strings = {b""}
    for op, arg in nodes:
        inner = _exact(op, arg)
        if inner is None or len(strings) * len(inner) > WIDEST:
            return None
        strings = {s + x for s in strings for x in inner}
    return strings


def _node(op, arg):
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        return ("or", *(_sequence(x) for x in arg[1]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _sequence(arg[2])
    return ALL


def _sequence(nodes):
    parts, strings = [], {b""}
    for op, arg in nodes:
        inner = _exact(op, arg)
        if inner is None:
            parts += [_of_strings(strings), _node(op, arg)]
            strings = {b""}
        elif len(strings) * len(inner) > WIDEST:
            parts.append(_of_strings(strings))
            strings = inner
        else:
            strings = {s + x for s in strings for x in inner}
    return ("and", *parts, _of_strings(strings))


def simplify(query):
    if isinstance(query, bytes) or query == ALL:
        return query
    parts = list(dict.fromkeys(simplify(x) for x in query[1:]))
    if query[0] == "and":
        parts = [x for x in parts if x != ALL]
    elif ALL in parts:
        return ALL
    return ALL if not parts else parts[0] if len(parts) == 1 else (query[0], *parts)


def trigrams_in(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_in(x) for x in query[1:]))


class TrigramIndex:
    """Posting lists, for the wanted trigrams, of a block of documents given as one buffer and its offsets."""

    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[65:91] += 32
    WINDOW = 1 << 22

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> None:
        """wanted: a flag for each of the 2**24 trigrams."""
        self.n = len(offsets) - 1
        grams, docs = [], []
        for at in range(int(offsets[0]), int(offsets[-1]) - 2, self.WINDOW):
            low = self.LOWER[data[at : min(at + self.WINDOW + 2, int(offsets[-1]))]].astype(np.uint32)
            codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            hits = np.flatnonzero(wanted[codes])
            doc = np.searchsorted(offsets, hits + at, "right") - 1
            whole = hits + at + 3 <= offsets[doc + 1]
            grams.append(codes[hits[whole]])
            docs.append(doc[whole])
        code = np.unique((np.concatenate(grams).astype(np.int64) if grams else np.empty(0, np.int64)) << 32 | (np.concatenate(docs) if docs else np.empty(0, np.int64)))
        keys, starts = np.unique(code >> 32, return_index=True)
        self.postings = dict(zip(keys.tolist(), np.split(code & 0xFFFFFFFF, starts[1:]), strict=True)) if len(keys) else {}

    def answer(self, query) -> np.ndarray:
        """Sorted numbers of the documents that satisfy the query."""
        if query == ALL:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.empty(0, np.int64))
        found = self.answer(query[1])
        for part in query[2:]:
            if query[0] == "and" and not len(found):
                break
            found = (np.intersect1d if query[0] == "and" else np.union1d)(found, self.answer(part))
        return found


def scan_block(texts: pa.Array, rules: tuple[Rule, ...], wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its spans as (start, rule number, end) in order."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    index = TrigramIndex(data, offsets, wanted)
    strings, found = texts.to_pylist(), [[] for _ in range(len(texts))]
    for number, rule in enumerate(rules):
        for doc in index.answer(rule.query).tolist():
            found[doc] += [(start, number, end) for start, end in rule.spans(strings[doc] or "")]
    return [sorted(x) for x in found]


def wanted_trigrams(rules: tuple[Rule, ...]) -> np.ndarray:
    flags = np.zeros(1 << 24, bool)
    for gram in set().union(*(trigrams_in(rule.query) for rule in rules)):
        flags[int.from_bytes(gram, "big")] = True
    return flags


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_<kind> long of every base rule, base_sha256, spans.

    A span is kind:start:end in code points, end exclusive; spans are ordered by start, then by the rules' order, and
    comma-joined. base_sha256 is the digest of the base rules' spans alone. A null or empty text has no spans, so the
    digest of the empty string. A very long text is scanned whole. Repeated rows are scanned each. Other columns are not
    read. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = [i for i, rule in enumerate(rules) if rule.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = wanted_trigrams(rules)
        for batch in batches:
            for part in slices(batch):
                found = scan_block(part.column("text").cast(pa.string()), rules, wanted)
                shown = [[(i, f"{rules[i].kind}:{start}:{end}") for start, i, end in spans] for spans in found]
                counts = [pa.array([sum(i == k for i, _ in spans) for spans in shown], pa.int64()) for k in base]
                digest = [sha256(",".join(x for i, x in spans if rules[i].base).encode()) for spans in shown]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(digest), pa.array([",".join(x for _, x in spans) for spans in shown], pa.string())],
                    ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"],
                )

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"n_{rules[k].kind} long" for k in base), "base_sha256 string", "spans string"]))
