"""Exact token counts at every prefix, by dynamic programming over the prefixes of each piece.

In byte-pair encoding the tokens before the last one are themselves the encoding of the bytes before
it, and a sequence is an encoding exactly when each two neighbours, encoded together, stay as they
are. So the last token of every prefix follows from the last tokens of shorter prefixes: of the
vocabulary entries that end there, the one that stays beside the last token of what precedes it.
The count at a prefix is the count before that token plus one. The table answers truncation and
budget questions about a text without encoding it again.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import PieceCache, slices


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        special = {t["content"] for t in spec["added_tokens"]}
        self.token = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = as_bytes(a), as_bytes(b)
            self.merges[self.token[left], self.token[right]] = rank, self.token[left + right]
        self.bytes_of = {i: t for t, i in self.token.items()}
        self.longest = max(map(len, self.token))
        self.stays: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(pattern).findall
        self.counts = PieceCache(self.count_block)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pair_stays(self, left: int, right: int) -> bool:
        """Whether the two tokens, as one string, encode to just themselves."""
        found = self.stays.get((left, right))
        if found is None:
            if len(self.stays) >= 300_000:
                self.stays.clear()
            found = self.stays[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of a short string, lowest rank first and leftmost within a rank."""
        ids = [self.token[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            known = [(self.merges[pair][0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.merges]
            if not known:
                break
            at = min(known)[1]
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., piece."""
        last, count = [-1], [0]
        self.extend(piece, last, count)
        return count[1:] or [0]

    def extend(self, piece: bytes, last: list[int], count: list[int]) -> None:
        """Continue the table of a prefix of the piece, its last tokens and counts, to the whole piece."""
        token, stays, longest = self.token.get, self.stays, self.longest
        for end in range(len(last), len(piece) + 1):
            for start in range(max(0, end - longest), end):
                right = token(piece[start:end])
                if right is None:
                    continue
                if not start:
                    break
                pair = last[start], right
                if stays[pair] if pair in stays else self.pair_stays(*pair):
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(right)
            count.append(count[start] + 1)

    def count_block(self, pieces: list[bytes]) -> list[int]:
        """Token counts of sorted pieces; each continues the table of the prefix that it shares with the one before."""
        out, last, count, held = [], [-1], [0], b""
        for piece in pieces:
            shared = len(os.path.commonprefix((held, piece)))
            del last[shared + 1 :], count[shared + 1 :]
            self.extend(piece, last, count)
            held = piece
            out.append(count[-1])
        return out

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text between special tokens, and those tokens."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def count_texts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut = [[(1, []) if special else (0, self.find(part)) for special, part in self.parts(text)] for text in texts]
        of_piece = self.counts.of_block([pieces for parts in cut for _, pieces in parts]).__getitem__
        return [sum(n + sum(map(of_piece, pieces)) for n, pieces in parts) for parts in cut]

    def count(self, text: str) -> int:
        return self.count_texts([text])[0]

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Token counts of every prefix of one text; prefixes are given as numbers of code points."""

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        self.counter, self.text = counter, text
        self.asked: dict[int, list[int]] = {}
        self.starts, self.before, at, total = [0], [0], 0, 0
        parts = [(special, [part] if special else counter.find(part)) for special, part in counter.parts(text)]
        of_piece = counter.counts.of_block([pieces for special, pieces in parts if not special])
        self.specials: set[int] = set()
        for special, pieces in parts:
            for piece in pieces:
                if special:
                    self.specials.add(len(self.starts) - 1)
                at += len(piece)
                total += 1 if special else of_piece[piece]
                self.starts.append(at)
                self.before.append(total)

    def count_at(self, n_chars: int) -> int:
        """Tokens of text[:n_chars]. Only the end of the prefix, where its pieces can differ from the text's, is cut anew.

        A new piece that a piece of the text begins with has its count in that piece's table.
        """
        n_chars = min(max(n_chars, 0), len(self.text))
        k = max(0, bisect_right(self.starts, n_chars) - 3)
        at, total, new = self.starts[k], self.before[k], []
        for special, part in self.counter.parts(self.text[at:n_chars]):
            for piece in [part] if special else self.counter.find(part):
                own = bisect_right(self.starts, at) - 1
                if special:
                    total += 1
                elif self.starts[own] == at and at + len(piece) <= self.starts[own + 1] and own not in self.specials:
                    total += self.counts_in(own)[len(piece) - 1]
                else:
                    new.append(piece)
                at += len(piece)
        return total + sum(map(self.counter.counts.of_block([new]).__getitem__, new))

    def counts_in(self, number: int) -> list[int]:
        """Token counts of a piece's prefixes of 1, 2, ... code points; made when it is first asked for."""
        found = self.asked.get(number)
        if found is None:
            piece = self.text[self.starts[number] : self.starts[number + 1]]
            counts, at, found = self.counter.prefixes(piece.encode()), 0, []
            for c in piece:
                at += len(c.encode())
                found.append(counts[at - 1])
            self.asked[number] = found
        return found

    def truncate(self, budget: int) -> int:
        """The longest prefix that has at most budget tokens, as a number of code points.

        Counts can fall where a prefix grows, so the candidates are tried from the longest on. None is longer than three
        pieces after the first that is over the budget, nor has more code points than the budget's tokens can have bytes.
        """
        if self.fits(budget):
            return len(self.text)
        over = bisect_right(self.before, budget)
        sure = max(0, over - 3)
        top = self.starts[over + 2] - 1 if over + 2 < len(self.starts) else len(self.text)
        top = min(top, max(self.starts[sure] + (budget - self.before[sure]) * self.longest, self.starts[over - 1]))
        return next((n for n in range(top, 0, -1) if self.count_at(n) <= budget), 0)

    @cached_property
    def longest(self) -> int:
        """The most code points that a token can have."""
        return max([self.counter.longest, *(self.starts[i + 1] - self.starts[i] for i in self.specials)])

    def fits(self, budget: int) -> bool:
        return self.before[-1] <= budget


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A very long text is counted whole, piece by piece. Repeated rows are
    counted each. Other columns are not read. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for batch in batches:
            for part in slices(batch):
                n = tokens.count_texts([text or "" for text in part.column("text").to_pylist()])
                size = pa.compute.coalesce(pa.compute.binary_length(part.column("text")), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.compute.cast(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        tokens.counts.drop()

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _by_table(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, made) -> DataFrame:
    """doc_id and the values that `made` takes from each text's PrefixTable."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for batch in batches:
            for part in slices(batch):
                found = [made(tokens.table(text or "")) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in zip(*found, strict=True))], ["doc_id", *names])
        tokens.counts.drop()

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, {schema}")


def prefix_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts: the tokens of the text's prefixes of 0, 1, 2, ... code points. Rows as in token_counts."""
    return _by_table(docs, path, pattern, id_col, text_col, "counts array<bigint>", lambda t: ([t.count_at(n) for n in range(len(t.text) + 1)],))


def truncated(docs: DataFrame, path: str, pattern: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, kept_chars, kept_tokens, kept: the longest prefix of each text that has at most budget tokens. Rows as in token_counts."""

    def cut(t: PrefixTable) -> tuple[int, int, int, str]:
        n = t.truncate(budget)
        return t.before[-1], n, t.count_at(n), t.text[:n]

    return _by_table(docs, path, pattern, id_col, text_col, "n_tokens bigint, kept_chars bigint, kept_tokens bigint, kept string", cut)
