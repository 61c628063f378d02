"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one piece run from a queue that keeps a bucket of linked-list positions for every merge
rank and a three-level bitmap over the ranks. Find-first-set on the bitmap gives the next rank in
a constant number of steps, so a piece of n bytes costs O(n log n) whatever its length; an entry
whose pair has changed since it was queued is stale and is skipped when it comes up.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import give_back, map_batches

SHIFT = 6


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Positions by rank; the lowest rank first, then the lowest position.

    encode_piece works on the levels in place: a call for every push and pop would take longer than the pushes and pops.
    """

    def __init__(self, n_ranks: int) -> None:
        self.low = [0] * ((n_ranks >> SHIFT) + 1)
        self.mid = [0] * ((len(self.low) >> SHIFT) + 1)
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]


class PieceCache:
    """What single pieces give, kept between blocks of texts. Beyond `limit`, pieces that don't come back go; this bounds memory and changes no result."""

    def __init__(self, encode_block, limit: int = 150_000, longest: int = 256) -> None:
        self.encode_block, self.limit, self.longest = encode_block, limit, longest
        self.recent: dict = {}
        self.older: dict = {}
        self.passing: list[str] = []

    def of_block(self, found: list[list[str]]) -> dict:
        """What each piece of these texts gives, until the next block; pieces that are new are encoded together."""
        for piece in self.passing:
            del self.recent[piece]
        if len(self.recent) >= self.limit:
            self.older, self.recent = self.recent, {}
        seen: set[str] = set()
        for pieces in found:
            seen.update(pieces)
        recent, older, new = self.recent, self.older, []
        for piece in seen.difference(recent):
            given = older.get(piece)
            if given is None:
                new.append(piece)
            else:
                recent[piece] = given
        new.sort()
        given = zip(new, self.encode_block([p.encode() for p in new]), strict=True)
        recent.update(given)
        self.passing = [piece for piece in new if len(piece) > self.longest]
        return recent

    def drop(self) -> None:
        """Let go what is kept, at the end of a task: the process lives on and serves other operators."""
        self.recent, self.older, self.passing = {}, {}, []


class BpeCodec:
    """Encodes text as the tiktoken library does for the same ranks and pattern, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.queue = RankQueue(max(self.tokens, default=0) + 1)
        self.find = regex.compile(pattern).findall
        self.pieces = PieceCache(self.encode_block)
        # Flat arrays: some hundred thousand tuples would leave the worker's memory full of holes for as long as it lives.
        keys, merged = array("q"), array("i")
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        pair_keys = np.array(keys, np.int64)
        order = np.argsort(pair_keys)
        self.pair_keys = np.append(pair_keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(merged, np.int32)[order], np.int32(-1))
        self.byte_ranks = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        low, mid, buckets, lengths, rank_of = self.queue.low, self.queue.mid, self.queue.buckets, self.lengths, ranks.get
        n, top = len(piece), 0
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        found = [(rank_of(piece[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for rank, i in found:
                if rank is None:
                    continue
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, i)
                    continue
                bucket.append(i)
                word = rank >> 6
                bits = low[word]
                low[word] = bits | 1 << (rank & 63)
                if not bits:
                    block = word >> 6
                    mid[block] |= 1 << (word & 63)
                    top |= 1 << block
            while top:
                block = (top & -top).bit_length() - 1
                bits = mid[block]
                word = block << 6 | (bits & -bits).bit_length() - 1
                bits = low[word]
                bit = bits & -bits
                rank = word << 6 | bit.bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    low[word] = bits ^ bit
                    if bits == bit:
                        mid[block] ^= 1 << (word & 63)
                        if not mid[block]:
                            top ^= 1 << block
                middle = after[i]
                if 0 < middle < n and after[middle] - i == lengths[rank]:
                    break
            else:
                break
            end = after[i] = after[middle]
            after[middle] = -1
            before[end] = i
            j = before[i]
            found = [(rank_of(piece[i : after[end]]), i)] if end < n else []
            if j >= 0:
                found.append((rank_of(piece[j:end]), j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbouring tokens, -1 if it doesn't merge; right is -1 at the end of a piece."""
        keys = np.where(right < 0, -1, left.astype(np.int64) << 32 | right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(-1))

    def encode_block(self, pieces: list[bytes], small: int = 64) -> list[bytes]:
        """Packed ids of many pieces, merged in step: a bucket holds the positions of a rank in all of them.

        A step takes the lowest rank, skips stale positions and merges the first that is left of each piece, so every
        piece goes through the merges that it would go through alone. Long pieces do go alone.
        """
        ranks = self.ranks
        out = [self.pack([ranks[p]]) if p in ranks else self.pack(self.encode_piece(p)) if len(p) > small else b"" for p in pieces]
        todo = [i for i, x in enumerate(out) if not x and pieces[i]]
        if not todo:
            return out
        lengths = np.array([len(pieces[i]) for i in todo])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        piece = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        token = np.append(self.byte_ranks[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[ends - lengths] = n
        pair = self.rank_of_pairs(token[:-1], token[after[:-1]])
        low, mid, top, buckets = [0] * len(self.queue.low), [0] * len(self.queue.mid), 0, defaultdict(list)
        alive = np.ones(n, bool)
        fresh = np.arange(n)
        while True:
            fresh = fresh[pair[fresh] >= 0]
            if len(fresh) == 1:
                groups = ((int(pair[fresh[0]]), fresh),)
            else:
                found = pair[fresh]
                by_rank = np.lexsort((fresh, found))
                fresh, found = fresh[by_rank], found[by_rank]
                edges = np.flatnonzero(found[1:] != found[:-1]) + 1
                groups = zip(found[np.concatenate(([0], edges))].tolist(), np.split(fresh, edges), strict=True) if len(fresh) else ()
            for rank, positions in groups:
                buckets[rank].append(positions)
                low[rank >> 6] |= 1 << (rank & 63)
                mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                top |= 1 << (rank >> 12)
            if not top:
                break
            block = (top & -top).bit_length() - 1
            word = block << 6 | (mid[block] & -mid[block]).bit_length() - 1
            rank = word << 6 | (low[word] & -low[word]).bit_length() - 1
            held = buckets[rank]
            held = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            held = held[pair[held] == rank]
            of = piece[held]
            first = np.ones(len(held), bool)
            first[1:] = of[1:] != of[:-1]
            if first.all():
                del buckets[rank]
                low[word] ^= 1 << (rank & 63)
                if not low[word]:
                    mid[block] ^= 1 << (word & 63)
                    if not mid[block]:
                        top ^= 1 << block
            else:
                buckets[rank] = [held[~first]]
                held = held[first]
            gone = after[held]
            end = after[gone]
            token[held], after[held], before[end], pair[gone], alive[gone] = rank, end, held, -1, False
            ahead = before[held]
            fresh = np.concatenate((held, ahead[ahead < n]))
            pair[fresh] = self.rank_of_pairs(token[fresh], token[after[fresh]])
        kept = np.flatnonzero(alive)
        packed = token[kept].astype("<u4").tobytes()
        stops = np.searchsorted(kept, ends).tolist()
        for i, start, stop in zip(todo, [0, *stops], stops, strict=False):
            out[i] = packed[4 * start : 4 * stop]
        return out

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        found = [self.find(text) for text in texts]
        of_piece = self.pieces.of_block(found).__getitem__
        return [b"".join(map(of_piece, pieces)) for pieces in found]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BpeCodec:
    return BpeCodec(load_ranks(path), pattern)


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: str, shown) -> DataFrame:
    """doc_id, n_tokens and what `shown` makes of the packed ids and the decoded bytes of each text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode_texts([text or "" for text in part.column("text").to_pylist()])
                made = [shown(x, bpe.decode(np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([x for x, _ in made]), pa.array([x for _, x in made])], ["doc_id", "n_tokens", "ids", "decoded"])
        bpe.pieces.drop()
        give_back()

    return map_batches(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids {schema}, decoded {schema}")


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (the id column), n_tokens, ids (binary, little-endian uint32), decoded (binary).

    A null text counts as empty: no tokens, empty bytes. A very long text is encoded whole; one very long piece costs
    O(n log n). Repeated rows are encoded each. Other columns are not read. An empty table gives no rows.
    """
    return _encoded(docs, path, pattern, id_col, text_col, "binary", lambda ids, decoded: (ids, decoded))


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what bpe_encode gives, hashed where it is made, so neither ids nor bytes travel."""
    hashed = _encoded(docs, path, pattern, id_col, text_col, "string", lambda ids, decoded: (sha256(ids), sha256(decoded)))
    return hashed.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def slices(batch: pa.RecordBatch, texts: pa.Array | None = None, text_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, a row at least, so that what is made of their texts stays small beside the executor's memory."""
    texts = batch.column("text") if texts is None else texts
    ends = np.cumsum(pa.compute.coalesce(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + text_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
