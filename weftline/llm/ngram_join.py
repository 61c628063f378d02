"""Jaccard self-join of documents on word n-grams with R-trees over count vectors.

A document's shingles are hashed; the hashes are dealt to groups, and the counts by group are the document's
point. Two sets share at most the sum over the groups of the smaller count, so a tree over points, whose nodes
keep the largest count of each group below them, answers which sets a given one can still be linked to. What
survives is verified on the sets themselves.

One tree over all documents would be visited almost everywhere, since points of unrelated documents of one size are
about equally far apart (README has the shares). So documents are first brought together by exact signatures of
groups: linked sets differ in at most D shingles, so of more than D groups at least one holds the same shingles in
both. Sets that agree on several groups are much alike: they share a home, within which trees are built in blocks of bounded
number and bytes. Of the sets that agree on a group, those of other homes than its least set's are that home's guests:
as texts with a passage in common are. Guests and hosts are compared by trees over their points alone, and pairs that
the bound lets pass are verified one by one. So a passage that many documents share never puts all of them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.bpe import slices
from weftline.llm.common import NO_ID, give_back, join_groups, keep_marked, key_counts, map_batches, materialize, release, row_keys, small
from weftline.llm.components import components

#: op8's rule: shingles of N words, links where 100 * intersection >= PERCENT * union.
N, PERCENT = 4, 85
GROUPS = 64
LEAF = 32
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Sets that agree on so many groups share a home. Any number gives the same links.
ALIKE = 4

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words; emptied at a limit, to bound memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str, hashes: Words, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles. bytes.lower and bytes.split know just A-Z and the six blanks."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total + h[i : len(words) - width + 1 + i]) * _GOLD
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))


def enough(both: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets link that share `both` and whose sizes sum to `sizes`: 100 * both >= percent * (sizes - both)."""
    return (100 + percent) * both >= percent * sizes


@lru_cache(maxsize=None)
def size_classes(percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of size classes; the sizes of two linked sets are in one class or in two that follow each other."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds)


@lru_cache(maxsize=None)
def scheme(k: int, percent: int = PERCENT) -> tuple[int, int]:
    """(D, groups): how many shingles a linked pair whose smaller set is of class k can differ in, and how many groups to sign."""
    x = int(size_classes(percent)[k + 1]) - 1
    differ = (100 - percent) * (x + x * 100 // percent) // (100 + percent)
    return differ, -(-29 * (differ + 1) // 20)


def signatures(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys such that any two linked, different sets have one in common.

    Of a scheme's groups at most D differ between linked sets. A set signs the groups that hold at least t shingles, t as
    large as leaves more than D of them; whichever of two linked sets has the larger t, a group that agrees is among its
    signed ones, and the other set, whose t is no larger, signs it too.
    """
    if not len(h):
        return np.empty(0, np.uint64)
    k = int(np.searchsorted(size_classes(percent), len(h), "right")) - 1
    content, out = mix(h + _GOLD), []
    for c in (k, k - 1) if k else (k,):
        differ, groups = scheme(c, percent)
        if not differ:
            continue
        of = ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        sizes = np.bincount(of, minlength=groups)
        least = np.partition(sizes, groups - differ - 1)[groups - differ - 1]
        starts = np.cumsum(sizes) - sizes
        sums = np.zeros(groups, np.uint64)
        held = sizes > 0
        sums[held] = np.add.reduceat(content, starts[held])
        signed = np.flatnonzero(sizes >= least)
        out.append(mix(sums[signed] + (signed.astype(np.uint64) + np.uint64(c << 40)) * _GOLD))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_id(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sid(identity: bytes) -> int:
    return int.from_bytes(identity[:8], "little", signed=True)


def signed_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """key, sid: the keys of every set, once a task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = set(), Words()
        for batch in batches:
            for part in slices(batch):
                keys, sids = [], []
                for text in part.column("text").to_pylist():
                    h = shingles(text or "", words, n)
                    if len(h) and (sid := _sid(set_id(h))) not in seen:
                        seen.add(sid)
                        keys.append(signatures(h, percent))
                        sids.append(sid)
                if len(seen) > 200_000:
                    seen.clear()
                if keys:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), [len(x) for x in keys]))], ["key", "sid"])
        del seen, words
        give_back()

    return map_batches(docs.select("text"), run, "key long, sid long")


def agreements(signed: DataFrame) -> DataFrame:
    """u, v, n: each set beside the least set of each key that it shares with others, and how many keys they so share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            key, sid = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
            again[0] = last == (key[0], sid[0])
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            firsts = sid[new]
            if last is not None and key[0] == last[0]:
                firsts[0] = least
            first = firsts[np.cumsum(new) - 1]
            last, least = (key[-1], sid[-1]), first[-1]
            beside = (sid != first) & ~again
            if beside.any():
                pairs, n = np.unique(np.stack((sid[beside], first[beside]), 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], ["u", "v", "n"])
        give_back()

    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = map_batches(signed.repartition(n, "key").sortWithinPartitions("key", "sid"), run, "u long, v long, n long")
    return rows.groupBy("u", "v").agg(F.sum("n").alias("n"))


def document_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (null for an empty set), sid (its first 64 bits), size_class, point (the packed counts by group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in (part for batch in batches for part in slices(batch)):
            sizes, ids, points = [], [], []
            for text in part.column("text").to_pylist():
                h = shingles(text or "", words, n)
                sizes.append(len(h))
                ids.append(set_id(h) if len(h) else None)
                points.append(packed(count_vector(h)) if len(h) else None)
            of_size = np.searchsorted(size_classes(percent), sizes, "right")
            arrays = [part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([_sid(x) if x else None for x in ids], pa.int64()), pa.array(of_size, pa.int32()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "set_id", "sid", "size_class", "point"])
        del words
        give_back()

    return map_batches(docs.select("doc_id", "text", row_keys()[1]), run, "doc_id long, text_hash long, n_shingles long, set_id binary, sid long, size_class int, point binary")


class CountTree:
    """An R-tree over count vectors: leaves of sets next to each other in size, nodes with the largest counts below them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF, percent: int = PERCENT) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(sizes), leaf)
        self.leaves = [(int(s), int(min(s + leaf, len(sizes)))) for s in starts]
        self.levels = []
        top = np.maximum.reduceat(self.points, starts, axis=0) if len(sizes) else self.points
        least = self.sizes[starts] if len(sizes) else self.sizes
        self.levels.append((top, least))
        while len(top) > leaf:
            starts = np.arange(0, len(top), leaf)
            top, least = np.maximum.reduceat(top, starts, axis=0), least[starts]
            self.levels.append((top, least))
        self.leaf, self.percent = leaf, percent

    def can_link(self, points: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
        """Whether the bound on the overlap lets point i be linked to other j (for a node: to something below it)."""
        bound = np.empty((len(points), len(others)), np.int64)
        for i, point in enumerate(points):
            bound[i] = np.minimum(point, others).sum(1)
        return enough(bound, sizes[:, None] + other_sizes[None, :], self.percent)

    def candidates(self, points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of queries, numbers of stored sets) that the bounds let pass, leaf by leaf."""
        top, least = self.levels[-1]
        reach = self.can_link(points, sizes, top, least)
        for top, least in reversed(self.levels[:-1]):
            parent = np.arange(len(top)) // self.leaf
            below = np.zeros((len(points), len(top)), bool)
            for p in range(reach.shape[1]):
                asked, inner = np.flatnonzero(reach[:, p]), np.flatnonzero(parent == p)
                if len(asked):
                    below[np.ix_(asked, inner)] = self.can_link(points[asked], sizes[asked], top[inner], least[inner])
            reach = below
        for number, (start, stop) in enumerate(self.leaves):
            asked = np.flatnonzero(reach[:, number])
            if len(asked):
                passed = self.can_link(points[asked], sizes[asked], self.points[start:stop], self.sizes[start:stop])
                i, j = np.nonzero(passed)
                yield asked[i], self.order[start + j]


def count_vector(h: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def packed(point: np.ndarray) -> bytes:
    """Counts in two bytes each where they fit, else in four."""
    return point.astype("<u2" if point.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, groups: int = GROUPS) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * groups else "<u4").astype(np.int64)


def overlaps(h: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The exact size of the intersection of h with each other set."""
    joined = np.concatenate(others)
    at = np.searchsorted(h, joined)
    at[at == len(h)] = 0
    lengths = [len(x) for x in others]
    return np.add.reduceat((h[at] == joined).astype(np.int64), np.cumsum([0, *lengths[:-1]]))


def verified_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j) of left and right; of left with itself, i < j, if right is None."""
    stored = left if right is None else right
    tree = CountTree(np.array([count_vector(h) for h in stored]), np.array([len(h) for h in stored]), percent=percent)
    found = list(tree.candidates(np.array([count_vector(h) for h in left]), np.array([len(h) for h in left])))
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if right is None:
        i, j = i[i < j], j[i < j]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    for at in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1) if len(i) else ():
        a = left[i[at[0]]]
        for part in np.array_split(at, -(-len(at) // 256)):
            others = [stored[x] for x in j[part]]
            both = overlaps(a, others)
            ok = enough(both, len(a) + np.array([len(x) for x in others]), percent)
            yield from ((int(i[x]), int(j[x])) for x in part[ok])


PAIR = ["c1", "b1", "c2", "b2"]


def deal_blocks(members: DataFrame, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """members (canopy, size_class, set_id, data, ...) with the pair of blocks (c1, b1, c2, b2) that a row is for and the sides of it (left, right) that it is on; a row for each pair.

    A canopy of at most `block` sets and block_bytes of data is one block. A larger one is cut by size class, and a class
    into blocks; a block meets those of its own class and of the two next to it, since sets of others can't be linked.
    """
    own = [c for c in members.columns if c != "size_class"]
    n, size = F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes")
    large = materialize(members.groupBy("canopy").agg(n, size).filter((F.col("n") > block) | (F.col("bytes") > block_bytes)).select("canopy"), "large")
    whole = members.join(small(large), "canopy", "left_anti").select(*own, *(F.lit(0).alias(c) for c in PAIR), F.lit(True).alias("left"), F.lit(True).alias("right"))
    cut = members.join(small(large), "canopy", "left_semi")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).cast("int").alias("own")
    order = Window.partitionBy("canopy").orderBy("size_class")
    beside = lambda found, step: F.when(found("size_class").over(order) == F.col("size_class") + step, found("own").over(order)).otherwise(0)
    sized = cut.groupBy("canopy", "size_class").agg(n, size).select("canopy", "size_class", blocks).select("*", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    placed = join_groups(cut, sized, ["canopy", "size_class"], F.col("set_id"), "inner")
    k, at = F.col("size_class"), F.pmod(F.xxhash64("set_id"), F.col("own")).cast("int")
    pair = lambda c1, b1, c2, b2, left, right: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), left.alias("left"), right.alias("right"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    yes, no = F.lit(True), F.lit(False)
    pairs = F.concat(
        F.transform(upto(F.col("own")), lambda o: pair(k, F.least(o, at), k, F.greatest(o, at), at <= o, at >= o)),
        F.transform(upto(F.col("below")), lambda o: pair(k - 1, o, k, at, no, yes)),
        F.transform(upto(F.col("above")), lambda o: pair(k, at, k + 1, o, yes, no)),
    )
    return whole.unionByName(placed.select(*own, F.inline(pairs)))


def by_block_pair(dealt: DataFrame, fn: Callable[[dict[str, list], int, int], Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    """fn(columns, start, stop) of the rows of each canopy's pair of blocks, out of sorted partitions; it yields rows of the schema."""
    keys = ["canopy", *PAIR]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            held = {c: table.column(c).to_pylist() for c in ("canopy", *columns)}
            rows = [row for start, stop in groups for row in fn(held, start, stop)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([np.diff(table.column(c).to_numpy()) != 0 for c in keys])
            starts = np.flatnonzero(new).tolist()
            yield from made(table, list(zip(starts, starts[1:], strict=False)))
            rest = table.slice(starts[-1])
        if rest is not None:
            yield from made(rest, [(0, rest.num_rows)])
        del rest
        give_back()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(dealt.select(*keys, *columns).repartition(n, *keys).sortWithinPartitions(*keys), run, schema)


def link_blocks(members: DataFrame, block: int, percent: int = PERCENT) -> DataFrame:
    """members (canopy, size_class, set_id, copies, data: the set): set_id, root, links, one row per set and pair of blocks in which it has a link.

    Each pair of blocks is joined on its own, so no task holds more than two. links counts the documents linked in that
    pair of blocks; root is the least set there that is reachable.
    """

    def join(held: dict[str, list], start: int, stop: int) -> Iterator[tuple]:
        ids, copies, on_left, on_right = (held[c][start:stop] for c in ("set_id", "copies", "left", "right"))
        sets = [np.frombuffer(x, np.uint64) for x in held["data"][start:stop]]
        left, right = ([i for i, x in enumerate(side) if x] for side in (on_left, on_right))
        root, links = list(range(len(sets))), [0] * len(sets)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if left and right:
            for i, j in verified_links([sets[x] for x in left], None if on_left == on_right else [sets[x] for x in right], percent):
                x, y = left[i], right[j]
                links[x] += copies[y]
                links[y] += copies[x]
                x, y = find(x), find(y)
                if x != y:
                    x, y = sorted((x, y), key=ids.__getitem__)
                    root[y] = x
        yield from ((ids[x], ids[find(x)], links[x]) for x in range(len(sets)) if links[x])

    return by_block_pair(deal_blocks(members, block), join, ["set_id", "copies", "data", "left", "right"], "set_id binary, root binary, links long")


def bounded_pairs(members: DataFrame, block: int, percent: int = PERCENT) -> DataFrame:
    """a, b: pairs of sets of different homes that meet at one and that the trees over their points let pass. Only guests ask.

    members: canopy (a home), size_class, set_id, home, n_shingles, data (the packed point).
    """

    def join(held: dict[str, list], start: int, stop: int) -> Iterator[tuple]:
        sizes, ids = (held[c][start:stop] for c in ("n_shingles", "set_id"))
        if stop - start == 2 and 100 * min(sizes) < percent * max(sizes):
            return
        homes, n = np.array(held["home"][start:stop]), np.array(sizes)
        left, right = (np.flatnonzero(held[c][start:stop]) for c in ("left", "right"))
        points = np.array([unpacked(x) for x in held["data"][start:stop]])
        for asked, stored in ((left, right),) if len(left) == len(right) == len(n) else ((left, right), (right, left)):
            guests = asked[homes[asked] != held["canopy"][start]]
            if len(guests) and len(stored):
                for i, j in CountTree(points[stored], n[stored], percent=percent).candidates(points[guests], n[guests]):
                    x, y = guests[i], stored[j]
                    apart = homes[x] != homes[y]
                    yield from ((min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(x[apart].tolist(), y[apart].tolist(), strict=True))

    return by_block_pair(deal_blocks(members, block), join, ["set_id", "home", "n_shingles", "data", "left", "right"], "a binary, b binary").distinct()


def verified_pairs(pairs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """set_id, root, links of the pairs (a, b) whose sets, out of members (set_id, copies, data), are linked: a row for each side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, copies_a, copies_b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if enough(overlaps(x, [y])[0], len(x) + len(y), percent):
                    out += [(a, a, copies_b), (b, a, copies_a)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["set_id", "root", "links"])
        give_back()

    side = lambda name: members.select(F.col("set_id").alias(name), F.col("copies").alias(f"copies_{name}"), F.col("data").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_batches(both.select("a", "b", "copies_a", "copies_b", "set_a", "set_b"), run, "set_id binary, root binary, links long")


def linked_sets(docs: DataFrame, block: int, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, text_hash, n_shingles, set_id; sets: set_id, id, component, n_links of every set that is not empty).

    Sets are told apart by themselves, never by the doc_ids that have them. id is the least doc_id of a set's component,
    NO_ID where all are null; component its least set; n_links counts a set's documents' links.
    """
    slim = materialize(document_sets(docs, n, percent), "sets")
    least = F.min(F.struct("key", "text_hash")).alias("of")
    kept = [F.first(c).alias(c) for c in ("n_shingles", "size_class", "point")]
    sets = materialize(slim.withColumn("key", row_keys()[0]).filter("n_shingles > 0").groupBy("set_id", "sid").agg(least, F.count(F.lit(1)).alias("copies"), *kept), "distinct-sets")
    agree = materialize(agreements(signed_sets(docs, n, percent)), "agreements")

    # Sets much alike have one home; other sets are homes of their own.
    homes = materialize(components(agree.filter(F.col("n") >= ALIKE).select("u", "v"), "homes").select(F.col("node").alias("sid"), F.col("component").alias("home")), "homes")
    home_of = lambda name: homes.select(F.col("sid").alias(name), F.col("home").alias(f"home_{name}"))
    apart = agree.filter(F.col("n") < ALIKE).join(home_of("u"), "u", "left").join(home_of("v"), "v", "left")
    guests = apart.filter(F.coalesce("home_u", "u") != F.coalesce("home_v", "v")).select(F.coalesce("home_v", "v").alias("canopy"), F.col("u").alias("sid")).distinct()
    guests = materialize(guests, "guests")
    info = sets.join(homes, "sid", "left").select("sid", "set_id", "n_shingles", "size_class", F.coalesce("home", "sid").alias("home"), F.col("point").alias("data"))
    hosts = info.withColumn("canopy", F.col("home")).join(guests.select("canopy").distinct(), "canopy", "left_semi")
    meeting = materialize(guests.join(info, "sid").unionByName(hosts).drop("sid"), "meeting")
    pairs = materialize(bounded_pairs(meeting, block, percent), "pairs")

    paired = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().withColumn("paired", F.lit(True))
    wanted = sets.join(homes, "sid", "left").join(paired, "set_id", "left").filter("home IS NOT NULL OR paired")
    wanted = materialize(wanted.select(F.col("home").alias("canopy"), "size_class", "set_id", "copies", "of.*"), "wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch):
                h = [shingles(text or "", words, n) for text in part.column("text").to_pylist()]
                same = pa.array([len(x) > 0 and set_id(x) == want for x, want in zip(h, part.column("set_id").to_pylist(), strict=True)], pa.bool_())
                whole = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("canopy", "size_class", "set_id", "copies")), pa.array([x.tobytes() for x in h], pa.binary())], ["canopy", "size_class", "set_id", "copies", "data"])
                yield whole.filter(same)
        del words
        give_back()

    texts = docs.select(*row_keys(), "text").join(small(wanted), ["key", "text_hash"])
    members = map_batches(texts.select("canopy", "size_class", "set_id", "copies", "text"), hashed, "canopy long, size_class int, set_id binary, copies long, data binary")
    # In the order of canopies, sets that are much alike lie together, and their copies for the pairs of blocks compress.
    members = materialize(members.dropDuplicates(["set_id"]).repartitionByRange("canopy", "set_id").sortWithinPartitions("canopy", "set_id"), "members")
    links = materialize(link_blocks(members.filter("canopy IS NOT NULL"), block, percent).unionByName(verified_pairs(pairs, members, percent)), "links")
    release(agree, homes, guests, meeting, pairs, wanted, members)
    reach = materialize(components(links.select(F.col("set_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "set_id"), "reach")
    held = sets.select("set_id", "copies", F.col("of.key").alias("own")).join(links.groupBy("set_id").agg(F.sum("links").alias("links")), "set_id", "left").join(reach, "set_id", "left")
    of_component = held.filter("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("id"))
    held = join_groups(held, of_component, ["component"], F.col("set_id"), counts=key_counts(reach, ["component"]))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    return slim, held.select("set_id", F.coalesce("id", "own").alias("id"), F.coalesce("component", "set_id").alias("component"), n_links)


def ngram_jaccard(docs: DataFrame, block: int = BLOCK, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links (documents that it is linked to).

    Documents are linked whose sets of n-word shingles have a Jaccard similarity of at least percent / 100. Shingles are
    told apart by 64-bit hashes. Documents with equal sets are linked; null, empty and blank texts have an empty set and
    are linked with nothing. A null doc_id is the component of its document only if it is linked to no other one. Rows
    that repeat a doc_id are documents of their own, linked only by their own texts. A very long text is one set, of
    8 bytes a word. Other columns are not read. An empty table gives no rows.
    """
    slim, sets = linked_sets(docs, block, n, percent)
    found = join_groups(slim, sets, ["set_id"], F.struct("doc_id", "text_hash"))
    return found.select("doc_id", "n_shingles", F.nullif(F.coalesce("id", "doc_id"), F.lit(NO_ID)).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, block: int = BLOCK, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs' own columns: one row of each component, one with its smallest doc_id (null only where there is no other).

    Rows without a shingle all stay. Of rows with that doc_id in one component, repeated rows among them, any one stays.
    """
    slim, sets = linked_sets(docs, block, n, percent)
    key = row_keys()[0]
    rows = join_groups(slim.filter("n_shingles > 0"), sets.select("set_id", "id", "component"), ["set_id"], F.struct("doc_id", "text_hash")).select(key, "text_hash", "id", "component")
    rows = materialize(rows, "component-rows")
    kept = rows.filter(F.col("key") == F.col("id")).groupBy("component").agg(F.min("text_hash").alias("of_hash"))
    stays = (F.col("key") == F.col("id")) & (F.col("text_hash") == F.col("of_hash"))
    return keep_marked(docs, join_groups(rows, kept, ["component"], F.struct("key", "text_hash"), "inner").select("key", "text_hash", stays.alias("keep")))
