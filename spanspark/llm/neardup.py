"""MinHash near-duplicates from bottom-k sketches, confirmed on whole shingle sets.

One hash function maps every shingle to 64 bits; a document's sketch is the k smallest values of its set. Documents
with equal sets become one node first. Values that several nodes retain form inverted lists. Two sets with a Jaccard
similarity of 0.75 share at least ``least_shared`` retained values (always for sets the sketch holds whole, else but for
one pair in ten million), so a node needs to stand only in the lists of its rarest retained values: a passage that many
documents share stands last in that order and makes no list of theirs meet.

Every list names a pivot, its smallest node, and the nodes with a common pivot form a bucket, in which each pair that
shares a list meets. Inside a block of a bucket, overlaps of sketches and then the union-sketch estimate filter the
pairs, the whole sets decide, and pairs already connected are skipped, so a block returns at most one link for each of
its nodes. A bucket beyond a fixed size is cut into blocks, and its pivot stands in each: one round, in which every node
is sent once, connects a group of near copies. Nodes that their block leaves apart from the pivot get a pivot of their
own in the next round, as long as rounds connect most of them. What isn't in the largest component of its bucket after
that meets, in blocks by pairs, the nodes with which it shares a list but no component; before that, nodes of which too
few shingles are held outside their component for any link are left out, which is exact. Components come from alternating
large and small stars. No list, link or component is ever gathered on the driver, and joins on values, pivots, contents
and roots split hot keys.

Defined results: null text is the empty text, which is linked with nothing; a null doc_id takes part in links but never
names a component unless all of its ids are null; repeated rows are copies; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import SHINGLE_WORDS, bound_batches, broadcast_up_to, checkpointed, drop_unused, few_tasks, skew_join, text_of

PERCENT = 75
K = 64
#: Retained values of the union that a pair at the threshold shares at least, but for a chance under 1e-7 (binomial).
SHARED = 26
#: Of a block: nodes, and shingles of all nodes.
BLOCK_NODES, BLOCK_SHINGLES = 128, 2_000_000
#: Rounds of pivots go on while one leaves at most this part of the nodes that the last one left apart.
ROUND_LEAVES = 0.7
#: Pivots of all nodes in a table that is broadcast at most (a node has 39 at most, so many bytes each).
BROADCAST_PLACES = 250_000
#: Shingles of a slice of them by value, of which a task holds all; slices at most (beyond that, each grows).
SLICE_SHINGLES, MOST_SLICES = 250_000, 1_000
CACHE_WORDS, LONGEST_KEPT = 150_000, 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: odd multipliers of a 64-bit mixer


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; bytes.split() parts at the contract's white space."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = mixed(acc * MIX[0] + h[k : k + n])
    return np.unique(acc)


def least_shared(retained: int) -> int:
    """Values that a sketch of so many shares with that of any linked set."""
    return -(-PERCENT * retained // 100) if retained <= K * PERCENT // 100 else SHARED


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, row, n, content (digest of the set, null if empty), sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, content, sketch = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                content.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch.append(s[:K].view(np.int64))
            flat = pa.array(np.concatenate(sketch) if sketch else np.empty(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "row", "n", "content", "sketch"])

    return docs.mapInArrow(rows, "doc_id bigint, row bigint, n bigint, content binary, sketch array<bigint>")


def rare_lists(nodes: DataFrame) -> DataFrame:
    """(value, node) for the rarest retained values of each node that it shares with another."""
    values = nodes.select("node", F.least("n", F.lit(K)).alias("m"), F.explode("sketch").alias("value"))
    shared = checkpointed(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    rows = nodes.select(F.coalesce(F.sum(F.least("n", F.lit(K))), F.lit(0))).first()[0]
    held = skew_join(values, shared.withColumn("holders", F.col("df")), "value", "holders", rows).groupBy("node", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    least = F.when(F.col("m") <= K * PERCENT // 100, F.ceil(F.col("m") * PERCENT / 100)).otherwise(SHARED)
    taken = (F.col("m") - least + 1 - (F.col("m") - F.size("held"))).cast("int")
    return held.where(taken > 0).select("node", F.explode(F.slice("held", F.lit(1), taken)).alias("x")).select(F.col("x.value").alias("value"), "node")


def buckets(lists: DataFrame) -> DataFrame:
    """(pivot, node): each node with the smallest node of each of its lists."""
    pivots = checkpointed(lists.groupBy("value").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return skew_join(lists, pivots, "value", "size", lists.count()).select("pivot", "node").distinct()


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def roots(self) -> np.ndarray:
        while not np.array_equal(jumped := self.up[self.up], self.up):
            self.up = jumped
        return self.up

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def overlaps(sketches: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Retained values that each two of the sketches have in common, from their inverted lists."""
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    values, place, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    owner, column = owner[keep], rank[place[keep]]
    found = np.zeros((len(sketches), len(sketches)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, chunk):
        a, b = np.searchsorted(column, [at, at + chunk])
        m = np.zeros((len(sketches), chunk), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        found += m @ m.T
    return found


def union_shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Values among the k smallest of each union of two sketches that both retain."""
    last = np.uint64(2**64 - 1)
    both = np.full((len(others), 2 * K), last, np.uint64)
    both[:, : len(one)] = one
    for r, s in enumerate(others):
        both[r, K : K + len(s)] = s
    both.sort(axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != last)
    distinct = np.arange(1, 2 * K) - np.cumsum(twice, axis=1)
    return (twice & (distinct < K)).sum(axis=1)


def block_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the pairs of a block connect: (smallest node, other node) of each component."""
    order = sorted({n: k for k, n in enumerate(nodes)}.items())
    nodes, sets = [n for n, _ in order], [sets[k] for _, k in order]
    size = np.array([len(s) for s in sets], np.int32)
    forest = Forest(len(nodes))
    if len(nodes) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(nodes[0], nodes[1])] if 100 * common >= PERCENT * (size.sum() - common) else []
    sketches = [s[:K] for s in sets]
    least = np.array([least_shared(len(s)) for s in sketches], np.float32)
    shared = overlaps(sketches)
    likely = (shared >= np.maximum(least[:, None], least)) & (np.minimum(size[:, None], size) >= np.maximum(size[:, None], size) * np.float32(PERCENT / 100 - 1e-3))
    np.fill_diagonal(likely, False)
    seen = np.zeros(len(nodes), bool)
    for a in range(len(nodes)):
        roots = forest.roots()
        b = np.flatnonzero(likely[a] & ~seen & (roots != roots[a]))
        seen[a] = True
        if len(b):
            b = b[union_shared(sketches[a], [sketches[k] for k in b]) >= np.maximum(least[a], least[b])]
        for part in np.array_split(b, max(1, int(size[b].sum()) // 4_000_000)) if len(b) else ():
            flat = np.concatenate([sets[k] for k in part])
            at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
            common = np.add.reduceat(sets[a][at] == flat, np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            for k in part[100 * common >= PERCENT * (size[a] + size[part] - common)].tolist():
                forest.join(a, k)
    return [(nodes[r], nodes[k]) for k, r in enumerate(forest.roots().tolist()) if r != k]


def place(i, j, times_i=1, times_j=1, split=False):
    """Where a node stands in its bucket: the blocks from (i, j) to (i + times_i, j + times_j), exclusive; split: are apart nodes to be told?"""
    numbers = (F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in zip(("i", "j", "times_i", "times_j"), (i, j, times_i, times_j), strict=True))
    return F.struct(F.col("pivot"), *numbers, (F.lit(split) if isinstance(split, bool) else split).alias("split")).alias("place")


def block_counts(rows: DataFrame, name: str = "blocks") -> DataFrame:
    """(pivot, blocks, held, lead): blocks that a bucket's rows(pivot, node, n) fill, the number of rows, the smallest node."""
    return rows.groupBy("pivot").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name), F.count(F.lit(1)).alias("held"), F.min("node").alias("lead"))


def with_lead(docs: DataFrame, rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """A round in which the first node of each bucket of rows(pivot, node, n, row) stands in all blocks of the bucket.

    Returns its links(u, v), and (pivot, node) of buckets of several blocks where a block leaves the node apart from the first.
    """
    dealt = skew_join(rows, checkpointed(block_counts(rows)), "pivot", "held", n_rows)
    first = F.col("node") == F.col("lead")
    spots = dealt.select("node", "row", place(F.when(first, 0).otherwise(F.pmod("node", F.col("blocks"))), 0, F.when(first, F.col("blocks")).otherwise(1), 1, F.col("blocks") > 1))
    met = meet(docs, spots, n_rows)
    return met.where("not apart").select("u", "v"), met.where("apart").select(F.col("u").alias("pivot"), F.col("v").alias("node"))


def linked_components(docs: DataFrame, nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, root) of nodes in components of links: pairs that share one of lists(value, node), confirmed on the whole sets of docs(row, whole)."""
    weighed = checkpointed(buckets(lists).join(nodes.select("node", "n", "row"), "node"))
    drop_unused(docs.sparkSession)
    found, apart = with_lead(docs, weighed, weighed.count())
    first_apart, left = apart, apart.count()
    while left:
        drop_unused(docs.sparkSession)
        rows = checkpointed(apart.join(nodes.select("node", "n", "row"), "node"))
        more, apart = with_lead(docs, rows, left)
        found, before, left = found.union(more), left, apart.count()
        if left > ROUND_LEAVES * before:
            break
    roots = checkpointed(components(found))
    if first_apart.isEmpty():
        return roots
    sizes = weighed.groupBy("pivot").agg(F.count(F.lit(1)).alias("held")).join(first_apart.select("pivot").distinct(), "pivot", "left_semi")
    all_of = checkpointed(rooted(skew_join(weighed, checkpointed(sizes), "pivot", "held", weighed.count()), roots))
    far = checkpointed(not_in_largest(all_of))
    if far.isEmpty():
        return roots
    return components(roots.select(F.col("root").alias("u"), F.col("node").alias("v")).union(across(docs, far, all_of, lists)))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(node, …) with the root of their node, itself where it is linked with nothing."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def not_in_largest(rows: DataFrame) -> DataFrame:
    """(pivot, node) of the rows(pivot, node, root) whose component isn't the one with most nodes of their bucket."""
    held = rows.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("held"))
    largest = held.groupBy("pivot").agg(F.max(F.struct("held", "root")).alias("most"), F.sum("held").alias("held")).select("pivot", "held", F.col("most.root").alias("largest"))
    return skew_join(rows, checkpointed(largest), "pivot", "held", rows.count()).where("root <> largest").select("pivot", "node")


def in_mixed_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows(pivot, node, root, …) whose node shares one of lists(value, node) with a node of another component."""
    own = checkpointed(lists.join(rows.select("node", "root").distinct(), "node"))
    mixed = own.groupBy("value").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("held")).where("a < b").select("value", "held")
    nodes = checkpointed(skew_join(own, checkpointed(mixed), "value", "held", own.count()).select("node").distinct())
    return checkpointed(rows.join(nodes, "node", "left_semi"))


def shared_outside(docs: DataFrame, nodes: DataFrame, slices: int) -> DataFrame:
    """(node, outside): how many shingles of each of nodes(node, row, root) a node of another component holds too; each shingle is sent once."""
    names = ["slice", "shingles", "nodes", "roots"]
    lists = pa.list_(pa.int64())

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, hashes) for text in batch.column(0).to_pylist()]
            if not sets:
                continue
            flat, sizes = np.concatenate(sets), [len(s) for s in sets]
            part = ((flat >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            offsets = pa.array([*at, len(flat)], pa.int32())
            held = (flat.view(np.int64), *(np.repeat(batch.column(k).to_numpy(), sizes) for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in held)], names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list) -> pa.RecordBatch:
            value, node, root = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((node, value))
            value, node, root = value[order], node[order], root[order]
            once = np.concatenate([[True], (value[1:] != value[:-1]) | (node[1:] != node[:-1])])
            value, node, root = value[once], node[once], root[once]
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(node[np.repeat(mixed, np.diff([*starts, len(value)]))], return_counts=True)], ["node", "outside"])

        key, parts = None, []
        for batch in batches:
            for r, k in enumerate(batch.column(0).to_pylist()):
                if k != key and parts:
                    yield rows(parts)
                    parts = []
                key = k
                parts.append([batch.column(c)[r].values.to_numpy() for c in names[1:]])
        if parts:
            yield rows(parts)

    texts = docs.select("row", "whole").join(broadcast_up_to(nodes, BROADCAST_PLACES), "row").select("whole", "node", "root")
    parts = texts.mapInArrow(sliced, "slice int, shingles array<bigint>, nodes array<bigint>, roots array<bigint>")
    return parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(counted, "node bigint, outside bigint").groupBy("node").agg(F.sum("outside").alias("outside"))


def linkable(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows(pivot, node, n, row, root) that may be linked to another component's node in their bucket.

    Sets of n and p shingles are linked if they share at least 3 / 7 * (n + p); so a node is left out exactly if for no
    size p in its bucket so many of its shingles are held outside its component.
    """
    nodes = checkpointed(rows.select("node", "row", "root", "n").distinct())
    slices = min(MOST_SLICES, -(-nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SLICE_SHINGLES))
    outside = checkpointed(shared_outside(docs, nodes.drop("n"), slices))
    classes = rows.groupBy("pivot", F.floor(F.log("n") * 50).alias("class")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("held"))
    sizes = checkpointed(classes.groupBy("pivot").agg(F.collect_list(F.struct("least", "most")).alias("sizes"), F.sum("held").alias("held")))
    fits = F.exists("sizes", lambda p: (4 * p.most >= 3 * F.col("n")) & (3 * F.greatest(4 * p.least, 3 * F.col("n")) <= 4 * (7 * F.col("outside") - 3 * F.col("n"))))
    return checkpointed(skew_join(rows.join(outside, "node"), sizes, "pivot", "held", rows.count()).where(fits).drop("sizes", "outside"))


def across(docs: DataFrame, far: DataFrame, all_of: DataFrame, lists: DataFrame) -> DataFrame:
    """Links(u, v) of far(pivot, node) to all nodes of their buckets all_of(pivot, node, n, row, root) with which they share a list but no component."""
    drop_unused(docs.sparkSession)
    all_of = in_mixed_lists(linkable(docs, in_mixed_lists(all_of, lists)), lists)
    drop_unused(docs.sparkSession)
    own = checkpointed(all_of.join(far, ["pivot", "node"], "left_semi"))
    n_own, n_all = own.count(), all_of.count()
    one, other = block_counts(own, "own_blocks").select("pivot", "own_blocks", F.col("held").alias("own_held")), block_counts(all_of, "all_blocks").drop("lead")
    counts = checkpointed(one.join(other, "pivot"))
    rows = skew_join(own, counts.drop("held"), "pivot", "own_held", n_own).select("node", "row", place(F.pmod("node", F.col("own_blocks")), 0, 1, F.col("all_blocks")))
    columns = skew_join(all_of, counts.drop("own_held"), "pivot", "held", n_all).select("node", "row", place(0, F.pmod("node", F.col("all_blocks")), F.col("own_blocks"), 1))
    return meet(docs, rows.union(columns), n_own + n_all).select("u", "v")


def meet(docs: DataFrame, spots: DataFrame, n_spots: int) -> DataFrame:
    """(u, v, apart): links u < v that connect what stands in a common block of spots(node, row, place), and, where asked
    for, bucket u's nodes v that aren't connected to the first of their block."""
    places = checkpointed(spots.groupBy("node", "row").agg(F.collect_list("place").alias("places")))
    texts = docs.select("row", "whole").join(F.broadcast(places) if n_spots <= BROADCAST_PLACES else places, "row").select("node", "whole", *(F.col(f"places.{k}").alias(k) for k in ("pivot", "i", "j", "times_i", "times_j", "split")))
    names = ["pivot", "i", "j", "node", "split", "shingles"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for node, text, *spots_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, hashes).view(np.int64)
                for pivot, i0, j0, times_i, times_j, split in zip(*spots_, strict=True):
                    for i, j in product(range(i0, i0 + times_i), range(j0, j0 + times_j)):
                        for x, y in zip(out, (pivot, i, j, node, split, s), strict=True):
                            x.append(y)
                        held += len(s)
                        if held > BLOCK_SHINGLES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                            out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            key, nodes_, sets = None, [], []
            for batch in batches:
                lists = batch.column("shingles")
                flat, ends = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                for r, (pivot, i, j, node, split) in enumerate(zip(*(batch.column(k).to_pylist() for k in names[:5]), strict=True)):
                    if (pivot, i, j, split) != key:
                        if len(nodes_) > 1:
                            yield *key, nodes_, sets
                        key, nodes_, sets = (pivot, i, j, split), [], []
                    nodes_.append(node)
                    sets.append(flat[ends[r] : ends[r + 1]].copy())
            if len(nodes_) > 1:
                yield *key, nodes_, sets

        def rows(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["u", "v", "apart"])

        found = []
        for pivot, _, _, split, nodes_, sets in groups():
            pairs = block_links(nodes_, sets) if len(set(nodes_)) > 1 else []
            found += [(u, v, False) for u, v in pairs]
            if split:
                near = {min(nodes_), *(v for u, v in pairs if u == min(nodes_))}
                found += [(pivot, v, True) for v in nodes_ if v not in near]
            if len(found) > 50_000:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    blocks_ = texts.mapInArrow(placed, "pivot bigint, i int, j int, node bigint, split boolean, shingles array<bigint>")
    return checkpointed(blocks_.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "node").mapInArrow(linked, "u bigint, v bigint, apart boolean"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges(u, v), u < v; the root is the component's smallest node."""

    def state(e: DataFrame):
        return tuple(e.select(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    edges = checkpointed(few_tasks(edges, edges.count()))
    before = state(edges)
    while before[0]:
        drop_unused(edges.sparkSession)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("held"))
        large = skew_join(both, least, "u", "held", 2 * before[0]).where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("held"))
        small = skew_join(large, least, "v", "held", before[0]).select("m", F.explode(F.array("u", "v")).alias("v")).where("m < v").select(F.col("m").alias("u"), "v").distinct()
        edges = checkpointed(few_tasks(small, before[0]))
        if (after := state(edges)) == before:
            break
        before = after
    return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, component_id, kept, first (the group's one row key to keep) for docs(doc_id, text)."""
    base = bound_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("whole")).withColumn("row", F.xxhash64("doc_id", "whole"))
    sketches = checkpointed(sketched(base.select("doc_id", "row", "whole")))
    by_set = sketches.where("n > 0").groupBy("content").agg(F.min("doc_id").alias("least_doc"), F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row")).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(by_set.select("content", "copies", "least_doc", "least", F.col("least.row").alias("row"), "n", "sketch", F.monotonically_increasing_id().alias("node")))
    drop_unused(docs.sparkSession)
    roots = linked_components(base, nodes, checkpointed(rare_lists(nodes)))
    named = checkpointed(nodes.join(roots, "node", "left").select("content", "copies", "least_doc", "least", F.coalesce("root", "node").alias("root")))
    groups = checkpointed(named.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.min("least").alias("least"), F.count(F.lit(1)).alias("held")).select("root", "component_id", F.col("least.row").alias("first"), "held"))
    by_content = checkpointed(skew_join(named.select("content", "copies", "root"), groups, "root", "held", named.count()).drop("root"))
    found = skew_join(sketches.select("doc_id", "row", F.col("n").alias("n_shingles"), "content"), by_content, "content", "copies", sketches.count(), "left")
    alone = F.col("content").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.when(alone, F.col("row")).otherwise(F.col("first")).alias("first"))
