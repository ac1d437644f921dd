"""Near-duplicate join on word shingles by signature trees.

Two documents link if their sets of distinct shingles have a Jaccard similarity of at least a threshold. In steps:

1. Every document becomes a sorted set of shingle hashes. Equal sets form a class; only classes are compared.
2. A linked partner shares at least ``need`` of the smallest hashes of a class (extended prefix filter). Prefixes are
   dealt out in packed blocks by hash; classes with too few shared hashes are out. Among the others, the classes that
   hold each of their shingles are counted. The rarest shingles of a class, as many as the threshold lets a partner
   lack and one more, form its second prefix; a common one joins classes to a candidate cluster. No link leaves a
   cluster, and passages that many documents share come last, so they hardly join anything.
3. Clusters are compared in tasks of bounded size. There, per range of sizes, a signature tree holds in each node the
   OR of its documents' bitmaps and their range of sizes. Two trees are walked together; a pair of nodes is left when
   the common bits, or the sizes, cannot reach the overlap that the threshold asks for, or when all documents below are
   linked already. What is left of single pairs is compared exactly. A task returns a spanning forest of its links.
4. Clusters beyond a task are cut into chunks by size range and hash; every two chunks whose sizes can match meet.
5. Links are gathered to components.

Only the order of work depends on hashes of 64 bits; sets are told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import Cache, named
from tableloom.llm.graph import components, stars
from tableloom.session import materialise

BROADCAST_BYTES = 32 * 1024 * 1024
#: Part of a set, beyond what the threshold asks for, that goes into its prefix.
EXTRA = 0.1
#: Children of a node, and documents of a leaf, of a signature tree.
FAN, LEAF = 8, 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; words are lower-cased (A-Z) runs between ASCII white space."""

    def __init__(self, width: int = 5, cached: int = 300_000):
        self.width, self.words = width, Cache(xxhash.xxh3_64_intdigest, cached)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))  # fewer words: the whole sequence is the one shingle
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = mixed(out * ODD + h[i : len(h) - width + 1 + i])
        return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` at least shares with any partner."""
    return -(-n * percent // 100)


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + 1 + int(EXTRA * n))


def need(n: int, percent: int) -> int:
    """Prefix hashes that a set of ``n`` at least shares with the prefix of any partner."""
    return 1 + int(EXTRA * least_overlap(n, percent))


# --- 2: packed blocks of prefixes -------------------------------------------------------------------------------------


def sketches(docs: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """(id, n, need, fp, cls, prefix) per row: set size, 128-bit mark of the set, its first half, packed prefix."""
    chosen = docs.select(named(key).alias("id"), named(text).cast("binary").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in _slices(batches):
            n, needed, marks, halves, prefixes = [], [], [], [], []
            for value in batch.column(1).to_pylist():
                own = shingles(value)
                mark = xxhash.xxh3_128_digest(own.tobytes())
                n.append(len(own))
                needed.append(need(len(own), percent))
                marks.append(mark)
                halves.append(int.from_bytes(mark[:8], "little", signed=True))
                prefixes.append(own[: prefix_size(len(own), percent)].tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(needed, pa.int64()), pa.array(marks, pa.binary()),
                 pa.array(halves, pa.int64()), pa.array(prefixes, pa.binary())],
                names=["id", "n", "need", "fp", "cls", "prefix"],
            )

    return chosen.mapInArrow(run, f"id {kind}, n bigint, need bigint, fp binary, cls bigint, prefix binary")


PACKED = "bucket bigint, own binary, other binary, how binary"
#: Classes of a block that may hold a hash before it counts as frequent for all.
FREQUENT = 64
#: Stands for the number of classes of a frequent hash, and marks a size.
EVERYWHERE, SIZE = 1 << 62, -1


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of equal values, and the run of every value."""
    new = np.r_[True, sorted_values[1:] != sorted_values[:-1]] if len(sorted_values) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _pairs(hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, class), sorted."""
    order = np.lexsort((classes, hashes))
    h, c = hashes[order], classes[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.empty(0, bool)
    return h[fresh], c[fresh]


def _packed(buckets: np.ndarray, *columns: np.ndarray, direct: bool = False) -> Iterator[tuple]:
    """One row per bucket with all its entries; ``direct`` rows only pass through the bucket on their way."""
    order = np.argsort(buckets, kind="stable")
    starts, _ = _runs(buckets[order])
    for s, e in zip(starts, np.r_[starts[1:], len(order)].astype(int)):
        bucket = int(buckets[order[s]])
        packed = [c[order[s:e]].tobytes() for c in columns]
        yield (-1 - bucket if direct else bucket, *packed, *([b""] * (3 - len(packed))))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "own", "other", "how"]
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "own", "other", "how"]).astype({"bucket": "int64"})


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts, so few sets are held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _joined(group: pd.DataFrame, column: str, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), kind)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, class) of a batch of (class, prefix)."""
    prefixes = batch.column(1).to_pylist()
    hashes = np.frombuffer(b"".join(prefixes), np.uint64)
    classes = np.repeat(np.asarray(batch.column(0).to_pylist(), np.int64), [len(p) // 8 for p in prefixes])
    return _pairs(hashes, classes)


def _grouped(dealt: DataFrame, function, schema: str = PACKED) -> DataFrame:
    bucket = F.col("bucket")
    return dealt.groupBy(F.when(bucket < 0, -1 - bucket).otherwise(bucket).alias("to")).applyInPandas(function, schema)


def shared_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(cls, shared): how many of a class's prefix hashes other classes have too; ``rows``: (cls, prefix).

    Within a block, hashes of several classes are counted at once and leave one mark for the other blocks, so a hash
    costs one entry per block however many classes hold it. Copies of a class in several blocks may raise its count.
    """
    mask = np.uint64(buckets - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = _read(batch)
            starts, run = _runs(h)
            several = np.diff(np.r_[starts, len(h)]) > 1
            alone = ~several[run] if len(h) else np.empty(0, bool)
            marks = h[starts[several]]
            hashes, classes = np.r_[h[alone], marks], np.r_[c[alone], np.zeros(len(marks), np.int64)]
            known, often = np.unique(c[~alone], return_counts=True)
            out = [*_packed((hashes & mask).astype(np.int64), hashes, classes)]
            yield _batch([*out, *_packed(known & np.int64(buckets - 1), known, often.astype(np.int64), direct=True)])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        own, direct = group[group["bucket"] >= 0], group[group["bucket"] < 0]
        h, c = _pairs(_joined(own, "own", np.uint64), _joined(own, "other"))
        starts, run = _runs(h)
        hit = np.diff(np.r_[starts, len(h)]) > 1
        hit[run[c == 0]] = True
        counted = hit[run] & (c != 0) if len(h) else np.empty(0, bool)
        known, often = np.unique(c[counted], return_counts=True)
        known, often = np.r_[known, _joined(direct, "own")], np.r_[often, _joined(direct, "other")].astype(np.int64)
        return _frame([*_packed(known & np.int64(buckets - 1), known, often)])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        known, at = np.unique(_joined(group, "own"), return_inverse=True)
        return pd.DataFrame({"cls": known, "shared": np.bincount(at, _joined(group, "other"), len(known)).astype(np.int64)})

    return _grouped(_grouped(rows.mapInArrow(deal, PACKED), gather), add, "cls bigint, shared bigint")


def rare_edges(texts: DataFrame, buckets: int, percent: int, width: int) -> DataFrame:
    """(a, b): edges that connect all nodes which share a hash of their second prefixes; ``texts``: (node, fp, text).

    Hashes are ordered by the number of nodes that hold them, then by value. A hash that many nodes of one block hold
    counts as held everywhere, for all nodes alike, so it costs one entry per block.
    """
    mask = np.uint64(buckets - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in _slices(batches):
            held = {}
            for node, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = shingles(text)
                if xxhash.xxh3_128_digest(own.tobytes()) == mark:  # another row may have the same key
                    held[node] = own
            nodes = np.array(sorted(held), np.int64)
            sizes = np.array([len(held[k]) for k in nodes], np.int64)
            h, c = _pairs(np.concatenate([np.empty(0, np.uint64), *(held[k] for k in nodes)]), np.repeat(nodes, sizes))
            starts, run = _runs(h)
            often = np.diff(np.r_[starts, len(h)]) > FREQUENT
            frequent = often[run] if len(h) else np.empty(0, bool)
            marks = h[starts[often]]
            hashes, classes = np.r_[h[~frequent], marks], np.r_[c[~frequent], np.full(len(marks), -1)]
            out = [*_packed((hashes & mask).astype(np.int64), hashes, classes)]
            to = np.r_[c[frequent], nodes]
            values = np.r_[h[frequent].astype(np.int64), sizes]
            how = np.r_[np.full(int(frequent.sum()), EVERYWHERE), np.full(len(nodes), SIZE)].astype(np.int64)
            yield _batch([*out, *_packed(to & np.int64(buckets - 1), to, values, how, direct=True)])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        own, direct = group[group["bucket"] >= 0], group[group["bucket"] < 0]
        h, c = _pairs(_joined(own, "own", np.uint64), _joined(own, "other"))
        starts, run = _runs(h)
        held = np.diff(np.r_[starts, len(h)]).astype(np.int64)
        held[run[c == -1]] = EVERYWHERE
        told = (held[run] > 1) & (c != -1) if len(h) else np.empty(0, bool)
        nodes = np.r_[c[told], _joined(direct, "own")]
        values = np.r_[h[told].astype(np.int64), _joined(direct, "other")]
        how = np.r_[held[run][told] if len(h) else held, _joined(direct, "how")].astype(np.int64)
        return _frame([*_packed(nodes & np.int64(buckets - 1), nodes, values, how)])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        nodes, values, how = (_joined(group, c) for c in ("own", "other", "how"))
        order = np.lexsort((values.view(np.uint64), how, nodes))  # a node's size comes first: SIZE is the least
        nodes, values, how = nodes[order], values[order], how[order]
        starts, run = _runs(nodes)
        place = np.arange(len(nodes)) - starts[run] if len(nodes) else nodes
        sized = how == SIZE  # more than once if the row was there more than once
        size = values[starts] if len(nodes) else values
        extra = np.bincount(run[sized], minlength=len(starts)) if len(nodes) else size
        shared = np.bincount(run[~sized], minlength=len(starts)) if len(nodes) else size
        allowed = size - -(-size * percent // 100) + 1 - (size - shared)  # of the shared ones; the others come before
        taken = ~sized & (place - extra[run] < allowed[run]) if len(nodes) else np.empty(0, bool)
        h, c = _pairs(values[taken].view(np.uint64), nodes[taken])
        starts, run = _runs(h)
        first = c[starts][run] if len(h) else c
        a, b = stars(first[first != c], c[first != c])
        out = [*_packed((h[starts] & mask).astype(np.int64), h[starts], c[starts])]
        return _frame([*out, *_packed(a & np.int64(buckets - 1), a, b, direct=True)])

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        own, direct = group[group["bucket"] >= 0], group[group["bucket"] < 0]
        h, c = _pairs(_joined(own, "own", np.uint64), _joined(own, "other"))
        starts, run = _runs(h)
        first = c[starts][run] if len(h) else c
        a, b = np.r_[first[first != c], _joined(direct, "own")], np.r_[c[first != c], _joined(direct, "other")]
        a, b = stars(a, b)
        return pd.DataFrame({"a": a, "b": b})

    counted = _grouped(texts.mapInArrow(deal, PACKED), count)
    return _grouped(_grouped(counted, choose), connect, "a bigint, b bigint")


# --- 3: signature trees -----------------------------------------------------------------------------------------------


class Forest:
    """Union-find over the documents of a task, with the links that joined them."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        self.links.append((a, b))
        self.parent[self.find(a)] = self.find(b)


class Tree:
    """Documents of one range of sizes, near ones side by side; node 0 is the root, nodes below the leaves are rows."""

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray]):
        order = sorted(range(len(docs)), key=lambda i: sets[docs[i]][:3].tolist())
        self.docs = docs[order]
        self.sizes = np.array([len(sets[d]) for d in self.docs])
        self.bits = max(64, 1 << int(4 * self.sizes.max() - 1).bit_length())
        bitmap = np.zeros((len(docs), self.bits // 64), np.uint64)
        for i, d in enumerate(self.docs):
            at = sets[d] & np.uint64(self.bits - 1)
            np.bitwise_or.at(bitmap[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.bitmap = bitmap
        self.lost = self.sizes - np.bitwise_count(bitmap).sum(axis=1)  # shingles that share a bit with another
        # nodes: ranges of rows, level by level from the leaves; children of a node are a range of nodes
        low, high, kids = [], [], []
        level = [(s, min(s + LEAF, len(docs)), (0, 0)) for s in range(0, len(docs), LEAF)]
        while True:
            base = len(low)
            for a, b, k in level:
                low.append(a)
                high.append(b)
                kids.append(k)
            if len(level) == 1:
                break
            level = [
                (level[s][0], level[min(s + FAN, len(level)) - 1][1], (base + s, base + min(s + FAN, len(level))))
                for s in range(0, len(level), FAN)
            ]
        self.low, self.high, self.kids, self.root = low, high, kids, len(low) - 1
        self.union = np.stack([np.bitwise_or.reduce(bitmap[a:b], axis=0) for a, b in zip(low, high)])
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(low, high)])
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(low, high)])
        self.spare = np.array([self.lost[a:b].max() for a, b in zip(low, high)])
        self.uniform = [False] * len(low)

    def folded(self, array: np.ndarray, bits: int) -> np.ndarray:
        """Bitmaps for a smaller number of bits; each then stands for several."""
        words = bits // 64
        return np.bitwise_or.reduce(array.reshape(len(array), -1, words), axis=1) if array.shape[1] > words else array


class Join:
    """Walks pairs of trees and links documents whose similarity reaches the threshold."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.forest = sets, percent, Forest(len(sets))
        self.compared = 0

    def possible(self, bits_a, size_a, most_a, spare_a, bits_b, size_b, most_b, spare_b) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (rows of a, rows of b) can hold a link, and their numbers of common bits."""
        common = np.bitwise_count(bits_a[:, None, :] & bits_b[None, :, :]).sum(axis=2, dtype=np.int64)
        overlap = common + np.minimum(spare_a[:, None], spare_b[None, :])
        overlap = np.minimum(overlap, np.minimum(most_a[:, None], most_b[None, :]))
        p, both = self.percent, size_a[:, None] + size_b[None, :]
        fits = overlap * (100 + p) >= p * both  # overlap >= p % of (both - overlap)
        fits &= 100 * most_a[:, None] >= p * size_b[None, :]
        fits &= 100 * most_b[None, :] >= p * size_a[:, None]
        return fits, common

    def same(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        both = len(np.intersect1d(x, y, assume_unique=True))
        self.compared += 1
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def rows(self, s: Tree, i: int, t: Tree, j: int) -> None:
        """Two leaves, document by document, the most similar first."""
        a, b = slice(s.low[i], s.high[i]), slice(t.low[j], t.high[j])
        bits = min(s.bits, t.bits)
        x, y = s.folded(s.bitmap[a], bits), t.folded(t.bitmap[b], bits)
        spare = [u.sizes[k] - np.bitwise_count(z).sum(axis=1) for u, k, z in ((s, a, x), (t, b, y))]
        fits, common = self.possible(x, s.sizes[a], s.sizes[a], spare[0], y, t.sizes[b], t.sizes[b], spare[1])
        if s is t and i == j:
            fits &= np.triu(np.ones_like(fits), 1)
        r, c = np.nonzero(fits)
        find = self.forest.find
        for k in np.argsort(-common[r, c], kind="stable"):
            d, e = int(s.docs[a][r[k]]), int(t.docs[b][c[k]])
            if find(d) != find(e) and self.same(d, e):
                self.forest.link(d, e)

    def settled(self, s: Tree, i: int, t: Tree, j: int) -> bool:
        """All documents of both nodes are linked already."""
        find = self.forest.find
        return s.uniform[i] and t.uniform[j] and find(int(s.docs[s.low[i]])) == find(int(t.docs[t.low[j]]))

    def within(self, s: Tree, i: int) -> None:
        first, last = s.kids[i]
        if first == last:
            self.rows(s, i, s, i)
        else:
            for k in range(first, last):
                self.within(s, k)
            kids = list(range(first, last))
            self.across(s, kids, s, kids, True)
        find = self.forest.find
        s.uniform[i] = len({find(int(d)) for d in s.docs[s.low[i] : s.high[i]]}) == 1

    def across(self, s: Tree, left: list[int], t: Tree, right: list[int], upper: bool = False) -> None:
        """All pairs of these nodes that can still hold a link, the most similar first."""
        bits = min(s.bits, t.bits)
        x, y = s.folded(s.union[left], bits), t.folded(t.union[right], bits)
        # folding may put more shingles on one bit: with fewer bits, at most as many as there are
        spare_s = s.spare[left] if bits == s.bits else s.most[left]
        spare_t = t.spare[right] if bits == t.bits else t.most[right]
        fits, common = self.possible(x, s.least[left], s.most[left], spare_s, y, t.least[right], t.most[right], spare_t)
        if upper:
            fits &= np.triu(np.ones_like(fits), 1)
        r, c = np.nonzero(fits)
        for k in np.argsort(-common[r, c], kind="stable"):
            i, j = left[r[k]], right[c[k]]
            if self.settled(s, i, t, j):
                continue
            a, b = s.kids[i], t.kids[j]
            if a[0] == a[1] and b[0] == b[1]:
                self.rows(s, i, t, j)
            else:
                self.across(
                    s, list(range(*a)) if a[0] < a[1] else [i], t, list(range(*b)) if b[0] < b[1] else [j]
                )


def size_range(n: int, percent: int) -> int:
    """Number of the range of sizes; partners are at most two ranges apart."""
    return math.floor(2 * math.log(n) / math.log(100 / percent) + 1e-9) if n > 1 else 0


def linked(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with two sides, only of those between side 0 and side 1."""
    join = Join(sets, percent)
    ranges = np.array([size_range(len(s), percent) for s in sets])
    trees: dict[tuple[int, int], Tree] = {}
    for side in np.unique(sides):
        for k in np.unique(ranges[sides == side]):
            trees[int(side), int(k)] = Tree(np.flatnonzero((sides == side) & (ranges == k)), sets)
    two = len(np.unique(sides)) == 2
    if not two:
        for tree in trees.values():
            join.within(tree, tree.root)
    for (side, k), tree in sorted(trees.items()):
        for other, away in ((s, d) for s in ({1} if two and side == 0 else set() if two else {side}) for d in range(-2 if two else 1, 3)):
            partner = trees.get((other, k + away))
            if partner is not None:
                join.across(tree, [tree.root], partner, [partner.root])
    return join.forest.links


# --- 4, 5: tasks and components ---------------------------------------------------------------------------------------


def bounded(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its measured size is within bounds."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def candidate_classes(marks: DataFrame, buckets: int) -> DataFrame:
    """(node, fp, n, rep): the classes that share enough of their prefix; ``node`` numbers them, ``rep`` is a key."""
    classes = marks.groupBy("fp", "cls", "n", "need").agg(F.min("id").alias("rep"))
    kept = classes.join(shared_counts(marks.select("cls", "prefix"), buckets), "cls").filter("shared >= need")
    return materialise(kept.select(F.monotonically_increasing_id().alias("node"), "fp", "n", "rep"))


def tasks(members: DataFrame, budget: int, percent: int) -> DataFrame:
    """(node, task, part, side): where each member of a cluster is compared; ``members``: (node, cluster, n).

    Small clusters share tasks, told apart by ``part``. Larger ones are cut into chunks of at most about half a budget
    of shingles, by range of sizes and hash; a task holds one chunk, or two on sides 0 and 1 whose sizes can match.
    """
    sums = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    small = sums.filter(F.col("total") <= budget)
    total = small.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    slots = max(1, math.ceil(2 * total / budget))
    slot = F.pmod(F.xxhash64("cluster"), F.lit(slots))
    few = members.join(small, "cluster").select(
        "node", F.struct(slot.alias("slot"), F.lit(-1).alias("i"), F.lit(-1).alias("j")).alias("task"),
        F.col("cluster").alias("part"), F.lit(0).alias("side"),
    )
    band = F.floor(2 * F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    large = members.join(sums.filter(F.col("total") > budget).select("cluster"), "cluster").withColumn("band", band)
    bands = materialise(
        large.groupBy("cluster", "band").agg(F.ceil(2 * F.sum("n") / F.lit(budget)).cast("int").alias("cuts"))
    )
    chunk = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    placed = large.join(bands, ["cluster", "band"]).select("node", "cluster", "band", chunk.alias("cut"))
    one = bands.select(
        "cluster", F.col("band").alias("x"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("i")
    )
    other = bands.select(
        F.col("cluster").alias("of"), F.col("band").alias("y"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("j")
    )
    # pairs of chunks: a few per chunk, by size; not pairs of documents
    near = (F.col("cluster") == F.col("of")) & F.col("y").between(F.col("x"), F.col("x") + 2)
    pairs = materialise(one.join(other, near & ((F.col("x") < F.col("y")) | (F.col("i") <= F.col("j")))).drop("of"))
    number = F.struct(F.xxhash64("cluster", "x", "y").alias("slot"), "i", "j").alias("task")
    sides = []
    for side, (b, k) in enumerate((("x", "i"), ("y", "j"))):
        at = pairs.select(F.col("cluster").alias("part"), F.col(b).alias("b"), F.col(k).alias("k"), number,
                          ((F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))).alias("alone"))
        at = at if side == 0 else at.filter(~F.col("alone"))
        sides.append(
            placed.join(at, (F.col("cluster") == F.col("part")) & (F.col("band") == F.col("b")) & (F.col("cut") == F.col("k")))
            .select("node", "task", "part", F.lit(side).alias("side"))
        )
    return few.unionByName(sides[0]).unionByName(sides[1])


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 80,
    width: int = 5,
    budget: int = 1_000_000,
    bucket_entries: int = 1_000_000,
) -> DataFrame:
    """(``key``, n_shingles, component_id) per row: set size, and the smallest key reachable by links.

    Whole texts. Sets are distinct shingles of ``width`` words; a text with fewer words is one shingle; texts without
    words, and null texts, have none and are linked with nothing. Rows with a null key link with nothing and have a null
    component. Rows that share a key are documents each. An empty table gives no rows. Other columns are ignored.
    """
    marks = materialise(sketches(docs, key, text, percent, width))
    real = marks.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    entries = real.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    buckets = 1 << max(4, math.ceil(entries / bucket_entries)).bit_length()
    kept = candidate_classes(real, buckets)
    texts = docs.select(named(key).alias("id"), named(text).cast("binary").alias("text"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        return texts.join(bounded(nodes.select("node", "fp", "rep"), 64), F.col("id") == F.col("rep")).select("node", "fp", "text")

    edges = rare_edges(texts_of(kept), buckets, percent, width)
    clusters = components(edges).withColumnRenamed("component", "cluster")
    members = materialise(kept.join(clusters, "node"))
    where = tasks(members.select("node", "cluster", "n"), budget, percent)
    rows = texts_of(members).join(where, "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        shingles, found = Shingler(width, 100_000), []
        for _, part in group.groupby("part", sort=True):
            sets, nodes, sides, seen = [], [], [], set()
            for node, side, mark, value in zip(part["node"], part["side"], part["fp"], part["text"]):
                own = shingles(value)
                # rows may be there twice, or share their key with another text
                if xxhash.xxh3_128_digest(own.tobytes()) == mark and (node, side) not in seen:
                    seen.add((node, side))
                    sets.append(own)
                    nodes.append(node)
                    sides.append(side)
            found += [(nodes[a], nodes[b]) for a, b in linked(sets, np.array(sides), percent)]
        a, b = stars(*np.array(found, np.int64).reshape(-1, 2).T)
        return pd.DataFrame({"a": a, "b": b})

    links = materialise(rows.groupBy("task").applyInPandas(compare, "a bigint, b bigint"))
    joined = components(links).join(members.select("node", "fp", "rep"), "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    named_classes = joined.join(least, "component").select(F.col("fp").alias("of"), "least")
    # a class without links keeps its own smallest key
    own = real.groupBy("fp").agg(F.min("id").alias("rep"))
    label = own.join(named_classes, F.col("fp") == F.col("of"), "left").select(
        F.col("fp").alias("mark"), F.coalesce("least", "rep").alias("component_id")
    )
    linked_rows = real.select("id", "n", "fp").join(label, F.col("fp") == F.col("mark")).select("id", "n", "component_id")
    others = marks.filter(F.col("id").isNull() | (F.col("n") == 0)).select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(others).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id"
    )
