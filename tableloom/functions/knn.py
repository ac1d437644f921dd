"""Exact k-nearest-neighbour join.

No pairs are materialised and nothing is approximated:

1. Equal candidate vectors are reduced to the first ``k`` ids (ties break by id,
   so the rest can never be returned). A pile of copies therefore costs ``k`` rows.
2. Candidates live in leaves of a two-level tree of cuts along leading principal
   axes. A bounded sample gives the axes and the upper level (or the groups are
   it); every cell of more than ``BLOCK_ROWS`` rows gets a lower level of its own,
   so the number of leaves follows the data. A leaf's summary is the box of its
   rows on the axes and the range of what the axes leave over: in many dimensions
   both bound distances far better than distances to pivots do.
3. A leaf is stored as blocks of bounded size. Blocks stay in place: queries
   stream past a block that a task holds, and keep their best ``k``. Every query
   first meets its home block, which bounds its k-th neighbour from above; then
   it goes only to blocks whose lower bound is within that.
4. Inside a task products in single precision or, by city blocks in many
   dimensions, codes of a few bits tell with a bound of their error which pairs
   can be among the best; only those are measured.
5. The local winners are merged per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tableloom.functions.expr import unit_hash
from tableloom.functions.keyed import top_k
from tableloom.session import materialise

BLOCK_ROWS = 4096
#: Queries that stream past one copy of a block; more get another copy of it.
STREAM_ROWS = 16 * BLOCK_ROWS
#: Bounds prune little in many dimensions, and then a query travels to most blocks: there a block is this part of all
#: candidates, up to so many rows, so a query travels a bounded number of times.
WIDE, WIDE_BLOCKS, WIDE_BLOCK_ROWS = 16, 16, 32_768
#: Entries of the matrices that a task holds at once: by products, by codes, and by one dimension after another.
PRODUCT_CELLS, CODE_CELLS, SUM_CELLS = 1_000_000, 262_144, 131_072
#: Levels of a code, codes whose distances add up to a byte; pairs of a matrix, one in so many, that are measured singly.
LEVELS, CODES_A_BYTE, FEW = 128, 2, 8
#: Vectors in the sample of a level, principal axes, cells of the upper level, leaves in all.
SAMPLE_ROWS, AXES, CELLS, LEAVES = 4096, 8, 256, 65_536
#: Relative room for rounding in bounds.
SLACK = 1e-9
METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski", "cosine")


def knn_join(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    *,
    query_id: str,
    candidate_id: str,
    query_vector: str = "vector",
    candidate_vector: str = "vector",
    metric: str = "euclidean",
    p: float = 2.0,
    exclude_same: bool = False,
    within: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, candidate_id, distance, rank[, within])``, at most ``k`` rows per query.

    ``within`` names a column on both sides; neighbours must share its value.
    For ``cosine`` the distance is ``1 - cosine similarity``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {', '.join(METRICS)}")
    wanted = k + 1 if exclude_same else k
    asked = _side(queries, query_id, "query_id", query_vector, within, metric)
    offered = _side(candidates, candidate_id, "candidate_id", candidate_vector, within, metric)
    offered = materialise(top_k(offered, ["cell", "vector"], [F.col("candidate_id")], wanted).drop("rank"))
    search = Search(wanted, metric, p, block_rows)
    layout = lay_out(offered, search, within is not None)
    near = search_blocks(asked, offered, layout, search)
    if exclude_same:
        near = near.filter(F.col("query_id") != F.col("candidate_id"))
    best = top_k(near, ["query_id"], [F.col("distance"), F.col("candidate_id")], k)
    if metric == "cosine":
        best = best.withColumn("distance", F.col("distance") * F.col("distance") / 2)
    return best


def _side(df: DataFrame, key: str, name: str, vector: str, within: str | None, metric: str) -> DataFrame:
    cell = F.col(within).cast("string") if within else F.lit("")
    side = df.select(cell.alias("cell"), F.col(key).alias(name), F.col(vector).cast("array<double>").alias("vector"))
    side = side.filter(F.col("cell").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
    return side.mapInArrow(_unit_rows(name), side.schema) if metric == "cosine" else side


def _unit_rows(name: str) -> Callable:
    """Vectors divided by their lengths; those of length zero have no direction and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = batch.column(2).flatten(), batch.column(2).offsets.to_numpy()
            x, starts = flat.to_numpy(zero_copy_only=False), offsets - offsets[:1]
            sizes = np.diff(starts)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            length = np.sqrt(np.bincount(rows, weights=x * x, minlength=len(sizes)))
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = x / length[rows]
            made = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(unit))
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["cell", name, "vector"])
            yield whole.filter(pa.array(length != 0))

    return run


# -- the tree ---------------------------------------------------------------------


@dataclass
class Tree:
    """Cuts along axes; a child below zero is leaf ``-child - 1``."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    leaves: int = 0

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every point."""
        at = np.zeros(len(points), dtype=np.int64)
        if not self.axis:
            return at
        axis, cut = np.array(self.axis), np.array(self.cut)
        below, above = np.array(self.below), np.array(self.above)
        moving = np.arange(len(points))
        while len(moving):
            node = at[moving]
            under = points[moving, axis[node]] <= cut[node]
            at[moving] = np.where(under, below[node], above[node])
            moving = moving[at[moving] >= 0]
        return -at - 1


def grow(points: np.ndarray, leaves: int) -> Tree:
    """A tree over a sample: always the widest axis is cut, in proportion to the leaves on either side."""
    tree = Tree()

    def split(rows: np.ndarray, count: int) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(points.shape[1])
        axis = int(spread.argmax()) if len(spread) else 0
        if count > 1 and len(spread) and spread[axis] > 0:
            half = count // 2
            values = np.sort(rows[:, axis])
            cut = float(values[min(len(values) - 1, max(0, len(values) * half // count - 1))])
            under = rows[:, axis] <= cut
            if under.any() and not under.all():
                node = len(tree.axis)
                tree.axis.append(axis)
                tree.cut.append(cut)
                tree.below.append(0)
                tree.above.append(0)
                tree.below[node] = split(rows[under], half)
                tree.above[node] = split(rows[~under], count - half)
                return node
        tree.leaves += 1
        return -tree.leaves

    if len(points):
        split(points, leaves)
    return tree if tree.axis else Tree(leaves=1)


@dataclass
class Search:
    """What is asked for."""

    wanted: int
    metric: str
    p: float
    block_rows: int

    @property
    def leaf_rows(self) -> int:
        return max(self.block_rows // 2, 2 * self.wanted)

    def distance(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return _distance(self.metric, self.p)

    def share(self, width: int) -> float:
        """The metric is at least this times the Euclidean distance."""
        if self.metric in ("euclidean", "cosine", "manhattan"):
            return 1.0
        p = np.inf if self.metric == "chebyshev" else self.p
        return 1.0 if p <= 2 else float(width) ** (1 / p - 0.5)


@dataclass
class Layout:
    """Axes, trees and the leaves' summaries; bounded by ``CELLS`` and ``LEAVES`` whatever the data."""

    centre: np.ndarray
    axes: np.ndarray  # columns
    upper: Tree
    lower: dict[str, Tree]
    parts: dict[tuple[str, int], int]
    boxes: dict[str, np.ndarray] = field(default_factory=dict)  # per cell: leaf, low, high per axis and for the rest

    def points(self, x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes and, last, the length of the rest."""
        gap = x - self.centre
        on = gap @ self.axes
        rest = gap - on @ self.axes.T
        return np.hstack([on, np.sqrt((rest * rest).sum(axis=1))[:, None]])

    def place(self, cells: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and leaf of every point; ``cells`` are group names, or empty where the upper level decides."""
        if self.upper.axis:
            cells = self.upper.place(points).astype(str).astype(object)
        leaf = np.zeros(len(points), dtype=np.int64)
        if self.lower:
            for cell in pd.unique(cells):
                if cell in self.lower:
                    rows = np.flatnonzero(cells == cell)
                    leaf[rows] = self.lower[cell].place(points[rows])
        return cells, leaf


def vectors_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def lay_out(offered: DataFrame, search: Search, grouped: bool) -> Layout:
    """Learns the tree from the candidates."""
    n = offered.count()
    sizes: dict[str, int] = {}
    if grouped:
        # groups larger than a block: fewer than rows / block_rows
        large = offered.groupBy("cell").count().filter(F.col("count") > search.block_rows)
        sizes = {r["cell"]: r["count"] for r in large.orderBy(F.desc("count"), "cell").limit(LEAVES).collect()}
    if (not grouped and n <= search.block_rows) or (grouped and not sizes):
        return Layout(np.zeros(1), np.zeros((1, 0)), Tree(leaves=1), {}, {})
    by_hash = F.xxhash64("vector", "candidate_id")
    sample = np.array([r["vector"] for r in offered.orderBy(by_hash).limit(SAMPLE_ROWS).select("vector").collect()])
    if sample.shape[1] > WIDE:
        search.block_rows = max(search.block_rows, min(WIDE_BLOCK_ROWS, -(-n // WIDE_BLOCKS)))
    centre = sample.mean(axis=0)
    _, size, v = np.linalg.svd(sample - centre, full_matrices=False)
    layout = Layout(centre, v[:AXES].T, Tree(leaves=1), {}, {})
    leaf_rows = max(search.leaf_rows, 2 * n // LEAVES)
    # where the axes hold little more than their share, a query travels to most leaves: about a block in each
    if sample.shape[1] > WIDE and (size[:AXES] ** 2).sum() * sample.shape[1] < 2 * AXES * (size**2).sum():
        leaf_rows = max(leaf_rows, 3 * search.block_rows // 4)
    if not grouped:
        layout.upper = grow(layout.points(sample), min(CELLS, -(-n // leaf_rows)))
    # lower level: a bounded sample of every large cell
    marked = offered.mapInArrow(_placing(layout, "candidate_id", keep=False), _placed(offered, "candidate_id", keep=False))
    counts = marked.groupBy("cell").count()
    sizes = {r["cell"]: r["count"] for r in counts.filter(F.col("count") > search.block_rows).orderBy(F.desc("count")).limit(LEAVES).collect()}
    if sizes:
        some = marked.join(F.broadcast(_listed(offered, sizes)), "cell")
        taken = top_k(some, ["cell"], [F.xxhash64("candidate_id", "point"), F.col("candidate_id")], SAMPLE_ROWS // 4)
        wanted_leaves = {c: max(1, min(CELLS, -(-m // leaf_rows))) for c, m in sizes.items()}
        kinds = "cell string, axis array<int>, cut array<double>, below array<int>, above array<int>, leaves int"

        def grown(group: pd.DataFrame) -> pd.DataFrame:  # one cell: a bounded sample
            cell = group["cell"].iloc[0]
            t = grow(np.stack(group["point"].to_numpy()), wanted_leaves[cell])
            return pd.DataFrame({"cell": [cell], "axis": [t.axis], "cut": [t.cut], "below": [t.below], "above": [t.above], "leaves": [t.leaves]})

        for r in taken.groupBy("cell").applyInPandas(grown, kinds).collect():
            layout.lower[r["cell"]] = Tree(list(r["axis"]), list(r["cut"]), list(r["below"]), list(r["above"]), r["leaves"])
    # summaries of the leaves from all rows
    marked = offered.mapInArrow(_placing(layout, "candidate_id", keep=False), _placed(offered, "candidate_id", keep=False))
    if grouped:
        marked = marked.join(F.broadcast(_listed(offered, sizes)), "cell")
    width = layout.axes.shape[1] + 1
    low = [F.min(F.col("point")[i]) for i in range(width)]
    high = [F.max(F.col("point")[i]) for i in range(width)]
    boxes = marked.groupBy("cell", "leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*low).alias("low"), F.array(*high).alias("high"))
    found: dict[str, list] = {}
    for r in boxes.collect():
        found.setdefault(r["cell"], []).append([r["leaf"], *r["low"], *r["high"]])
        if r["n"] > search.block_rows:
            layout.parts[r["cell"], r["leaf"]] = -(-r["n"] // search.block_rows)
    layout.boxes = {c: np.array(sorted(rows)) for c, rows in found.items()}
    return layout


def _listed(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in sizes], "cell string")


def _placed(df: DataFrame, key: str, keep: bool) -> str:
    kind = df.schema[key].dataType.simpleString()
    rest = "vector array<double>" if keep else "point array<double>"
    return f"cell string, {key} {kind}, leaf int, part int, {rest}"


def _placing(layout: Layout, key: str, keep: bool) -> Callable:
    """Cell, leaf and part of rows (cell, key, vector); with the vector, or with its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0)
            points = np.zeros((batch.num_rows, 1))
            leaf = np.zeros(batch.num_rows, dtype=np.int64)
            if layout.boxes or layout.upper.axis or layout.axes.size:
                points = layout.points(vectors_of(batch.column(2)))
                names, leaf = layout.place(np.array(cells.to_pylist(), dtype=object), points)
                cells = pa.array(names, pa.string())
            part = np.zeros(batch.num_rows, dtype=np.int64)
            if layout.parts:
                ids = pd.util.hash_array(np.array(batch.column(1).to_pylist(), dtype=object).astype(str).astype(object), categorize=False)
                cuts = np.array([layout.parts.get(at, 1) for at in zip(cells.to_pylist(), leaf.tolist())], dtype=np.uint64)
                part = (ids % cuts).astype(np.int64)
            last = batch.column(2) if keep else pa.array(list(points), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [cells, batch.column(1), pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), last],
                names=["cell", key, "leaf", "part", "vector" if keep else "point"],
            )

    return run


# -- blocks and streams -----------------------------------------------------------------

UNIT = ["cell", "leaf", "part"]


def search_blocks(asked: DataFrame, offered: DataFrame, layout: Layout, search: Search) -> DataFrame:
    """(query_id, candidate_id, distance): the best of each block that a query met."""
    blocks = offered.select("cell", "candidate_id", "vector").mapInArrow(
        _placing(layout, "candidate_id", keep=True), _placed(offered, "candidate_id", keep=True)
    )
    home = asked.select("cell", "query_id", "vector").mapInArrow(
        _placing(layout, "query_id", keep=True), _placed(asked, "query_id", keep=True)
    ).withColumn("bound", F.lit(float("inf")))
    if not layout.boxes:  # one block per group
        return _pairs(stream(home, blocks, search))
    blocks = materialise(blocks)
    first = materialise(stream(home, blocks, search))
    again = first.mapInArrow(_routing(layout, search), _routed_schema(asked))
    return _pairs(first).unionByName(_pairs(stream(again, blocks, search, keep=False)))


def _pairs(found: DataFrame) -> DataFrame:
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "distances")).alias("pair"))
    return pairs.select("query_id", F.col("pair.ids").alias("candidate_id"), F.col("pair.distances").alias("distance"))


def _routed_schema(asked: DataFrame) -> str:
    kind = asked.schema["query_id"].dataType.simpleString()
    return f"cell string, query_id {kind}, leaf int, part int, vector array<double>, bound double"


def _routing(layout: Layout, search: Search) -> Callable:
    """Sends every query on to the blocks that can hold something nearer than its k-th neighbour so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(layout.boxes)
        m = layout.axes.shape[1] + 1
        outer = np.array([np.r_[b[:, 1 : m + 1].min(axis=0), b[:, m + 1 :].max(axis=0)] for b in layout.boxes.values()])
        free = bool(layout.upper.axis) or names == [""]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column(4))
            points, share = layout.points(x), search.share(x.shape[1])
            bound = batch.column(5).to_numpy(zero_copy_only=False)
            reach = bound * (1 + SLACK) + SLACK * (1 + np.sqrt((points * points).sum(axis=1)))
            cells = np.array(batch.column(0).to_pylist(), dtype=object)
            leaves, parts = (batch.column(i).to_numpy() for i in (2, 3))
            for at, cell in enumerate(names):
                if free:
                    rows = np.flatnonzero(share * _gap(points, outer[at, :m], outer[at, m:]) <= reach)
                else:
                    rows = np.flatnonzero(cells == cell)
                for box in layout.boxes[cell]:
                    if not len(rows):
                        break
                    leaf = int(box[0])
                    near = rows[share * _gap(points[rows], box[1 : m + 1], box[m + 1 :]) <= reach[rows]]
                    for part in range(layout.parts.get((cell, leaf), 1)):
                        to = near[~((cells[near] == cell) & (leaves[near] == leaf) & (parts[near] == part))]
                        if len(to):
                            yield pa.RecordBatch.from_arrays([
                                pa.array([cell] * len(to), pa.string()), batch.column(1).take(pa.array(to)),
                                pa.array(np.full(len(to), leaf), pa.int32()), pa.array(np.full(len(to), part), pa.int32()),
                                batch.column(4).take(pa.array(to)), pa.array(bound[to]),
                            ], names=["cell", "query_id", "leaf", "part", "vector", "bound"])

    return run


def _gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least Euclidean distance to anything in a box, the rest's length being one more coordinate."""
    out = np.maximum(np.maximum(low - points, points - high), 0.0)
    return np.sqrt((out * out).sum(axis=1))


def stream(asked: DataFrame, blocks: DataFrame, search: Search, keep: bool = True) -> DataFrame:
    """Streams queries past the block that they are sent to.

    A row per query and block: (cell, query_id, leaf, part, vector, bound, ids, distances), ``bound`` being the k-th
    distance so far, endless if fewer were found. ``keep``: queries go on from here, so their vectors are needed.
    """
    # a block that very many queries visit is there once for every STREAM_ROWS of them
    busy = asked.groupBy(*UNIT).count().filter(F.col("count") > STREAM_ROWS)
    busy = materialise(busy.select(*UNIT, F.ceil(F.col("count") / STREAM_ROWS).cast("int").alias("shares")))
    small = busy.count() <= LEAVES
    shares = F.broadcast(busy) if small else busy
    n = F.coalesce(F.col("shares"), F.lit(1))
    asked = asked.join(shares, UNIT, "left").withColumn("share", F.pmod(F.xxhash64("query_id"), n).cast("int")).drop("shares")
    blocks = blocks.join(shares, UNIT, "left").withColumn("share", F.explode(F.sequence(F.lit(0), n - 1))).drop("shares")
    q_type, c_type = asked.schema["query_id"].dataType, blocks.schema["candidate_id"].dataType
    q_kind, c_kind = q_type.simpleString(), c_type.simpleString()
    unit = [*UNIT, "share"]
    both = blocks.select(
        *unit, F.lit(0).alias("kind"), F.lit(None).cast(q_kind).alias("query_id"), "candidate_id", "vector",
        F.lit(None).cast("double").alias("bound"),
    ).unionByName(asked.select(
        *unit, F.lit(1).alias("kind"), "query_id", F.lit(None).cast(c_kind).alias("candidate_id"), "vector", "bound",
    ))
    dealt = both.repartition(*unit).sortWithinPartitions(*unit, "kind")
    schema = (
        f"cell string, query_id {q_kind}, leaf int, part int, vector array<double>, bound double, ids array<{c_kind}>,"
        " distances array<double>"
    )
    names = ["cell", "query_id", "leaf", "part", "vector", "bound", "ids", "distances"]
    id_type, wanted, distance = to_arrow_type(c_type), search.wanted, search.distance()
    squared = search.metric in ("euclidean", "cosine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            kinds = batch.column(4).to_numpy()
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                part = batch.slice(a, b - a)
                if keys[a] != now:
                    now, ids, held, block = keys[a], [], [], None
                if kinds[a] == 0:
                    ids += part.column(6).to_pylist()
                    held.append(vectors_of(part.column(7)))
                    continue
                if block is None:
                    block = Block(ids, np.vstack(held) if held else np.zeros((0, 0)))
                x = vectors_of(part.column(7))
                bound = part.column(8).to_numpy(zero_copy_only=False)
                found = block.best(x, bound, wanted, squared, distance)
                offsets = pa.array(np.r_[0, np.cumsum([len(f[0]) for f in found])], pa.int32())
                listed = pa.array([i for f in found for i in f[0]], id_type)
                far = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
                bounds = [f[1][-1] if len(f[0]) == wanted else np.inf for f in found]
                vectors = part.column(7)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(5), part.column(1), part.column(2),
                    vectors if keep else pa.nulls(len(vectors), vectors.type),
                    pa.array(np.minimum(bounds, bound)), pa.ListArray.from_arrays(offsets, listed),
                    pa.ListArray.from_arrays(offsets, pa.array(far)),
                ], names=names)

    return dealt.mapInArrow(run, schema)


class Block:
    """The candidates that a task holds."""

    def __init__(self, ids: list, vectors: np.ndarray):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, self.vectors = [ids[i] for i in order], vectors[order]
        self.rough: Products | Codes | None = None
        self.across: np.ndarray | None = None  # the vectors by dimension

    def best(self, x: np.ndarray, bound: np.ndarray, wanted: int, squared: bool, distance: Callable) -> list[tuple[list, np.ndarray]]:
        """Ids and distances of each query's best ``wanted`` within its bound, nearest first, ties to the smaller id."""
        found: list[tuple[list, np.ndarray]] = []
        if not self.ids:
            return [([], np.zeros(0))] * len(x)
        coded = not squared and getattr(distance, "sums", False) and x.shape[1] > WIDE
        if self.rough is None and (squared or coded):
            self.rough = (Products if squared else Codes)(self.vectors)
        cells = PRODUCT_CELLS if squared else CODE_CELLS if coded else SUM_CELLS
        for part in _chunks(len(x), len(self.ids), cells):
            row, column, d = self.near(x[part], bound[part], min(wanted, len(self.ids)), squared, distance)
            near = d <= bound[part][row] * (1 + SLACK)
            row, column, d = row[near], column[near], d[near]
            order = np.lexsort((column, d, row))  # candidates are in the order of their ids
            row, column, d = row[order], column[order], d[order]
            starts = np.searchsorted(row, np.arange(len(x[part]) + 1))
            for a, b in zip(starts, starts[1:]):
                b = min(b, a + wanted)
                found.append(([self.ids[c] for c in column[a:b]], d[a:b]))
        return found

    def near(self, x: np.ndarray, bound: np.ndarray, k: int, squared: bool, distance: Callable):
        """Pairs that can be among the k best and within the bound, with their distances."""
        seeming = self.rough.table(x) if self.rough is not None else None
        if seeming is not None:
            least, most = self.rough.least(seeming), max(seeming.size // FEW, 2 * k * len(x))

            def reached(table: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return np.divmod(np.flatnonzero(table <= limit[:, None]), table.shape[1])

            def measured(row: np.ndarray, column: np.ndarray) -> np.ndarray:
                return _measured(x, self.vectors, row, column, squared, distance)

            ended = np.isfinite(bound).all()
            row, column = reached(least, self.rough.limit(x, bound)) if ended else (None, None)
            if not ended or len(row) > most:
                # the k that seem best, and all as near as the farthest of them
                row, column = reached(seeming, np.partition(seeming, k - 1, axis=1)[:, k - 1])
                if len(row) <= most:
                    far = np.maximum.reduceat(measured(row, column), np.searchsorted(row, np.arange(len(x))))
                    row, column = reached(least, self.rough.limit(x, np.minimum(bound, far)))
            if len(row) <= most:
                return row, column, measured(row, column)
        size, against = len(x), self.vectors
        if not squared:
            self.across = np.asfortranarray(self.vectors) if self.across is None else self.across
            size, against = max(1, SUM_CELLS // len(self.ids)), self.across
        found = []
        for i in range(0, len(x), size):
            row, column, d = _close_pairs(x[i : i + size], against, k, squared, distance)
            found.append((row + i, column, d))
        return tuple(np.concatenate(part) for part in zip(*found))


# -- distances inside a task ---------------------------------------------------------------


def _distance(metric: str, p: float) -> Callable[..., np.ndarray]:
    sums = metric == "manhattan" or (metric == "minkowski" and p == 1)

    def full(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
        """Distances of all pairs, or row by row."""
        # one dimension after another, in place: no array of all pairs and dimensions
        shape = len(a) if paired else (len(a), len(b))
        total, gap = np.zeros(shape), np.empty(shape)
        for one, others in zip(a.T, np.ascontiguousarray(b.T)):
            np.abs(np.subtract(one if paired else one[:, None], others, out=gap), out=gap)
            if metric == "chebyshev":
                np.maximum(total, gap, out=total)
                continue
            if metric == "minkowski" and p not in (1, 2):
                np.power(gap, p, out=gap)
            elif not sums:
                np.multiply(gap, gap, out=gap)
            total += gap
        if metric == "chebyshev" or sums:
            return total
        return total ** (1.0 / p) if metric == "minkowski" and p != 2 else np.sqrt(total)

    full.sums = sums
    return full


def _chunks(n: int, other: int, cells: int) -> Iterator[slice]:
    step = max(1, cells // max(1, other))
    return (slice(i, i + step) for i in range(0, n, step))


def _close_pairs(x, y, k: int, squared: bool, distance: Callable):
    """Pairs that can be among the k best, with their distances computed without cancellation."""
    if squared:
        rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        scale = (x * x).sum(1).max() + (y * y).sum(1).max()
        slack = 1e-13 * (x.shape[1] + 8) * scale
    else:
        rough, slack = distance(x, y), 0.0
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1][:, None] + slack
    row, column = np.nonzero(rough <= limit)
    if not squared:
        return row, column, rough[row, column]
    gap = x[row] - y[column]
    return row, column, np.sqrt((gap * gap).sum(axis=1))


def _measured(x, y, row, column, squared: bool, distance: Callable) -> np.ndarray:
    d = np.empty(len(row))
    for part in _chunks(len(row), x.shape[1], SUM_CELLS):
        a, b = x[row[part]], y[column[part]]
        if squared:
            gap = a - b
            d[part] = np.sqrt((gap * gap).sum(axis=1))
        else:
            d[part] = distance(a, b, paired=True)
    return d


class Products:
    """Squared distances, less the query's own square, by products in single precision."""

    def __init__(self, y: np.ndarray):
        size = (y * y).sum(axis=1)
        self.top = float(size.max())
        self.usable = self.top < 1e30
        if self.usable:
            self.y = np.ascontiguousarray(np.hstack([-2 * y, size[:, None]]).astype(np.float32).T)

    def table(self, x: np.ndarray) -> np.ndarray | None:
        """Every query by every candidate, if all are numbers of a usual size."""
        if not self.usable or not ((x * x).sum(axis=1) < 1e30).all():
            return None
        return np.hstack([x, np.ones((len(x), 1))]).astype(np.float32) @ self.y

    def least(self, table: np.ndarray) -> np.ndarray:
        return table

    def limit(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """What the least distances are at most for pairs within the bound."""
        size = (x * x).sum(axis=1)
        # above what the roundings of all terms and of their sum make
        error = 4e-7 * (x.shape[1] + 8) * (size + self.top) + 1e-30
        most = bound * bound * (1 + 4 * SLACK) - size + error
        return np.nextafter(most.astype(np.float32), np.float32(np.inf))


class Codes:
    """City-block distances, in steps, by codes of a few bits per dimension.

    A vector is off its code by the sum of what its coordinates are off, so the distance of two codes is off by at most
    both. Coordinates beyond the levels are off by more; their vectors are measured more often.
    """

    def __init__(self, y: np.ndarray):
        self.usable = bool(np.isfinite(y).all())
        if not self.usable:
            return
        low, high = np.quantile(y, [0.01, 0.99], axis=0)
        spread = float((high / 2 - low / 2).max()) * 2
        if not spread:
            low, spread = y.min(axis=0), float((y.max(axis=0) / 2 - y.min(axis=0) / 2).max()) * 2
        self.step = max(1.5 * spread / (LEVELS - 1), 1e-150)
        self.low = low - 0.25 * spread
        self.kind = np.uint16 if LEVELS * y.shape[1] < 1 << 16 else np.uint32
        self.usable = self.step < 1e150
        if self.usable:
            codes, off = self.coded(y)
            self.codes, self.off = np.ascontiguousarray(codes.T), self.rounded(off)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how many steps each vector is off at most, with room for rounding."""
        with np.errstate(over="ignore"):  # endless: measured
            level = np.clip(np.rint((x - self.low) / self.step), 0, LEVELS - 1)
            gap = np.abs(x - (self.low + level * self.step)).sum(axis=1)
            room = 1e-12 * (np.abs(x).sum(axis=1) + np.abs(self.low).sum() + LEVELS * x.shape[1] * self.step)
            return level.astype(np.int8), (gap + room) / self.step

    def table(self, x: np.ndarray) -> np.ndarray | None:
        """Every query by every candidate, if all are finite."""
        if not self.usable or not np.isfinite(x).all():
            return None
        codes = self.coded(x)[0].T
        shape = len(x), self.codes.shape[1]
        total = np.zeros(shape, self.kind)
        gap, few = np.empty(shape, np.int8), np.empty(shape, np.uint8)
        for i, (one, others) in enumerate(zip(codes, self.codes)):
            to = gap if i % CODES_A_BYTE else few.view(np.int8)
            np.abs(np.subtract(one[:, None], others, out=to), out=to)
            if i % CODES_A_BYTE:
                few += gap.view(np.uint8)
            if i % CODES_A_BYTE == CODES_A_BYTE - 1 or i == len(codes) - 1:
                total += few
        return total

    def least(self, table: np.ndarray) -> np.ndarray:
        """What the distances are at least, but for what the queries are off."""
        found = np.maximum(table, self.off)
        return np.subtract(found, self.off, out=found)

    def limit(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """What the least distances are at most for pairs within the bound."""
        return self.rounded(bound * (1 + 4 * SLACK) / self.step + self.coded(x)[1])

    def rounded(self, steps: np.ndarray) -> np.ndarray:
        return np.minimum(np.ceil(steps), np.iinfo(self.kind).max).astype(self.kind)


# -- every block against every block, for distances without bounds -----------------------------


def block_of(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), parts).cast("int")


def pair_units(
    asked: DataFrame, offered: DataFrame, query_parts: Column, candidate_parts: Column
) -> tuple[DataFrame, DataFrame]:
    """Give both sides ``(part_q, part_c)`` so that every block meets every other once."""
    others = F.explode(F.sequence(F.lit(0), candidate_parts - 1))
    asked = asked.withColumn("part_q", block_of(F.col("query_id"), query_parts)).withColumn("part_c", others)
    offered = offered.withColumn(
        "part_c", block_of(F.col("candidate_id"), candidate_parts)
    ).withColumn("part_q", F.explode(F.sequence(F.lit(0), query_parts - 1)))
    return asked, offered


def cogroup_blocks(asked: DataFrame, offered: DataFrame, work: Callable, schema) -> DataFrame:
    keys = ["cell", "part_q", "part_c"]
    return asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(work, schema)


def blocks_for(rows: int, block_rows: int) -> int:
    return max(1, -(-rows // block_rows))


def whole_units(asked: DataFrame, offered: DataFrame, n_asked: int, n_offered: int, block_rows: int):
    """Every block against every block, for distances without a triangle inequality."""
    parts = F.lit(blocks_for(n_asked, block_rows)), F.lit(blocks_for(n_offered, block_rows))
    return pair_units(
        asked.withColumn("cell", F.lit("all")), offered.withColumn("cell", F.lit("all")), *parts
    )
