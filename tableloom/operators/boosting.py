"""Second-order gradient boosting on histograms.

Features are cut into bins once. Rows with the same bins get the same score for ever, so without subsampling they are
added up to one weighted row: a regression needs their number and mean label, classes the number per label. There are at
most as many as combinations of bins, however long the table is. What is left is stored in packed blocks that a task
reads as arrays. A pass over the rows adds up gradients, second derivatives and rows by (node, feature,
bin) in every task, Spark sums them, and the driver picks splits from sums alone. A pass covers all nodes that can be
split next, of the trees of all classes at once, so a tree takes about as many passes as it has levels, however it
grows: level by level to a depth, by the same cut in all nodes of a level (oblivious), or best leaf first to a number of
leaves, where nodes are examined until the best-first order is settled. Leaves may be penalised (L1 and L2).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.columns import q
from tableloom.functions.expr import unit_hash
from tableloom.operators.base import FittedStep, Step
from tableloom.session import materialise

#: Rounds after which the rows' scores are written, so a pass evaluates few trees; a table of one task is read so fast
#: that it keeps more.
ROUNDS_KEPT, ROUNDS_KEPT_SMALL = 3, 8
#: Rows per task, at least as far as the input's partitions allow; rows and bytes of a packed block, blocks per file.
TASK_ROWS, PACK_ROWS, PACK_BYTES, PACKS_PER_FILE = 131_072, 16_384, 4 * 1024 * 1024, 16
#: Features whose sums travel in one row.
FEATURE_BLOCK = 64
LEAST_GAIN = 1e-12
#: Partial sums that may come to the driver unadded.
DRIVER_BYTES = 32 * 1024 * 1024


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def strength(g, h, l1: float, l2: float):
    """What a leaf with these sums takes off the loss, twice."""
    return shrunk(g, l1) ** 2 / np.maximum(h + l2, 1e-300)


class Growing:
    """One tree while it grows: nodes with their sums; leaves have no split."""

    def __init__(self):
        self.left, self.right, self.feature, self.bin, self.depth, self.gain = [-1], [-1], [-1], [-1], [0], [0.0]
        self.sums: list[np.ndarray | None] = [None]
        self.best: list[tuple | None] = [None]  # (gain, place of the feature, bin) once examined
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # sums and gains of examined leaves
        self.done = False

    def split(self, node: int, at: int, cut: int, chosen: np.ndarray, final: bool) -> None:
        """Cuts a leaf; its children's sums are known from its own. ``final``: they are not examined further."""
        table, gains = self.tables.pop(node)
        below = table[at, : cut + 1].sum(axis=0)
        for side, sums in ((self.left, below), (self.right, table[at].sum(axis=0) - below)):
            side[node] = len(self.feature)
            for values in (self.left, self.right, self.feature, self.bin):
                values.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.gain.append(0.0)
            self.sums.append(sums)
            self.best.append((0.0, -1, -1) if final else None)
        self.feature[node], self.bin[node], self.gain[node] = int(chosen[at]), cut, float(gains[at, cut])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.feature, self.bin, self.left, self.right))


def placed(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Node of every row in a tree over bins."""
    feature, cut, left, right = tree
    at = np.zeros(len(bins), dtype=np.int64)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        node = at[moving]
        at[moving] = np.where(bins[moving, feature[node]] <= cut[node], left[node], right[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def slopes(y: np.ndarray, scores: np.ndarray, task: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each score."""
    if task == "regression":
        return scores - y[:, None], np.ones_like(scores)
    if classes <= 2:
        p = 1 / (1 + np.exp(-scores))
        return p - y[:, None], p * (1 - p)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (np.arange(classes)[None, :] == y[:, None]), 2 * p * (1 - p)


class HistogramBooster(Step):
    """Boosted trees. ``growth``: ``level`` (to ``max_depth``), ``oblivious`` or ``leaf`` (to ``max_leaves``).

    ``classes``: two are learned by one score, more by a score each under one softmax. A missing feature value goes with
    the largest bin. Rows without a label are left out.
    """

    OPTIONS: ClassVar = {
        "task": "regression", "classes": 0, "features": "__features", "label": "__y", "rounds": 100,
        "learning_rate": 0.1, "growth": "level", "max_depth": 6, "max_leaves": 31, "min_rows": 1, "min_hessian": 0.0,
        "l1": 0.0, "l2": 0.0, "max_bins": 255, "subsample": 1.0, "column_share": 1.0, "seed": 42,
    }

    def _fit(self, df: DataFrame) -> HistogramBoosterModel:
        rows = df.select(vector_to_array(q(self.opt("features"))).alias("x"), q(self.opt("label")).cast("double").alias("y"))
        rows = rows.filter(F.col("y").isNotNull() & F.col("x").isNotNull())
        head = rows.first()
        if head is None:
            raise ValueError("no row to learn from")
        width, task = len(head["x"]), self.opt("task")
        classes = int(self.opt("classes")) if task == "classification" else 0
        outputs = classes if classes > 2 else 1
        edges = bin_edges(rows, width, self.opt("max_bins"))
        base = self._base(rows, classes, outputs)
        marked = materialise(weighed(binned(rows, edges, self.opt("subsample") < 1), task, self.opt("subsample") < 1))
        held = marked.count()
        # many short passes: no more tasks than the rows are worth
        few = marked.coalesce(max(1, -(-held // TASK_ROWS)))
        table = materialise(few.mapInArrow(_packing(width, base), PACKED), PACKS_PER_FILE)
        tasks = table.rdd.getNumPartitions()
        rounds_kept = ROUNDS_KEPT_SMALL if held <= TASK_ROWS else ROUNDS_KEPT
        trees: list[list[dict]] = []
        pending: list[list[tuple]] = []  # rounds not yet in the written scores: per output (arrays, values)
        rng = np.random.default_rng(self.opt("seed"))
        for number in range(self.opt("rounds")):
            chosen = np.arange(width)
            if self.opt("column_share") < 1.0:
                chosen = np.sort(rng.choice(width, max(1, round(self.opt("column_share") * width)), replace=False))
            grown = self._round(table, tasks, pending, number, chosen, edges, classes, outputs)
            values = [self._values(t) for t in grown]
            trees.append([stored(t, v, edges) for t, v in zip(grown, values)])
            pending.append([(t.arrays(), v) for t, v in zip(grown, values)])
            if all(len(t.feature) == 1 and abs(v[0]) < 1e-15 for t, v in zip(grown, values)):
                break  # nothing is left to learn
            if len(pending) == rounds_kept and number + 1 < self.opt("rounds"):
                table, pending = materialise(table.mapInArrow(_rescored(pending), PACKED), PACKS_PER_FILE), []
        return HistogramBoosterModel(self.options(), {"trees": trees, "base": [float(b) for b in base]})

    def _base(self, rows: DataFrame, classes: int, outputs: int) -> list[float]:
        if classes > 2:
            return [0.0] * outputs
        mean = rows.agg(F.avg("y")).first()[0]
        if self.opt("task") == "regression":
            return [mean]
        share = min(max(mean, 1e-6), 1 - 1e-6)
        return [float(np.log(share / (1 - share)))]

    def _values(self, tree: Growing) -> np.ndarray:
        out = np.zeros(len(tree.feature))
        for node, sums in enumerate(tree.sums):
            if tree.feature[node] < 0 and sums is not None:
                out[node] = -self.opt("learning_rate") * shrunk(sums[0], self.opt("l1")) / max(sums[1] + self.opt("l2"), 1e-300)
        return out

    def _round(self, table, tasks, pending, number, chosen, edges, classes, outputs) -> list[Growing]:
        trees, growth = [Growing() for _ in range(outputs)], self.opt("growth")
        widest = max(len(e) for e in edges) + 1
        empty = np.zeros((len(chosen), widest, 3))
        while True:
            wanted = [self._open(t) for t in trees]
            if not any(wanted):
                return trees
            found = histograms(table, tasks, pending, trees, wanted, number, classes, chosen, widest, self.options())
            for tree, nodes, sums in zip(trees, wanted, found):
                for node in nodes:
                    self._examine(tree, node, sums.get(node, empty))
                if growth == "leaf":
                    self._best_first(tree, chosen)
                elif growth == "oblivious":
                    self._split_alike(tree, nodes, chosen)
                else:
                    for node in nodes:
                        self._cut(tree, node, chosen)

    def _cut(self, tree: Growing, node: int, chosen: np.ndarray) -> None:
        depth = tree.depth[node] + 1
        if tree.best[node][0] > LEAST_GAIN and depth <= self.opt("max_depth"):
            tree.split(node, *tree.best[node][1:], chosen, depth == self.opt("max_depth"))

    def _open(self, tree: Growing) -> list[int]:
        """Leaves that are not examined yet."""
        return [] if tree.done else [n for n in range(len(tree.feature)) if tree.feature[n] < 0 and tree.best[n] is None]

    def _examine(self, tree: Growing, node: int, table: np.ndarray) -> None:
        """Sums of a node, (gradient, second derivative, rows) by feature and bin, and its best split."""
        tree.sums[node] = table[0].sum(axis=0)
        gains = self._gains(table)
        tree.tables[node] = table, gains
        at = int(gains.argmax()) if gains.size else 0
        best = float(gains.ravel()[at]) if gains.size else 0.0
        tree.best[node] = (best, *divmod(at, gains.shape[1])) if best > LEAST_GAIN else (0.0, -1, -1)

    def _gains(self, table: np.ndarray) -> np.ndarray:
        """Gain of a cut after every bin of every feature."""
        l1, l2 = self.opt("l1"), self.opt("l2")
        below = np.cumsum(table, axis=1)[:, :-1]
        whole = table.sum(axis=1)[:, None]
        above = whole - below
        gain = 0.5 * (
            strength(below[..., 0], below[..., 1], l1, l2) + strength(above[..., 0], above[..., 1], l1, l2)
            - strength(whole[..., 0], whole[..., 1], l1, l2)
        )
        enough = (np.minimum(below[..., 2], above[..., 2]) >= max(self.opt("min_rows"), 1)) & (
            np.minimum(below[..., 1], above[..., 1]) >= self.opt("min_hessian")
        )
        return np.where(enough, gain, 0.0)

    def _split_alike(self, tree: Growing, nodes: list[int], chosen) -> None:
        """The cut that gains most over all nodes of the level together."""
        if not nodes or tree.depth[nodes[0]] >= self.opt("max_depth"):
            return
        total = sum(tree.tables[n][1] for n in nodes)
        at = int(total.argmax()) if total.size else 0
        if total.size and total.ravel()[at] > LEAST_GAIN:
            for node in nodes:
                tree.split(node, *divmod(at, total.shape[1]), chosen, tree.depth[node] + 1 == self.opt("max_depth"))

    def _best_first(self, tree: Growing, chosen: np.ndarray) -> None:
        """Follows the best-first order through what is known. Where it meets a leaf that was not cut yet, that leaf and
        all others that might still get their turn are cut ahead, so the next pass examines all their children at once.
        Once the order is settled, cuts that it did not reach are taken back."""
        kept, waiting, leaves = set(), [0], 1
        while leaves < self.opt("max_leaves"):
            waiting.sort(key=lambda n: (-tree.best[n][0], n))
            if not waiting or tree.best[waiting[0]][0] <= LEAST_GAIN:
                break
            node = waiting[0]
            if tree.feature[node] < 0:
                for other in waiting[: self.opt("max_leaves") - leaves]:
                    if tree.feature[other] < 0 and tree.best[other][0] > LEAST_GAIN:
                        tree.split(other, *tree.best[other][1:], chosen, False)
                return
            kept.add(node)
            leaves += 1
            waiting = waiting[1:] + [tree.left[node], tree.right[node]]
        tree.feature = [f if n in kept else -1 for n, f in enumerate(tree.feature)]
        tree.done = True


def bin_edges(rows: DataFrame, width: int, max_bins: int) -> list[np.ndarray]:
    """Cuts per feature: values of the data at even ranks, at most ``max_bins - 1`` of them; a bin is what is at most its
    cut and above the one before."""
    probs = [i / max_bins for i in range(1, max_bins)]
    finite = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    found = rows.agg(*[F.percentile_approx(c, probs, 10 * max_bins * 4).alias(f"e{i}") for i, c in enumerate(finite)], *[F.max(c).alias(f"m{i}") for i, c in enumerate(finite)]).first()
    return [np.unique([v for v in (found[f"e{i}"] or []) if v != found[f"m{i}"]]).astype(float) for i in range(width)]


def binned(rows: DataFrame, edges: list[np.ndarray], drawn: bool = True) -> DataFrame:
    """(bins, y, u): a byte pair per feature, the label and, if rows are ``drawn``, a number from 0 to 1 that the row alone
    decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
            bins = np.where(np.isnan(x), np.array([len(e) for e in edges])[None, :], bins).astype("<u2")
            size, flat = 2 * len(edges), pa.py_buffer(bins.tobytes())
            ends = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], flat])
            yield pa.RecordBatch.from_arrays([made, batch.column(1), batch.column(2)], names=["bins", "y", "u"])

    marked = rows.withColumn("u", unit_hash(F.col("x"), F.col("y")) if drawn else F.lit(0.0))
    return marked.mapInArrow(run, "bins binary, y double, u double")


def weighed(rows: DataFrame, task: str, drawn: bool) -> DataFrame:
    """(bins, y, u, w): rows that no tree can tell apart are one row of their number. Where rows are drawn each stays."""
    if drawn:
        return rows.withColumn("w", F.lit(1.0))
    n = F.count(F.lit(1)).cast("double").alias("w")
    if task == "regression":
        # the sum of squared errors to a mean differs by a constant
        found = rows.groupBy("bins").agg(F.avg("y").alias("y"), n)
    else:
        found = rows.groupBy("bins", "y").agg(n)
    return found.select("bins", "y", F.lit(0.0).alias("u"), "w")


#: Rows one after another: bins (two bytes each), label, drawing number, weight and a score per output as doubles.
PACKED = "n int, bins binary, y binary, u binary, w binary, scores binary"


def _packing(width: int, base: list[float]):
    """Rows (bins, y, u, w) as packed blocks of bounded size, with their first scores."""
    most = max(1, min(PACK_ROWS, PACK_BYTES // (2 * width + 24 + 8 * len(base))))

    def block(rows: pa.Table) -> pa.RecordBatch:
        values = [rows.column(i).to_numpy().astype("<f8").tobytes() for i in (1, 2, 3)]
        scores = np.tile(np.array(base, "<f8"), (len(rows), 1)).tobytes()
        bins = b"".join(rows.column(0).to_pylist())
        parts = [[len(rows)], [bins], *([v] for v in values), [scores]]
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.binary() if i else pa.int32()) for i, p in enumerate(parts)],
            names=["n", "bins", "y", "u", "w", "scores"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting, n = [*waiting, batch], n + batch.num_rows
            if n < most:
                continue
            rows = pa.Table.from_batches(waiting)
            while len(rows) >= most:
                yield block(rows.slice(0, most))
                rows = rows.slice(most)
            waiting, n = rows.to_batches(), len(rows)
        if n:
            yield block(pa.Table.from_batches(waiting))

    return run


def unpacked(batch: pa.RecordBatch, i: int, pending: list) -> tuple[np.ndarray, ...]:
    """Bins, label, drawing number, weight and scores of a block's rows, after the rounds that are not written yet."""
    n = batch.column(0)[i].as_py()
    bins = np.frombuffer(batch.column(1)[i].as_buffer(), "<u2").reshape(n, -1)
    y, u, w = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8") for c in (2, 3, 4))
    scores = np.frombuffer(batch.column(5)[i].as_buffer(), "<f8").reshape(n, -1).copy()
    for outputs in pending:
        for k, (tree, values) in enumerate(outputs):
            scores[:, k] += values[placed(tree, bins)]
    return bins, y, u, w, scores


def _rescored(pending: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scores = pa.array([unpacked(batch, i, pending)[-1].tobytes()], pa.binary())
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:5], scores], names=row.schema.names)

    return run


def histograms(table: DataFrame, tasks: int, pending, trees, wanted, number, classes, chosen, widest, options) -> list[dict[int, np.ndarray]]:
    """Per output and node: sums by (feature, bin) of gradient, second derivative and rows."""
    grown, task, subsample = [t.arrays() for t in trees], options["task"], options["subsample"]
    blocks = [chosen[i : i + FEATURE_BLOCK] for i in range(0, len(chosen), FEATURE_BLOCK)]

    def add(sums: dict, bins, y, u, w, scores) -> None:
        g, h = slopes(y, scores, task, classes)
        drawn = np.flatnonzero(np.modf((u + 0.618033988749895 * (number + 1)) * 9973)[0] < subsample) if subsample < 1 else np.arange(len(y))
        for k, tree in enumerate(grown):
            at = placed(tree, bins[drawn])
            for node in wanted[k]:
                rows = drawn[at == node]
                if not len(rows):
                    continue
                weight = w[rows]
                values = g[rows, k] * weight, h[rows, k] * weight, weight
                for b, block in enumerate(blocks):
                    cell = (bins[np.ix_(rows, block)] + np.arange(len(block))[None, :] * widest).ravel()
                    size = len(block) * widest
                    made = np.stack([np.bincount(cell, np.repeat(v, len(block)), size) for v in values], axis=1).ravel()
                    sums[k, node, b] = sums.get((k, node, b), 0.0) + made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                add(sums, *unpacked(batch, i, pending))
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            *(pa.array([key[i] for key in keys], pa.int32()) for i in range(3)),
            pa.array([sums[key].tobytes() for key in keys], pa.binary()),
        ], names=["k", "node", "block", "v"])

    parts = table.mapInArrow(run, "k int, node int, block int, v binary")
    # partial sums of few tasks are added up here; those of many are added up by Spark first
    if 24 * widest * len(chosen) * sum(map(len, wanted)) * tasks > DRIVER_BYTES:
        parts = parts.groupBy("k", "node", "block").applyInArrow(_added, "k int, node int, block int, v binary")
    found: list[dict[int, dict[int, np.ndarray]]] = [{} for _ in trees]
    for batch in parts.toArrow().to_batches():
        for k, node, block, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
            by = found[k].setdefault(node, {})
            by[block] = by.get(block, 0.0) + np.frombuffer(v).reshape(-1, widest, 3)
    return [{n: np.concatenate([by[b] for b in sorted(by)]) for n, by in nodes.items()} for nodes in found]


def _added(group: pa.Table) -> pa.Table:
    """One cell's sums: as many numbers per row as features times bins, one row per task."""
    total = sum(np.frombuffer(v.as_py()) for v in group.column("v"))
    return group.slice(0, 1).set_column(3, "v", pa.array([total.tobytes()], pa.binary()))


def stored(tree: Growing, values: np.ndarray, edges: list[np.ndarray]) -> dict:
    """A tree over feature values, as plain lists. ``gain``: of each split."""
    cuts = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin)]
    gains = [g if f >= 0 else 0.0 for f, g in zip(tree.feature, tree.gain)]
    return {"feature": tree.feature, "cut": cuts, "left": tree.left, "right": tree.right, "value": values.tolist(), "gain": gains}


class HistogramBoosterModel(FittedStep):
    """Adds ``prediction`` and, for classes, ``probability``."""

    def scores(self):
        trees = [
            [tuple(np.array(t[n]) for n in ("feature", "cut", "left", "right", "value")) for t in outputs]
            for outputs in self.state["trees"]
        ]
        base = np.array(self.state["base"])

        @F.pandas_udf("array<double>")
        def made(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0))
            out = np.tile(base, (len(rows), 1))
            for outputs in trees:
                for k, (feature, cut, left, right, value) in enumerate(outputs):
                    at = np.zeros(len(rows), dtype=np.int64)
                    moving = np.flatnonzero(feature[at] >= 0)
                    while len(moving):
                        node = at[moving]
                        at[moving] = np.where(rows[moving, feature[node]] <= cut[node], left[node], right[node])
                        moving = moving[feature[at[moving]] >= 0]
                    out[:, k] += value[at]
            return pd.Series(list(out))

        return made

    def _transform(self, df: DataFrame) -> DataFrame:
        score = self.scores()(vector_to_array(q(self.opt("features"))))
        if self.opt("task") == "regression":
            return df.withColumn("prediction", score[0])
        scored = df.withColumn("__scores", score)
        if self.opt("classes") <= 2:
            one = 1 / (1 + F.exp(-F.col("__scores")[0]))
            shares = F.array(1 - one, one)
        else:
            top = F.array_max("__scores")
            powers = F.transform("__scores", lambda s: F.exp(s - top))
            shares = F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
        scored = scored.withColumn("__shares", shares)
        best = F.array_position("__shares", F.array_max("__shares")) - 1  # the smaller class wins a tie
        return scored.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("__shares")).drop("__scores", "__shares")

    def splits(self, spark: SparkSession) -> DataFrame:
        """``(round, output, node, feature, cut, gain, value)``: all nodes; ``feature`` is -1 for leaves."""
        rows = [
            (r, k, n, t["feature"][n], t["cut"][n], t["gain"][n], t["value"][n])
            for r, outputs in enumerate(self.state["trees"]) for k, t in enumerate(outputs) for n in range(len(t["feature"]))
        ]
        return spark.createDataFrame(rows, "round int, output int, node int, feature int, cut double, gain double, value double")
