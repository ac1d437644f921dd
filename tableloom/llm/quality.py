"""Quality rules: base counts of every document and gradient-boosted trees over its statistics.

Trees are grown on binned statistics in numpy and flattened into node arrays, so a batch of documents walks all trees
with one gather per level. Chosen statistics only ever lower the verdict (symbols, repeated lines, repeated words):
a split that would break this is not taken, and the values below a split stay on their side of its middle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import labelled_sample, named
from tableloom.session import materialise

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: statistic -> +1 if more of it may only raise the verdict, -1 if only lower it, 0 if free
STATISTICS = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "line_words": 0,
    "upper_share": 0, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "longest_word": 0, "commonest_share": 0,
    "odd_words": -1,
}


def repeated(ids: np.ndarray, width: int = 3) -> int:
    """Positions covered by a window of ``width`` ids that occurs twice or more."""
    if len(ids) <= width:
        return 0
    size = int(ids.max()) + 1
    windows = ids[: len(ids) - width + 1].copy()
    for i in range(1, width):  # renumbered at each step, so the pairs of numbers stay small
        windows = windows * size + ids[i : len(ids) - width + 1 + i]
        if i + 1 < width:
            windows = np.unique(windows, return_inverse=True)[1]
    _, which, often = np.unique(windows, return_inverse=True, return_counts=True)
    start = np.flatnonzero(often[which] > 1)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCTUATION = b"!\"'(),-./:;?@[\\]^_`{}~+="


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the statistics of one text, given as UTF-8."""
    words = text.split()
    n = len(words)
    points = len(text) if text.isascii() else len(text.decode("utf-8"))
    chars = points - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    again = repeated(ids)
    some, size = max(n, 1), max(len(text), 1)
    commonest = int(np.bincount(ids).max()) if n else 0
    odd = sum(1 for w in number if w.translate(None, PUNCTUATION + SYMBOLS) != w.strip(PUNCTUATION))
    values = [
        float(np.log1p(n)), chars / some, symbols / max(chars, 1), dup / max(len(lines), 1), again / some,
        n / max(len(lines), 1), (len(text) - len(text.translate(None, UPPER))) / size,
        (len(text) - len(text.translate(None, DIGITS))) / size, (len(text) - len(text.translate(None, PUNCTUATION))) / size,
        len(number) / some, float(max(map(len, number), default=0)), commonest / some, odd / max(len(number), 1),
    ]
    return [n, chars, symbols, dup, again], values


@dataclass
class Trees:
    """All trees in four arrays; a leaf is its own child, so every walk takes ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def boost(
    x: np.ndarray,
    y: np.ndarray,
    direction: Sequence[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    least: int = 5,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees for the log loss with Newton leaf values and monotonic ``direction`` per column."""
    share = float(np.clip(y.mean() if len(y) else 1.0, 0.001, 0.999))
    start = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(v)
        return at

    if len(y) == 0 or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else [] for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if len(x) else x
    score = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        here = node(rate * float(np.clip(-total_g / (total_h + ridge), low, high)))
        if level == 0:
            return here
        best = (1e-9, 0, 0, 0.0)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = codes[rows, j]
            gs = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
            ns = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
            a = np.clip(-gs / (hs + ridge), low, high)
            b = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)

            def worth(v, gg, hh):
                return -(gg * v + 0.5 * (hh + ridge) * v * v)

            gain = worth(a, gs, hs) + worth(b, total_g - gs, total_h - hs)
            gain -= worth(value[here] / rate, total_g, total_h)
            gain[(ns < least) | (len(rows) - ns < least) | (direction[j] * (b - a) < 0)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(a[k] + b[k]) / 2)
        if best[0] <= 1e-9:
            return here
        _, j, k, middle = best
        goes = codes[rows, j] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}
        first, second = bounds[direction[j]]
        feature[here], threshold[here] = j, float(edges[j][k])
        left[here] = grow(rows[goes], g, h, level - 1, *first)
        right[here] = grow(rows[~goes], g, h, level - 1, *second)
        return here

    def arrays() -> Trees:
        kinds = (np.int64, np.int64, float, np.int64, np.int64, float)
        return Trees(*(np.array(v, dtype=k) for v, k in zip((roots, feature, threshold, left, right, value), kinds)), depth, start)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
        grown = arrays()
        grown.roots, grown.start = grown.roots[-1:], 0.0
        score = score + grown.raw(x)
    return arrays()


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the counts, and ``stats``, the values named in ``STATISTICS``; whole texts.

    A null text counts as empty; repeated rows are measured each; other columns are not carried.
    """
    chosen = docs.select(named(key).alias("id"), named(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t or b"") for t in batch.column(1).to_pylist()]
            counts = list(zip(*(b[0] for b in both))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([b[1] for b in both], pa.list_(pa.float64()))], names=["id", *COUNTS, "stats"],
            )

    kind = chosen.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return chosen.mapInArrow(run, f"id {kind}, {counts}, stats array<double>")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = 10_000,
    keep_from: float = 0.5,
) -> DataFrame:
    """Per document: ``key``, the counts, ``base_failed``, ``score`` (probability of good quality) and ``kept``.

    Trees learn from at most ``max_rows`` labelled ids of either class (smallest hashes of the id). ``base_failed``:
    under 50 words, or over half of the words in repeated 3-word windows; such documents are never kept. The others are
    kept from ``keep_from``. Without labels of both classes the score is the share of good labels (0.999 without any),
    so only the base decides. Null and empty texts have no words and fail. Rows with a null id are scored, not learnt
    from; repeated rows are judged each; an empty table gives no rows.
    """
    rows = materialise(measure(docs, key, text))
    sample = labelled_sample(labels, key, label, max_rows)
    # the sample's ids: bounded by twice max_rows; repeated rows of an id count once
    known = rows.join(F.broadcast(sample), "id").select("id", "y", "stats").distinct().orderBy("id", "stats").collect()
    width = len(STATISTICS)
    x = np.array([r["stats"] for r in known], dtype=float).reshape(-1, width)
    model = boost(x, np.array([r["y"] for r in known], dtype=float), list(STATISTICS.values()))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for stats in batches:
            yield pd.Series(model.probability(np.stack(stats.to_numpy()).reshape(-1, width)) if len(stats) else [], dtype=float)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("score", scored("stats")).select(
        F.col("id").alias(key), *COUNTS, failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= keep_from)).alias("kept"),
    )
