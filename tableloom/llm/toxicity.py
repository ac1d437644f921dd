"""Toxicity by a counterfactually regularised linear classifier.

Features are hashed: every distinct word of a text and its first 4, 5 and 6 letters. Those that are commoner in toxic
texts are ranked by likelihood ratio and the best weighed by a logistic regression, whose ridge is looser the more
evidence a feature has; no least evidence is asked for, so few labels teach as well. Labelled texts that mention groups of people are
read a second time with the identity terms swapped for others of their kind; a change of score between both readings is
penalised, so a neutral mention of a group does not raise the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import Cache, labelled_sample, named
from tableloom.session import materialise

#: Texts whose features a task holds as numbers of Python at once.
READ_ROWS = 256
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Terms of one row may stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab", "mexican", "chinese"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
)


def hashed(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}:{text}".encode()) & 0x7FFFFFFF


def word_features(word: str) -> tuple[int, ...]:
    return (hashed("w", word), *(hashed(str(n), word[:n]) for n in PREFIXES if len(word) >= n))


def words_of(chunk: str) -> tuple[str, ...]:
    return tuple(LETTERS.findall(chunk.lower()))


@dataclass
class ToxicityModel:
    """Weights by hashed feature; their number is bounded by ``max_features`` of :func:`train`."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0

    def scorer(self):
        """Function from a text to its score between 0 and 1."""
        weights = self.weights
        hits = Cache(
            lambda chunk: frozenset(h for w in words_of(chunk) for h in word_features(w) if h in weights), 200_000
        )

        def score(text: str | None) -> float:
            found = frozenset().union(*map(hits.__getitem__, set((text or "").split())))
            z = self.bias + sum(sorted(weights[h] for h in found))
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))

        return score


def fit(
    rows: Sequence[tuple[int, Sequence[int], Sequence[Sequence[int]]]],
    features: Sequence[int],
    penalty: float = 1.0,
    ridge: float = 1e-4,
    steps: int = 400,
    evidence: Sequence[float] | None = None,
) -> ToxicityModel:
    """Logistic regression on (label, features, features of each swapped reading), both classes weighing the same.

    Minimises the log loss plus ``penalty`` times the mean squared change of the raw score under swaps plus a ridge,
    by Adam over all rows. With ``evidence``, a feature's ridge is divided by its evidence as a share of the largest.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max() or not len(features):
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    place = {f: i for i, f in enumerate(features)}

    def sparse(sets: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.array([place[f] for f in s if f in place], dtype=np.int64) for s in sets]
        return np.repeat(np.arange(len(sets)), [len(c) for c in cols]), np.concatenate([np.empty(0, np.int64), *cols])

    row, col = sparse([r[1] for r in rows])
    origin = [i for i, r in enumerate(rows) for _ in r[2]]
    swap_row, swap_col = sparse([s for r in rows for s in r[2]])
    origin_at = np.array(origin, dtype=np.int64)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    scale = np.ones(len(features)) if evidence is None else np.sqrt(np.array(evidence) / max(evidence))
    theta, first, second = np.zeros(len(features) + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        w, b = scale * theta[:-1], theta[-1]
        z = b + np.bincount(row, w[col], len(y))
        g = weight * (1 / (1 + np.exp(-z)) - y)
        if len(origin):
            change = z[origin_at] - b - np.bincount(swap_row, w[swap_col], len(origin))
            pull = 2 * penalty * change / len(origin)
            g_all = g + np.bincount(origin_at, pull, len(y))
            grad = np.bincount(col, g_all[row], len(features)) - np.bincount(swap_col, pull[swap_row], len(features))
        else:
            grad = np.bincount(col, g[row], len(features))
        total = np.append(scale * grad + 2 * ridge * theta[:-1], g.sum())
        first = 0.9 * first + 0.1 * total
        second = 0.999 * second + 0.001 * total**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return ToxicityModel({f: float(scale[i] * theta[i]) for f, i in place.items()}, float(theta[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    usable: Column | None = None,
    max_rows: int = 10_000,
    max_features: int = 4_096,
    identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 1.0,
) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled ids of either class (smallest hashes), whole texts.

    ``usable`` is a condition on the labels table that restricts the ids. Features are counted in Spark; only the
    ``max_features`` best and the sample's rows over these come to the driver. Without labels of both classes the model
    is a constant score: the share of toxic labels, at least 0.001.
    """
    sample = labelled_sample(labels, key, label, max_rows, keep=usable)
    terms = {t: tuple(group[(i + 1) % len(group)] for i in range(at, at + len(group) - 1))
             for group in identity_terms for at, t in enumerate(group)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cache(words_of)
        for batch in (b.slice(i, READ_ROWS) for b in batches for i in range(0, b.num_rows, READ_ROWS)):
            ys, own, swapped = [], [], []
            for value, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for chunk in set((value or "").split()) for w in known[chunk]}
                base = {h for w in words for h in word_features(w)}
                named_groups = [w for w in words if w in terms]
                others = []
                for turn in range(min(3, max((len(terms[w]) for w in named_groups), default=0))):
                    changed = {terms[w][turn % len(terms[w])] if w in terms else w for w in words}
                    others.append(sorted({h for w in changed for h in word_features(w)}))
                ys.append(y)
                own.append(sorted(base))
                swapped.append(others)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(own, pa.list_(pa.int32())),
                 pa.array(swapped, pa.list_(pa.list_(pa.int32())))], names=["y", "own", "swapped"],
            )

    chosen = docs.select(named(key).alias("id"), named(text).cast("string").alias("text"))
    # the sample's ids: bounded by twice max_rows
    rows = materialise(
        chosen.join(F.broadcast(sample), "id").select("text", "y")
        .mapInArrow(read, "y int, own array<int>, swapped array<array<int>>")
    )
    totals = rows.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    p, n = float(totals["p"]), float(totals["n"])
    if not p or not n:
        return fit([(1, (), ())] * int(p > 0) + [(0, (), ())] * int(n > 0), ())
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(seen, size):  # of the likelihood ratio; nothing for an empty cell
        expected = (a + b) * size / (p + n)
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    evidence = part(a, p) + part(b, n)
    counts = materialise(
        rows.select("y", F.explode("own").alias("f"))
        .groupBy("f")
        .agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
        .filter(a / p > b / n)
        .select("f", evidence.alias("e"))
    )
    # a histogram first, so that tasks do not each hand over max_features rows
    seen, least = 0, 0
    for bin_, size in sorted(map(tuple, counts.groupBy(F.floor("e")).count().collect()), reverse=True):
        seen, least = seen + size, bin_
        if seen >= max_features:
            break
    best = counts.filter(F.col("e") >= least).orderBy(F.col("e").desc(), "f").limit(max_features).collect()
    strength = dict(sorted((r["f"], r["e"]) for r in best))
    features = list(strength)
    mine = F.array(*map(F.lit, features)).cast("array<int>")
    kept = rows.select(
        "y",
        F.array_sort(F.array_intersect("own", mine)).alias("own"),
        F.transform("swapped", lambda s: F.array_sort(F.array_intersect(s, mine))).alias("swapped"),
    ).collect()
    ordered = sorted((r["y"], tuple(r["own"]), tuple(map(tuple, r["swapped"]))) for r in kept)
    return fit(ordered, features, penalty, evidence=list(strength.values()))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """Adds ``to``, a score between 0 and 1, from the whole text; replaces a column of that name.

    Null and empty texts, and texts without a known feature, score as the model's bias says. Equal texts score equal;
    repeated rows are scored each; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype="float64")

    return docs.withColumn(to, scored(named(text)))
