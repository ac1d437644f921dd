"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.session import materialise


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node it reaches through these edges: what one task knows, flattened."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == least).all() and (label[y] == least).all():
            break
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternating stars: every node links its larger neighbours, then its smaller ones, to its smallest neighbour. Trees
    flatten by about half each round until all are stars, so a few rounds do; each is written down. Minima are taken per task first, so a
    node with very many neighbours is a few rows per task.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = materialise(
        edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    while not flat(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        least = least.select("w", F.least("w", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v"))
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        pulled = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(pulled.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)


def flat(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or larger ones only: separate stars around their smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return sums.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()
