"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are dealt to blocks by a hash, a fixed number per source. A source's target is filled with whole rounds over
its blocks and then with blocks in a random order as far as they fit. The tree splits the exact number of blocks of
every source among the output shards: each node draws, without replacement, how many blocks of each source go to its
left half. Shards then take disjoint runs of the source's permuted blocks and shuffle locally. All draws come from
seeds and hashes of ids, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name
from tableloom.llm.common import named
from tableloom.session import materialise

BROADCAST_BYTES = 32 * 1024 * 1024


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the total by weight; what exceeds ``cap`` times a size goes to the others by weight, until none does.

    That ends where every target is min(cap * size, level * weight); the level is found by passing the caps in order.
    """
    total, weight, level = float(sum(sizes)), float(sum(weights)), 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        level = total / weight if weight > 1e-12 else 0.0
        if level * weights[i] <= cap * sizes[i]:
            break
        total -= cap * sizes[i]
        weight -= weights[i]
    return [min(float(cap * s), level * w) for s, w in zip(sizes, weights)]


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) per shard (rows); column sums are the quotas, row sums differ by rounding only."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[low] = here
            continue
        middle = (low + high) // 2
        share = round(int(here.sum()) * (middle - low) / (high - low))
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(here, share, method="marginals")
        stack += [(low, middle, left), (middle, high, here - left)]
    return out


def fill(words: np.ndarray, order: np.ndarray, target: float) -> np.ndarray:
    """How often each block is taken: whole rounds, then blocks in ``order`` as far as they fit, then the one that
    brings the sum nearest to the target, if it does."""
    total = int(words.sum())
    if total == 0:
        return np.zeros(len(words), dtype=np.int64)
    rounds = int(target // total)
    taken, rest = np.full(len(words), rounds, dtype=np.int64), target - rounds * total
    for i in order:
        if 0 < words[i] <= rest:
            taken[i] += 1
            rest -= int(words[i])
    left = [i for i in order if taken[i] == rounds and words[i] > 0]
    best = min(left, key=lambda i: abs(rest - int(words[i])), default=None)
    if best is not None and abs(rest - int(words[best])) < rest:
        taken[best] += 1
    return taken


@dataclass
class Plan:
    """``documents``: id, source, block, size. ``sources``: source, source_size, target (on the driver, one row per
    source). ``blocks``: source, block, shards – one entry of ``shards`` for each time the block is taken. ``pieces``: tasks
    that a shard is written by."""

    documents: DataFrame
    sources: pd.DataFrame
    blocks: DataFrame
    pieces: int = 1


def measure(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, source, size): words of the whole text."""
    chosen = docs.select(
        named(key).alias("id"), named(source).cast("string").alias("source"), named(text).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(t.split()) if t else 0 for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["id", "source", "size"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, source string, size bigint")


def block_of(blocks: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(blocks)).cast("int")


def plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    blocks: int = 1_024,
    shard_words: int = 4_000_000,
    tree_shards: int = 4_096,
    seed: int = 17,
) -> Plan:
    """Decides how often every block of every source is taken and by which shards.

    Sources in code point order, null last, weigh ``weights`` in turn. Sources are a list the user states weights for:
    one row each comes to the driver, with their quotas; documents and blocks do not. A source's taken words differ from
    its target by less than its lightest block that was left out. Sources without words take nothing.
    """
    documents = materialise(measure(docs, key, text, source).withColumn("block", block_of(blocks, seed)))
    cells = materialise(documents.groupBy("source", "block").agg(F.sum("size").alias("words")))
    known = cells.groupBy("source").agg(F.sum("words").alias("source_size")).toPandas()
    known["source"] = known["source"].astype(object).where(known["source"].notna(), None)
    known = known.sort_values("source", na_position="last", key=lambda c: c.map(lambda s: s if s is None else s.encode()))
    known = known.reset_index(drop=True)
    sizes = [int(s) for s in known["source_size"]]
    known["target"] = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    spark = docs.sparkSession
    number = {s: i for i, s in enumerate(known["source"])}
    goal = dict(zip(number.values(), known["target"]))

    def chosen(group: pd.DataFrame) -> pd.DataFrame:  # one source: at most ``blocks`` rows
        group = group.sort_values("block", ignore_index=True)
        name = group["source"].iloc[0]
        at = number[None if pd.isna(name) else name]
        order = np.random.default_rng([seed, 1]).permutation(blocks)[group["block"].to_numpy()].argsort()
        group["taken"] = fill(group["words"].to_numpy(), order, goal[at])
        return group[["source", "block", "words", "taken"]]

    kinds = "source string, block int, words bigint, taken bigint"
    taken = materialise(cells.groupBy("source").applyInPandas(chosen, kinds).filter("taken > 0"))
    sums = taken.groupBy("source").agg(F.sum("taken").alias("blocks"), F.sum(F.col("words") * F.col("taken")).alias("w"))
    quotas, total = np.zeros(len(known), dtype=np.int64), 0
    for row in sums.collect():
        quotas[number[row["source"]]] = row["blocks"]
        total += row["w"]
    # beyond ``tree_shards`` a shard is more than one task's share and is written in pieces
    shards = min(tree_shards, max(1, math.ceil(total / shard_words)))
    pieces = max(1, math.ceil(total / (shards * shard_words)))
    ends = np.cumsum(splitting_tree(quotas, shards, seed), axis=0)  # per shard: where its run of each source ends

    def dealt(group: pd.DataFrame) -> pd.DataFrame:  # one source: its permuted blocks go to the shards in runs
        group = group.sort_values("block", ignore_index=True)
        name = group["source"].iloc[0]
        at = number[None if pd.isna(name) else name]
        units = np.repeat(np.arange(len(group)), group["taken"])
        units = units[np.random.default_rng([seed, 2]).permutation(len(units))]
        shard = np.searchsorted(ends[:, at], np.arange(len(units)), side="right")
        lists: list[list[int]] = [[] for _ in range(len(group))]
        for unit, to in zip(units, shard.tolist()):
            lists[unit].append(to)
        return pd.DataFrame({"source": group["source"], "block": group["block"], "shards": lists})

    table = taken.groupBy("source").applyInPandas(dealt, "source string, block int, shards array<int>")
    return Plan(documents, known, materialise(table), pieces)


def checked(spark_table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(spark_table) if 128 * rows <= BROADCAST_BYTES else spark_table


def shares(made: Plan) -> DataFrame:
    """(id, size, source_size, target, taken, times) of every document; ``taken`` counts repeats."""
    spark = made.documents.sparkSession
    sources = spark.createDataFrame(
        [(s, int(n), float(t)) for s, n, t in made.sources.itertuples(index=False)],
        "from_source string, source_size bigint, target double",
    )
    blocks = made.blocks.select(
        F.col("source").alias("of_source"), F.col("block").alias("of_block"), F.size("shards").alias("times")
    )
    d = made.documents
    joined = d.join(
        checked(blocks, made.blocks.count()),
        d["source"].eqNullSafe(F.col("of_source")) & (d["block"] == F.col("of_block")), "left",
    ).join(checked(sources, len(made.sources)), d["source"].eqNullSafe(F.col("from_source")))
    times = F.coalesce("times", F.lit(0)).cast("bigint")
    return joined.select("id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", shard: str = "shard", seed: int = 17, blocks: int = 1_024, **options) -> DataFrame:
    """The mix itself: whole rows, repeated as often as taken, with their ``shard``; shards lie together in the
    partitions, each in a random order; where there are more words than ``tree_shards`` shards should hold, a shard is
    several runs of one random order, each in one partition. Options as in :func:`plan`.

    Documents with a null source form a source; repeated rows are taken alike; rows that the mix does not take and rows
    without words go; an empty table stays empty. Other columns stay; a column named like ``shard`` is replaced.
    """
    made = plan(docs, key=key, source=source, seed=seed, blocks=blocks, **options)
    names = {n: free_name(docs, n) for n in ("of_source", "of_block", "to", "at")}
    table = made.blocks.select(
        F.col("source").alias(names["of_source"]), F.col("block").alias(names["of_block"]),
        F.col("shards").alias(names["to"]),
    )
    block = F.pmod(F.xxhash64(F.lit(seed), named(key)), F.lit(blocks)).cast("int")
    joined = docs.join(
        checked(table, made.blocks.count()),
        named(source).cast("string").eqNullSafe(named(names["of_source"])) & (block == named(names["of_block"])),
    )
    others = [c for c in docs.columns if c.lower() != shard.lower()]
    spread = joined.select(*map(named, others), F.posexplode(named(names["to"])).alias(names["at"], shard))
    order = F.xxhash64(F.lit(seed), named(shard), named(key), named(names["at"]))
    if made.pieces == 1:
        return spread.repartition(named(shard)).sortWithinPartitions(named(shard), order).drop(names["at"])
    # a shard's random order cut into runs of equal chance
    run = F.floor((order / F.lit(2.0**64) + 0.5) * made.pieces)
    return spread.repartition(named(shard), run).sortWithinPartitions(named(shard), run, order).drop(names["at"])
