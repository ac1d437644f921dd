"""Targets by repeated resharing, exact quotas, and the mix itself."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tableloom.llm import mixing


def reshare(sizes, weights, cap):
    """Round by round: what exceeds a cap goes to the sources that are not capped, by weight."""
    total, capped, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(cap * sizes[i] for i in capped)
        over = False
        for i in range(len(sizes)):
            out[i] = cap * sizes[i] if i in capped else rest * weights[i] / sum(weights[j] for j in free)
        for i in free:
            if out[i] > cap * sizes[i] + 1e-9:
                capped.add(i)
                over = True
        if not over:
            return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 3.0)
    assert got == pytest.approx(reshare(sizes, weights, 3.0))
    assert sum(got) == pytest.approx(sum(sizes))


def test_tree_keeps_quotas():
    quotas = np.array([0, 1, 50, 1000, 3])
    for shards in (1, 2, 7, 64):
        tree = mixing.splitting_tree(quotas, shards, 3)
        assert (tree >= 0).all() and (tree.sum(axis=0) == quotas).all()
        assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1 + np.log2(shards)
    assert (mixing.splitting_tree(quotas, 7, 3) == mixing.splitting_tree(quotas, 7, 3)).all()
    many = np.array([mixing.splitting_tree(np.array([40, 60]), 2, s)[0, 0] for s in range(300)])
    assert abs(many.mean() - 20) < 1 and many.std() == pytest.approx(np.sqrt(50 * 0.4 * 0.6 * 50 / 99), rel=0.2)


ROWS = (
    [(i, "word " * (1 + i % 9), "big") for i in range(900)]
    + [(1000 + i, "a\x0bb  c\n", "mid") for i in range(60)]
    + [(2000 + i, "x y", "é") for i in range(5)]
    + [(3000, "one two", None), (3001, None, None), (3002, "", "mid"), (3003, " \n", "none"), (None, "no id", "big")]
    + [(4000, "w " * 30_000, "long"), (1, "word word", "big"), (1, "word word", "big")]
)


def test_mix(spark):
    df = spark.createDataFrame([(k, t, s, 1, 2) for k, t, s in ROWS], "doc_id bigint, text string, source string, block int, Shard int")
    made = mixing.plan(df, blocks=64, shard_words=2_000)
    rows = mixing.shares(made).collect()
    assert len(rows) == len(ROWS)
    size = Counter()
    for _, t, s in ROWS:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s) + [None]
    want = dict(zip(order, reshare([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3.0)))
    source = {k: s for k, _, s in ROWS}
    taken = Counter()
    for r in rows:
        s = source[r.id]
        taken[s] += r.taken
        assert (r.source_size, r.target) == (size[s], pytest.approx(want[s]))
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
    for s in order:
        lightest = max((len((t or "").split()) for _, t, x in ROWS if x == s), default=0)
        assert abs(taken[s] - want[s]) <= lightest * (30 if s == "big" else 1)
    again = mixing.shares(mixing.plan(df.repartition(7), blocks=64, shard_words=2_000)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mix = mixing.mixed(df, blocks=64, shard_words=2_000).collect()
    assert Counter((r.doc_id, r.text) for r in mix) == Counter(
        {k: v for k, v in _times(rows).items() if v}
    )
    shards = Counter()
    for r in mix:
        shards[r.shard] += 1
    assert len(shards) > 5 and all(r.block == 1 for r in mix)
    # few shards of many words are written in pieces, by more tasks than shards
    few = mixing.mixed(df, blocks=64, shard_words=2_000, tree_shards=2)
    assert mixing.plan(df, blocks=64, shard_words=2_000, tree_shards=2).pieces > 1
    assert Counter((r.doc_id, r.text) for r in few.collect()) == Counter((r.doc_id, r.text) for r in mix)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = {(r[0], r[1]) for r in few.select("Shard", F.spark_partition_id()).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({s for s, _ in places}) == 2 < len(places)


def _times(rows):
    """Expected repeats per (id, text): rows of one id share their block."""
    times = {r.id: r.times for r in rows}
    out = Counter()
    for k, t, _ in ROWS:
        out[k, t] += times[k]
    return out


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.shares(mixing.plan(df)).count() == 0 and mixing.mixed(df).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], df.schema)
    assert [(r.taken, r.target) for r in mixing.shares(mixing.plan(empty)).collect()] == [(0, 0.0)] * 2
    assert mixing.mixed(empty).count() == 0
