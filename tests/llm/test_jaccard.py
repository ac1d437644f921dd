"""The near-duplicate join against all pairs."""

import random

import numpy as np
import pytest

from tableloom.llm import jaccard
from tableloom.llm.graph import components


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=80):
    """rows: (id, text); one (id, size, component) per row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(s), least.get(find(i)) if k is not None else None) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, key = [], 1000
    passage = " ".join(rng.choices(words, k=40))
    for _ in range(n):
        text = rng.choices(words, k=rng.choice([3, 4, 5, 8, 30, 60, 120, 300]))
        copies = rng.choice([1, 1, 1, 2, 5, 12])
        for _ in range(copies):
            t = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.2:
                t += passage.split()
            if rng.random() < 0.2:
                t = t[: max(1, int(len(t) * rng.uniform(0.7, 1)))]
            key -= 1
            rows.append((key, rng.choice([" ", "\n", "\x0b "]).join(t).title()))
    return rows


@pytest.mark.parametrize("seed,budget,entries", [(1, 1_000_000, 1_000_000), (2, 300, 64)])
def test_against_all_pairs(spark, seed, budget, entries):
    rows = corpus(seed)
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, rows[0][1]), (None, None), rows[0], (rows[0][0], "other text"), (5, "One"), (6, "one")]
    df = spark.createDataFrame([(k, t, "n", 1, 2) for k, t in rows], "doc_id bigint, text string, n string, node int, fp int").repartition(4)
    got = jaccard.near_duplicates(df, budget=budget, bucket_entries=entries).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("sides", [False, True])
def test_trees_find_every_link(sides):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            keep = base[rng.random(len(base)) > 0.08]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 2**63, len(base) // 20).astype(np.uint64)]))
    sets = [s for s in sets if len(s)]
    side = rng.integers(0, 2, len(sets)) if sides else np.zeros(len(sets), int)
    forest = jaccard.Forest(len(sets))
    for a, b in jaccard.linked(sets, side, 80):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        assert 100 * len(x & y) >= 80 * len(x | y)
        forest.link(a, b)
    for a in range(len(sets)):
        for b in range(a):
            if sides and side[a] == side[b]:
                continue
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                assert forest.find(a) == forest.find(b)


def test_a_pile_of_near_copies_costs_few_comparisons():
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.sort(np.r_[base[rng.random(len(base)) > 0.02], rng.integers(0, 2**63, 3).astype(np.uint64)]) for _ in range(800)]
    join = jaccard.Join(sets, 80)
    ranges = [jaccard.size_range(len(s), 80) for s in sets]
    for k in sorted(set(ranges)):
        tree = jaccard.Tree(np.array([i for i, r in enumerate(ranges) if r == k]), sets)
        join.within(tree, tree.root)
    assert join.compared < 10 * len(sets)  # of 319,600 pairs


def test_sizes_of_partners_are_close():
    for n in range(1, 3000):
        m = n * 100 // 80
        assert jaccard.size_range(m, 80) - jaccard.size_range(n, 80) <= 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_against_all_pairs(spark):
    from tableloom.llm.queries import op2_jaccard

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in op2_jaccard(spark, sf).collect()]
    assert sorted(got, key=str) == brute(rows)
