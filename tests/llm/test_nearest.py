"""Nearest vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableloom.llm.nearest import nearest, search_tile
from tableloom.llm.queries import op10_nearest

def is_query():
    return F.col("vec_id") % 20 == 0


def brute(rows, k):
    """rows: {id: vector}; queries are ids divisible by 20."""
    out = {}
    for q, x in rows.items():
        if q % 20 == 0:
            scored = [(-float(np.dot(x, y)), i) for i, y in rows.items() if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def check(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q for q, rows in want.items() if rows} == set(found)
    for q, rows in want.items():
        assert [found[q][i + 1][0] for i in range(len(rows))] == [i for i, _ in rows]
        assert np.allclose([found[q][i + 1][1] for i in range(len(rows))], [s for _, s in rows])
        assert len(found[q]) == len(rows)


@pytest.mark.parametrize("blocks", [(4096, 16384), (3, 7)])
def test_copies_ties_and_odd_rows(spark, blocks):
    rng = np.random.default_rng(3)
    rows = {i: rng.integers(-3, 4, 6).astype(float) for i in range(120)}
    rows |= {i: rows[1] for i in range(200, 260)}  # many copies
    rows |= {300: np.ones(4), 301: np.arange(4.0), 320: np.array([2.0, 0, 0, 1])}  # another length
    bad = [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6),
           (480, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (500, [])]
    data = [(i, [float(v) for v in x], "t") for i, x in rows.items() if np.any(x)] + [(*b, "t") for b in bad]
    data += data[:5]  # repeated rows
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, score string").repartition(5)
    got = nearest(df, is_query(), 5, query_rows=blocks[0], candidate_rows=blocks[1]).collect()
    check(got, brute({i: x for i, x in rows.items() if np.any(x)}, 5))
    assert nearest(df.limit(0), is_query()).count() == 0


def test_quantisation_never_loses_a_neighbour():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 32))
    cand = np.concatenate([base + rng.normal(size=base.shape) * 10.0 ** -(i % 9) for i in range(12)])
    cand *= 10.0 ** rng.integers(-6, 6, (len(cand), 1))
    ids = np.arange(1000, 1000 + len(cand))
    a, b, s = search_tile(np.arange(len(base)), base, ids, cand, 7, part=(9, 50))
    scores = base @ cand.T
    for q in range(len(base)):
        assert sorted(s[a == q])[::-1] == pytest.approx(sorted(scores[q])[::-1][:7], rel=1e-9)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(op10_nearest(spark, sf).collect(), brute(rows, 20))
