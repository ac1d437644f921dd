"""Samples are the smallest hashes, however they are found; caches stay bounded."""

from pyspark.sql import functions as F

from tableloom.llm.common import Cache, labelled_sample, smallest


def test_thinning_changes_nothing(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 2).alias("y"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(0), "id"), 1)
    want = [r.id for r in df.orderBy(place, "id").limit(50).collect()]
    assert [r.id for r in smallest(df, F.xxhash64(F.lit(0), "id"), ["id"], 50).collect()] == want
    sample = labelled_sample(df, "id", "y", 50).collect()
    for y in (0, 1):
        want = [r.id for r in df.filter(F.col("y") == y).orderBy(place, "id").limit(50).collect()]
        assert sorted(r.id for r in sample if r.y == y) == sorted(want)
    assert smallest(df.limit(0), F.xxhash64("id"), ["id"], 5).count() == 0


def test_cache_is_bounded():
    made = []
    cache = Cache(lambda k: made.append(k) or -k, 3)
    assert [cache[k] for k in (1, 2, 3, 1, 4, 1)] == [-1, -2, -3, -1, -4, -1]
    assert len(cache) <= 3 and made == [1, 2, 3, 4, 1]
