"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return:
#: what ``bytes.split()`` gives in Python and this pattern on the JVM.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


class Cache(dict):
    """Remembers what ``make`` gives for a key; starts afresh once it holds ``limit`` keys, so memory is bounded."""

    def __init__(self, make: Callable, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def labelled_sample(
    labels: DataFrame, key: str, label: str, limit: int, seed: int = 0, keep: Column | None = None
) -> DataFrame:
    """At most ``limit`` labelled ids of either class (``id``, ``y``), those with the smallest hashes of their id.

    Rows whose label is neither 0 nor 1 are left out; an id with both labels counts as 1. ``keep`` restricts the ids.
    """
    rows = labels if keep is None else labels.filter(keep)
    known = (
        rows.select(named(key).alias("id"), named(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    halves = [smallest(known.filter(F.col("y") == y), F.xxhash64(F.lit(seed), "id"), ["id"], limit) for y in (0, 1)]
    return halves[0].unionByName(halves[1])


def smallest(df: DataFrame, hashed: Column, ties: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest hashes.

    A table of many rows is first thinned to about twice as many, evenly by the hash itself, so tasks do not each hand
    over ``limit`` rows.
    """
    place = F.shiftrightunsigned(hashed, 1)
    n = df.count()
    if n > 4 * limit:
        df = df.filter(place < F.lit(int(max(2 * limit, limit + 100) / n * 2**63)))
    return df.orderBy(place, *ties).limit(limit)
