"""Keep-first, top-k and learned-map joins that hold up under skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name, q
from tableloom.session import materialise

LITERAL_KEYS = 64
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows of one key that one task may hold; a key with more is spread over as many tasks as it takes.
TASK_ROWS = 1_000_000
#: Keys listed as hot at most, the largest: any other holds less than this part of all rows, about one task's share
#: where there are that many tasks.
HOT_KEYS = 65_536
#: Tasks over which rows without a key are spread.
SALTS = 256
RANK_BLOCK = 65536


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One whole row per key by order. Partial aggregation, so hot keys shrink before the shuffle."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[q(c) for c in df.columns])
    kept = df.groupBy(*[q(k) for k in keys]).agg(pick(row, F.struct(*order)).alias("row"))
    return kept.select("row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank; Spark limits each group before the shuffle."""
    window = Window.partitionBy(*[q(c) for c in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def table_size(table: DataFrame, key: str) -> tuple[int, int]:
    """Rows and approximate bytes of a learned table, measured."""
    width = sum(8 for c in table.columns if c != key) + 16
    row = table.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(q(key))), F.lit(0)).alias("chars")
    ).first()
    return row["n"], 4 * row["chars"] + width * row["n"]


def hot_keys(counts: DataFrame, key: str, n: str) -> dict[str, int]:
    """Keys with more rows than a task may hold, and the number of tasks that each is spread over."""
    large = counts.filter((q(n) > TASK_ROWS) & q(key).isNotNull()).orderBy(F.desc(n), key).limit(HOT_KEYS)
    return {r[0]: -(-r[1] // TASK_ROWS) for r in large.select(q(key).cast("string"), n).collect()}


def with_salts(df: DataFrame, key: Column, hot: Mapping[str, int], to: str, missing: bool = True) -> DataFrame:
    """Adds ``to``: over how many tasks the row's key is spread; rows without a key, if ``missing``, over ``SALTS``."""
    rest = F.when(key.isNull(), F.lit(SALTS if missing else 1)).otherwise(F.lit(1))
    if len(hot) <= LITERAL_KEYS:
        known = literal_map(sorted(hot.items()), key) if hot else F.lit(None)
        return df.withColumn(to, F.coalesce(known, rest).cast("int"))
    listed = df.sparkSession.createDataFrame(sorted(hot.items()), "__hot string, __tasks int")  # at most HOT_KEYS rows
    joined = df.join(F.broadcast(listed), key == F.col("__hot"), "left")
    return joined.withColumn(to, F.coalesce(F.col("__tasks"), rest).cast("int")).drop("__hot", "__tasks")


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    column: str,
    key: str,
    size_bytes: int | None = None,
    hot: Mapping[str, int] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Left join of a table keyed uniquely by ``key``; brings its other columns.

    A table measured to be small is broadcast. Otherwise rows of hot keys, and
    of missing keys, are spread over salts in proportion to their number and the
    few hot table rows are repeated once per salt. A value that became frequent
    only after the table was learned is left to adaptive skew-join splitting:
    the table has one row for it, so only the left side is cut.
    """
    left = q(column).cast("string")
    matches = left.eqNullSafe(F.col("__key")) if null_safe else left == F.col("__key")
    right = table.withColumnRenamed(key, "__key")
    if size_bytes is not None and size_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(right), matches, "left").drop("__key")

    salt = free_name(df, "salt")
    hot = hot or {}
    salted = with_salts(df, left, hot, salt)
    salted = salted.withColumn(salt, F.pmod(F.monotonically_increasing_id(), q(salt)).cast("int"))
    right = with_salts(right, F.col("__key"), hot, "__tasks_of_key")
    right = right.withColumn("__salt_key", F.explode(F.sequence(F.lit(0), F.col("__tasks_of_key") - 1))).drop(
        "__tasks_of_key"
    )
    return salted.join(right, matches & (q(salt) == F.col("__salt_key")), "left").drop(
        "__key", "__salt_key", salt
    )


def literal_map(pairs: Sequence[tuple[str, object]], column: Column) -> Column:
    """Lookup in a handful of learned values inside the projection; NULL when absent."""
    if not pairs:
        return F.lit(None)
    flat = [F.lit(x) for pair in pairs for x in pair]
    return F.create_map(*flat)[column]


def global_rank(df: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """Zero-based position of every row in the whole order, without one global sort task.

    Rows are range-partitioned, ranked inside each range, and shifted by the
    sizes of the ranges before; only those sizes are gathered.
    """
    part = free_name(df, "part")
    ranged = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: bounded by spark.sql.shuffle.partitions
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(part).alias("__from"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(starts), q(part) == F.col("__from"))
        .withColumn(rank, F.col("__start") + F.col("__inside"))
        .drop(part, "__from", "__start", "__inside")
    )


def grouped_rank(df: DataFrame, group: str, order: Sequence[Column], rank: str) -> DataFrame:
    """Zero-based position of every row within its group, however many rows a group has.

    Rows are range-partitioned by group and order and ranked inside each range; a group that goes on in further ranges
    is shifted by its rows in the ranges before. A null group is a group.
    """
    part = free_name(df, "part")
    ranged = materialise(df.repartitionByRange(q(group).asc_nulls_first(), *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(q(group).alias("__group"), q(part).alias("__from")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per group and range: a group has at most as many as there are ranges
    before = Window.partitionBy("__group").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__group", "__from", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(part, group).orderBy(*order)) - 1
    return (
        ranged.withColumn("__inside", inside)
        .join(starts, (q(part) == F.col("__from")) & q(group).eqNullSafe(F.col("__group")))
        .withColumn(rank, F.col("__start") + F.col("__inside"))
        .drop(part, "__group", "__from", "__start", "__inside")
    )


def rows_before(counts: DataFrame, order: Sequence[Column], n: str, to: str) -> DataFrame:
    """For a table of distinct values with counts: how many rows come before each value in order."""
    block = free_name(counts, "block")
    placed = global_rank(counts, order, "__at")
    placed = placed.withColumn(block, F.floor(F.col("__at") / RANK_BLOCK))
    sizes = placed.groupBy(block).agg(F.sum(n).alias("__rows"))
    # one row per RANK_BLOCK distinct values
    earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(block, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(block).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(starts, block)
        .withColumn(to, F.col("__start") + F.col("__inside"))
        .drop(block, "__start", "__inside", "__at")
    )
