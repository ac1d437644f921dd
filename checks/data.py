"""Inputs of the registered queries: given tables, and whole tables with injected properties.

An injection is a list of SQL expressions that both engines evaluate, so that
each side builds the same input from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Source:
    """A whole table seen through expressions, optionally with extra copies of some rows."""

    def __init__(self, name: str, *exprs: str, copies_where: str | None = None):
        self.name, self.exprs, self.copies_where = name, exprs or ("*",), copies_where
        listed = ", ".join(self.exprs)
        self.sql = f"(SELECT {listed} FROM {name}"
        if copies_where:
            self.sql += f" UNION ALL SELECT {listed} FROM {name} WHERE {copies_where}"
        self.sql += ")"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir, self.name)
        seen = base.selectExpr(*self.exprs)
        if self.copies_where:
            seen = seen.unionAll(base.filter(self.copies_where).selectExpr(*self.exprs))
        return seen


GAPS = Source(
    "orders",
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS sparse_price",
    "CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS finished",
)

COPIED = Source(
    "orders", "o_custkey % 40 AS cust_group", "o_orderstatus", "o_orderpriority",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 50 END AS price_group",
    "o_orderkey", copies_where="o_orderkey % 50 = 0",
)

SPIKES = Source(
    "events", "event_id", "user_id", "event_type",
    "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 100 = 0 THEN value * 50 ELSE value END AS value",
    "CAST(1 AS DOUBLE) AS flat",
)

RELATED = Source(
    "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_returnflag", "l_linestatus",
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE 2 * l_extendedprice + l_quantity END AS related",
)

SEGMENTS = Source(
    "customer", "c_custkey", "c_acctbal",
    "CASE WHEN c_custkey % 200 = 0 THEN 'RARE' WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    "CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity",
)

# the same table with categories that were not there when the map was learned
SEGMENTS_LATER = Source(
    "customer", "c_custkey", "c_acctbal",
    "CASE WHEN c_custkey % 20 = 0 THEN 'NEW' WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    "CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity",
)

DATED = Source(
    "orders", "o_orderkey", "o_orderdate",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS text_date",
)

UNEVEN = Source(
    "customer", "c_custkey", "c_acctbal", "CAST(c_nationkey AS DOUBLE) AS nation",
    "CASE WHEN c_custkey % 10 = 0 THEN 'rare' ELSE 'common' END AS label",
)


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounding for comparison; adding zero turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def near(sql: str, digits: int = 6) -> str:
    return f"(round(CAST({sql} AS DOUBLE), {digits}) + 0.0)"


def rounded_columns(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(f"`{c}`"), digits) for c in names})
