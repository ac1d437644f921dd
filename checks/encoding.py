"""E1–E10."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import SEGMENTS, SEGMENTS_LATER, near, rounded_columns, table
from tableloom.operators.encode import CategoricalEncoder

LEARN = f"(SELECT * FROM {SEGMENTS.sql} t)"
APPLY = f"(SELECT * FROM {SEGMENTS_LATER.sql} t)"


def applied(method, digits=None, **more):
    """Map learned on one version of the table, applied to the one with new categories."""

    def run(spark, sf):
        encoder = CategoricalEncoder(
            method=method, columns=["segment"], target="c_acctbal", order_by=["c_custkey"], **more
        )
        out = encoder.fit(SEGMENTS.df(spark, sf)).transform(SEGMENTS_LATER.df(spark, sf))
        out = out.drop("c_acctbal", "parity")
        if digits is not None:
            return rounded_columns(out, ["segment"], digits)
        bits = [c for c in out.columns if c.startswith("segment")]
        return out.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in bits})

    return run


def mapped_sql(code: str, digits: int = 6, else_: str = "0", prior: str = "0") -> str:
    return f"""
    WITH p AS (SELECT avg(c_acctbal) AS prior, count(segment) AS present FROM {LEARN}),
         m AS (SELECT segment AS seg, {code} AS code FROM {LEARN}, p WHERE segment IS NOT NULL GROUP BY 1)
    SELECT a.c_custkey, {near(f'coalesce(m.code, {else_})', digits)} AS segment
    FROM {APPLY} a LEFT JOIN m ON a.segment = m.seg"""


def e1(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    model = CategoricalEncoder(method="label").fit(df)
    return rounded_columns(model.transform(df), ["p_name", "p_type"], 6)


E1_SQL = f"""
    WITH f AS (SELECT p_name AS name, count(*) * 1.0 / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1),
         l AS (SELECT p_type AS kind, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM
               (SELECT DISTINCT p_type FROM part))
    SELECT p_partkey, {near('share')} AS p_name, {near('code')} AS p_type
    FROM part JOIN f ON p_name = name JOIN l ON p_type = kind"""


def e2(spark, sf):
    model = CategoricalEncoder(method="onehot", columns=["segment", "parity"]).fit(SEGMENTS.df(spark, sf))
    return model.transform(SEGMENTS_LATER.df(spark, sf)).drop("c_acctbal")


def e2_sql() -> str:
    own = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cols = [f"CASE WHEN segment = '{v}' THEN 1.0 ELSE 0.0 END AS \"segment_{v}\"" for v in own]
    cols.append('CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END AS segment_nan')
    cols.append("CASE WHEN segment = 'RARE' THEN 1.0 ELSE 0.0 END AS segment_infrequent_sklearn")
    cols.append("CASE WHEN parity = 'odd' THEN 1.0 ELSE 0.0 END AS parity_odd")
    cast = ", ".join(c.replace("1.0", "CAST(1 AS DOUBLE)").replace("0.0", "CAST(0 AS DOUBLE)") for c in cols)
    return f"SELECT c_custkey, {cast} FROM {APPLY} a"


E3_SQL = f"""
    WITH m AS (SELECT seg, dense_rank() OVER (ORDER BY seg) - 1 AS code
               FROM (SELECT DISTINCT coalesce(segment, 'nan') AS seg FROM {LEARN}))
    SELECT c_custkey, CAST(coalesce(code, -1) AS BIGINT) AS segment
    FROM {APPLY} a LEFT JOIN m ON coalesce(a.segment, 'nan') = m.seg"""

E4_SQL = f"""
    WITH m AS (SELECT seg, dense_rank() OVER (ORDER BY seg) - 1 AS code
               FROM (SELECT DISTINCT segment AS seg FROM {LEARN} WHERE segment IS NOT NULL))
    SELECT c_custkey, CASE WHEN a.segment IS NOT NULL THEN {near('coalesce(code, -1)')} END AS segment
    FROM {APPLY} a LEFT JOIN m ON a.segment = m.seg"""

E7_SQL = f"""
    WITH m AS (SELECT seg, row_number() OVER (ORDER BY first_seen, seg) - 1 AS code
               FROM (SELECT segment AS seg, min(c_custkey) AS first_seen FROM {LEARN} GROUP BY 1)),
         a AS (SELECT c_custkey, coalesce(m.code, 0) AS code
               FROM {APPLY} a LEFT JOIN m ON a.segment IS NOT DISTINCT FROM m.seg)
    SELECT c_custkey, CAST((code >> 2) & 1 AS BIGINT) AS segment_bit_0,
           CAST((code >> 1) & 1 AS BIGINT) AS segment_bit_1, CAST(code & 1 AS BIGINT) AS segment_bit_2 FROM a"""

HASH = "CAST(('0x' || substr(md5(coalesce(segment, 'nan')), {0}, 8)) AS BIGINT)"


def hash_sql() -> str:
    rest = "0"
    for start in (1, 9, 17, 25):
        rest = f"(({rest}) * 967296 + {HASH.format(start)}) % 1000000"
    return f"""
    WITH m AS (SELECT DISTINCT segment AS seg, {rest} AS code FROM {LEARN})
    SELECT c_custkey, {near('coalesce(code, 0)')} AS segment
    FROM {APPLY} a LEFT JOIN m ON a.segment IS NOT DISTINCT FROM m.seg"""


def e6_large(spark, sf):
    """Every customer name is its own category: the map stays a table and is joined."""
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = CategoricalEncoder(method="onehot").fit(df).transform(df)
    return rounded_columns(out, ["c_name"], 9)


TARGET = "count(*) * 1.0 / (count(*) + 10) * avg(c_acctbal) + (1 - count(*) * 1.0 / (count(*) + 10)) * any_value(prior)"

CHECKS = {
    "e1_cardinality_guard": (e1, E1_SQL),
    "e2_onehot": (e2, e2_sql()),
    "e3_label": (applied("label"), E3_SQL),
    "e4_ordinal": (applied("ordinal", 6), E4_SQL),
    "e5_target_mean": (applied("target", 4), mapped_sql(TARGET, 4)),
    "e5_target_mean_prior": (
        applied("target", 4, unknown="prior"),
        mapped_sql(TARGET, 4, else_=f"(SELECT avg(c_acctbal) FROM {LEARN})"),
    ),
    "e6_frequency": (applied("frequency", 6), mapped_sql("count(*) * 1.0 / any_value(present)")),
    "e6_frequency_large_map": (
        e6_large,
        "WITH f AS (SELECT c_name AS n, count(*) * 1.0 / (SELECT count(*) FROM customer) AS share "
        f"FROM customer GROUP BY 1) SELECT c_custkey, {near('share', 9)} AS c_name FROM customer JOIN f ON c_name = n",
    ),
    "e7_binary_digits": (applied("binary"), E7_SQL),
    "e8_smoothed_sum": (applied("catboost", 4), mapped_sql("(sum(c_acctbal) + any_value(prior)) / (count(*) + 1)", 4)),
    "e9_hash": (applied("hash", 6), hash_sql()),
    "e10_unknown_ignored": (
        applied("frequency", 6, handle_unknown="ignore"), mapped_sql("count(*) * 1.0 / any_value(present)"),
    ),
}
