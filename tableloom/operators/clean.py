"""Cleaning: duplicates, sparse columns, imputation, outliers."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.columns import CATEGORICAL, NUMERIC, choose_columns, number, present, q
from tableloom.functions.keyed import first_by, top_k
from tableloom.functions.knn import BLOCK_ROWS, cogroup_blocks, knn_join, whole_units
from tableloom.functions.stats import most_frequent, null_counts, numeric_stats, quantiles
from tableloom.operators.base import FittedStep, Step
from tableloom.operators.detect import outlier_bounds
from tableloom.session import materialise

#: Searches by pattern of missing values: as many at most; fewer pairs of rows than this are compared outright.
PATTERN_SEARCHES, FEW_PAIRS = 64, BLOCK_ROWS * BLOCK_ROWS
STRATEGIES = ("mean", "median", "most_frequent", "constant", "knn", "drop")


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the first, the last, or (``False``) no member of each group of equal rows.

    Rows have no order of their own: without ``order_by`` the other columns, as far as they can be ordered, decide.
    """
    keys = choose_columns(df, subset)
    if keep is False:
        single = df.groupBy(*[q(c) for c in keys]).agg(
            F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*[q(c) for c in df.columns])).alias("__row")
        )
        return single.filter(F.col("__n") == 1).select("__row.*")
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    if not order_by:
        order_by = [f.name for f in df.schema.fields if f.name not in keys and not _has_map(f.dataType)]
    if not order_by:
        return df.dropDuplicates(keys)
    return first_by(df, keys, [q(c) for c in order_by], last=keep == "last")


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


class DuplicateDropper(Step):
    """Duplicates are judged on the features; the target travels with its row."""

    OPTIONS: ClassVar = {"subset": None, "keep": "first", "order_by": None, "target": None}

    def _fit(self, df: DataFrame) -> DuplicateDropperModel:
        subset = self.opt("subset") or [c for c in df.columns if c != self.target_of(df)]
        return DuplicateDropperModel(self.options(), {"subset": subset})


class DuplicateDropperModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_duplicates(df, self.state["subset"], self.opt("keep"), self.opt("order_by"))


class SparseColumnDropper(Step):
    """Drop columns whose missing share at fit time is above the threshold."""

    OPTIONS: ClassVar = {"threshold": 0.8, "target": None}

    def _fit(self, df: DataFrame) -> ColumnDropperModel:
        names = [c for c in df.columns if c != self.target_of(df)]
        rows, nulls = null_counts(df, names)
        sparse = [c for c in names if rows and nulls[c] / rows > self.opt("threshold")]
        return ColumnDropperModel(self.options(), {"columns": sparse})


class ColumnDropperModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.state["columns"])


class Imputer(Step):
    """Fill missing values per column.

    ``strategy`` applies to numeric columns, ``column_strategies`` overrides it
    by name, categorical columns take their most frequent value.
    """

    OPTIONS: ClassVar = {
        "strategy": "median", "fill_value": None, "columns": None, "knn_neighbors": 5,
        "column_strategies": None, "key": None, "target": None, "keep": None,
    }

    def _check(self) -> None:
        for s in [self.opt("strategy"), *(self.opt("column_strategies") or {}).values()]:
            if s not in STRATEGIES:
                raise ValueError(f"unknown imputation strategy {s!r}, expected one of {', '.join(STRATEGIES)}")

    def _fit(self, df: DataFrame) -> ImputerModel:
        names = self.pick(df, None)
        keep = {self.opt("key")}
        numeric = [c for c in names if isinstance(df.schema[c].dataType, NUMERIC) and c not in keep]
        text = [c for c in names if isinstance(df.schema[c].dataType, CATEGORICAL) and c not in keep]
        own = self.opt("column_strategies") or {}
        plan: dict[str, list[str]] = {s: [] for s in STRATEGIES}
        for c in numeric:
            plan[own.get(c, self.opt("strategy"))].append(c)

        fills: dict[str, object] = {}
        if plan["mean"] or plan["median"]:
            stats = numeric_stats(df, plan["mean"] + plan["median"] + plan["knn"], ["count", "mean"])
            fills.update({c: stats[c]["mean"] for c in plan["mean"]})
            counts = {c: s["count"] for c, s in stats.items()}
            medians = quantiles(df, plan["median"], [0.5], counts)
            fills.update({c: v[0] if v else None for c, v in medians.items()})
        modes = most_frequent(df, plan["most_frequent"] + text)
        fills.update({c: (None if modes[c] is None else float(modes[c])) for c in plan["most_frequent"]})
        fills.update({c: modes[c] for c in text})
        if plan["constant"]:
            value = self.opt("fill_value")
            if value is None:
                warnings.warn("strategy 'constant' without fill_value: using 0", RuntimeWarning, stacklevel=2)
                value = 0
            fills.update({c: value for c in plan["constant"]})

        tables = {}
        state = {"fills": fills, "drop": plan["drop"], "knn": numeric if plan["knn"] else [],
                 "numeric": numeric, "text": text}
        if plan["knn"]:
            means = numeric_stats(df, numeric, ["mean"])
            state["means"] = {c: means[c]["mean"] for c in numeric}
            donors = df.select(F.array(*[number(df, c) for c in numeric]).alias("vector"))
            # equal donors beyond the k-th can never be among the k nearest
            k = self.opt("knn_neighbors")
            counted = donors.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
            tables["donors"] = materialise(
                counted.select("vector", F.least(F.col("n"), F.lit(k)).cast("int").alias("n"))
            )
        return ImputerModel(self.options(), state, tables)


class ImputerModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state
        dropped = [c for c in state["drop"] if c in df.columns]
        if dropped:
            df = df.na.drop(subset=[f"`{c}`" for c in dropped])
        filled = {
            c: self._filled(df, c, v) for c, v in state["fills"].items() if c in df.columns and v is not None
        }
        source = df
        df = df.withColumns(filled) if filled else df
        if state["knn"]:
            # columns with a fill of their own keep it; distances use the values as they came
            df = self._by_neighbours(df, source, [c for c in state["knn"] if c not in filled])
        return df

    @staticmethod
    def _filled(df: DataFrame, c: str, value: object) -> Column:
        if isinstance(df.schema[c].dataType, CATEGORICAL):
            return F.coalesce(present(df, c), F.lit(str(value)))
        whole = isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if whole and float(value).is_integer():
            return F.coalesce(q(c), F.lit(int(value)).cast(df.schema[c].dataType))
        return F.coalesce(number(df, c), F.lit(float(value)))

    def _by_neighbours(self, df: DataFrame, source: DataFrame, wanted: list[str]) -> DataFrame:
        """Mean of the k nearest donors per missing cell, else the column mean."""
        names = self.state["knn"]
        key = self.opt("key")
        if key is None:
            raise ValueError("strategy 'knn' needs key=, a column that identifies rows")
        holes = source.select(q(key).alias("query_id"), F.array(*[number(source, c) for c in names]).alias("vector"))
        holes = materialise(holes.filter(F.exists("vector", lambda v: v.isNull())))
        donors, k = self.tables["donors"], self.opt("knn_neighbors")
        sizes = holes.count(), donors.count()
        searches = _searches(holes, donors) if sizes[0] * sizes[1] > FEW_PAIRS else None
        if searches is not None:
            near = _nearest_by_pattern(holes, donors, searches, k, len(names))
        else:
            units = whole_units(holes, donors.withColumn("candidate_id", F.xxhash64("vector")), *sizes, BLOCK_ROWS)
            near = cogroup_blocks(
                *units, _nearest_donors(k, len(names)),
                T.StructType([
                    T.StructField("query_id", holes.schema["query_id"].dataType),
                    T.StructField("slot", T.IntegerType()), T.StructField("distance", T.DoubleType()),
                    T.StructField("value", T.DoubleType()),
                ]),
            )
        best = top_k(near, ["query_id", "slot"], [F.col("distance"), F.col("value")], k)
        means = best.groupBy("query_id", "slot").agg(F.avg("value").alias("value"))
        per_row = means.groupBy(F.col("query_id").alias("__row")).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("__found")
        )
        joined = df.join(per_row, q(key) == F.col("__row"), "left")
        filled = {
            c: F.coalesce(
                number(df, c), F.col("__found")[F.lit(names.index(c))], F.lit(self.state["means"][c])
            )
            for c in wanted if c in df.columns
        }
        return joined.withColumns(filled).select(*[q(c) for c in df.columns])


def _known() -> Column:
    """Which entries of a vector are there, as text: ``101``."""
    return F.array_join(F.transform("vector", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")


def _searches(holes: DataFrame, donors: DataFrame) -> list[tuple[str, str, int]] | None:
    """(pattern of the row, pattern of the donor, missing entry) of all pairs with a common entry; none if too many."""
    found = []
    for side in (holes, donors):
        found.append(sorted(r[0] for r in side.select(_known()).distinct().limit(PATTERN_SEARCHES + 1).collect()))
        if len(found[-1]) > PATTERN_SEARCHES:
            return None
    searches = [
        (p, d, slot) for p in found[0] for d in found[1] for slot in range(len(p))
        if p[slot] == "0" and d[slot] == "1" and any(a == b == "1" for a, b in zip(p, d))
    ]
    return searches if len(searches) <= PATTERN_SEARCHES else None


def _nearest_by_pattern(holes: DataFrame, donors: DataFrame, searches, k: int, width: int) -> DataFrame:
    """``(query_id, slot, distance, value)``: the k nearest donors of every missing entry, per pattern of donors.

    Between two patterns the missing-tolerant distance is the Euclidean one over the entries that both have, times a
    constant; so each search is an exact neighbour join of its own, and those over equally many entries run as one.
    Donors are known by the wanted value, which breaks ties.
    """
    common = [[i for i in range(width) if p[i] == d[i] == "1"] for p, d, _ in searches]
    copies = donors.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    found = []
    for used in sorted({len(c) for c in common}):
        asked, offered = [], []
        for t, ((p, d, slot), at) in enumerate(zip(searches, common)):
            if len(at) == used:
                part = F.array(*[F.col("vector")[i] for i in at]).alias("part")
                of = F.lit(str(t)).alias("search")
                key = F.struct(F.col("query_id").alias("id"), F.lit(t).alias("t")).alias("key")
                asked.append(holes.filter(_known() == p).select(of, key, part))
                offered.append(copies.filter(_known() == d).select(of, F.col("vector")[slot].alias("value"), part))
        near = knn_join(
            reduce(DataFrame.unionByName, asked), reduce(DataFrame.unionByName, offered), k, query_id="key",
            candidate_id="value", query_vector="part", candidate_vector="part", within="search",
        )
        slots = F.array(*[F.lit(s) for _, _, s in searches])
        # ties between patterns: the root's rounding is rounded away
        whole = F.format_string("%.12e", F.col("distance") * F.col("distance") * F.lit(width / used)).cast("double")
        found.append(near.select(
            F.col("query_id.id").alias("query_id"), F.get(slots, F.col("query_id.t")).alias("slot"),
            F.sqrt(whole).alias("distance"), F.col("candidate_id").alias("value"),
        ))
    schema = T.StructType([
        holes.schema["query_id"], T.StructField("slot", T.IntegerType()), T.StructField("distance", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ])
    return reduce(DataFrame.unionByName, found) if found else holes.sparkSession.createDataFrame([], schema)


def _nearest_donors(k: int, width: int):
    """Per block pair: the k nearest donors of every missing cell, by missing-tolerant distance."""

    def work(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not asked.empty and not offered.empty:
            x = np.array(asked["vector"].map(list).tolist(), dtype=float).reshape(-1, width)
            y = np.array(offered["vector"].map(list).tolist(), dtype=float).reshape(-1, width)
            copies = offered["n"].to_numpy()
            step = max(1, 4_000_000 // (len(y) * width))
            for start in range(0, len(x), step):
                rows = x[start : start + step]
                gap = rows[:, None, :] - y[None, :, :]
                shared = ~np.isnan(gap)
                used = shared.sum(axis=2)
                total = np.where(shared, gap * gap, 0.0).sum(axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.sqrt(np.where(used > 0, total * width / used, np.nan))
                for slot in range(width):
                    missing = np.flatnonzero(np.isnan(rows[:, slot]))
                    usable = np.flatnonzero(~np.isnan(y[:, slot]))
                    if not len(missing) or not len(usable):
                        continue
                    value = y[usable, slot]
                    for r in missing:
                        order = np.lexsort((value, d[r, usable]))
                        order = order[~np.isnan(d[r, usable][order])][:k]
                        order = np.repeat(order, copies[usable][order])[:k]
                        out.append(pd.DataFrame({
                            "query_id": asked["query_id"].iloc[start + r], "slot": np.int32(slot),
                            "distance": d[r, usable][order], "value": value[order],
                        }))
        if not out:
            return pd.DataFrame({"query_id": [], "slot": [], "distance": [], "value": []})
        return pd.concat(out, ignore_index=True)

    return work


class OutlierTreatment(Step):
    """Clip to, or drop rows outside, bounds learned at fit time."""

    OPTIONS: ClassVar = {
        "method": "iqr", "threshold": 1.5, "action": "winsorize", "columns": None, "target": None, "keep": None,
    }

    def _check(self) -> None:
        if self.opt("action") not in ("winsorize", "drop"):
            raise ValueError("action must be 'winsorize' or 'drop'")
        if self.opt("method") not in ("iqr", "zscore"):
            raise ValueError("method must be 'iqr' or 'zscore'")

    def _fit(self, df: DataFrame) -> OutlierTreatmentModel:
        names = self.pick(df, "numeric")
        bounds = outlier_bounds(df, names, self.opt("method"), self.opt("threshold"))
        return OutlierTreatmentModel(self.options(), {"bounds": {c: list(b) for c, b in bounds.items()}})


class OutlierTreatmentModel(FittedStep):
    def bounds(self, spark) -> DataFrame:
        rows = [(c, float(lo), float(hi)) for c, (lo, hi) in self.state["bounds"].items()]
        return spark.createDataFrame(rows, "column string, lower double, upper double")

    def _transform(self, df: DataFrame) -> DataFrame:
        bounds = {c: b for c, b in self.state["bounds"].items() if c in df.columns}
        if self.opt("action") == "drop":
            for c, (low, high) in bounds.items():
                df = df.filter(number(df, c).between(low, high))
            return df
        return df.withColumns({
            c: F.when(number(df, c).isNotNull(), F.least(F.greatest(number(df, c), F.lit(low)), F.lit(high)))
            for c, (low, high) in bounds.items()
        })
