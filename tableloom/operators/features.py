"""Generated features. All are projections, except group aggregates, which join a learned table."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from functools import reduce
from itertools import combinations, combinations_with_replacement
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.columns import DATETIME, number, q
from tableloom.functions.expr import quotient
from tableloom.functions.keyed import hot_keys, lookup_join, table_size
from tableloom.operators.base import FittedStep, Step, appended
from tableloom.session import materialise

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    # a sum over nothing is 0
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
}


class PolynomialFeatures(Step):
    """All monomials up to ``degree``; they replace the input columns, as doubles, at the end."""

    OPTIONS: ClassVar = {
        "degree": 2, "columns": None, "interaction_only": False, "include_bias": False,
        "max_features": 50, "max_output_features": 5000, "target": None, "keep": None,
    }

    def _fit(self, df: DataFrame) -> PolynomialModel:
        names = self.pick(df, "numeric")
        n, degree = len(names), self.opt("degree")
        if n > self.opt("max_features"):
            raise ValueError(f"{n} input columns exceed max_features={self.opt('max_features')}")
        if self.opt("interaction_only"):
            outputs = sum(math.comb(n, d) for d in range(1, degree + 1))
        else:
            outputs = math.comb(n + degree, degree) - 1
        if outputs > self.opt("max_output_features"):
            raise ValueError(f"{outputs} output columns exceed max_output_features={self.opt('max_output_features')}")
        return PolynomialModel(self.options(), {"columns": names})


class PolynomialModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        if not names:
            return df
        choose = combinations if self.opt("interaction_only") else combinations_with_replacement
        made: dict[str, Column] = {"1": F.lit(1.0)} if self.opt("include_bias") else {}
        for degree in range(1, self.opt("degree") + 1):
            for picked in choose(names, degree):
                powers = {c: picked.count(c) for c in dict.fromkeys(picked)}
                title = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
                made[title] = reduce(lambda a, b: a * b, [number(df, c) for c in picked])
        return appended(df, names, made)


class InteractionFeatures(Step):
    """Products of column subsets; missing factors are left out of the product."""

    OPTIONS: ClassVar = {
        "columns": None, "max_interactions": 2, "max_output_features": 5000, "target": None, "keep": None,
    }

    def _fit(self, df: DataFrame) -> InteractionModel:
        names = self.pick(df, "numeric")
        sets = [
            list(s) for size in range(2, min(self.opt("max_interactions"), len(names)) + 1)
            for s in combinations(names, size)
        ]
        if len(sets) > self.opt("max_output_features"):
            raise ValueError(f"{len(sets)} interactions exceed max_output_features={self.opt('max_output_features')}")
        return InteractionModel(self.options(), {"sets": sets})


class InteractionModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        made = {
            "*".join(s): reduce(lambda a, b: a * b, [F.coalesce(number(df, c), F.lit(1.0)) for c in s])
            for s in self.state["sets"]
        }
        return df.withColumns(made) if made else df


class RatioFeatures(Step):
    """Both quotients of every column pair; more pairs than ``max_pairs``, where given, are an error."""

    OPTIONS: ClassVar = {"columns": None, "epsilon": 1e-6, "max_pairs": None, "target": None, "keep": None}

    def _fit(self, df: DataFrame) -> RatioModel:
        pairs = [list(p) for p in combinations(self.pick(df, "numeric"), 2)]
        most = self.opt("max_pairs")
        if most is not None and len(pairs) > most:
            raise ValueError(f"{len(pairs)} column pairs exceed max_pairs={most}")
        return RatioModel(self.options(), {"pairs": pairs})


class RatioModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        shift = self.opt("epsilon")
        made = {}
        for a, b in self.state["pairs"]:
            made[f"{a}_over_{b}"] = quotient(number(df, a), number(df, b) + shift)
            made[f"{b}_over_{a}"] = quotient(number(df, b), number(df, a) + shift)
        return df.withColumns(made) if made else df


class GroupAggregates(Step):
    """Aggregates per group learned at fit time and attached to each row.

    ``aggregations`` names built-in aggregates or maps names to functions of a column.
    """

    OPTIONS: ClassVar = {
        "group_column": None, "agg_columns": None, "aggregations": ["mean", "sum", "std", "min", "max", "count"],
        "target": None, "keep": None,
    }

    def _fit(self, df: DataFrame) -> GroupAggregatesModel:
        group = self.opt("group_column")
        if group not in df.columns:
            raise ValueError(f"group column {group!r} is not in the table")
        names = [c for c in self.pick(df, "numeric", "agg_columns") if c != group]
        wanted = self.opt("aggregations")
        functions = wanted if isinstance(wanted, dict) else {}
        unknown = [a for a in wanted if a not in AGGREGATES and a not in functions]
        if unknown:
            raise ValueError(f"unknown aggregation {', '.join(unknown)}")
        made = [
            ({**AGGREGATES, **functions}[a](number(df, c)).alias(f"{c}_{a}")) for c in names for a in wanted
        ]
        table = df.filter(q(group).isNotNull()).groupBy(q(group).cast("string").alias("__group")).agg(
            F.count(F.lit(1)).alias("__rows"), *made
        )
        table = materialise(table)
        _, size = table_size(table, "__group")
        hot = hot_keys(table, "__group", "__rows")
        settings = {**self.options(), "aggregations": list(wanted)}
        return GroupAggregatesModel(
            settings, {"group": group, "bytes": size, "hot": hot}, {"groups": table.drop("__rows")}
        )


class GroupAggregatesModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return lookup_join(
            df, self.tables["groups"], self.state["group"], "__group", self.state["bytes"], self.state["hot"]
        )


PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "dayofweek": F.weekday,
    "quarter": F.quarter,
    "is_weekend": lambda c: F.coalesce((F.weekday(c) >= 5).cast("int"), F.lit(0)),
}


class DateParts(Step):
    """Calendar parts of date columns; text is read as a date, unreadable text is missing."""

    OPTIONS: ClassVar = {
        "date_columns": None, "auto_detect": False, "target": None, "keep": None,
        **{f"create_{part}": True for part in PARTS},
    }

    def _fit(self, df: DataFrame) -> DatePartsModel:
        if self.opt("date_columns") is not None:
            names = [c for c in self.opt("date_columns") if c in df.columns]
        elif self.opt("auto_detect"):
            names = [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]
        else:
            names = []
            warnings.warn("no date_columns given and auto_detect is off", RuntimeWarning, stacklevel=2)
        text = [c for c in names if not isinstance(df.schema[c].dataType, DATETIME)]
        if text:
            # columns without a single readable date are left alone
            seen = df.agg(*[F.count(_as_date(df, c)).alias(str(i)) for i, c in enumerate(text)]).first()
            names = [c for c in names if c not in text or seen[str(text.index(c))] > 0]
        return DatePartsModel(self.options(), {"columns": names})


class DatePartsModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        made: dict[str, Column] = {}
        for c in self.state["columns"]:
            value = _as_date(df, c)
            made[c] = value
            made.update({f"{c}_{p}": f(value) for p, f in PARTS.items() if self.opt(f"create_{p}")})
        return df.withColumns(made) if made else df


def _as_date(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(q(name))
    return q(name) if isinstance(kind, DATETIME) else F.expr(f"try_cast(`{name}` as timestamp)")
