"""Categorical encoding.

One shuffle of partial counts learns every column at once. Columns above
``max_categories`` are frequency-encoded whatever the method. Because of that
guard the other methods' maps are small: they are applied inside the projection,
without a join. Large frequency maps stay tables and are joined with their hot
keys spread out.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.functions.columns import number, present, q
from tableloom.functions.expr import md5_modulo
from tableloom.functions.keyed import LITERAL_KEYS, global_rank, hot_keys, literal_map, lookup_join, table_size
from tableloom.functions.stats import value_counts
from tableloom.operators.base import FittedStep, Step
from tableloom.session import materialise

METHODS = ("onehot", "label", "target", "frequency", "binary", "catboost", "hash", "ordinal", "none")
MAPPED = ("target", "frequency", "catboost", "hash")
SMOOTHING = 10
MISSING_LABEL = "nan"


class CategoricalEncoder(Step):
    OPTIONS: ClassVar = {
        "method": "onehot", "columns": None, "max_categories": 50, "min_frequency": 0.01,
        "handle_unknown": "ignore", "unknown": "zero", "order_by": None, "target": None, "keep": None,
    }

    def _check(self) -> None:
        if self.opt("method") not in METHODS:
            raise ValueError(f"unknown encoding method {self.opt('method')!r}, expected one of {', '.join(METHODS)}")
        if self.opt("handle_unknown") not in ("ignore", "error"):
            raise ValueError("handle_unknown must be 'ignore' or 'error'")

    def _fit(self, df: DataFrame) -> CategoricalEncoderModel:
        method = self.opt("method")
        names = self.pick(df, "categorical")
        extra = {}
        if method in ("target", "catboost"):
            target = self.target_of(df)
            if target is None:
                raise ValueError(f"encoding method {method!r} needs a target column")
            extra = {"y": (number(df, target), F.sum), "seen": (number(df, target), F.count)}
        if method == "binary":
            order = self.opt("order_by")
            position = F.struct(*[q(c) for c in order]) if order else F.struct(F.lit(0))
            extra = {"at": (position, F.min)}
        if not names:
            return CategoricalEncoderModel(self.options(), {"columns": {}, "large": {}, "prior": None})

        counts = materialise(value_counts(df, names, extra))
        sizes = {
            r["column"]: r
            for r in counts.groupBy("column").agg(
                F.count("value").alias("distinct"),
                F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("present"),
                F.sum("n").alias("rows"),
            ).collect()
        }
        limit = self.opt("max_categories")
        many = [c for c in names if limit is not None and sizes.get(c) and sizes[c]["distinct"] > limit]
        for c in many:
            warnings.warn(
                f"column {c} has {sizes[c]['distinct']} categories (> {limit}): frequency-encoded",
                RuntimeWarning, stacklevel=2,
            )
        prior = None
        if extra and "y" in extra:
            total = counts.filter(F.col("column") == names[0]).agg(F.sum("y"), F.sum("seen")).first()
            prior = total[0] / total[1] if total[1] else None

        few = [c for c in names if c not in many and method != "none"]
        small = [
            c for c in few
            if sizes.get(c) is None or sizes[c]["distinct"] < LITERAL_KEYS or method == "onehot"
        ]
        codes, tables, large = {}, {}, {}
        settings = (method, prior, self.opt("min_frequency"))
        if small:
            # at most max_categories values per column, so the windows and the rows read here are bounded
            rows = _small_codes(counts.filter(F.col("column").isin(small)), *settings).collect()
            for c in small:
                codes[c] = sorted(
                    ([r["value"], r["code"]] for r in rows if r["column"] == c),
                    key=lambda p: (p[0] is None, p[0] or ""),
                )
        for i, c in enumerate([c for c in names if c in many or (c in few and c not in small)]):
            used = "frequency" if c in many else method
            own = counts.filter(F.col("column") == c).drop("column")
            table = _large_codes(own, used, prior, sizes[c])
            tables[f"map{i}"] = materialise(table.filter(F.col("code").isNotNull()))
            _, size = table_size(tables[f"map{i}"], "value")
            large[c] = {
                "table": f"map{i}", "bytes": size, "method": used,
                "hot": hot_keys(tables[f"map{i}"], "value", "n"),
            }
        counted = {c: sizes[c]["distinct"] + (sizes[c]["rows"] != sizes[c]["present"]) for c in names if c in sizes}
        state = {"columns": codes, "large": large, "prior": prior, "categories": counted, "order": names}
        return CategoricalEncoderModel(self.options(), state, tables)


def _formula(method: str, prior: float | None, present_rows: Column) -> Column | None:
    """Codes that depend on the value's own counts only."""
    known = F.col("value").isNotNull()
    if method == "frequency":
        return F.when(known, F.col("n") / present_rows)
    if method == "target":
        share = F.col("n") / (F.col("n") + SMOOTHING)
        mean = F.try_divide(F.col("y"), F.col("seen"))
        return F.when(known, share * mean + (1 - share) * F.lit(prior))
    if method == "catboost":
        return F.when(known, (F.coalesce(F.col("y"), F.lit(0.0)) + F.lit(prior)) / (F.col("n") + 1))
    if method == "hash":
        return md5_modulo(F.coalesce(F.col("value"), F.lit(MISSING_LABEL))).cast("double")
    return None


def _small_codes(counts: DataFrame, method: str, prior: float | None, min_frequency: float) -> DataFrame:
    """``(column, value, code)`` for columns with a handful of values."""
    within = Window.partitionBy("column")
    present_rows = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(within)
    code = _formula(method, prior, present_rows)
    if code is None:
        if method == "onehot":
            # 1 = a column of its own, 0 = shares the infrequent column
            share = F.col("n") / F.sum("n").over(within)
            code = F.when(share < min_frequency, 0.0).otherwise(1.0)
        else:
            code = (F.row_number().over(within.orderBy(*_sequence(method))) - 1).cast("double")
    return counts.select("column", "value", code.alias("code"))


def _large_codes(own: DataFrame, method: str, prior: float | None, size) -> DataFrame:
    """``(value, n, code)`` for a column with many values, ranked without a global window."""
    code = _formula(method, prior, F.lit(size["present"]))
    if code is None:
        own = global_rank(own, _sequence(method), "at_rank")
        code = F.col("at_rank").cast("double")
    return own.select("value", "n", code.alias("code"))


def _sequence(method: str) -> list[Column]:
    if method == "label":
        # the missing value is the text "nan", sorted among the others
        return [F.coalesce(F.col("value"), F.lit(MISSING_LABEL))]
    if method == "ordinal":
        return [F.col("value").asc_nulls_last()]
    return [F.col("at"), F.col("value")]


class CategoricalEncoderModel(FittedStep):
    def mapping(self, spark, column: str) -> DataFrame:
        """The learned map of one column as ``(value, code)``."""
        if column in self.state["large"]:
            return self.tables[self.state["large"][column]["table"]].select("value", "code")
        rows = [(v, c) for v, c in self.state["columns"][column]]
        return spark.createDataFrame(rows, "value string, code double")

    def output_columns(self) -> list[str]:
        names: list[str] = []
        for c in self.state["columns"]:
            if self.opt("method") == "onehot":
                names += [n for n, _ in self._indicators(c, F.lit(None))]
            elif self.opt("method") == "binary":
                names += [f"{c}_bit_{i}" for i in range(self._bits(c))]
            else:
                names.append(c)
        return names + list(self.state["large"])

    def _transform(self, df: DataFrame) -> DataFrame:
        method = self.opt("method")
        replaced: dict[str, Column] = {}
        new: dict[str, Column] = {}
        gone: list[str] = []
        for c, pairs in self.state["columns"].items():
            if c not in df.columns:
                continue
            value = present(df, c).cast("string")
            if method == "onehot":
                gone.append(c)
                new.update(dict(self._indicators(c, value)))
            elif method == "binary":
                gone.append(c)
                new.update(self._bit_columns(c, value))
            else:
                replaced[c] = self._coded(c, value, pairs, method)
        for c, info in self.state["large"].items():
            if c in df.columns:
                df, code = self._joined(df, c, info)
                if info["method"] == "binary":
                    gone.append(c)
                    new.update(self._bits_of(c, code))
                else:
                    replaced[c] = code
        kept = [c for c in df.columns if c not in gone and not c.startswith("__code:")]
        return df.select(
            *[(replaced[c].alias(c) if c in replaced else q(c)) for c in kept],
            *[expr.alias(name) for name, expr in new.items()],
        )

    # -- small maps, inside the projection ------------------------------------

    def _coded(self, c: str, value: Column, pairs: Sequence, method: str) -> Column:
        if method == "label":
            key = F.coalesce(value, F.lit(MISSING_LABEL))
            known = {(MISSING_LABEL if v is None else v): code for v, code in pairs}
            return F.coalesce(literal_map(sorted(known.items()), key).cast("double"), F.lit(-1.0)).cast("int")
        known = [(v, float(code)) for v, code in pairs if v is not None and code is not None]
        found = literal_map(known, value).cast("double")
        if method == "ordinal":
            return F.when(value.isNotNull(), F.coalesce(found, F.lit(-1.0)))
        if method == "hash" and any(v is None for v, _ in pairs):
            code = next(code for v, code in pairs if v is None)
            found = F.when(value.isNull(), F.lit(float(code))).otherwise(found)
        return self._or_unknown(c, found, value)

    def _or_unknown(self, c: str, found: Column, value: Column) -> Column:
        if self.opt("handle_unknown") == "error":
            message = F.concat(F.lit(f"unknown category in column {c}: "), F.coalesce(value, F.lit("NULL")))
            return F.when(found.isNotNull(), found).otherwise(F.raise_error(message).cast("double"))
        fallback = self.state["prior"] if self.opt("unknown") == "prior" and self.state["prior"] else 0.0
        return F.coalesce(found, F.lit(float(fallback)))

    def _indicators(self, c: str, value: Column) -> list[tuple[str, Column]]:
        pairs = self.state["columns"][c]
        own = [v for v, code in pairs if code == 1.0]
        rare = [v for v, code in pairs if code == 0.0]

        def equals(v):
            return value.isNull() if v is None else F.coalesce(value == F.lit(v), F.lit(False))

        columns = [(f"{c}_{MISSING_LABEL if v is None else v}", equals(v)) for v in own]
        if rare:
            test = equals(rare[0])
            for v in rare[1:]:
                test = test | equals(v)
            columns.append((f"{c}_infrequent_sklearn", test))
        if len(columns) == 2:
            columns = columns[1:]
        known = F.lit(False)
        for v, _ in pairs:
            known = known | equals(v)
        checked = []
        for name, test in columns:
            flag = F.when(test, 1.0).otherwise(0.0)
            if self.opt("handle_unknown") == "error":
                flag = F.when(known, flag).otherwise(
                    F.raise_error(F.lit(f"unknown category in column {c}")).cast("double")
                )
            checked.append((name, flag))
        return checked

    def _bits(self, c: str) -> int:
        return max(1, int(self.state["categories"].get(c, 0)).bit_length())

    def _bit_columns(self, c: str, value: Column) -> dict[str, Column]:
        pairs = self.state["columns"][c]
        found = literal_map([(v, int(code)) for v, code in pairs if v is not None], value).cast("int")
        for v, code in pairs:
            if v is None:
                found = F.when(value.isNull(), F.lit(int(code))).otherwise(found)
        return self._bits_of(c, found)

    def _bits_of(self, c: str, code: Column) -> dict[str, Column]:
        bits = self._bits(c)
        index = F.coalesce(code.cast("int"), F.lit(0))
        return {
            f"{c}_bit_{i}": F.shiftright(index, bits - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(bits)
        }

    # -- large maps, joined -----------------------------------------------------

    def _joined(self, df: DataFrame, c: str, info) -> tuple[DataFrame, Column]:
        name = f"__code:{c}"
        table = self.tables[info["table"]].select("value", F.col("code").alias(name))
        null_safe = info["method"] in ("label", "hash", "binary")
        df = lookup_join(df, table, c, "value", info["bytes"], info["hot"], null_safe)
        code, value = q(name), q(c).cast("string")
        if info["method"] == "label":
            return df, F.coalesce(code, F.lit(-1.0)).cast("int")
        if info["method"] == "ordinal":
            return df, F.when(value.isNotNull(), F.coalesce(code, F.lit(-1.0)))
        if info["method"] == "binary":
            return df, code
        if info["method"] == "frequency" and self.opt("method") != "frequency":
            return df, F.coalesce(code, F.lit(0.0))
        return df, self._or_unknown(c, code, value)


def category_codes(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """Sorted integer codes for categorical columns, missing as -1."""
    encoder = CategoricalEncoder(
        method="ordinal", columns=list(columns) if columns is not None else None,
        max_categories=(1 << 62), target=target,
    )
    model = encoder.fit(df)
    names = [*model.state["columns"], *model.state["large"]]
    coded = model.transform(df)
    return coded.withColumns({c: F.coalesce(q(c), F.lit(-1.0)).cast("int") for c in names}) if names else coded
