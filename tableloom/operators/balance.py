"""Class rebalancing.

Choices are made by hashes of a row key, so they do not depend on partitioning,
and "the first n by hash" is a threshold found by an exact order statistic, not a
window over a whole class. Neighbour-based methods use the exact k-nearest-neighbour join.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import NUMERIC, detect_target, free_name, number, present, q
from tableloom.functions.expr import unit_hash
from tableloom.functions.knn import knn_join
from tableloom.functions.stats import order_statistics
from tableloom.operators.base import Configured
from tableloom.operators.select import MAX_CLASSES
from tableloom.session import materialise

METHODS = ("smote", "adasyn", "random_over", "random_under", "tomek", "enn", "smote_tomek", "smote_enn")
OVER = ("smote", "adasyn", "random_over", "smote_tomek", "smote_enn")


class NotApplicable(ValueError):
    """The data does not allow the method."""


class ClassBalancer(Configured):
    """``resample(df)`` changes the number of rows, so this is not an ML stage.

    ``sampling_strategy``: ``auto``, ``minority``, ``not minority``, ``not majority``,
    ``all``, or ``{class: rows}``. Synthetic rows have no key.
    """

    OPTIONS: ClassVar = {
        "method": "smote", "target": None, "key": None, "columns": None, "sampling_strategy": "auto",
        "seed": 42, "k_neighbors": 5, "max_classes": MAX_CLASSES,
    }

    def _check(self) -> None:
        if self.opt("method") not in METHODS:
            raise ValueError(f"unknown balancing method {self.opt('method')!r}, expected one of {', '.join(METHODS)}")
        self.before: DataFrame | None = None
        self.after: DataFrame | None = None

    def resample(self, df: DataFrame) -> DataFrame:
        target = self.opt("target") or detect_target(df)
        if target is None:
            raise ValueError("rebalancing needs a target column")
        self.before = df
        row, label = free_name(df, "row"), free_name(df, "label")
        key = self.opt("key")
        keyed = df.withColumn(row, (q(key).cast("string") if key else F.monotonically_increasing_id().cast("string")))
        keyed = keyed.withColumn(label, present(df, target).cast("string"))
        keyed = keyed if key else materialise(keyed)
        counts = {
            r[label]: r["n"]
            for r in keyed.filter(q(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .limit(self.opt("max_classes") + 1).collect()
        }
        if len(counts) > self.opt("max_classes"):
            raise ValueError(f"{target} has more than {self.opt('max_classes')} classes (max_classes)")
        work = _Work(self, df, keyed, row, label, key, target, counts)
        try:
            done = work.run(self.opt("method"))
        except NotApplicable as reason:
            warnings.warn(f"{self.opt('method')} failed ({reason}); random over-sampling instead", RuntimeWarning,
                          stacklevel=2)
            done = work.random_over(work.over_targets("auto"))
        self.after = done.select(*[q(c) for c in df.columns])
        return self.after

    def report(self) -> dict[str, Any]:
        """Method, sizes before and after, strategy and seed of the last resampling."""
        if self.before is None or self.after is None:
            return {}
        width = len(self.before.columns)
        return {
            "method": self.opt("method"), "rows_before": self.before.count(), "rows_after": self.after.count(),
            "columns": width, "sampling_strategy": self.opt("sampling_strategy"), "seed": self.opt("seed"),
        }


class _Work:
    def __init__(self, options, df, keyed, row, label, key, target, counts: Mapping[str, int]):
        self.o, self.df, self.keyed, self.row, self.label = options, df, keyed, row, label
        self.key, self.target, self.counts = key, target, dict(counts)
        self.most = max(counts.values())
        self.least = min(counts.values())
        self.majority = min(c for c, n in counts.items() if n == self.most)
        self.minority = min(c for c, n in counts.items() if n == self.least)

    # -- which classes, how many rows -------------------------------------------

    def over_targets(self, strategy) -> dict[str, int]:
        if isinstance(strategy, Mapping):
            wanted = {str(c): int(n) for c, n in strategy.items()}
            short = [c for c, n in wanted.items() if n < self.counts.get(c, 0)]
            if short:
                raise NotApplicable(f"over-sampling cannot shrink class {', '.join(short)}")
            return wanted
        classes = {
            "auto": [c for c in self.counts if c != self.majority],
            "not majority": [c for c in self.counts if c != self.majority],
            "not minority": [c for c in self.counts if c != self.minority],
            "minority": [self.minority], "all": list(self.counts),
        }
        if strategy not in classes:
            raise ValueError(f"unknown sampling_strategy {strategy!r}")
        return dict.fromkeys(classes[strategy], self.most)

    def cleaned_classes(self, strategy) -> list[str]:
        if isinstance(strategy, Mapping):
            return [str(c) for c in strategy]
        classes = {
            "auto": [c for c in self.counts if c != self.minority],
            "not minority": [c for c in self.counts if c != self.minority],
            "not majority": [c for c in self.counts if c != self.majority],
            "majority": [self.majority], "all": list(self.counts),
        }
        if strategy not in classes:
            raise ValueError(f"unknown sampling_strategy {strategy!r}")
        return classes[strategy]

    def run(self, method: str) -> DataFrame:
        strategy = self.o.opt("sampling_strategy")
        if method == "random_over":
            return self.random_over(self.over_targets(strategy))
        if method == "random_under":
            return self.random_under(strategy)
        self._need_numbers()
        if method == "smote":
            return self.smote(self.over_targets(strategy))
        if method == "adasyn":
            return self.adasyn(self.over_targets(strategy))
        if method == "tomek":
            return self.without_tomek(self.keyed, self.cleaned_classes(strategy))
        if method == "enn":
            return self.edited(self.keyed, self.cleaned_classes(strategy))
        grown = materialise(self.smote(self.over_targets(strategy)))
        clean = self.without_tomek if method == "smote_tomek" else self.edited
        return clean(grown, list(self.counts))

    # -- by hash ------------------------------------------------------------------

    def _hash(self, seed_shift: int = 0) -> Column:
        return unit_hash(q(self.row), seed=self.o.opt("seed") + seed_shift)

    def first_by_hash(self, wanted: Mapping[str, int]) -> Column:
        """True for exactly ``wanted[class]`` rows of each class, those with the smallest hashes."""
        wanted = {c: n for c, n in wanted.items() if n > 0}
        flag = F.lit(False)
        if not wanted:
            return flag
        names = list(wanted)
        hashed = self.keyed.select(
            *[F.when(q(self.label) == c, self._hash()).alias(f"h{i}") for i, c in enumerate(names)]
        )
        limits = order_statistics(
            hashed, {f"h{i}": [wanted[c] - 1] for i, c in enumerate(names)},
            {f"h{i}": self.counts[c] for i, c in enumerate(names)},
        )
        found = hashed.agg(
            *[F.count_if(F.col(f"h{i}") <= limits[f"h{i}", wanted[c] - 1]).alias(f"n{i}") for i, c in enumerate(names)]
        ).first()
        for i, c in enumerate(names):
            limit = limits[f"h{i}", wanted[c] - 1]
            extra = found[f"n{i}"] - wanted[c]
            test = self._hash() <= limit
            if extra > 0:
                # equal hashes at the limit: the last ones by key stay out
                equal = self.keyed.filter((q(self.label) == c) & (self._hash() == limit))
                out = [r[0] for r in equal.orderBy(F.desc(self.row)).limit(extra).select(self.row).collect()]
                test &= ~q(self.row).isin(out)
            flag = flag | ((q(self.label) == c) & test)
        return F.coalesce(flag, F.lit(False))

    def _draws(self, amounts: Mapping[str, int], otherwise: int) -> DataFrame:
        """Rows repeated so that each class gives ``amounts[class]`` draws, spread evenly; ``__draw`` counts them."""
        amounts = {c: n for c, n in amounts.items() if c in self.counts}
        every = F.lit(otherwise)
        for c, n in amounts.items():
            every = F.when(q(self.label) == c, F.lit(n // self.counts[c])).otherwise(every)
        more = self.first_by_hash({c: n % self.counts[c] for c, n in amounts.items()})
        return (
            self.keyed.withColumn("__draws", (every + more.cast("int")).cast("int"))
            .filter("__draws > 0")
            .withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("__draws"))))
            .drop("__draws")
        )

    def random_over(self, targets: Mapping[str, int]) -> DataFrame:
        return self._draws(targets, otherwise=1).drop("__draw")

    def random_under(self, strategy) -> DataFrame:
        if isinstance(strategy, Mapping):
            wanted = {str(c): int(n) for c, n in strategy.items()}
        else:
            wanted = dict.fromkeys(self.cleaned_classes(strategy), self.least)
        short = [c for c, n in wanted.items() if n > self.counts.get(c, 0)]
        if short:
            raise NotApplicable(f"under-sampling cannot grow class {', '.join(short)}")
        cut = q(self.label).isin(list(wanted)) & q(self.label).isNotNull()
        kept = self.first_by_hash(wanted)
        return self.keyed.filter(~F.coalesce(cut, F.lit(False)) | kept)

    # -- by neighbours --------------------------------------------------------------

    def _features(self) -> list[str]:
        chosen = self.o.opt("columns")
        return list(chosen) if chosen else [c for c in self.df.columns if c not in (self.target, self.key)]

    def _need_numbers(self) -> None:
        names = self._features()
        text = [c for c in names if not isinstance(self.df.schema[c].dataType, NUMERIC)]
        if text:
            raise NotApplicable(f"not numeric: {', '.join(text)}")
        row = self.df.agg(*[F.count_if(number(self.df, c).isNull()).alias(str(i)) for i, c in enumerate(names)]).first()
        if any(row):
            raise NotApplicable("missing values")

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.filter(q(self.label).isNotNull()).select(
            self.row, self.label, F.array(*[q(c).cast("double") for c in self._features()]).alias("vector")
        )

    def _near(self, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
        return knn_join(
            queries, candidates, k, query_id=self.row, candidate_id=self.row, exclude_same=True
        )

    def smote(self, targets: Mapping[str, int]) -> DataFrame:
        grow = {c: n for c, n in targets.items() if n > self.counts.get(c, 0)}
        k = self.o.opt("k_neighbors")
        self._enough_rows(grow, k)
        draws = self._draws({c: n - self.counts[c] for c, n in grow.items()}, otherwise=0)
        return self._with_synthetic(draws.select(self.row, self.label, "__draw"), list(grow), k)

    def adasyn(self, targets: Mapping[str, int]) -> DataFrame:
        grow = {c: n for c, n in targets.items() if n > self.counts.get(c, 0)}
        k = self.o.opt("k_neighbors")
        self._enough_rows(grow, k)
        rows = self._vectors(self.keyed)
        labels = rows.select(F.col(self.row).alias("candidate_id"), F.col(self.label).alias("other"))
        parts = []
        for c, n in grow.items():
            near = self._near(rows.filter(q(self.label) == c), rows, k).join(labels, "candidate_id")
            share = near.groupBy("query_id").agg((F.count_if(F.col("other") != c) / k).alias("share"))
            share = materialise(share)
            total = share.agg(F.sum("share")).first()[0]
            if not total:
                raise NotApplicable(f"class {c} has no neighbours of another class")
            draws = F.rint(F.col("share") / total * (n - self.counts[c])).cast("int")
            parts.append(share.select(
                F.col("query_id").alias(self.row), F.lit(c).alias(self.label), draws.alias("__draws")
            ))
        if not parts:
            return self.keyed
        allotted = parts[0]
        for part in parts[1:]:
            allotted = allotted.unionByName(part)
        draws = allotted.filter("__draws > 0").withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("__draws"))))
        return self._with_synthetic(draws.drop("__draws"), list(grow), k)

    def _enough_rows(self, grow: Mapping[str, int], k: int) -> None:
        few = [c for c in grow if self.counts.get(c, 0) <= k]
        if few:
            raise NotApplicable(f"class {', '.join(few)} has no more than {k} rows")

    def _with_synthetic(self, draws: DataFrame, classes: list[str], k: int) -> DataFrame:
        """Points on the segment from each drawn row to one of its neighbours of the same class."""
        rows = materialise(self._vectors(self.keyed.filter(q(self.label).isin(classes))))
        near = None
        for c in classes:
            own = rows.filter(q(self.label) == c)
            found = self._near(own, own, k)
            near = found if near is None else near.unionByName(found)
        names = self._features()
        doubles = self.keyed.withColumns({c: q(c).cast("double") for c in names})
        if near is None:
            return doubles
        seed = self.o.opt("seed")
        pick = (F.pmod(F.xxhash64(F.lit(seed + 1), q(self.row), F.col("__draw")), F.lit(k)) + 1).cast("int")
        base = rows.select(q(self.row), F.col("vector").alias("from"))
        partner = rows.select(q(self.row).alias("candidate_id"), F.col("vector").alias("to"))
        links = near.select(F.col("query_id").alias("__from"), F.col("rank").alias("__rank"), "candidate_id")
        made = (
            draws.withColumn("__pick", pick)
            .join(links, (q(self.row) == F.col("__from")) & (F.col("__pick") == F.col("__rank")))
            .join(partner, "candidate_id").join(base, self.row)
            .withColumn("u", unit_hash(q(self.row), F.col("__draw"), seed=seed + 2))
            .withColumn("at", F.zip_with("from", "to", lambda a, b: a + F.col("u") * (b - a)))
        )
        index = {c: i for i, c in enumerate(names)}
        synthetic = made.select(
            *[
                (F.col("at")[index[c]] if c in index
                 else q(self.label).cast(self.df.schema[c].dataType) if c == self.target
                 else F.lit(None).cast(self.df.schema[c].dataType)).alias(c)
                for c in self.df.columns
            ],
            F.concat(q(self.row), F.lit("#"), F.col("__draw").cast("string")).alias(self.row),
            q(self.label),
        )
        return doubles.unionByName(synthetic)

    def without_tomek(self, df: DataFrame, classes: list[str]) -> DataFrame:
        """Drop the chosen classes' members of mutual nearest neighbours of different class."""
        rows = self._vectors(df)
        near = materialise(self._near(rows, rows, 1).select("query_id", "candidate_id"))
        back = near.select(F.col("candidate_id").alias("query_id"), F.col("query_id").alias("candidate_id"))
        labels = rows.select(F.col(self.row).alias("query_id"), F.col(self.label).alias("own"))
        others = rows.select(F.col(self.row).alias("candidate_id"), F.col(self.label).alias("other"))
        links = near.join(back, ["query_id", "candidate_id"], "left_semi").join(labels, "query_id").join(
            others, "candidate_id"
        )
        bad = links.filter((F.col("own") != F.col("other")) & F.col("own").isin(classes))
        return df.join(bad.select(F.col("query_id").alias(self.row)), self.row, "left_anti")

    def edited(self, df: DataFrame, classes: list[str], k: int = 3) -> DataFrame:
        """Drop rows of the chosen classes whose three neighbours do not all agree with them."""
        rows = self._vectors(df)
        queries = rows.filter(q(self.label).isin(classes))
        others = rows.select(F.col(self.row).alias("candidate_id"), F.col(self.label).alias("other"))
        own = queries.select(F.col(self.row).alias("query_id"), F.col(self.label).alias("own"))
        near = self._near(queries, rows, k).join(others, "candidate_id").join(own, "query_id")
        bad = near.filter(F.col("own") != F.col("other")).select(F.col("query_id").alias(self.row)).distinct()
        return df.join(bad, self.row, "left_anti")
