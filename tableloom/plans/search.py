"""Parameter search: random draws from the typed ranges, scored by cross-validation on Spark."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.operators.models import checked_params, cross_validated, folded, schema_for


def random_params(schema: Mapping[str, Mapping], n: int = 1, seed: int | None = None) -> list[dict[str, Any]]:
    """``n`` draws: a choice, a number in the range, or the default where there is no range."""
    rng = random.Random(seed)

    def draw(rule: Mapping) -> Any:
        if "choices" in rule:
            return rng.choice(rule["choices"])
        if rule.get("min") is not None and rule.get("max") is not None:
            between = rng.randint if rule["type"] == "int" else rng.uniform
            return between(rule["min"], rule["max"])
        return rule["default"]

    return [{name: draw(rule) for name, rule in schema.items()} for _ in range(n)]


def grid_params(schema: Mapping[str, Mapping], seed: int | None = None) -> list[dict[str, Any]]:
    """One random draw."""
    return random_params(schema, 1, seed)


def suggested_params(schema: Mapping[str, Mapping], n_rows: int, n_features: int) -> dict[str, Any]:
    """Defaults adjusted to the size of the data (fixed values)."""
    params = {name: rule["default"] for name, rule in schema.items()}
    if "n_estimators" in params:
        if n_rows > 10_000:
            params["n_estimators"] = min(500, schema["n_estimators"].get("max") or 500)
        elif n_rows > 5_000:
            params["n_estimators"] = 200
    if "max_depth" in params and n_features > 50:
        params["max_depth"] = min(10, schema["max_depth"].get("max") or 20)
    if "learning_rate" in params and n_rows > 10_000:
        params["learning_rate"] = 0.05
    if "alpha" in params and n_features > 100:
        params["alpha"] = min(2.0, schema["alpha"].get("max") or 10.0)
    return params


def suggest_for(df: DataFrame, kind: str, task: str, features: Sequence[str]) -> dict[str, Any]:
    return suggested_params(schema_for(kind, task), df.agg(F.count(F.lit(1))).first()[0], len(features))


def random_search(
    df: DataFrame, kind: str, task: str, key: str, candidates: Sequence[Mapping[str, Any]], *,
    target: str | None = None, features: Sequence[str] | None = None, folds: int = 5, seed: int = 42,
    parallelism: int = 2,
) -> DataFrame:
    """``(candidate, params, mean_score, std_score)``, best first."""
    rows = []
    checked = [checked_params(kind, task, params) for params in candidates]
    # all candidates learn from the same folds, written once
    table = folded(df, task, key, target, features, folds, seed) if candidates else None
    for i, params in enumerate(candidates):
        found = cross_validated(table, kind, task, checked[i], parallelism=parallelism)
        rows.append((i, str(dict(params)), float(found["mean_score"]), float(found["std_score"])))
    frame = df.sparkSession.createDataFrame(rows, "candidate int, params string, mean_score double, std_score double")
    return frame.orderBy(F.desc("mean_score"), "candidate")
