"""Experiment log as five append-only Parquet tables.

Nothing is updated in place: a run's state is the latest of its appended events,
versions are numbered when read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.keyed import grouped_rank

SCHEMAS = {
    "runs": "run_id string, model_name string, task string, status string, start_time timestamp, "
    "end_time timestamp, metadata string, recorded_at timestamp",
    "parameters": "run_id string, param_name string, param_value string",
    "metrics": "run_id string, metric_name string, metric_value double, recorded_at timestamp",
    "models": "run_id string, model_path string, model_type string, created_at timestamp, is_best boolean",
    "tags": "run_id string, tag_key string, tag_value string",
}
FILTERS = ("run_id", "model_name", "task", "status")


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: Sequence[tuple]) -> None:
        if rows:
            frame = self.spark.createDataFrame(list(rows), SCHEMAS[name]).coalesce(1)
            frame.write.mode("append").parquet(f"{self.root}/{name}")

    def start_run(
        self, model_name: str, task: str, params: Mapping[str, Any], tags: Mapping[str, str] | None = None
    ) -> str:
        run_id, now = str(uuid.uuid4()), _now()
        self._append("runs", [(run_id, model_name, task, "running", now, None, json.dumps({"tags": dict(tags or {})}), now)])
        self._append("parameters", [(run_id, k, json.dumps(v)) for k, v in params.items()])
        self._append("tags", [(run_id, k, str(v)) for k, v in (tags or {}).items()])
        return run_id

    def log_metrics(self, run_id: str, metrics: Mapping[str, float]) -> None:
        now = _now()
        self._append("metrics", [(run_id, k, float(v), now) for k, v in metrics.items()])

    def finish_run(self, run_id: str, status: str = "completed") -> None:
        now = _now()
        self._append("runs", [(run_id, None, None, status, None, now, None, now)])

    def register_model(self, run_id: str, path: str, model_type: str, is_best: bool = False) -> str:
        self._append("models", [(run_id, path, model_type, _now(), is_best)])
        mine = versions(self.table("models")).filter((F.col("run_id") == run_id) & (F.col("model_path") == path))
        return mine.agg(F.max_by("model_version", "created_at")).first()[0]

    def experiments(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return experiments(run_states(self.table("runs")), self.table("metrics"), self.table("parameters"), filters)

    def best_model(self, model_type: str) -> DataFrame:
        return best_model(self.table("models"), model_type)

    def compare(self, run_ids: Sequence[str]) -> DataFrame:
        return compare(self.table("metrics"), run_ids)

    def details(self, run_id: str) -> DataFrame:
        return run_details(
            run_states(self.table("runs")), self.table("parameters"), self.table("metrics"),
            self.table("models"), run_id,
        )


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def run_states(events: DataFrame) -> DataFrame:
    """Current state of each run: latest status, first start, last end, duration in seconds."""
    state = events.groupBy("run_id").agg(
        F.max("model_name").alias("model_name"), F.max("task").alias("task"),
        F.max_by("status", "recorded_at").alias("status"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"), F.max("metadata").alias("metadata"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / F.lit(1e6)
    return state.withColumn("duration_seconds", seconds)


VERSION_ORDER = ("created_at", "run_id", "model_path")


def versions(models: DataFrame) -> DataFrame:
    """``v1.0``, ``v2.0``, … per model type in order of creation. A type may hold any share of all models."""
    numbered = grouped_rank(models, "model_type", [F.col(c) for c in VERSION_ORDER], "__place")
    number = (F.col("__place") + 1).cast("bigint").cast("string")
    return numbered.withColumn("model_version", F.concat(F.lit("v"), number, F.lit(".0"))).drop("__place")


def experiments(
    runs: DataFrame, metrics: DataFrame, parameters: DataFrame, filters: Mapping[str, Any] | None = None
) -> DataFrame:
    """Runs with their distinct ``name:value`` lists, newest first. Each side is aggregated before joining."""
    for column, value in (filters or {}).items():
        if column not in FILTERS:
            raise ValueError(f"cannot filter by {column!r}, only by {', '.join(FILTERS)}")
        runs = runs.filter(F.col(column) == value)

    def listed(df: DataFrame, name: str, value: str, to: str) -> DataFrame:
        pair = F.concat(F.col(name), F.lit(":"), F.col(value).cast("string"))
        return df.groupBy("run_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(pair))).alias(to))

    return (
        runs.join(listed(metrics, "metric_name", "metric_value", "metrics"), "run_id", "left")
        .join(listed(parameters, "param_name", "param_value", "parameters"), "run_id", "left")
        .orderBy(F.desc("start_time"), "run_id")
    )


def best_model(models: DataFrame, model_type: str) -> DataFrame:
    """The newest model of a type that is flagged best, with its version: one more than the models before it."""
    mine = models.filter(F.col("model_type") == model_type)
    place = F.struct(*VERSION_ORDER)
    best = mine.filter("is_best").orderBy(*[F.desc(c) for c in VERSION_ORDER]).limit(1)
    best = best.select("run_id", "model_path", F.col("model_type").alias("of"), place.alias("at"))
    earlier = mine.select(F.col("model_type").alias("type"), place.alias("place")).join(
        F.broadcast(best.select("of", "at")), (F.col("type") == F.col("of")) & (F.col("place") < F.col("at"))
    )
    number = earlier.groupBy("of").agg(F.count(F.lit(1)).alias("before"))
    version = F.concat(F.lit("v"), (F.coalesce("before", F.lit(0)) + 1).cast("string"), F.lit(".0"))
    return best.join(number, "of", "left").select("run_id", version.alias("version"), F.col("model_path").alias("path"))


def compare(metrics: DataFrame, run_ids: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """One row per run, one column per metric; the latest value wins."""
    chosen = metrics.filter(F.col("run_id").isin(list(run_ids))) if run_ids is not None else metrics
    return chosen.groupBy("run_id").pivot("metric_name", list(names) if names else None).agg(
        F.max_by("metric_value", "recorded_at")
    )


def run_details(
    runs: DataFrame, parameters: DataFrame, metrics: DataFrame, models: DataFrame, run_id: str | None = None
) -> DataFrame:
    """Run with its parameter map, metric map and model; one run or all."""
    if run_id is not None:
        runs, parameters, metrics = (d.filter(F.col("run_id") == run_id) for d in (runs, parameters, metrics))
    params = parameters.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("param_name", "param_value"))).alias("parameters")
    )
    latest = metrics.groupBy("run_id", "metric_name").agg(F.max_by("metric_value", "recorded_at").alias("metric_value"))
    measured = latest.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value"))).alias("metrics")
    )
    model = versions(models).groupBy("run_id").agg(
        F.min_by(
            F.struct(F.col("model_version").alias("version"), F.col("model_path").alias("path"),
                     F.col("model_type").alias("type")), "created_at",
        ).alias("model")
    )
    return (
        runs.join(params, "run_id", "left").join(measured, "run_id", "left").join(model, "run_id", "left")
    )
