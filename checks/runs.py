"""K1–K7: an experiment log derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import near, rounded, table
from tableloom.session import scratch_path
from tableloom.sources import runlog
from tableloom.sources.runlog import RunLog

RUNS_SQL = """
    SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id,
           CASE WHEN user_id % 3 = 0 THEN 'ridge' WHEN user_id % 3 = 1 THEN 'knn' ELSE 'linear' END AS model_name,
           CASE WHEN user_id % 2 = 0 THEN 'regression' ELSE 'classification' END AS task,
           'completed' AS status, min(ts) AS start_time, max(ts) AS end_time FROM events GROUP BY user_id"""
METRICS_SQL = f"""
    SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, event_type AS metric_name,
           {near('avg(value)', 3)} AS metric_value FROM events GROUP BY user_id, event_type"""


def log_frames(spark, sf):
    """Events as a log: a start and an end record per user, averages as metrics, counts as parameters."""
    e = table(spark, sf, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.when(F.col("user_id") % 3 == 0, "ridge").when(F.col("user_id") % 3 == 1, "knn").otherwise("linear")
    task = F.when(F.col("user_id") % 2 == 0, "regression").otherwise("classification")
    spans = e.groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    started = spans.select(
        user.alias("run_id"), kind.alias("model_name"), task.alias("task"), F.lit("running").alias("status"),
        F.col("start").alias("start_time"), none.cast("timestamp_ntz").alias("end_time"),
        F.lit("{}").alias("metadata"), F.lit(0).alias("recorded_at"),
    )
    ended = spans.select(
        user.alias("run_id"), none.cast("string").alias("model_name"), none.cast("string").alias("task"),
        F.lit("completed").alias("status"), none.cast("timestamp_ntz").alias("start_time"),
        F.col("end").alias("end_time"), none.cast("string").alias("metadata"), F.lit(1).alias("recorded_at"),
    )
    metrics = e.groupBy("user_id", "event_type").agg(
        rounded(F.avg("value"), 3).alias("metric_value"), F.max("ts").alias("recorded_at")
    ).select(user.alias("run_id"), F.col("event_type").alias("metric_name"), "metric_value", "recorded_at")
    parameters = spans.select(
        user.alias("run_id"), F.lit("n").alias("param_name"), F.to_json(F.struct("n")).alias("param_value")
    )
    models = spans.select(
        user.alias("run_id"), F.concat(F.lit("/models/"), user).alias("model_path"), kind.alias("model_type"),
        F.col("end").alias("created_at"), (F.col("user_id") % 7 == 0).alias("is_best"),
    )
    return started.unionByName(ended), parameters, metrics, models


def k1(spark, sf):
    """Class counts logged as one run's metrics, parameters and tags, then read back."""
    log = RunLog(spark, scratch_path(spark, "runlog"))
    sizes = {
        r["event_type"]: float(r["n"])
        for r in table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    run = log.start_run("counter", "classification", {"sizes": sorted(sizes)}, {"table": "events"})
    log.log_metrics(run, sizes)
    log.finish_run(run)
    return log.table("metrics").select("metric_name", "metric_value")


def k2(spark, sf):
    events, *_ = log_frames(spark, sf)
    return runlog.run_states(events).select(
        "run_id", "model_name", "task", "status", "start_time", "end_time",
        rounded("duration_seconds", 3).alias("duration_seconds"),
    )


def k3(spark, sf):
    *_, models = log_frames(spark, sf)
    return runlog.versions(models).select("run_id", "model_type", "model_version")


MODELS_SQL = f"""
    SELECT run_id, model_name AS model_type, '/models/' || run_id AS model_path, end_time AS created_at,
           CAST(substr(run_id, 2) AS BIGINT) % 7 = 0 AS is_best,
           'v' || CAST(row_number() OVER (PARTITION BY model_name ORDER BY end_time, run_id) AS VARCHAR) || '.0'
             AS model_version FROM ({RUNS_SQL})"""


def k4(spark, sf):
    events, parameters, metrics, _ = log_frames(spark, sf)
    found = runlog.experiments(
        runlog.run_states(events), metrics.withColumn("metric_value", F.round(F.col("metric_value") * 1000).cast("bigint")),
        parameters, {"task": "regression"},
    )
    return found.select("run_id", "model_name", "task", "status", "metrics", "parameters")


K4_SQL = f"""
    SELECT r.run_id, model_name, task, status, m.metrics, p.parameters FROM ({RUNS_SQL}) r
    LEFT JOIN (SELECT run_id, string_agg(pair, ',' ORDER BY pair) AS metrics FROM (
         SELECT run_id, metric_name || ':' || CAST(CAST(round(metric_value * 1000) AS BIGINT) AS VARCHAR) AS pair
         FROM ({METRICS_SQL})) GROUP BY 1) m ON r.run_id = m.run_id
    LEFT JOIN (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id,
         'n:{{"n":' || CAST(count(*) AS VARCHAR) || '}}' AS parameters FROM events GROUP BY user_id) p
         ON r.run_id = p.run_id WHERE task = 'regression'"""


def k5(spark, sf):
    *_, models = log_frames(spark, sf)
    return runlog.best_model(models, "ridge")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def k6(spark, sf):
    _, _, metrics, models = log_frames(spark, sf)
    return runlog.compare(metrics, names=EVENT_TYPES)  # of all runs


def k7(spark, sf):
    events, parameters, metrics, models = log_frames(spark, sf)
    found = runlog.run_details(runlog.run_states(events), parameters, metrics, models)
    return found.select(
        "run_id", "status", F.size("metrics").cast("bigint").alias("n_metrics"),
        rounded(F.aggregate(F.map_values("metrics"), F.lit(0.0), lambda a, v: a + v), 3).alias("metric_sum"),
        F.col("parameters")["n"].alias("n"), F.col("model.version").alias("version"), F.col("model.path").alias("path"),
    )


K7_SQL = f"""
    SELECT r.run_id, status, n_metrics, metric_sum, p.n, model_version AS version, model_path AS path
    FROM ({RUNS_SQL}) r
    JOIN (SELECT run_id, count(*) AS n_metrics, {near('sum(metric_value)', 3)} AS metric_sum
          FROM ({METRICS_SQL}) GROUP BY 1) m ON r.run_id = m.run_id
    JOIN (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, '{{"n":' || CAST(count(*) AS VARCHAR) || '}}' AS n
          FROM events GROUP BY user_id) p ON r.run_id = p.run_id
    JOIN ({MODELS_SQL}) d ON r.run_id = d.run_id"""

CHECKS = {
    "k1_append_run": (
        k1,
        "SELECT event_type AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM events GROUP BY 1",
    ),
    "k2_finish_run": (
        k2,
        "SELECT run_id, model_name, task, status, start_time, end_time, "
        f"{near('epoch_us(end_time) / 1e6 - epoch_us(start_time) / 1e6', 3)} AS duration_seconds FROM ({RUNS_SQL})",
    ),
    "k3_model_versions": (k3, f"SELECT run_id, model_type, model_version FROM ({MODELS_SQL})"),
    "k4_list_experiments": (k4, K4_SQL),
    "k5_best_model": (
        k5,
        f"SELECT run_id, model_version AS version, model_path AS path FROM ({MODELS_SQL}) "
        "WHERE model_type = 'ridge' AND is_best ORDER BY created_at DESC, run_id DESC LIMIT 1",
    ),
    "k6_compare_runs": (
        k6,
        "SELECT run_id, " + ", ".join(f"max(CASE WHEN metric_name = '{e}' THEN metric_value END) AS {e}" for e in EVENT_TYPES)
        + f" FROM ({METRICS_SQL}) GROUP BY run_id",
    ),
    "k7_run_details": (k7, K7_SQL),
}
