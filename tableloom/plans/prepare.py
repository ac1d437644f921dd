"""Prepare a table by configuration: an ordinary ``pyspark.ml.Pipeline`` of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame

from tableloom.functions.columns import detect_target
from tableloom.operators import clean, detect, encode, features, reduce, scale, select, transform
from tableloom.operators.balance import ClassBalancer
from tableloom.plans.config import PrepareConfig
from tableloom.session import materialise

COMPONENTS: dict[str, Callable[..., Any]] = {
    "drop_duplicates": clean.DuplicateDropper,
    "drop_high_missing": clean.SparseColumnDropper,
    "imputation": clean.Imputer,
    "outlier_handling": clean.OutlierTreatment,
    "polynomial": features.PolynomialFeatures,
    "interactions": features.InteractionFeatures,
    "ratios": features.RatioFeatures,
    "aggregations": features.GroupAggregates,
    "date_parts": features.DateParts,
    "log_transform": transform.LogTransformer,
    "sqrt": transform.SqrtTransformer,
    "reciprocal": transform.ReciprocalTransformer,
    "boxcox": transform.BoxCoxTransformer,
    "yeojohnson": transform.YeoJohnsonTransformer,
    "percentile": transform.PercentileTransformer,
    "encoding": encode.CategoricalEncoder,
    "scaling": scale.FeatureScaler,
    "feature_selection": select.FeatureSelector,
    "pca": reduce.PCAReducer,
    "lda": reduce.LDAReducer,
    "balancing": ClassBalancer,
    **{
        f"{name}_detector": lambda function=function, **options: detect.Detector(function, options)
        for name, function in {
            "missing": detect.missing_values, "outlier": detect.outliers, "correlation": detect.correlated_pairs,
            "cardinality": detect.cardinality, "duplicate": detect.duplicates,
        }.items()
    },
}


def register_component(name: str, component: Callable[..., Any]) -> None:
    """Make any ``pyspark.ml`` stage class (or factory) available by name."""
    if name in COMPONENTS:
        raise ValueError(f"component {name!r} is already registered")
    COMPONENTS[name] = component


def create(name: str, **options: Any):
    """A component by name."""
    if name not in COMPONENTS:
        raise ValueError(f"unknown component {name!r}, expected one of {', '.join(COMPONENTS)}")
    return COMPONENTS[name](**options)


def preparation_stages(
    config: PrepareConfig, target: str | None = None, keep: Sequence[str] = (), key: str | None = None
) -> list[tuple[str, Any]]:
    """Named stages in their fixed order; disabled ones are left out.

    ``keep`` columns (row keys) pass through untouched. ``key`` identifies rows,
    needed only by neighbour imputation.
    """
    kept = sorted({*keep, *([key] if key else [])})
    common = {"target": target, "keep": kept or None}
    c = config
    stages: list[tuple[str, Any]] = []

    def add(enabled: bool, name: str, **options: Any) -> None:
        if enabled:
            stages.append((name, create(name, **options)))

    add(c.drop_duplicates, "drop_duplicates", target=target)
    add(c.drop_high_missing, "drop_high_missing", threshold=c.high_missing_threshold, target=target)
    add(
        True, "imputation", strategy=c.imputation_method, fill_value=c.imputation_fill_value,
        columns=c.imputation_columns, knn_neighbors=c.imputation_knn_neighbors, key=key, **common,
    )
    add(
        c.outlier_method != "none", "outlier_handling", method=c.outlier_method, threshold=c.outlier_threshold,
        action=c.outlier_action, columns=c.outlier_columns, **common,
    )
    add(
        c.create_polynomial, "polynomial", degree=c.polynomial_degree, max_features=c.polynomial_max_features,
        max_output_features=c.polynomial_max_output_features, **common,
    )
    add(c.create_interactions, "interactions", **common)
    add(c.create_ratios, "ratios", max_pairs=c.ratios_max_pairs, **common)
    group, *measured = c.engineering_columns or [None]
    add(
        c.create_aggregations and group is not None, "aggregations", group_column=group,
        agg_columns=measured or None, **common,
    )
    add(c.apply_log_transform, "log_transform", columns=c.transform_columns, **common)
    add(c.apply_boxcox, "boxcox", columns=c.transform_columns, lambda_=c.transform_lambda, **common)
    add(c.apply_yeojohnson, "yeojohnson", columns=c.transform_columns, lambda_=c.transform_lambda, **common)
    add(
        c.encoding_method != "none", "encoding", method=c.encoding_method, columns=c.encoding_columns,
        max_categories=c.encoding_max_categories, min_frequency=c.encoding_min_frequency,
        handle_unknown=c.encoding_handle_unknown, **common,
    )
    add(
        c.scaling_method != "none", "scaling", method=c.scaling_method, columns=c.scaling_columns,
        with_mean=c.scaling_with_mean, with_std=c.scaling_with_std, **common,
    )
    add(
        c.feature_selection_method != "none", "feature_selection", method=c.feature_selection_method,
        threshold=c.feature_selection_threshold, k=c.feature_selection_k, columns=c.feature_selection_columns,
        task_type=c.task_type, **common,
    )
    add(
        c.reduction_method == "pca", "pca", n_components=c.reduction_components,
        variance_ratio=c.reduction_variance_ratio, **common,
    )
    add(c.reduction_method == "lda", "lda", n_components=c.reduction_components, **common)
    return stages


class Preparation(Pipeline):
    """A ``Pipeline`` that writes the table down after a stage that shuffles rows while fitting.

    Each later stage learns from the output of the ones before; without this every
    one of them would repeat the shuffle.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        fitted = []
        stages = self.getStages()
        for i, stage in enumerate(stages):
            model = stage if isinstance(stage, Transformer) else stage.fit(dataset)
            fitted.append(model)
            if i + 1 < len(stages):
                dataset = model.transform(dataset)
                if isinstance(model, SHUFFLING) and any(isinstance(s, Estimator) for s in stages[i + 1 :]):
                    dataset = materialise(dataset)
        return PipelineModel(fitted)


SHUFFLING = (clean.DuplicateDropperModel,)


def build(
    config: PrepareConfig, target: str | None = None, keep: Sequence[str] = (), key: str | None = None,
    extra: Sequence[Any] = (),
) -> Pipeline:
    """``extra`` stages of your own run last."""
    return Preparation(stages=[stage for _, stage in preparation_stages(config, target, keep, key)] + list(extra))


@dataclass
class Prepared:
    table: DataFrame
    model: PipelineModel
    target: str | None
    balance: dict[str, Any] | None = None
    message: str = ""


def prepare(
    df: DataFrame, config: PrepareConfig, target: str | None = None, keep: Sequence[str] = (),
    key: str | None = None, extra: Sequence[Any] = (),
) -> Prepared:
    """Rebalance if asked, learn all stages, apply them. The target stays in the rows throughout."""
    target = target or detect_target(df)
    report, message = None, ""
    if config.balancing_method != "none" and config.balancing_apply_before_pipeline and target:
        balancer = ClassBalancer(
            method=config.balancing_method, target=target, key=key,
            sampling_strategy=config.balancing_sampling_strategy or "auto", seed=config.balancing_random_state,
        )
        df = balancer.resample(df)
        report = balancer.report()
        message = f"{config.balancing_method}: {report['rows_before']} → {report['rows_after']} rows"
    model = build(config, target, keep, key, extra).fit(df)
    return Prepared(model.transform(df), model, target, report, message)
