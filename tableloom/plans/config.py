"""Configuration of a table preparation, and named presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from tableloom.operators import balance, clean, encode, scale, select

CHOICES = {
    "task_type": ("classification", "regression"),
    "imputation_method": clean.STRATEGIES,
    "scaling_method": (*scale.METHODS, "none"),
    "encoding_method": encode.METHODS,
    "outlier_method": ("iqr", "zscore", "none"),
    "outlier_action": ("winsorize", "drop"),
    "balancing_method": (*balance.METHODS, "none"),
    "feature_selection_method": (*select.METHODS, "none"),
    "reduction_method": (None, "pca", "lda"),
}

# Named in older configurations but without an algorithm behind them.
NOT_OFFERED = {"imputation_method": ("mice",), "outlier_method": ("isolation_forest", "dbscan")}


@dataclass
class PrepareConfig:
    """Field names, choices and defaults are fixed values: saved configurations use them."""

    task_type: str = "classification"

    imputation_method: str = "median"
    imputation_columns: list | None = None
    imputation_fill_value: Any = None
    imputation_knn_neighbors: int = 5

    scaling_method: str = "standard"
    scaling_columns: list | None = None
    scaling_with_mean: bool = True
    scaling_with_std: bool = True

    encoding_method: str = "onehot"
    encoding_columns: list | None = None
    encoding_max_categories: int = 50
    encoding_min_frequency: float = 0.01
    encoding_handle_unknown: str = "ignore"
    encoding_sparse: bool = True

    outlier_method: str = "iqr"
    outlier_threshold: float = 1.5
    outlier_action: str = "winsorize"
    outlier_columns: list | None = None

    balancing_method: str = "none"
    balancing_sampling_strategy: Any = None
    balancing_random_state: int = 42
    balancing_apply_before_pipeline: bool = True

    feature_selection_method: str = "none"
    feature_selection_threshold: float = 0.01
    feature_selection_k: int | None = None
    feature_selection_columns: list | None = None

    apply_log_transform: bool = False
    apply_boxcox: bool = False
    apply_yeojohnson: bool = False
    transform_columns: list | None = None
    transform_lambda: float | None = None

    create_polynomial: bool = False
    polynomial_degree: int = 2
    polynomial_max_features: int = 50
    polynomial_max_output_features: int = 5000
    create_interactions: bool = False
    create_ratios: bool = False
    ratios_max_pairs: int = 100
    create_aggregations: bool = False
    engineering_columns: list | None = None

    reduction_method: str | None = None
    reduction_components: int | None = None
    reduction_variance_ratio: float = 0.95

    drop_duplicates: bool = True
    drop_high_missing: bool = True
    high_missing_threshold: float = 0.8
    random_state: int = 42
    verbose: bool = True

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            value = getattr(self, name)
            if value in NOT_OFFERED.get(name, ()):
                raise ValueError(f"{name}={value!r} has no algorithm; use one of {allowed}")
            if value not in allowed:
                raise ValueError(f"{name}={value!r} is not one of {allowed}")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> PrepareConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def preset(cls, name: str, **overrides: Any) -> PrepareConfig:
        """A named preset; explicit options win."""
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}, expected one of {', '.join(PRESETS)}")
        return cls.from_dict({**PRESETS[name], **overrides})

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))

    @classmethod
    def load(cls, path: str) -> PrepareConfig:
        return cls.from_dict(json.loads(Path(path).read_text()))


# What each preset sets. "high_performance" clips by IQR, because the
# outlier method it once named has no algorithm.
PRESETS: dict[str, dict[str, Any]] = {
    "quick": {
        "imputation_method": "median", "scaling_method": "standard", "encoding_method": "onehot",
        "outlier_method": "iqr", "outlier_threshold": 1.5,
    },
    "robust": {
        "imputation_method": "median", "scaling_method": "robust", "encoding_method": "target",
        "outlier_method": "iqr", "outlier_threshold": 3.0, "outlier_action": "winsorize",
    },
    "high_performance": {
        "imputation_method": "knn", "scaling_method": "standard", "encoding_method": "catboost",
        "outlier_method": "iqr", "outlier_action": "winsorize", "create_polynomial": True,
        "polynomial_degree": 2, "apply_boxcox": True,
    },
    "minimal": {
        "imputation_method": "median", "scaling_method": "standard", "encoding_method": "ordinal",
        "outlier_method": "none", "drop_duplicates": False, "drop_high_missing": False,
    },
    "nlp_ready": {
        "imputation_method": "most_frequent", "scaling_method": "standard", "encoding_method": "frequency",
        "outlier_method": "iqr", "outlier_threshold": 1.5, "create_polynomial": False,
    },
    "time_series": {
        "imputation_method": "median", "scaling_method": "standard", "encoding_method": "onehot",
        "outlier_method": "iqr", "outlier_threshold": 1.5, "drop_duplicates": True,
        "create_interactions": False, "create_ratios": False,
    },
    "imbalanced": {
        "imputation_method": "median", "scaling_method": "standard", "encoding_method": "target",
        "outlier_method": "iqr", "outlier_threshold": 1.5, "balancing_method": "smote",
        "balancing_apply_before_pipeline": True, "outlier_action": "winsorize",
    },
}
