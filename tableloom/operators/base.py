"""Fit / transform base classes on ``pyspark.ml``.

A ``Step`` is an ``Estimator`` whose options are ordinary ML params, so steps
compose in ``pyspark.ml.Pipeline`` and persist with it. Fitting gives a
``FittedStep``: its small learned values are JSON in the model metadata and its
learned tables (category maps, group aggregates, training rows) are DataFrames
written as Parquet next to it.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any, ClassVar

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

from tableloom.functions.columns import choose_columns, detect_target


class Configured(Params):
    """Params declared as a table of names and defaults."""

    OPTIONS: ClassVar[dict[str, Any]] = {}

    def __init__(self, **options: Any):
        super().__init__()
        for name, default in self.OPTIONS.items():
            setattr(self, name, Param(self, name, name))
            self._setDefault(**{name: default})
        unknown = sorted(set(options) - set(self.OPTIONS))
        if unknown:
            raise TypeError(f"{type(self).__name__} has no option {', '.join(unknown)}")
        self._set(**options)
        self._check()

    def _check(self) -> None:
        """Reject option values that have no meaning."""

    def opt(self, name: str) -> Any:
        return self.getOrDefault(name)

    def options(self) -> dict[str, Any]:
        return {name: self.opt(name) for name in self.OPTIONS}


class Step(Configured, Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """Base of all learning operators. ``target`` and ``keep`` columns are never touched by default."""

    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        raise ValueError(f"{type(self).__name__} must be fitted before transform")

    def target_of(self, df: DataFrame) -> str | None:
        named = self.opt("target") if "target" in self.OPTIONS else None
        return named or detect_target(df)

    def pick(self, df: DataFrame, family: str | None, option: str = "columns") -> list[str]:
        keep = list(self.opt("keep") or []) if "keep" in self.OPTIONS else []
        return choose_columns(df, self.opt(option), family, exclude=[self.target_of(df), *keep])


class _FittedWriter(MLWriter):
    def __init__(self, model: FittedStep):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        names = sorted(self.model.tables)
        DefaultParamsWriter.saveMetadata(
            self.model, path, SparkSession.active(),
            extraMetadata={"state": self.model.state, "tables": names, "options": self.model.settings},
        )
        for name in names:
            self.model.tables[name].write.parquet(f"{path}/tables/{name}")


class _FittedReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedStep:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(
            metadata["options"],
            metadata["state"],
            {n: spark.read.parquet(f"{path}/tables/{n}") for n in metadata["tables"]},
        )
        model._resetUid(metadata["uid"])
        return model


class FittedStep(Model, MLWritable, MLReadable):
    """Learned state applied unchanged to any table."""

    def __init__(
        self,
        settings: Mapping[str, Any] | None = None,
        state: Mapping[str, Any] | None = None,
        tables: Mapping[str, DataFrame] | None = None,
    ):
        super().__init__()
        self.settings = dict(settings or {})
        self.state = dict(state or {})
        self.tables = dict(tables or {})

    def opt(self, name: str) -> Any:
        return self.settings[name]

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)


def appended(df: DataFrame, drop: list[str], new: Mapping[str, Any]) -> DataFrame:
    """Replace columns: the dropped ones go, the new ones come last, in order."""
    from tableloom.functions.columns import q

    gone = set(drop)
    return df.select(
        *[q(c) for c in df.columns if c not in gone and c not in new],
        *[expr.alias(name) for name, expr in new.items()],
    )
