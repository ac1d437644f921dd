"""Choosing columns: type families, explicit lists, target detection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
CATEGORICAL = (T.StringType,)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
FAMILIES = {"numeric": NUMERIC, "categorical": CATEGORICAL, "datetime": DATETIME}

# Names that mark a target column, compared in lower case.
TARGET_NAMES = ("target", "y", "label", "class")


def family_columns(df: DataFrame, family: str, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of one type family in schema order."""
    skipped = {name for name in exclude if name}
    kinds = FAMILIES[family]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skipped]


def choose_columns(
    df: DataFrame,
    requested: Sequence[str] | None,
    family: str | None = None,
    exclude: Iterable[str] = (),
) -> list[str]:
    """``None`` takes the whole family; a list keeps the names that exist, whatever their type."""
    skipped = {name for name in exclude if name}
    if requested is not None:
        present = set(df.columns)
        return [name for name in requested if name in present]
    if family is None:
        return [name for name in df.columns if name not in skipped]
    return family_columns(df, family, skipped)


def select_columns(
    df: DataFrame, requested: Sequence[str] | None = None, family: str | None = None
) -> DataFrame:
    return df.select(*[q(c) for c in choose_columns(df, requested, family)])


def detect_target(df: DataFrame) -> str | None:
    """First column whose lower-cased name is a conventional target name."""
    return next((name for name in df.columns if name.lower() in TARGET_NAMES), None)


def split_target(df: DataFrame, target: str | None = None) -> tuple[list[str], str | None]:
    """Feature names and target name. Rows are never separated, so nothing has to be re-aligned."""
    target = target or detect_target(df)
    return [name for name in df.columns if name != target], target


def q(name: str) -> Column:
    """Column by exact name; generated names may contain dots, stars or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    column = q(name)
    return F.when(~F.isnan(column), column) if is_floating(df, name) else column


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN read as missing."""
    return present(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: applied when a table is read."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({name: present(df, name) for name in floating}) if floating else df


def free_name(df: DataFrame, stem: str) -> str:
    """A working column name that does not clash with the table."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name
