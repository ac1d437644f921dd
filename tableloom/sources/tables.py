"""Table scans, previews and the Parquet sink."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.columns import nan_to_null, q

FALLBACK_ENCODING = "ISO-8859-1"


class EmptyTableError(ValueError):
    """The source holds no rows."""


def load(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV or Parquet by suffix; a source without rows is an error. NaN is read as missing."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, sep=sep, encoding=encoding, schema=schema)
    if kind == "parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported table format {kind!r}: use .csv or .parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Header row and inferred types; pass ``schema`` to save the inference scan.

    Without ``encoding`` a file is UTF-8 when it decodes as such, else Latin-1.
    A file stays splittable unless some quoted field in it really spans lines.
    One pass over the text decides for every file what was not given; files that
    are read alike are read together.
    """

    def read(paths, code, lines, types):
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", code)
        reader = reader.option("multiLine", lines).option("escape", '"')
        return (reader.schema(types) if types is not None else reader.option("inferSchema", True)).csv(paths)

    if encoding is not None and multiline is not None:
        return _filled(read(path, encoding, multiline, schema), path)
    groups: dict[tuple[str, bool], list[str]] = {}
    for found in inspect_files(spark, path):
        kind = (encoding or found["encoding"], found["multiline"] if multiline is None else multiline)
        groups.setdefault(kind, []).append(found["file"])
    if len(groups) < 2:
        code, lines = next(iter(groups), (encoding or "UTF-8", bool(multiline)))
        return _filled(read(path, code, lines, schema), path)
    parts = [(kind, sorted(files)) for kind, files in sorted(groups.items())]
    types = schema
    if types is None:
        types = common_schema([read(files, *kind, None).schema for kind, files in parts])
        parts_read = [
            read(files, *kind, T.StructType([types[f.name] for f in read(files, *kind, None).schema])) for kind, files in parts
        ]
    else:
        parts_read = [read(files, *kind, types) for kind, files in parts]
    return _filled(reduce(DataFrame.unionByName, parts_read), path)


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """One type per column that holds what every schema says; columns that differ in name are an error."""
    widest = [T.IntegerType(), T.LongType(), T.DoubleType()]
    names = schemas[0].names
    if any(sorted(s.names) != sorted(names) for s in schemas):
        raise ValueError(f"files differ in their columns: {', '.join(sorted({n for s in schemas for n in s.names}))}")

    def common(name: str) -> T.DataType:
        kinds = [s[name].dataType for s in schemas]
        if all(k == kinds[0] for k in kinds):
            return kinds[0]
        return max(kinds, key=widest.index) if all(k in widest for k in kinds) else T.StringType()

    return T.StructType([T.StructField(n, common(n)) for n in names])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _filled(spark.read.parquet(path), path)


def _filled(df: DataFrame, path: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise EmptyTableError(f"{path} holds no rows")
    return nan_to_null(df)


def inspect_files(spark: SparkSession, path: str) -> list[dict]:
    """Per file: its encoding, UTF-8 if all lines decode as such, and whether any line leaves a quote open.

    One row per file, as in the driver's own list of the files; empty files have none.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    rows = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("multiline")
    ).collect()
    return [
        {"file": unquote(r["file"]), "encoding": "UTF-8" if r["utf8"] else FALLBACK_ENCODING, "multiline": r["multiline"]}
        for r in rows
    ]


def preview(df: DataFrame, limit: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First rows, in the given order if there is one."""
    return (df.orderBy(*[q(c) for c in order_by]) if order_by else df).limit(limit)


def shape(df: DataFrame) -> DataFrame:
    """``(rows, columns, names)``."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), names.alias("names")
    )


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
