"""Markdown corpus scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, root: str, document_id: str = "stem") -> DataFrame:
    """``(document_id, name, content, source)`` of every ``.md`` file below ``root``.

    The id is the file stem; ``document_id="path"`` uses the path below the root,
    which stays unique when two folders hold files of one name.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .text(root, wholetext=True)
        .select(F.col("value").alias("content"), F.url_decode(F.col("_metadata.file_path")).alias("source"))
    )
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    if document_id == "path":
        key = F.regexp_replace(F.element_at(F.split("source", _quoted(root)), -1), r"^/+|\.md$", "")
    else:
        key = F.regexp_replace(name, r"\.md$", "")
    return files.select(key.alias("document_id"), name.alias("name"), "content", "source")


def _quoted(root: str) -> str:
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/") if "://" in root or ":" in root else root.strip("/")
    return r"\Q" + plain + r"\E"
