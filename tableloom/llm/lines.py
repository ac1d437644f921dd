"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages per line and site are counted over hashes first: a hash counts at least as many pages as its line, so lines under
the limit are out, and the few that are left are counted again by their text, exactly. A site's boilerplate is short:
lines on more than a share of its pages are at most (lines per page) / share. It travels to the pages, not the pages to
their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name
from tableloom.llm.common import named
from tableloom.session import materialise

BROADCAST_BYTES = 32 * 1024 * 1024


def boilerplate(
    pages: DataFrame, site: Column, text: Column, ratio: float = 0.05, least_pages: int = 5
) -> DataFrame:
    """(site, line, n_pages, site_pages): lines on more than ``ratio`` of their site's pages and at least
    ``least_pages`` of them. A page counts once per line; blank lines never count; a null site is a site of its own."""
    lines = pages.select(site.alias("site"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).filter(
        F.col("line").rlike(r"\S")
    )
    # partial counts per task come first, so one site or line with a third of all rows is a few rows per task here
    totals = pages.groupBy(site.alias("total_site")).agg(F.count(F.lit(1)).alias("site_pages"))
    hashed = lines.groupBy("site", F.xxhash64("line").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    often = F.col("n_pages") > F.lit(ratio) * F.col("site_pages")
    maybe = materialise(
        hashed.filter(F.col("n") >= least_pages)
        .join(totals, F.col("site").eqNullSafe(F.col("total_site")))
        .withColumnRenamed("n", "n_pages")
        .filter(often)
        .select(F.col("site").alias("maybe_site"), F.col("h").alias("maybe_h"), "site_pages")
    )
    same = F.col("site").eqNullSafe(F.col("maybe_site")) & (F.xxhash64("line") == F.col("maybe_h"))
    return (
        lines.join(small(maybe), same)
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.max("site_pages").alias("site_pages"))
        .filter(often & (F.col("n_pages") >= least_pages))
    )


def small(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if its measured size is within bounds; else it is joined by a shuffle."""
    widths = [F.coalesce(F.sum(F.length(named(c)) if t == "string" else F.lit(12)), F.lit(0)) for c, t in table.dtypes]
    size = table.agg(*(w.alias(f"w{i}") for i, w in enumerate(widths))).first()
    return F.broadcast(table) if 4 * sum(size) <= BROADCAST_BYTES else table


def drop_boilerplate(
    pages: DataFrame,
    site: Column,
    text: str = "text",
    ratio: float = 0.05,
    least_pages: int = 5,
    dropped: str | None = None,
) -> DataFrame:
    """The pages with boilerplate lines taken out of ``text``; all columns and rows stay.

    Lines are cut at line feeds and compared exactly. Null texts stay null and count as pages without lines; a text of
    boilerplate only becomes empty; texts without boilerplate stay as they are. Repeated rows are pages each. With
    ``dropped``, a column of that name tells how many lines went. An empty table stays empty.
    """
    rows = materialise(boilerplate(pages, site, named(text), ratio, least_pages).select("site", "line"))
    key, lines = free_name(pages, "site"), free_name(pages, "lines")
    width = rows.agg(F.coalesce(F.sum(F.length("line") + 16), F.lit(0))).first()[0]
    # at most (lines per page) / ratio lines in one array
    table = rows.groupBy(F.col("site").alias(key)).agg(F.collect_list("line").alias(lines))
    table = F.broadcast(table) if 4 * width <= BROADCAST_BYTES else table
    joined = pages.join(table, site.eqNullSafe(named(key)), "left")
    cut = F.split(named(text), "\n")
    hit = named(lines).isNotNull() & F.arrays_overlap(cut, named(lines))
    kept = F.filter(cut, lambda line: ~F.array_contains(named(lines), line))
    made = {text: F.when(hit, F.array_join(kept, "\n")).otherwise(named(text))}
    if dropped is not None:
        made[dropped] = F.when(hit, F.size(cut) - F.size(kept)).otherwise(0).cast("bigint")
    return joined.withColumns(made).drop(key, lines)
