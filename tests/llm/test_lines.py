"""Site-relative boilerplate against a count in Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableloom.llm.lines import boilerplate, drop_boilerplate


def brute(rows, ratio, least):
    """rows: (site, text)"""
    pages, holds = Counter(), Counter()
    for site, text in rows:
        pages[site] += 1
        holds.update({(site, line) for line in (text or "").split("\n") if line.strip()} if text is not None else ())
    bad = {k for k, n in holds.items() if n > ratio * pages[k[0]] and n >= least}
    out = []
    for site, text in rows:
        if text is None:
            out.append((site, None, 0))
            continue
        parts = text.split("\n")
        kept = [p for p in parts if (site, p) not in bad]
        out.append((site, "\n".join(kept), len(parts) - len(kept)))
    return sorted(out, key=str), bad


ROWS = (
    [("a", f"Home\nbody {i}\n\nFooter\nbody {i}") for i in range(30)]
    + [("a", "Home\nFooter")] * 3
    + [("b", f"Home\ntext {i}") for i in range(4)]  # too few pages
    + [(None, f"Menu\nx {i}") for i in range(8)]
    + [("a", None), ("a", ""), ("c", " \n \t"), ("a", "long " * 50_000), ("a", "Home")]
    + [("d", f"rare {i}\n{'shared' if i % 20 == 0 else i}") for i in range(100)]
)


@pytest.mark.parametrize("ratio,least", [(0.1, 5), (0.5, 2), (0.02, 5)])
def test_against_count(spark, ratio, least):
    df = spark.createDataFrame([(s, t, 7, "k") for s, t in ROWS], "source string, text string, site int, __lines string")
    got = drop_boilerplate(df, F.col("source"), ratio=ratio, least_pages=least, dropped="gone").collect()
    want, bad = brute(ROWS, ratio, least)
    assert sorted(((r.source, r.text, r.gone) for r in got), key=str) == want
    assert all(r.site == 7 and r["__lines"] == "k" for r in got)
    found = boilerplate(df, F.col("source"), F.col("text"), ratio, least).collect()
    assert {(r.site, r.line) for r in found} == bad


def test_empty_table(spark):
    df = spark.createDataFrame([], "source string, text string")
    assert drop_boilerplate(df, F.col("source")).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([("a", "x")], "source string, text string")
    plan = drop_boilerplate(df, F.col("source"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
