"""Queries that must not gather or sort all rows in one place."""

import re

from checks.numbers import f5
from checks.runs import k6

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_runs_are_not_listed_in_the_plan(spark):
    assert not re.search(r"run_id#\d+ IN \(", plan(k6(spark, SF)))


def test_ranks_are_not_sorted_in_one_task(spark):
    assert not re.search(r"windowspecdefinition\(bal", plan(f5(spark, SF)))
