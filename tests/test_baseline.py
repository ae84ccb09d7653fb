"""The plain-Spark-SQL comparison answers exactly what the library answers."""

import os

import pytest

import __spark_entry__ as entry
from fleetspark.plans.baseline_sql import BASELINES
from tools.oracle_check import rows as norm_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(BASELINES))
def test_baseline_equals_library(spark, name):
    ours = norm_rows(entry.queries()[name](spark, SF).toPandas())
    plain = norm_rows(BASELINES[name](spark, SF).toPandas())
    assert ours == plain
