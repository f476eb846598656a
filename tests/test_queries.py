"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
from textloom.plans.registry import load  # noqa: E402
from tools import check  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(load()))
def test_agrees_with_sql(spark, connection, name):
    good, note = check.compare(spark, connection, name, SF)
    assert good, note


def test_entry_has_rows_and_six_metrics(spark):
    frame = entry_module.entry(spark)
    assert set(check_metrics()) <= set(frame.columns)
    assert frame.count() == 20


def check_metrics():
    from textloom.schemas import METRIC_NAMES

    return METRIC_NAMES


def test_sql_has_no_orphans():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
