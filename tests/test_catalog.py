"""Every query against its SQL, and the contract of the entry module."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import difference, duck
from jumptrail.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TEXT_QUERIES = {"hexdump", "reverse_bytes", "bytes_from_hex"}


@pytest.fixture(scope="module")
def oracle():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    queries, sql = set(entry.queries()), set(entry.oracle_sql())
    assert set(QUERIES) <= sql <= queries


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    assert len(want) > 0
    assert difference(got, want) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "file", "appid", "path", "class", "variant", "n_matches"]
    assert df.filter("path IS NOT NULL").count() > 0 and df.filter("path IS NULL").count() > 0
