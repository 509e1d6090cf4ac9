"""Queries of the subpackage that SQL can express, against that SQL; the others at least run over whole tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import difference, duck
from jumptrail.llm.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck(SF_DIR).execute(ORACLE[name]).df()
    assert len(want) > 0
    assert difference(got, want) is None


def test_every_operator_and_the_pipeline_are_registered():
    numbers = {name.split("_")[0] for name in entry.queries() if name in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries()
