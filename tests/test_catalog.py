import pytest

import __spark_entry__ as entry
from beaconfold.plans import catalog, changes, formats, reports  # noqa: F401

from differential import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


def test_every_vector_passes_with_all_its_fields(spark):
    rows = catalog.QUERIES["vector_conformance"](spark, SF).collect()
    assert len(rows) == 30 and [r.id for r in rows if not r.passed] == []


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_theta_join_and_its_rewrite_agree(spark):
    a, b = (sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect())) for n in ("event_fanout", "event_fanout_equi"))
    assert a == b
