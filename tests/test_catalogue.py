"""Every registered query with SQL agrees with it; the smoke query runs."""

import compare
import pytest

import __spark_entry__ as entry
from claimspark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rel = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert compare.rows(df.columns, [tuple(r) for r in df.collect()]) == compare.rows(names, rel.fetchall())


def test_entry(spark):
    assert {r["action"] for r in entry.entry(spark).collect()} <= {"added", "updated", "unchanged", "withdrawn", "pastDropped"}
