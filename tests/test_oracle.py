"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as E
from relevo.plans.compare import compare, type_mismatches
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    sdata = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    problems = compare(sdf.columns, sdata, dcols, cur.fetchall())
    assert not problems, problems
    rel = duck.sql(ORACLES[name])
    assert not type_mismatches(sdf.dtypes, rel.columns, rel.types)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) >= {"query_id", "doc_id", "hybrid", "hybrid_rank"}
    assert all(0.0 <= r["hybrid"] <= 1.0 for r in rows)
