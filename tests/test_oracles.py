"""Every query with an oracle, compared row by row on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomspark.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
# the rest of the oracles is compared by the driver; these cover each family
NAMES = [n for n in ORACLES if not n.startswith(("rule_", "predicate_")) or n in ("rule_read_only_table", "rule_dead_table", "rule_raw_sql_sink", "predicate_combinators", "predicate_no_incoming", "predicate_property_missing")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted([tuple(round(float(v), 4) if isinstance(v, float) else str(v) for v in row) for row in rows])


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    got = [tuple(row[c] for c in columns) for row in found.collect()]
    assert len(got) == len(expected)
    for a, b in zip(plain(got), plain(expected)):
        assert all(x == y or abs(float(x) - float(y)) < 1e-3 for x, y in zip(a, b))
