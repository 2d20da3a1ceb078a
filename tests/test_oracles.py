import duckdb
import pytest

from footing.plans.queries import ORACLE_SQL, QUERIES
from footing.tables import release

SCALES = ("sf0.001", "sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for sf in SCALES:
        con.execute(f'CREATE SCHEMA "{sf}"')
        for t in TABLES:
            con.execute(f"CREATE VIEW \"{sf}\".{t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    return con


CASES = [(n, sf) for n in sorted(QUERIES) for sf in SCALES]


@pytest.mark.parametrize(("name", "sf"), CASES)
def test_query_matches_sql(name, sf, spark, duck):
    duck.execute(f'USE "{sf}"')
    got = QUERIES[name](spark, f"/root/testdata/{sf}")
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    release()  # what the query wrote
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        pick = [names.index(c) for c in columns]
        assert rows == sorted((tuple(r[k] for k in pick) for r in want.fetchall()), key=str)
