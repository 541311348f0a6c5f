"""Every query beside its SQL oracle at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in ORACLES if not n.startswith("op"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def small_tables(spark):
    """Settings for a few thousand rows: compiling a stage would take longer than running it."""
    own = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall())
    assert compare(got, want) in ("exact", "close")


def test_entry(spark):
    assert entry.entry(spark).count() == 8
