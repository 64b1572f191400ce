"""Every registered query against its DuckDB oracle (the driver's gate, run
here on the smallest scale so the suite stays quick)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

from .conftest import SF_SMALL

SLOW = {"model_eval_lang", "near_dup_documents", "build_dataset_sizes", "induced_label_space"}
NAMES = sorted(k for k in E.oracle_sql() if k not in SLOW)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert digest(s_rows, sdf.columns)[0] == digest(o_rows, o_cols)[0]


def test_every_query_is_registered_with_a_callable():
    qs = E.queries()
    assert len(qs) >= 50
    missing = set(E.oracle_sql()) - set(qs)
    assert not missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["intent", "count", "mean_confidence"]
