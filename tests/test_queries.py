"""Every registered query of the library against its DuckDB twin, or its own invariant."""

import math

import duckdb
import pytest

from seriesloom.plans import QUERIES, SQL

from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
    assert [KINDS[t] for _, t in df.select(*cols).dtypes] == [str(rel.types[names.index(c)]) for c in cols]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_paired_tests(spark):
    rows = {r["arm"]: r for r in QUERIES["paired_tests"](spark, SF).collect()}
    facts = duckdb.sql(f"select l_returnflag, (l_discount >= 0.05)::int, (l_tax >= 0.04)::int from '{SF}/lineitem.parquet'").fetchall()
    for arm, r in rows.items():
        d = [a - b for f, a, b in facts if f == arm]
        m = sum(d) / len(d)
        sd = math.sqrt(sum((x - m) ** 2 for x in d) / (len(d) - 1))
        assert r["p_z"] == pytest.approx(math.erfc(abs(m / (sd / math.sqrt(len(d)))) / math.sqrt(2)), abs=2e-6)
        b, c = d.count(1), d.count(-1)
        assert r["p_mcnemar"] == pytest.approx(math.erfc(abs(b - c) / math.sqrt(b + c) / math.sqrt(2)), abs=2e-6)
        assert 0 <= r["p_t"] <= 1 and abs(r["p_t"] - r["p_z"]) < 0.01
