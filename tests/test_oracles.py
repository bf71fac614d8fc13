"""Every query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_module

QUERIES = {name: query for name, query in entry_module.queries().items() if name not in entry_module.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry_module.oracle_sql().items() if name not in entry_module.LLM_ORACLES}


TYPES = {
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def _rows(rows):
    return sorted(
        (tuple(0.0 if v == 0 and isinstance(v, float) else v for v in row) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = _rows(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    kinds = {row[0]: row[1] for row in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == _rows(tuple(row[i] for i in order) for row in result.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["timestamp", "count"]
    assert df.count() == 721
