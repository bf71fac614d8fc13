"""Every query of the package: against its SQL where there is one, else against a plain version."""

import pytest

from gatelens.llm.oracles import ORACLES
from gatelens.llm.queries import QUERIES


def _plain(value):
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        return value.asDict()
    return value


def _rows(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = _rows(tuple(row[i] for i in order) for row in result.fetchall())
    assert _rows(tuple(r) for r in df.select(*columns).collect()) == expected
