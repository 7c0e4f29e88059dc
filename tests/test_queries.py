"""Every query of the library against its DuckDB SQL: names, types and rows."""

import pytest

from terrace import catalog
from tests.compare import duck, kinds_of, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    own = rows(df.columns, df.collect())
    assert own
    if name in catalog.ORACLES:
        found = duck(sf_dir).execute(catalog.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert kinds_of(df) == {c[0]: str(c[1]) for c in found.description}
        assert own == rows(columns, found.fetchall())
