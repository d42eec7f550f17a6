"""Every registered query against its SQL."""

import pytest

from tests.util import assert_same
from threadlake import operators  # noqa: F401
from threadlake.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert_same(df, duck.execute(SQL[name]))
    else:
        assert df.count() > 0 or name == "r07_backfill"  # every fact of the smallest table has a vector
