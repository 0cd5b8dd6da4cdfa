from __future__ import annotations

import pytest
from catalogs import DATA

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["vec_id", "pos", "token"] and df.count() > 0
