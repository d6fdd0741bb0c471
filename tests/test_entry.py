import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables are not here")
def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 500 and sum(r["flagged"] for r in rows) == 70
