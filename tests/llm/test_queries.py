"""The dealt queries at the smallest scale: against SQL where there is any, else for rows."""

import pytest

from prizelens.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], sf) == ""
    else:
        rows = QUERIES[name](spark, sf).count()
        table = {"op3": "pages", "op5": "pages", "op11": "conversations"}.get(name.split("_")[0], "documents")
        given = spark.read.parquet(f"{sf}/{table}.parquet")
        if name.startswith("op11"):
            assert rows == given.select("conv_id").distinct().count()
        elif name.startswith("op13"):
            assert rows >= given.count()
        else:
            assert rows == given.count()
