"""Every registered query against its SQL twin; the others must give rows."""

import pytest

from prizelens.queries import ORACLES, QUERIES, forecasts
from tests.oracle import compare, connect

@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    """Results that have a closed form do not depend on the number of trees."""
    monkeypatch.setattr(forecasts, "TREES", 12)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], sf) == ""
    else:
        assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_every_survey_section_has_queries():
    starts = {n.split("_")[0] for n in QUERIES}
    expected = (
        [f"s{i:02d}" for i in range(1, 16)]
        + [f"p{i:02d}" for i in range(1, 39)]
        + [f"q{i:02d}" for i in range(1, 27)]
        + [f"j{i:02d}" for i in range(1, 12)]
        + [f"a{i:02d}" for i in range(1, 44)]
        + [f"w{i:02d}" for i in range(1, 15)]
        + [f"t{i:02d}" for i in range(1, 9)]
        + [f"m{i:02d}" for i in range(1, 11)]
        + [f"x{i:02d}" for i in range(1, 14)]
        + ["r1", "o1", "o2", "o3", "o4", "o5"]
    )
    assert sorted(set(expected) - starts) == []
