"""Every query with an oracle gives the oracle's rows."""

from __future__ import annotations

import pytest

from graphmill.plans import ORACLES, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
