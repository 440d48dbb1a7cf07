from __future__ import annotations

import pytest

from graphmill.llm.queries import oracle_sql, queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    assert same(queries()[name](spark, sf_dir), duck.sql(oracle_sql()[name])) == ""


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
