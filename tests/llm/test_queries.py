"""Every registered query that has SQL, against it."""

import pytest

from anamnesis.llm import registry
from oracle_check import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001").startswith("ok")


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
