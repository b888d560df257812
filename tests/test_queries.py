"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import pytest

from shelfmark.plans import catalogue, problems
from tests.conftest import DATA
from tests.oracle import both

CASES = [(n, m) for m in (catalogue, problems) for n in m.oracle_sql()]


@pytest.mark.parametrize(("name", "module"), CASES, ids=[n for n, _ in CASES])
def test_query_equals_sql(spark, name, module):
    ours, theirs = both(spark, name, module.queries()[name], module.oracle_sql()[name], DATA)
    assert ours == theirs


def test_every_query_has_sql_or_is_named_here():
    assert {n for m in (catalogue, problems) for n in m.queries()} == {n for n, _ in CASES}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_without_the_subpackage():
    from pathlib import Path

    import shelfmark

    for p in Path(shelfmark.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "shelfmark.llm" not in p.read_text(), p
