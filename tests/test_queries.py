"""Every registered query against the SQL that it must equal."""

import subprocess
import sys

import pytest

from palimpsest import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_imports_nothing_from_llm():
    code = "import sys, palimpsest.queries, palimpsest.sources.store, palimpsest.streaming.ingest; assert not any(m.startswith('palimpsest.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
