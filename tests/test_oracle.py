"""Every core query that has SQL against it on the smallest tables; those without are held against plain Python elsewhere."""

import compare
import pytest

from strandloom.plans import registry

SQL = registry.oracle_sql()
CON = {}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    con = CON.setdefault(sf_dir, compare.connect(sf_dir))
    assert compare.compare(df, con.sql(SQL[name])) == ""


#: Where the queries without SQL are tested.
PLAIN = {
    "test_problems": {"p1_found", "p1_unified", "p5_found"},
    "test_whole": {"hops", "call_paths", "taint"},
    "test_plain": {"rate_limit", "stream_rate_limit", "merkle_root", "chunk_paragraphs", "chunk_windows", "chunk_code", "chunk_json", "chunk_spans", "mmr_extract", "mmr_near", "kv_compact", "budget_skip", "sliding_dedup", "check_and_add", "snippet_pack"},
}


def test_every_query_is_tested():
    assert set().union(*PLAIN.values()) == set(registry.queries()) - set(SQL)


def test_sql_has_queries():
    assert set(SQL) <= set(registry.queries())


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and callable(e.entry)
