"""The driver's contract, and a sample of its queries against DuckDB."""

import pytest

import __spark_entry__ as entry
from checks.run import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ("parse_web_access", "parse_auth", "enrich_domain", "match_rules", "cooldown", "corr_account", "downsample_snapshots",
          "merge_occurrences", "apply_incident_actions", "retention_effective", "stream_cooldown", "stream_dedup_ids")


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) > 130 and set(oracle) <= set(queries)
    from checks import all_queries

    assert set(all_queries()[0]) == set(all_queries()[1]) and set(all_queries()[0]) <= set(queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"host", "fingerprint", "rule_id", "occurrence_count"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_duckdb(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == oracle_rows(SF, entry.oracle_sql()[name])
    assert got[1]
