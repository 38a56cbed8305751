"""The registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.oracle import compare, connect

# One of each family here; all of them run with `python tests/oracle.py <folder>`.
KEYS = [
    "ag01_profile_orders", "ag07_audit_tables", "ag08_validate_table", "wi08_samples", "cl17_multi_target",
    "cl19_rule_clean", "wi09_running_last", "co05_report", "co07_apply", "jo01_orphans", "sc02_drift", "wi03_trend",
    "in03_fk", "in02_chi2", "gr10_impact", "gr14_page_rank", "io12_parse_payloads", "st02_histogram",
    "io02_csv_quoted", "io03_json_array", "io08_row_sample", "io09_ingest_lines", "io09_same_name", "gr05_long_chain", "jo06_traversal_join",
]


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, sf_dir, key):
    assert compare(spark, connect(sf_dir), sf_dir, key) == []


def test_entry(spark, sf_dir):
    assert E.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
