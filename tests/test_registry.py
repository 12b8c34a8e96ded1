import pytest

from fleet.check import compare, duckdb_over, load_all
from fleet.registry import ORACLES, QUERIES

load_all()
SF = "/root/testdata/sf0.001"
FAST = "freshness_fleet failure_top_errors naming_coherence volatility_class content_hash diff_columns mask_columns flatten_json fuzzy_field_match route_sync_events snapshot_pairs drift_lifecycle".split()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, duckdb_over(SF), SF, name)
    assert ok, note
