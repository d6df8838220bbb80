"""A spread of registered queries against their SQL on the smallest data; tools/check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import TABLES, compare, rows_of

NAMES = (
    "drop_rate_by_transition", "normalise_offers", "dedup_latest", "batch_validation", "other_airline_context",
    "same_airline_alternative", "peer_anchor", "hierarchical_anchor", "schedule_history_cross_era", "template_history",
    "exact_next_pairs", "nearest_lower_aux", "asof_target_market", "event_registry", "choice_set", "horizon_interpolation",
    "stratified_head", "outer_split", "fold_tags", "classification_metrics", "pairwise_concordance", "policy_metrics",
    "conformal_mondrian", "horizon_coverage", "oracle_ceiling", "composition_shift", "slice_metrics", "stream_upsert",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, cursor.fetchall())
    assert len(got) == len(want) > 0
    assert compare(got, want)[0] == 0
