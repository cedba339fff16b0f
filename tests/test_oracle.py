"""Registered queries against independent SQL on the same tables.

By default one query per family; TEST_ALL_QUERIES=1 runs every query with SQL.
"""

import os

import duckdb
import pytest

from basketry.plans import oracle
from basketry.plans.all_queries import QUERIES, runnable
from basketry.sources.bindings import BASE_TABLES
from tests.conftest import SF_DIR

FAMILIES = [
    "clean_city", "clean_price", "dedupe_merchants", "impute_median", "cleaning_summary", "keyword_matches", "enrich_menu",
    "smoothed_rating", "menu_rank", "price_band", "capping_summary", "step_state", "cond_prob_edges", "degree_stats",
    "negative_samples", "next_item_affinity", "merchant_affinity", "time_split", "item_index", "user_rfm", "fit_scalers",
    "training_set", "fix_zero_embeddings", "similar_items_indexed", "cart_vector", "recommend_cooc", "metrics_table", "policy_lift", "auc_exact",
    "conditional_attach", "price_outliers", "random_walk_first_step", "stream_attach_rate", "stream_sessions",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def as_sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(row[i] if not isinstance(row[i], float) else round(row[i], 9) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def test_every_statement_belongs_to_a_query():
    assert set(oracle.statements()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.statements()) if os.environ.get("TEST_ALL_QUERIES") else FAMILIES)
def test_query_equals_sql(spark, duck, name):
    result = runnable()[name](spark, SF_DIR)
    cursor = duck.execute(oracle.statements()[name])
    expected_columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(expected_columns)
    expected = as_sorted(expected_columns, cursor.fetchall())
    assert as_sorted(result.columns, [tuple(r) for r in result.collect()]) == expected
    assert expected
