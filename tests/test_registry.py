"""A cross-section of the registered queries against DuckDB; ``tools/check.py`` runs all of them."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tools.check import canonical

NAMES = [
    "union_sources", "route_by_label", "drop_blank", "length_bounds", "accepted_submissions", "cap_per_problem", "pair_by_problem",
    "first_member", "value_counts", "distinct_groups", "lexical_features_documents", "feature_matrix", "perplexity_features",
    "balance_classes", "stratified_folds", "class_moments", "mann_whitney_lineitem", "wasserstein", "exact_median", "anova_f",
    "class_report", "baseline_covariance", "hbd_score", "score_auroc", "nearest_class", "incremental_features",
]


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, db, name):
    df = entry.queries()[name](spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    result = db.sql(entry.oracle_sql()[name])
    want = pd.DataFrame(result.fetchall(), columns=result.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
