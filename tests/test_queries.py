"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import os
from pathlib import Path

import duckdb
import pytest

from stratavec.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def same(ours, theirs):
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda d: d[columns].astype(object).where(d[columns].notna(), None).map(lambda v: v + 0.0 if isinstance(v, float) else v).astype(str).sort_values(columns).values.tolist()
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, con, name):
    same(plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "metric", "least"), [("lsh_knn", "euclidean", 0.87), ("lsh_knn_multiprobe", "euclidean", 0.87), ("lsh_knn_cosine_multiprobe", "cosine", 0.87), ("coarse_cells_exact", "euclidean", 0.9)])
def test_recall_of_the_search_queries(spark, name, metric, least):
    """Against exact search, here on 25 queries; README has the figures of the larger tables."""
    truth = plans.QUERIES[f"knn_{metric}"](spark, SF)
    found = plans.QUERIES[name](spark, SF)
    assert plans.ann.overlap(truth, found, plans.K).first().recall >= least


@pytest.mark.parametrize("name", ["lsh_knn", "lsh_knn_cosine_multiprobe", "lsh_knn_multiprobe", "lsh_recall"])
def test_search_queries_make_no_row_of_a_candidate(spark, name):
    """Candidates meet in blocks; as rows, they are most pairs of a query and a point."""
    assert "bucket_key" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
