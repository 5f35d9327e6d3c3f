import os

import duckdb
import pytest

from skarn.llm import catalogue

TABLES = "documents conversations labels benchmark pages embeddings".split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    made = catalogue.queries()[name](spark, sf_dir)
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    expected = base.execute(catalogue.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert sorted(made.columns) == sorted(expected.columns)
    columns = sorted(made.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in made.collect()))) == sorted(map(str, (tuple(r) for r in expected[columns].astype(object).itertuples(index=False))))
