import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LLM = tuple(n for n in entry.queries() if n.startswith("op") or n == "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    norm = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)
    return sorted((tuple(map(norm, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n not in LLM))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - set(LLM)))
def test_query_runs(spark, name):
    """Every row is made; what the rows are is tested with the operators."""
    rows = entry.queries()[name](spark, SF).collect()
    assert rows
    assert len(rows[0]) >= 2


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
