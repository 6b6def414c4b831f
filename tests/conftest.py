import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same_rows(got, want) -> None:
    """Two pandas frames hold the same rows in any order, columns by name."""

    def show(v):
        if v is None or v is not None and not hasattr(v, "__len__") and v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    def plain(df):
        df = df[sorted(df)].map(show)
        return df.sort_values(list(df)).reset_index(drop=True)

    assert sorted(got) == sorted(want)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(3).to_dict("records"), b[(a != b).any(axis=1)].head(3).to_dict("records"))
