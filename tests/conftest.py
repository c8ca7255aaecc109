import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(spark_df, sql, sf_dir):
    """Compare a DataFrame with DuckDB's answer over the same tables."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    want = con.sql(sql).df()
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted((tuple("" if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)

    assert rows(got) == rows(want)
