import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    """The tables as views, and rows of a statement with sorted columns."""
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


@pytest.fixture(scope="session")
def same_rows(spark, data, duck):
    def check(query, statement):
        df = query(spark, data)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        result = duck.execute(statement)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert got == wanted

    return check
