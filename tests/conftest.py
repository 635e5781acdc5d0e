import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck, tmp_path_factory):
    """Run a query and its SQL: equal rows, column names and types."""
    out = tmp_path_factory.mktemp("results")

    def check(name, query, sql):
        path = f"{out}/{name}"
        query(spark, sf_dir).write.parquet(path)
        found = f"SELECT * FROM read_parquet('{path}/*.parquet')"
        kinds = [sorted(r[:2] for r in duck.execute(f"DESCRIBE {x}").fetchall()) for x in (sql, found)]
        assert kinds[0] == kinds[1]
        names = ", ".join(f'"{n}"' for n, _ in kinds[0])
        rows = [sorted(map(repr, duck.execute(f"SELECT {names} FROM ({x})").fetchall())) for x in (sql, found)]
        assert rows[0] == rows[1]

    return check
