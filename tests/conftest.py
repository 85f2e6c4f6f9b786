from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{own}/checkpoints").config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows(spark):
    """Compares a query with its SQL in DuckDB over the smallest tables."""
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(SMALL):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")

    def plain(v):
        if v is None or v != v:
            return None
        if hasattr(v, "as_tuple") or isinstance(v, float):
            return round(float(v), 6)
        return v if isinstance(v, (bool, int, str)) else str(v)

    def check(query, sql):
        got = query(spark, SMALL)
        columns = sorted(got.columns)
        want = db.sql(sql)
        assert sorted(want.columns) == columns
        sort = lambda rows: sorted([tuple(plain(x) for x in r) for r in rows], key=str)
        a = sort(got.select(columns).collect())
        assert a == sort(want.select(*columns).fetchall())
        return len(a)

    return check
