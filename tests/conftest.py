import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def normal(df):
    """Rows as sorted strings, floats at six decimals, missing values alike."""
    import pandas as pd

    def text(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return "null"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x):.6f}"
        return str(x)

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        ours, theirs = query(spark, DATA).toPandas(), duck.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert normal(ours) == normal(theirs)
        return len(ours)

    return check
