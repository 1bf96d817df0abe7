import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare():
    """compare(spark rows, DuckDB SQL, sf_dir): both as sorted text rows."""
    import glob

    import duckdb
    import pandas as pd

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "~"
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted([text(v) for v in r] for r in frame.itertuples(index=False))

    def run(df, sql, sf_dir):
        c = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        want, got = c.sql(sql).df(), df.toPandas()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got) == rows(want)

    return run
