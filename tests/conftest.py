import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def plain(x):
    """A value as both engines print it."""
    if x is None or (isinstance(x, float) and x != x):
        return "None"
    return f"{x:.3f}" if isinstance(x, float) else str(x)


def same_rows(spark, query, sql, sf_dir=SMALL):
    """Assert that a Spark query and its DuckDB oracle give equal columns and rows."""
    import duckdb

    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = c.execute(sql)
    order = [[d[0] for d in cur.description].index(x) for x in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert len(order) == len(cur.description or order)
    assert got == want
    return got
