import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def canonical(rows):
    """Rows as sorted texts, floats to six digits."""
    import math

    def v(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(v, x)) + "]"
        return repr(x)

    return sorted("|".join(map(v, r)) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Holds a query against its SQL."""

    def check(run, sql):
        df = run(spark, sf_dir)
        names = sorted(df.columns)
        rel = duck.sql(sql)
        assert names == sorted(rel.columns)
        left = canonical([tuple(r) for r in df.select(*names).collect()])
        right = canonical(rel.select(*[f'"{c}"' for c in names]).fetchall())
        assert left == right

    return check
