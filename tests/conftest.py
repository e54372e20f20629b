import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegate.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Rows of a query and of its SQL, with columns by name and values as text."""
    import decimal
    import numbers

    import pandas as pd

    def text(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        return repr(float(x)) if isinstance(x, (bool, numbers.Number, decimal.Decimal)) or type(x).__module__ == "numpy" else str(x)

    def rows(pdf):
        return sorted(tuple(map(text, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))

    def run(query, sql):
        got, want = query(spark, str(DATA)).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return run
