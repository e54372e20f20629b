"""An embedded database on a cluster: executors are processes of their own and cannot open the driver's database."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

REPO = Path(__file__).resolve().parents[1]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RUN = """
import sys
import duckdb
sys.path.insert(0, {repo!r})
from tidegate.queries import connectors
from tidegate.session import build_session
spark = build_session("embedded", "local-cluster[2,1,1024]", **{{"spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "3", "spark.checkpoint.dir": "file://{at}/shared", "spark.sql.files.maxPartitionBytes": "64k"}})
connectors.QUERIES[{name!r}](spark, {data!r}).write.parquet("{at}/out")
con = duckdb.connect()
con.execute("CREATE VIEW orders AS SELECT * FROM '{data}/orders.parquet'")
got, want = con.execute("SELECT * FROM '{at}/out/*.parquet' ORDER BY ALL").fetchall(), con.execute("SELECT * FROM (" + connectors.ORACLE[{name!r}] + ") ORDER BY ALL").fetchall()
assert want and got == want, (len(got), len(want))
"""


def on_cluster(name: str, tmp_path: Path) -> None:
    """The query on two executors equals its SQL."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)  # where executors log
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path)}
    script = RUN.format(repo=str(REPO), at=tmp_path, name=name, data=DATA)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("name", ["jdbc_insert", "jdbc_truncate_insert", "jdbc_upsert"])
def test_matches_sql(name, tmp_path):
    on_cluster(name, tmp_path)
